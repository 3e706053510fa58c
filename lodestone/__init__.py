"""Spark-native analytics over documents, pages, tables and event logs."""
