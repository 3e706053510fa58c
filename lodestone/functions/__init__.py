"""Column functions: text, numbers, similarity, predicates. register() offers the scalar ones to SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> list[str]:
    """Temporary SQL functions for use in spark.sql; the bodies are built-in expressions, so they stay in the plan."""
    bodies = {
        "lode_clean": ("s STRING", "STRING", r"trim(regexp_replace(coalesce(s, ''), '(?U)\\s+', ' '))"),
        "lode_canonical": ("s STRING", "STRING", r"array_join(regexp_extract_all(lower(coalesce(s, '')), '([a-z0-9]+(?:\\.[0-9]+)?)', 1), ' ')"),
        "lode_slug": ("s STRING, n INT", "STRING", "array_join(slice(regexp_extract_all(lower(coalesce(s, '')), '([a-z0-9]+)', 1), 1, n), '_')"),
        "lode_clamp": ("x DOUBLE", "DOUBLE", "greatest(0D, least(1D, coalesce(x, 0D)))"),
        "lode_relative_difference": ("a DOUBLE, b DOUBLE", "DOUBLE", "abs(a - b) / greatest(abs(a), abs(b), 1e-6D)"),
    }
    for name, (parameters, kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return sorted(bodies)
