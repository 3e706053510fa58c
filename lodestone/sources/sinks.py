"""Writers. Partitions are replaced whole, so a repeated run leaves the same files."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def bundle(rows: DataFrame, key: str) -> DataFrame:
    """(key, content): the members (key, member, content) of each key as one archive, in order of their names. A key's members are one unit; equal members give equal bytes."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for member, content in sorted(zip(pdf["member"], pdf["content"], strict=True), key=lambda x: x[0]):
                z.writestr(zipfile.ZipInfo(member, (1980, 1, 1, 0, 0, 0)), bytes(content or b""))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [out.getvalue()]})

    return rows.select(key, "member", "content").groupBy(key).applyInPandas(pack, f"{key} {rows.schema[key].dataType.simpleString()}, content binary")


def replace_documents(rows: DataFrame, path: str, key: str = "document_id") -> None:
    """Delete-then-insert by document: only partitions of documents in rows change."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def without_documents(table: DataFrame, gone: DataFrame, key: str = "document_id") -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def json_artifacts(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_events(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def export_name(title: Column, journal: Column, published: Column) -> Column:
    """slug_of_title__slug_of_journal_year"""
    year = F.coalesce(F.nullif(F.regexp_extract(published, r"((?:19|20)\d{2})", 1), F.lit("")), F.lit("undated"))
    return F.concat_ws("_", X.slug(title, 8), F.lit(""), X.slug(journal, 5), year)


def markdown(items: DataFrame, key: str, title: Column | str = "title") -> DataFrame:
    """(key, markdown): sections in order, at most 30 items of at most 3 references each, as the report shows them."""
    w = Window.partitionBy(key, "section").orderBy("ord")
    rows = items.withColumn("__n", F.row_number().over(w)).where("__n <= 30")
    line = F.concat(F.lit("- "), "statement", F.when(F.size("refs") > 0, F.concat(F.lit(" ["), F.array_join(F.slice("refs", 1, 3), ", "), F.lit("]"))).otherwise(""))
    sections = rows.groupBy(key, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"), F.min("section_ord").alias("o"))
    return sections.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "section", "body"))), lambda x: F.concat(F.lit("## "), F.initcap(x["section"]), F.lit("\n"), x["body"])), "\n\n").alias("markdown"))


def metric_lines(metrics: DataFrame, name: str, value: str) -> DataFrame:
    """metrics with the line of a markdown listing."""
    return metrics.withColumn("line", F.concat(F.lit("- "), F.col(name), F.lit(": "), F.col(value).cast("string"), F.lit(" items")))


def html(markdown_rows: DataFrame, key: str) -> DataFrame:
    """(key, html): the same, escaped, headings as h2 and items as li."""
    body = F.regexp_replace(F.regexp_replace(X.html_escape(F.col("markdown")), r"(?m)^## (.*)$", "<h2>$1</h2>"), r"(?m)^- (.*)$", "<li>$1</li>")
    return markdown_rows.select(key, F.concat(F.lit("<!doctype html><body>"), body, F.lit("</body>")).alias("html"))


def legend_map(rows: DataFrame, key: str) -> DataFrame:
    """(key, json) maps from figure token to caption."""
    return rows.groupBy(key).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "caption"))))).alias("json"))


def prune_artifacts(files: DataFrame, keep: int) -> DataFrame:
    """Files (family, stamp, path) to delete: all but the newest `keep` stamps of a family."""
    w = Window.partitionBy("family").orderBy(F.desc("stamp"))
    return files.withColumn("__r", F.dense_rank().over(w)).where(F.col("__r") > keep).drop("__r")


def main_fallback(pages: DataFrame, text_col: str = "text", least: int = 1200) -> DataFrame:
    """Pages that may stand in for a missing main document."""
    return pages.where(F.length(text_col) >= least)
