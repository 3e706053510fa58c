"""Corpus preparation: language ID, line dedup, near-dedup, benchmark decontamination, byte-level BPE.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents, and no stage samples or caps.
Nulls, empty and long texts, ties, repeated rows, empty tables and further columns (which all stages but the last carry along) have the results that
each stage states; tests/llm covers them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontam, langid, lines, neardup
from lodestone.llm.common import scratch, table, written


def _columns(docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns of documents, with n_chars brought up to date."""
    return docs.select(*[F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in names])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their best language's model accepts; null, empty and letterless texts go, equal texts share their fate; without labelled rows none is accepted."""
    model = langid.train(docs, ~langid.held_out())
    return langid.identify(docs, model).where("accepted").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a later document holds; null texts stay null, rows that repeat an id lose lines by their own text, rows without an id come before all others."""
    return _columns(lines.drop_repeated_lines(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the largest id of each class of near copies. Of rows that repeat that id the greatest (by its columns in order) stays; rows without an id all stay."""
    classes = written(neardup.near_classes(docs), "near-verdicts")
    kept = classes.where("kept and doc_id is not null").select(F.col("doc_id").alias("__kept"))
    # as many ids as documents: always a merge join, whatever a small table would allow
    stay = docs.join(kept.hint("merge"), docs["doc_id"] == kept["__kept"], "left_semi").select(*docs.columns)
    unnamed = docs.where("doc_id is null")
    rows, nameless = docs.count(), unnamed.count()
    if rows - nameless > classes.where("doc_id is not null").count():
        stay = stay.groupBy("doc_id").agg(F.max(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return stay.unionByName(unnamed) if nameless else stay


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; null texts and an empty benchmark drop nothing, repeated rows share their fate."""
    found = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size(decontam.SPANS) == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and of the bytes that decoding gives; a null text has none; columns of other names aren't carried."""
    return bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), keep_ids=True).drop("text")


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := scratch(spark, f"stage-{i}"))
        docs = spark.read.schema(out.schema).parquet(path)
    return docs


#: Language models, verified near copies and BPE are no SQL.
ORACLE_SQL = None
