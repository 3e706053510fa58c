"""Exact dedup: a two-pass Bloom filter finds the hashes that may repeat; only those rows shuffle.

DataFrame functions only. The text is read once, into a table of (id, SHA-256). Pass one sets two bits
a row in a bit table of 2**bits cells and keeps the cells hit at least twice, packed 64 to a word. Pass two
probes that filter: a row with a cell hit once is unique and goes straight to the result; the others meet by hash.

The packed filter is broadcast: it holds at most 2**MAX_BITS / 64 rows of two longs whatever the input is (2**19 rows, about 20 MB). Larger tables are
parted by hash into ranges of about 2**MAX_BITS / CELLS_PER_ROW rows, each with a filter of its own that is built and probed by itself, one after the other, so
the share of unique rows that pass stays the same; equal texts are in the same range. From MAX_RANGES ranges on (5 * 10**8 rows) ranges grow,
and more unique rows reach the shuffle, which costs time and no correctness. Hashes with over 1/2048 of the rows (fewer than 2048 of them)
are broadcast too, so that no task of the join gets a large group of copies.

Defined results: null text counts as empty; equal texts keep the largest id, and rows that repeat an id
with the same text share its verdict; a null id is smaller than any other; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, written

MAX_BITS = 25
CELLS_PER_ROW = 16
MAX_RANGES = 256
HOT_GROUPS = 2048


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sha) of the normalised text: A-Z lower-cased, null as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.sha2(ascii_lower(text).cast("binary"), 256).alias("sha"))


def ranges_of(rows: int) -> int:
    return max(1, min(MAX_RANGES, math.ceil(rows * CELLS_PER_ROW / (1 << MAX_BITS))))


def marked_rows(fp: DataFrame, rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """fp with the flag maybe, range by range, and the tables that hold it."""
    n = ranges_of(rows)
    if n == 1:
        cells = with_cells(fp, filter_bits(rows))
        parts = [written(maybe_repeated(cells, repeated_cells(cells)), "exact-marked")]
    else:
        ranged = written(fp.withColumn("range", F.pmod(F.xxhash64("sha", F.lit(1)), F.lit(n)).cast("int")), "exact-ranges", ["range"])
        parts = []
        for r in range(n):
            cells = with_cells(ranged.where(F.col("range") == r).select("id", "sha"), filter_bits(math.ceil(rows / n)))
            parts.append(written(maybe_repeated(cells, repeated_cells(cells)), "exact-marked"))
        discard(ranged)
    return reduce(DataFrame.unionByName, parts), parts


def filter_bits(rows: int) -> int:
    return min(MAX_BITS, max(10, math.ceil(math.log2(max(1, rows) * CELLS_PER_ROW))))


def with_cells(fp: DataFrame, bits: int) -> DataFrame:
    """Two cells a row, from the two halves of one 64-bit hash."""
    mask, h = (1 << bits) - 1, F.xxhash64("sha")
    return fp.withColumn("c1", h.bitwiseAND(mask)).withColumn("c2", F.shiftrightunsigned(h, 32).bitwiseAND(mask))


def repeated_cells(cells: DataFrame) -> DataFrame:
    """Pass one: (word, mask) of the cells hit at least twice. A task sends each of its cells once."""
    hit = cells.select(F.explode(F.array("c1", "c2")).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return hit.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))").alias("mask"))


def maybe_repeated(cells: DataFrame, words: DataFrame) -> DataFrame:
    """Pass two: adds the flag maybe; false proves that the hash occurs once."""
    out = cells
    for i in ("1", "2"):
        side = F.broadcast(words.select(F.col("word").alias(f"w{i}"), F.col("mask").alias(f"m{i}")))
        out = out.join(side, F.shiftright(F.col(f"c{i}"), 6) == F.col(f"w{i}"), "left")
    bit = [F.expr(f"coalesce(shiftright(m{i}, cast(c{i} & 63 as int)) & 1L, 0L) = 1L") for i in (1, 2)]
    return out.select("id", "sha", (bit[0] & bit[1]).alias("maybe"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of docs."""
    fp = written(fingerprints(docs, id_col, text_col), "exact-hashes")
    n = fp.count()
    marked, parts = marked_rows(fp, n)
    discard(fp)
    alone = marked.where("not maybe").select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    again = marked.where("maybe").select("id", "sha")
    groups = written(again.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "exact-groups")
    limit = max(1, n // HOT_GROUPS)
    hot = F.broadcast(groups.where(F.col("group_size") > limit))
    cold = groups.where(F.col("group_size") <= limit)
    large = again.join(hot, "sha")
    small = again.join(F.broadcast(groups.where(F.col("group_size") > limit).select("sha")), "sha", "left_anti").join(cold, "sha")
    out = alone.unionByName(large).unionByName(small)
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )
