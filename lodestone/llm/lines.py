"""Line dedup: levelled sorted runs of line hashes; each batch merge-anti-joins the runs and adds its own.

DataFrame functions only. A line's key is its 128-bit hash after stripping blanks at both ends and lower-casing
A-Z. Documents come in batches of about equal size, from the largest ids to the smallest. A batch is aggregated to its keys, with the number
of documents and the largest id that hold each; a merge-anti-join with the runs leaves the keys that no earlier batch has
seen, and these, with their largest id as owner, are the batch's own run. So runs share no key, the first batch to hold a line
owns it, and FANOUT runs of a level are compacted by a plain union into one of the next level. Counts of documents go to a tally a batch. Runs and
tallies are tables in the shared folder, bucketed and sorted by key with as many buckets as there are shuffle partitions, so that joins and
compaction need no exchange.

A line is dropped if its key has at least min_chars code points, occurs in at least min_docs documents,
and this is not the owner. Keys in over 1/4096 of the documents' lines (fewer than 4096 keys) are broadcast, the rest
meet by shuffle. Positions, not texts, are gathered for a row; texts shuffle once, to meet them.

Defined results: null or empty text is one empty line and stays; blank and short lines always stay; rows that
repeat an id count as one document, and each loses lines by its own text; documents with a null id own nothing before others (a null id
is below any other); an empty table gives no rows; other columns are carried by drop_repeated_lines and ignored by the digest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bucketed, discard, shuffle_parts, written

BLANKS = " \t\n\x0b\x0c\r"
FANOUT = 3
BATCHES = 4
HOT_KEYS = 4096


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The normalised line; its length decides whether it counts."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def row_hash(text: Column) -> Column:
    """With the id, tells rows apart: rows that are equal in both lose the same lines."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, row, pos, key) of every line that counts, read from the whole text."""
    lines = docs.select(F.col(id_col).alias("id"), row_hash(F.col(text_col)).alias("row"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    # a line of fewer bytes has fewer code points
    lines = lines.where(F.octet_length("line") >= min_chars).select("id", "row", "pos", line_key(F.col("line")).alias("norm"))
    return lines.where(F.char_length("norm") >= min_chars).select("id", "row", "pos", F.unhex(F.md5(F.col("norm").cast("binary"))).alias("key"))


class LineRuns:
    """The levelled store. Runs hold (key, owner), each key once in all of them; tallies hold (key, docs) a batch."""

    def __init__(self, buckets: int, fanout: int = FANOUT):
        self.buckets, self.fanout, self.levels, self.tallies = buckets, fanout, [], []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """Takes a batch of (key, id); its own run holds the keys that are new, with their largest id in the batch."""
        own = batch.groupBy("key", "id").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("owner"))
        tally = bucketed(own, "line-tally", "key", self.buckets)
        self.tallies.append(tally)
        new = tally.select("key", "owner")
        for run in self.runs():
            new = new.join(run.select("key").hint("merge"), "key", "left_anti")
        self._place(bucketed(new, "line-run", "key", self.buckets), 0)

    def _place(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = bucketed(reduce(DataFrame.unionByName, old), "line-run", "key", self.buckets)
            discard(*old)
            self._place(merged, level + 1)

    def repeated(self, min_docs: int) -> DataFrame:
        """(key, docs, owner) of the keys that so many documents hold."""
        # read as plain files: a group over a union of bucketed scans loses its exchange and so is wrong (Spark 4.1)
        counts = [t.sparkSession.read.schema(t.schema).parquet(t.scratch_path).select("key", "docs") for t in self.tallies]
        tally = reduce(DataFrame.unionByName, counts).groupBy("key").agg(F.sum("docs").alias("docs"))
        often = bucketed(tally.where(F.col("docs") >= min_docs), "line-often", "key", self.buckets)
        parts = [often.join(run.hint("merge"), "key") for run in self.runs()]
        out = written(reduce(DataFrame.unionByName, parts).select("key", "docs", "owner"), "line-repeated")
        discard(often)
        return out

    def close(self) -> None:
        discard(*self.tallies, *self.runs())


def batch_cuts(ids: DataFrame, batches: int) -> list:
    """Descending ids between batches of about equal size; none for ids without arithmetic."""
    if ids.schema["id"].dataType.typeName() not in ("long", "integer", "short", "byte"):
        return []
    found = ids.approxQuantile("id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    return sorted({int(x) for x in found}, reverse=True)


def dropped_positions(docs: DataFrame, id_col: str, text_col: str, min_chars: int = 20, min_docs: int = 3, batches: int = BATCHES) -> DataFrame:
    """(id, row, drops): ascending positions of the lines to drop, for rows that lose any."""
    hashed = written(line_hashes(docs, id_col, text_col, min_chars), "line-hashes")
    store, upper = LineRuns(shuffle_parts(docs.sparkSession)), None
    for cut in [*batch_cuts(docs.select(F.col(id_col).alias("id")), batches), None]:
        part = F.lit(True) if cut is None else F.col("id") > cut
        part = part if upper is None else part & (F.col("id") <= upper)
        part = F.coalesce(part, F.lit(True)) if cut is None else part  # a null id goes with the last batch
        store.add(hashed.where(part).select("key", "id"))
        upper = cut
    repeated = store.repeated(min_docs)
    store.close()
    limit = max(1, hashed.count() // HOT_KEYS)
    hot = F.broadcast(repeated.where(F.col("docs") > limit).select("key", "owner"))
    cold = repeated.where(F.col("docs") <= limit).select("key", "owner")
    of_hot = hashed.join(hot, "key")
    of_cold = hashed.join(F.broadcast(repeated.where(F.col("docs") > limit).select("key")), "key", "left_anti").join(cold, "key")
    hits = of_hot.unionByName(of_cold).where(~F.col("id").eqNullSafe(F.col("owner")))
    drops = written(hits.groupBy("id", "row").agg(F.sort_array(F.collect_set("pos")).alias("drops")), "line-drops")
    discard(hashed, repeated)
    return drops


def kept_lines(lines: Column, drops: Column) -> Column:
    """The lines between the ascending positions drops, in time linear in the lines."""
    none = F.array().cast("array<int>")
    drops = F.coalesce(drops, none)
    starts, ends = F.concat(F.array(F.lit(-1)), drops), F.concat(drops, F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 2, e - s - 1)))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = BATCHES) -> DataFrame:
    """docs with text_col rewritten, and n_lines and n_dropped added under the names __n_lines and __n_dropped."""
    docs = docs.drop("__id", "__row", "__drops", "__n_lines", "__n_dropped")
    drops = dropped_positions(docs, id_col, text_col, min_chars, min_docs, batches).select(F.col("id").alias("__id"), F.col("row").alias("__row"), F.col("drops").alias("__drops"))
    joined = docs.join(drops.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("__id")) & (row_hash(F.col(text_col)) == F.col("__row")), "left")
    lines = lines_of(F.col(text_col))
    cut = F.array_join(kept_lines(lines, F.col("__drops")), "\n")
    return joined.select(
        *[F.when(F.col("__drops").isNull(), F.col(text_col)).otherwise(cut).alias(text_col) if c == text_col else F.col(c) for c in docs.columns],
        F.size(lines).cast("long").alias("__n_lines"),
        F.coalesce(F.size("__drops"), F.lit(0)).cast("long").alias("__n_dropped"),
    )


def line_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    out = drop_repeated_lines(docs.select(id_col, text_col), id_col, text_col, **options)
    return out.select(
        id_col, F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
