"""Joins and lookups. No hints: sizes decide at run time."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import numbers as N
from ..functions import predicates as P
from ..functions import similarity as S
from ..functions import text as X


def look_up(rows: DataFrame, table: DataFrame, key: str, table_key: str, value: str, default: str) -> DataFrame:
    """rows with the looked-up value, or the default where there is none."""
    side = table.select(F.col(table_key).alias("__key"), F.col(value).alias("__value"))
    return rows.join(side, F.col(key) == F.col("__key"), "left").withColumn(value, F.coalesce("__value", F.lit(default))).drop("__key", "__value")


def related_pairs(claims: DataFrame, packets: DataFrame, group: str, numeric: bool = False) -> DataFrame:
    """(group, claim_id, packet_id) that share a reference, named or in the statement; with numeric also those that both have a value.

    claims: (group, claim_id, refs, said_refs, value); packets: (group, packet_id, refs, said_refs, value). References meet by hash,
    never all by all; the numeric branch pairs what a group holds and is for groups of a document's size.
    """
    pairs = []
    for refs in ("refs", "said_refs"):
        left = claims.select(group, "claim_id", F.explode(F.array_distinct(refs)).alias("ref"))
        right = packets.select(group, "packet_id", F.explode(F.array_distinct(refs)).alias("ref"))
        pairs.append(left.join(right, [group, "ref"]).select(group, "claim_id", "packet_id"))
    out = pairs[0].union(pairs[1])
    if numeric:
        out = out.union(claims.where("value is not null").select(group, "claim_id").join(packets.where("value is not null").select(group, "packet_id"), group))
    return out.distinct()


def tone(rows: DataFrame) -> Column:
    """The polarities of a row's text: its column tone, where they are known already."""
    return F.col("tone") if "tone" in rows.columns else P.polarities(F.col("text"))


def value_relations(claims: DataFrame, packets: DataFrame, group: str, limit: float = 0.35) -> DataFrame:
    """(group, claim_id, conflict, packet_id) of the claims (.., text, value) that are related by value to any packet of their group: both have one.

    conflict: whether some such packet's value differs by more than the limit, or its text says the opposite; packet_id is one that does, null
    without conflict. A claim differs from some value if it does from the least or the greatest, and packets of equal polarity are
    opposed alike, so a group sends its two outermost packets and one for each polarity, never a pair a packet.
    """
    valued = packets.where("value is not null").withColumn("said", tone(packets))
    edge = lambda f: f(F.struct("value", "packet_id"))
    edges = valued.groupBy(group).agg(edge(F.min).alias("least"), edge(F.max).alias("most"))
    tones = valued.groupBy(group, "said").agg(F.min("packet_id").alias("packet_id")).groupBy(group).agg(F.collect_list(F.struct("said", "packet_id")).alias("tones"))
    each = claims.where("value is not null").select(group, "claim_id", "value", tone(claims).alias("own")).join(edges.join(tones, group), group)
    differs = [F.when(magnitude_mismatch(F.col("value"), F.col(f"{c}.value"), limit), F.col(f"{c}.packet_id")) for c in ("least", "most")]
    opposed = F.filter("tones", lambda t: P.opposed(F.col("own"), t["said"]))
    found = F.coalesce(*differs, F.try_element_at(opposed, F.lit(1))["packet_id"])
    return each.select(group, "claim_id", found.isNotNull().alias("conflict"), found.alias("packet_id"))


def without_partner(claims: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    return claims.join(pairs.select(*keys).distinct(), keys, "left_anti")


def magnitude_mismatch(a: Column, b: Column, limit: float = 0.35) -> Column:
    return F.coalesce(N.relative_difference(a, b) > limit, F.lit(False))


def relation(claim: Column, packet: Column, claim_value: Column, packet_value: Column, overlap: Column, limit: float = 0.35) -> Column:
    """The first rule that fires for a related pair."""
    return tones_relation(P.polarities(claim), P.polarities(packet), claim_value, packet_value, overlap, limit)


def tones_relation(claim: Column, packet: Column, claim_value: Column, packet_value: Column, overlap: Column, limit: float = 0.35) -> Column:
    """relation of texts by their polarities."""
    return F.when(magnitude_mismatch(claim_value, packet_value, limit), "magnitude_mismatch").when(P.opposed(claim, packet), "contradicted").when(overlap, "support").otherwise("unresolved")


def hydrate(packets: DataFrame, chunks: DataFrame, group: str) -> DataFrame:
    """packets (group, packet_id, anchor, refs) with meta and place of the first of anchor and refs that has them.

    chunks: (group, ord, anchor, meta). A repeated anchor gives its last meta and its first place.
    """
    known = chunks.groupBy(group, "anchor").agg(F.max_by("meta", "ord").alias("meta"), F.min("ord").alias("place"))
    tries = packets.select(group, "packet_id", F.posexplode(F.concat(F.array("anchor"), "refs")).alias("i", "anchor"))
    found = tries.join(known, [group, "anchor"], "left").groupBy(group, "packet_id").agg(F.min_by("meta", F.when(F.col("meta").isNotNull(), F.col("i"))).alias("meta"), F.min_by("place", F.when(F.col("place").isNotNull(), F.col("i"))).alias("place"))
    return packets.join(found, [group, "packet_id"], "left")


def anchor_keys(c: Column) -> list[Column]:
    """Ever looser keys of an anchor: itself, lower-cased, colons collapsed, title words with index, index."""
    low = F.lower(F.trim(c))
    colons = F.regexp_replace(low, ":+", ":")
    index = F.regexp_extract(colons, r"^section:.*:(\d+)$", 1)
    title = F.array_join(F.regexp_extract_all(F.regexp_extract(colons, r"^section:(.*):\d+$", 1), F.lit("([a-z0-9]+)"), F.lit(1)), " ")
    stem = F.regexp_replace(title, "s$", "")
    return [F.trim(c), low, colons, F.when(index != "", F.concat(index, F.lit("|"), stem)), F.when(index != "", index)]


def resolve_anchors(refs: DataFrame, anchors: DataFrame, group: str) -> DataFrame:
    """refs (group, ref) with the anchor that it means, null where it means none or several. anchors: (group, anchor)."""
    levels = anchors.select(group, F.col("anchor"), F.posexplode(F.array(*anchor_keys(F.col("anchor")))).alias("level", "key")).where("key is not null")
    single = levels.groupBy(group, "level", "key").agg(F.count_distinct("anchor").alias("n"), F.max("anchor").alias("resolved")).where("n = 1").drop("n")
    tries = refs.select(group, "ref").distinct().select(group, "ref", F.posexplode(F.array(*anchor_keys(F.col("ref")))).alias("level", "key")).where("key is not null")
    best = tries.join(single, [group, "level", "key"]).groupBy(group, "ref").agg(F.min_by("resolved", "level").alias("resolved"))
    return refs.join(best, [group, "ref"], "left")


def valid_refs(rows: DataFrame, anchors: DataFrame, keys: list[str], ref: str) -> DataFrame:
    """Rows whose reference exists among the anchors."""
    return rows.join(anchors.select(*[k for k in keys if k in anchors.columns], F.col("anchor").alias(ref)).distinct(), [*[k for k in keys if k in anchors.columns], ref], "left_semi")


def best_sentence(items: DataFrame, sentences: DataFrame, keys: list[str]) -> DataFrame:
    """For each item (keys.., item_id, statement) the sentence (keys.., pos, sentence) of the same anchor that says it best; the earliest of equals."""
    return best_said(items.withColumn("words", X.word_set(F.col("statement"))).join(sentences, keys))


def best_said(pairs: DataFrame) -> DataFrame:
    """best_sentence of pairs (item_id, words of its statement, pos, sentence) that are there already. Scores are equal where nine decimals are."""
    said = pairs.withColumn("own", X.word_set(F.col("sentence")))
    scored = said.select("item_id", "sentence", "pos", (S.set_f1(F.col("words"), F.col("own")) + F.least(F.lit(0.15), F.length("sentence") / 2000.0)).alias("score"))
    return scored.groupBy("item_id").agg(F.max_by("sentence", F.struct(F.round("score", 9), -F.col("pos"))).alias("sentence"), F.max("score").alias("score"))


#: Words of reference points, and queries, that a task holds at once.
BLOCK_WORDS, BLOCK_QUERIES, BLOCK_ROWS, CELLS = 1 << 19, 2048, 1 << 14, 1 << 22


class _Points:
    """A block of reference points: their parts, sizes, and an index from word to points."""

    def __init__(self, rows: list):
        self.ids, self.parts = [r[0] for r in rows], [r[1] for r in rows]
        self.size = np.array([len(r[2]) for r in rows], np.int64)
        flat = pa.array([w for r in rows for w in r[2]], pa.string()).dictionary_encode()
        self.words = flat.dictionary
        order = np.argsort(codes := flat.indices.to_numpy(), kind="stable")
        self.points = np.repeat(np.arange(len(rows)), self.size)[order]
        self.begin = np.searchsorted(codes[order], np.arange(len(self.words) + 1))

    def scores(self, lists: pa.ListArray) -> np.ndarray:
        """[line, point] -> twice the shared words by all words of both."""
        n, m = len(lists), pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        code = pc.fill_null(pc.index_in(lists.flatten(), self.words), -1).to_numpy()
        line = np.repeat(np.arange(n), m)[code >= 0]
        code = code[code >= 0]
        count = self.begin[code + 1] - self.begin[code]
        at = np.repeat(self.begin[code] - np.cumsum(count) + count, count) + np.arange(count.sum())
        shared = np.bincount(np.repeat(line, count) * len(self.ids) + self.points[at], minlength=n * len(self.ids)).reshape(n, -1)
        return np.where(shared > 0, 2.0 * shared / np.maximum(m[:, None] + self.size[None, :], 1), 0.0)


def best_match(reference: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """For each reference point (ref_id, part, words) the line (line_id, part, words) whose word set is most alike by token F1, the least line of equals; whether it reaches the threshold; and the best score of a line of the same part.

    Points that share no word with any line are left out. Reference points pass over the lines in blocks of at most BLOCK_WORDS words, one pass a block (one
    for any usual reference); a task counts shared words by an index and sends its best line a point, so no pair is ever shuffled.
    """
    spark, parts = lines.sparkSession, []
    schema = T.StructType([T.StructField("ref_id", reference.schema["ref_id"].dataType), T.StructField("line_id", lines.schema["line_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("same_part", T.DoubleType())])

    def run(shared):
        def each(batches):
            points = shared.value
            step = max(1, CELLS // max(1, len(points.ids)))
            for batch in batches:
                for i in range(0, batch.num_rows, step):
                    part = batch.slice(i, step)
                    score = points.scores(part.column(2))
                    ids = part.column(0).to_numpy()
                    rounded = np.round(score, 9)
                    top = rounded.max(0)
                    line = np.where(rounded == top, ids[:, None], np.iinfo(ids.dtype).max).min(0)
                    same = np.where(np.array(part.column(1).to_pylist(), object)[:, None] == np.array(points.parts, object)[None, :], score, 0.0).max(0)
                    on = np.flatnonzero(top > 0)
                    yield pa.RecordBatch.from_arrays([pa.array([points.ids[k] for k in on], to_arrow_type(schema[0].dataType)), pa.array(line[on]), pa.array(score.max(0)[on]), pa.array(same[on])], names=schema.names)

        return lines.select("line_id", "part", "words").mapInArrow(each, schema)

    block, held = [], 0
    for r in reference.select("ref_id", "part", "words").where(F.size("words") > 0).toLocalIterator(prefetchPartitions=True):
        if block and held + len(r[2]) > BLOCK_WORDS:
            parts.append(run(spark.sparkContext.broadcast(_Points(block))))
            block, held = [], 0
        block.append(r)
        held += len(r[2])
    parts.append(run(spark.sparkContext.broadcast(_Points(block))) if block else spark.createDataFrame([], schema))
    found = reduce(DataFrame.unionByName, parts).groupBy("ref_id").agg(
        F.max_by("line_id", F.struct(F.round("score", 9), -F.col("line_id"))).alias("line_id"), F.max("score").alias("score"), F.max("same_part").alias("same_part")
    )
    return found.withColumn("matched", F.col("score") >= threshold)


def _cosines(q: list[np.ndarray], v: list[np.ndarray]) -> np.ndarray:
    """[query, row] -> cosine over the common prefix, 0 to 1; 0 where a side is empty or all zero."""
    out = np.zeros((len(q), len(v)))
    a, b = np.array([len(x) for x in q]), np.array([len(x) for x in v])
    for m in np.unique(a[a > 0]):
        for n in np.unique(b[b > 0]):
            i, j, k = np.flatnonzero(a == m), np.flatnonzero(b == n), min(m, n)
            x, y = np.stack([q[t][:k] for t in i]), np.stack([v[t][:k] for t in j])
            norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
            out[np.ix_(i, j)] = np.where(norm > 0, np.clip(x @ y.T / np.where(norm > 0, norm, 1), 0, 1), 0)
    return out


def nearest_vectors(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """For each query (id, vector) the nearest other row (vec_id, vector) by cosine, the least of equals: (id, nearest, similarity).

    Every query meets every row, as blocks: a cell holds about BLOCK_QUERIES queries and BLOCK_ROWS rows and multiplies them as matrices, and only its best
    row a query leaves it. Rows are sent once for each block of queries.
    """
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    nq, n = queries.count(), rows.count()
    across, down = max(1, -(-nq // BLOCK_QUERIES)), max(1, -(-n // BLOCK_ROWS))
    if across * down < parallel:
        down = max(1, min(parallel, n // 256))

    def placed(df: DataFrame, key: str, side: int) -> DataFrame:
        own, other = ("i", across), ("j", down)
        if side:
            own, other = other, own
        slot = F.pmod(F.xxhash64(key), F.lit(own[1])).cast("int").alias(own[0])
        return df.select(slot, F.explode(F.sequence(F.lit(0), F.lit(other[1] - 1))).alias(other[0]), F.lit(side).alias("side"), F.col(key).cast("long").alias("key"), F.col("vector").cast("array<double>").alias("vector"))

    def best(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        cell = pa.Table.from_batches(parts).combine_chunks()
        side, keys = cell.column("side").to_numpy(), cell.column("key").to_numpy()
        vectors = [np.array(x if x is not None else [], float) for x in cell.column("vector").to_pylist()]
        left = int((side == 0).sum())
        if not left or left == len(side):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["id", "vec_id", "c"])
        c = np.round(_cosines(vectors[:left], vectors[left:]), 9)
        c[keys[:left, None] == keys[None, left:]] = -1
        top = c.max(1)
        row = np.where(c == top[:, None], keys[None, left:], np.iinfo(np.int64).max).min(1)
        on = top >= 0
        return pa.RecordBatch.from_arrays([pa.array(keys[:left][on]), pa.array(row[on]), pa.array(top[on])], names=["id", "vec_id", "c"])

    def run(batches):
        held, last = [], None
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in (0, 1)], 1)
            edges = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1 if len(key) else []
            for p, q in zip([0, *edges], [*edges, len(key)], strict=True):
                if p == q:
                    continue
                if held and last != tuple(key[p]):
                    yield best(held)
                    held = []
                last = tuple(key[p])
                held.append(batch.slice(p, q - p))
        if held:
            yield best(held)

    both = placed(queries, "id", 0).select("i", "j", "side", "key", "vector").unionByName(placed(rows, "vec_id", 1))
    cells = both.repartition(max(across * down, 1), "i", "j").sortWithinPartitions("i", "j", "side").mapInArrow(run, "id long, vec_id long, c double")
    return cells.groupBy("id").agg(F.max_by("vec_id", F.struct("c", -F.col("vec_id"))).alias("nearest"), F.max("c").alias("similarity"))


def longest_by_token(captions: DataFrame, keys: list[str]) -> DataFrame:
    """The longest caption (keys.., token, ord, caption) of each token; the first of equals."""
    return captions.groupBy(*keys, "token").agg(F.max_by("caption", F.struct(F.length("caption"), -F.col("ord"))).alias("caption"))


def words_in_cells(words: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """Text of each cell: the words whose centre lies in it, from left to right. cells: (key, row, col, x0, y0, x1, y1); words: (key, x0, y0, x1, y1, text).

    Words meet cells of the same image only, by the grid band of their centre's row.
    """
    band = 64
    of_cell = cells.select(key, "row", "col", *[F.col(c).alias(f"c{c}") for c in ("x0", "y0", "x1", "y1")], F.explode(F.sequence(F.floor(F.col("y0") / band), F.floor(F.col("y1") / band))).alias("band"))
    of_word = words.select(key, "text", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y")).withColumn("band", F.floor(F.col("y") / band))
    inside = of_word.join(of_cell, [key, "band"]).where("x >= cx0 and x < cx1 and y >= cy0 and y < cy1")
    return inside.groupBy(key, "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda w: w["text"]), " ").alias("text"))


def first_by_signature(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
