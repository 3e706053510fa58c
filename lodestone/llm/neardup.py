"""MinHash near-dedup: DartMinHash signatures, banded joining, exact verification, connected classes.

A document is the set of its shingles of five words (fewer words: one shingle of all of them). Every element throws darts
into regions of unit weight: in region v of an element, darts arrive as a Poisson process along the rank axis with
hashed exponential gaps, each with a hashed coordinate and place in the region; a dart counts if its place lies
under the element's weight. The earliest dart of a coordinate is the signature there, so two sets agree in a coordinate with
the probability of their (weighted) Jaccard similarity. Ranks are followed up to DARTS / total weight, some
DARTS * coordinates darts whatever the length; the few rows with an empty coordinate go on to twice that rank.

Equal sets collapse to one node. Bands of ROWS coordinates make buckets; buckets with the same nodes count once. The nodes of a bucket meet
in blocks of about BLOCK rows with their whole sets (32-bit shingle hashes), where every pair that is still of two classes is settled
by its exact Jaccard similarity, most by the first comparison with the block's centre. A bucket of several blocks has one node in
all of them; when the classes so far are known, its members of other classes meet all its blocks, two by two. So the classes are those of all
similar pairs that share a bucket, whatever its size, and a bucket costs its members outside its largest class times all its
members at most. With 30 bands of 5, a pair of similarity 0.8 meets with probability 0.999993. Classes are the connected components of the
links, by min-label propagation with pointer jumping in tables.

Similarity is that of sets of shingles, so each element weighs 1 and has one whole region; dart_signatures also takes weights.

Buckets, sets and labels with over 1/2048 of the rows are broadcast as single rows. Nothing is collected but counts.

Defined results: texts without words (null, empty) are classes of their own; rows that repeat an id are one document, whose
texts all join its class; rows with a null id share one result, a class of their own with a null class_id; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, hot_limit, join_groups, written
from .textnum import ALNUM, K1, K2, slices, utf8, words

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 5
DARTS = 10.0
SLICE_BYTES, SLICE_ROWS = 4 << 20, 1500
RANK_BITS, RANK_MAX = 45, 64.0


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * K1
        x = (x ^ (x >> np.uint64(29))) * K2
        return x ^ (x >> np.uint64(32))


def shingles(column, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, 44-bit hash) of the distinct shingles, ordered by row and hash. At most 2**19 rows."""
    h, row, _, _ = words(column, ALNUM)
    n = len(column)
    count = np.bincount(row, minlength=n)
    with np.errstate(over="ignore"):
        rolled, s = h * K1, np.zeros(max(0, len(h) - width + 1), np.uint64)
        for j in range(width):
            s = mix(s * K2 + rolled[j : j + len(s)])
        inside = row[: len(s)] == row[width - 1 :] if len(s) else np.zeros(0, bool)
        s, at = s[inside], row[: len(s)][inside]
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            first = np.searchsorted(row, short)
            own = count[short].astype(np.uint64)
            for j in range(width - 1):
                has = count[short] > j
                own[has] = mix(own[has] * K2 + rolled[first[has] + j])
            s, at = np.concatenate([s, own]), np.concatenate([at, short])
    packed = np.unique((at.astype(np.int64) << 44) | (s >> np.uint64(20)).astype(np.int64))
    return packed >> 44, packed & ((1 << 44) - 1)


def dart_signatures(row: np.ndarray, element: np.ndarray, rows: int, coordinates: int, weight: np.ndarray | None = None, darts: float = DARTS) -> np.ndarray:
    """[row, coordinate] -> rank of the earliest dart, as an integer; rows without weight have -1. row ascends."""
    if weight is None:
        region = mix(element.astype(np.uint64))
        share, total = None, np.bincount(row, minlength=rows).astype(float)
    else:  # regions of unit weight, the last one in part
        cells = np.ceil(weight).astype(np.int64)
        first = np.cumsum(cells) - cells
        own = np.repeat(np.arange(len(cells)), cells)
        level = np.arange(int(cells.sum())) - first[own]
        with np.errstate(over="ignore"):
            region = mix(element.astype(np.uint64)[own] + mix(level.astype(np.uint64)) * (level > 0))
        share, total, row = np.minimum(1.0, weight[own] - level), np.bincount(row, weight, minlength=rows), row[own]
    out = np.full(rows * coordinates, -1, np.int64)
    todo = np.flatnonzero(total > 0)
    reach = np.zeros(rows)
    reach[todo] = darts / total[todo]
    while len(todo):
        keep = np.zeros(rows, bool)
        keep[todo] = True
        index = np.full(rows, -1, np.int64)
        index[todo] = np.arange(len(todo))
        at = np.flatnonzero(keep[row])
        seed, rank, limit = region[at], np.zeros(len(at)), reach[row[at]]
        part, base = None if share is None else share[at], index[row[at]] * coordinates
        hits, j = [], 0
        while len(seed):
            j += 1
            with np.errstate(over="ignore"):
                h = mix(seed + np.uint64(j) * K2)
            rank = rank - np.log(((h >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) / coordinates
            on = rank < limit
            if not on.all():
                seed, rank, limit, base, h = seed[on], rank[on], limit[on], base[on], h[on]
                part = None if part is None else part[on]
            g = mix(h ^ K1)
            cell = base + ((g >> np.uint64(32)) % np.uint64(coordinates)).astype(np.int64)
            key = (cell << RANK_BITS) | np.minimum(rank * (2.0**RANK_BITS / RANK_MAX), 2.0**RANK_BITS - 1).astype(np.int64)
            hits.append(key if part is None else key[(g & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < part])
        keys = np.sort(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        cell = keys >> RANK_BITS
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        cell, keys = cell[first], keys[first] & ((1 << RANK_BITS) - 1)
        out[todo[cell // coordinates] * coordinates + cell % coordinates] = keys
        full = np.bincount(cell // coordinates, minlength=len(todo)) == coordinates
        todo = todo[~full]
        reach[todo] *= 2
    return out.reshape(rows, coordinates)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[row, band] -> bucket, a 64-bit hash of the band's number and coordinates."""
    out = np.empty((len(signature), bands), np.int64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(len(signature), np.uint64(b + 1))
            for j in range(rows):
                h = mix(h * K1 + signature[:, b * rows + j].astype(np.uint64))
            out[:, b] = h.astype(np.int64)
    return out


SKETCH = T.StructType(
    [T.StructField("row", T.LongType()), T.StructField("id", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("set", T.BinaryType())]
)


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row for each of docs: row (its number), id, s1, s2 (hash of the set), size, bands, set (ascending 32-bit shingle hashes); all but row and id are null without words or id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, SLICE_BYTES):
                for i in range(a, b, SLICE_ROWS):
                    part = batch.slice(i, min(SLICE_ROWS, b - i))
                    n = part.num_rows
                    row, s = shingles(part.column(1), width)
                    signature = dart_signatures(row, s, n, bands * rows)
                    flat = (s >> 12).astype("<u4")
                    new = np.ones(len(flat), bool)
                    new[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
                    x = s.astype(np.uint64)
                    size = np.bincount(row[new], minlength=n)
                    none = (size == 0) | ~part.column(0).is_valid().to_numpy(zero_copy_only=False)
                    has = np.flatnonzero(np.bincount(row, minlength=n))
                    s1, s2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                    if len(has):
                        first = np.searchsorted(row, has)
                        s1[has], s2[has] = np.add.reduceat(mix(x), first), np.add.reduceat(mix(x ^ K1), first)
                    ends = np.concatenate([[0], np.cumsum(size)])
                    flat = flat[new]
                    hashes = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(band_hashes(signature, bands, rows).ravel()), mask=pa.array(none))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.arange(number, number + n), pa.int64()), part.column(0), pa.array(s1.astype(np.int64), mask=none), pa.array(s2.astype(np.int64), mask=none), pa.array(size.astype(np.int32), mask=none), hashes,
                            pa.array([None if no else flat[p:q].tobytes() for p, q, no in zip(ends, ends[1:], none, strict=False)], pa.binary()),
                        ],
                        names=SKETCH.names,
                    )
                    number += n

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SKETCH)


class Sets:
    """Sets of 32-bit hashes of a block's rows, one after the other, as dense codes."""

    def __init__(self, sets: list[bytes]):
        self.size = np.array([len(s) // 4 for s in sets], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        values, self.code = np.unique(np.frombuffer(b"".join(sets), "<u4"), return_inverse=True)
        self.mark = np.zeros(len(values), np.int32)

    def centre(self) -> int:
        """The row whose elements most rows hold."""
        company = np.bincount(self.code)[self.code]
        return int((np.add.reduceat(company, self.start[:-1]) / self.size).argmax())

    def similarity(self, p: int, others: np.ndarray) -> np.ndarray:
        """Jaccard similarity of row p with each of the others."""
        own = self.code[self.start[p] : self.start[p + 1]]
        self.mark[own] = 1
        if 4 * len(others) > len(self.size):
            common = np.add.reduceat(self.mark[self.code], self.start[:-1])[others]
        else:
            common = np.array([self.mark[self.code[self.start[q] : self.start[q + 1]]].sum() for q in others])
        self.mark[own] = 0
        return common / (self.size[others] + self.size[p] - common)


def block_links(nodes: np.ndarray, labels: np.ndarray, left: int | None, sets: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """Links that join every class which a similar pair joins: of a row before `left` with a later one (None: of any two rows).

    Labels are the classes known so far. Rows are compared with all rows of other classes, one row at a time; those in the class of
    the first row, the block's centre, need not take their turn, as a pair of two classes has a row outside that one. Sizes
    that rule the similarity out aren't counted.
    """
    x, links = Sets(sets), []
    _, label = np.unique(labels, return_inverse=True)
    asked = np.arange(len(nodes)) < (len(nodes) if left is None else left)
    done = np.zeros(len(nodes), bool)
    partner = np.ones(len(nodes), bool) if left is None else ~asked
    first = x.centre() if left is None else None
    for p in np.flatnonzero(asked) if first is None else [first, *np.flatnonzero(np.arange(len(nodes)) != first)]:
        if first is not None and p != first and label[p] == label[first]:
            continue
        done[p] = True
        may = partner & (label != label[p]) & ~done
        may &= np.minimum(x.size, x.size[p]) >= similarity * np.maximum(x.size, x.size[p]) - 1e-9
        others = np.flatnonzero(may)
        if not len(others):
            continue
        for q in others[x.similarity(int(p), others) >= similarity - 1e-9]:
            if label[q] != label[p]:
                links.append((int(nodes[p]), int(nodes[q])))
                label[label == label[q]] = label[p]
    return links


def linked(rows: DataFrame, key: list[str], similarity: float) -> DataFrame:
    """Links (a, b) of the blocks of rows (key, side, node, label, set); side 0 meets side 1 where there is a side 1, else itself."""

    def finish(parts: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        own = pa.Table.from_batches(parts).combine_chunks()
        side, nodes, labels = (own.column(len(key) + k).to_numpy() for k in range(3))
        left = int((side == 0).sum())
        if not left:
            return []
        sets = own.column(len(key) + 3).to_pylist()
        return block_links(nodes, labels, left if left < len(side) else None, sets, similarity)

    def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, out = [], None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(len(key))], 1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for p, q in zip([0, *edges], [*edges, len(keys)], strict=True):
                if held and last != tuple(keys[p]):
                    out += finish(held)
                    held = []
                last = tuple(keys[p])
                held.append(batch.slice(p, q - p))
            if len(out) >= 10_000:
                yield batch_of(out)
                out = []
        yield batch_of(out + (finish(held) if held else []))

    columns = [*key, "side", "node", "label", "set"]
    return rows.select(columns).repartition(*key).sortWithinPartitions(*key, "side", "node").mapInArrow(run, "a long, b long")


#: Members and elements of a block, on average.
BLOCK, BLOCK_SIZE = 2048, 4 << 20


def shared_buckets(reps: DataFrame) -> DataFrame | None:
    """(bucket, members, blocks, node) of the buckets with several nodes, from (node, size, bands); of buckets with the same nodes one stands for all. None if there are none."""
    every = reps.select("node", "size", F.explode("bands").alias("bucket"))
    members = every.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("members"), F.sum("size").alias("elements"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2")
    ).where("members > 1")
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.max("elements") / BLOCK_SIZE)).cast("int")
    crowd = written(members.groupBy("members", "x1", "x2").agg(F.min("bucket").alias("bucket"), blocks.alias("blocks")).select("bucket", "members", "blocks"), "near-crowd")
    total = crowd.agg(F.sum("members")).first()[0] or 0
    if not total:
        return None
    out = written(join_groups(every.select("bucket", "node"), crowd, ["bucket"], "members", total), "near-shared")
    discard(crowd)
    return out


def slot_of() -> Column:
    return F.pmod(F.xxhash64("bucket", "node"), F.col("blocks")).cast("int")


def links_in_blocks(shared: DataFrame, sets: DataFrame, large: bool, similarity: float) -> DataFrame:
    """Links within blocks. The node that stands for a bucket of several blocks is in each of them, which joins most of what blocks part."""
    rows = shared.select("bucket", slot_of().alias("slot"), "node")
    if large:
        heads = shared.where("blocks > 1").groupBy("bucket").agg(F.min("node").alias("node"), F.max("blocks").alias("blocks"))
        rows = rows.unionByName(heads.select("bucket", F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != slot_of())).alias("slot"), "node"))
    return linked(rows.join(sets.hint("merge"), "node").withColumn("side", F.lit(0)).withColumn("label", F.col("node")), ["bucket", "slot"], similarity)


def links_across_blocks(shared: DataFrame, sets: DataFrame, labels: DataFrame | None, similarity: float) -> DataFrame:
    """Links between blocks of a bucket: members outside the class of the bucket's head, in blocks, meet each block of the bucket."""
    large = shared.where("blocks > 1").select("bucket", "blocks", "node")
    if labels is None:
        marked = large.withColumn("label", F.col("node"))
    else:
        marked = large.join(labels.select(F.col("id").alias("node"), "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    marked = written(marked, "near-marked")
    head = marked.groupBy("bucket").agg(F.min_by("label", "node").alias("main"), F.max("blocks").alias("n"))
    other = marked.join(F.broadcast(head.select("bucket", "main")) if _few(head) else head.select("bucket", "main"), "bucket").where("label <> main")
    other = written(other.select("bucket", "blocks", "node", "label"), "near-other")
    asking = other.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("turns"))
    asking = written(asking, "near-asking")
    few = F.broadcast(asking) if _few(asking) else asking
    side0 = other.join(few, "bucket").select("bucket", F.pmod(F.xxhash64("node", F.lit(3)), F.col("turns")).cast("int").alias("turn"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("slot"), F.lit(0).alias("side"), "node", "label")
    side1 = marked.join(few, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), slot_of().alias("slot"), F.lit(1).alias("side"), "node", "label")
    return linked(side0.unionByName(side1).join(sets.hint("merge"), "node"), ["bucket", "turn", "slot"], similarity)


def _few(rows: DataFrame, most: int = 1 << 16) -> bool:
    """Whether the rows, of a few numbers each, are few enough to broadcast."""
    return rows.limit(most + 1).count() <= most


def components(links: DataFrame, name: str = "near-labels") -> DataFrame:
    """(id, label) of the ids in links (a, b): the least id of the connected component."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), name)
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.col("a").alias("old"), F.least("a", "m").alias("label")), name)
    while True:
        now = labels.select("id", "label")
        near = both.join(now.select(F.col("id").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("id")).agg(F.min("l").alias("l"))
        step = now.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = now.select(F.col("id").alias("label"), F.col("label").alias("top"))
        new = written(step.join(jump, "label").select("id", "old", F.least("label", "top").alias("label")), name)
        discard(labels)
        labels = new
        if not new.where("label <> old").limit(1).count():
            discard(both)
            return new


def labels_of(reps: DataFrame, sets: DataFrame, same_id: DataFrame | None, similarity: float) -> DataFrame | None:
    """(id, label) of the nodes that links join to others: the least node of their class. None if there are no links. same_id: links between texts of one id."""
    shared = shared_buckets(reps)
    parts = [] if same_id is None else [same_id]
    if shared is not None:
        large = shared.where("blocks > 1").limit(1).count() > 0
        parts.append(written(links_in_blocks(shared, sets, large, similarity), "near-links"))
    links = reduce(DataFrame.unionByName, parts) if parts else None
    labels = None if links is None or not links.limit(1).count() else components(links)
    if shared is not None and large:
        more = written(links_across_blocks(shared, sets, labels, similarity), "near-more")
        parts.append(more)
        if more.limit(1).count():
            discard(labels)
            labels = components(reduce(DataFrame.unionByName, parts))
    discard(shared, *parts)
    return labels


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, class_id, class_size, kept) of every distinct id: its class's largest id, the rows there, and whether it is that id."""
    sketch = written(sketches(docs, id_col, text_col, width, bands, rows), "near-sketches")
    same = sketch.where("s1 is not null").groupBy("s1", "s2").agg(F.min("row").alias("node"), F.max("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    same = written(same, "near-copies")
    with_words = sketch.where("s1 is not null").select("row", "id", "s1", "s2", "size", "bands")
    member = join_groups(with_words, same, ["s1", "s2"], "copies", sketch.count())
    member = written(member.select("id", "node", "rep", "copies", *[F.when(F.col("row") == F.col("node"), F.col(c)).alias(c) for c in ("size", "bands")]), "near-members")
    wordless = sketch.where("s1 is null").select("id", *[F.lit(None).cast("long").alias(c) for c in ("node", "rep", "copies")])
    by_id = member.select("id", "node", "rep", "copies").unionByName(wordless).groupBy("id").agg(
        F.min(F.when(F.col("node").isNotNull(), F.struct("node", "rep", "copies"))).alias("own"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n")
    )
    by_id = written(by_id.select("id", "own.node", "own.rep", "own.copies", "last", "n"), "near-ids")
    several = by_id.where("last > node")
    same_id = None
    if several.limit(1).count():  # ids with several texts
        several = written(several.select("id", F.col("node").alias("b"), "n"), "near-several")
        same_id = written(join_groups(member.select("id", F.col("node").alias("a")), several, ["id"], "n", sketch.count()).where("a <> b").select("a", "b").distinct(), "near-same-id")
        discard(several)
    reps = member.where("bands is not null").select("node", "size", "bands")
    sets = sketch.where("set is not null").select(F.col("row").alias("node"), "set")
    labels = labels_of(reps, sets, same_id, similarity)
    if labels is None:
        discard(sketch, member, same)
        out = by_id.withColumn("class_id", F.col("rep")).withColumn("class_size", F.col("copies"))
    else:
        classes = written(same.join(labels.select(F.col("id").alias("node"), "label"), "node").select("node", "rep", "copies", "label"), "near-classes")
        tops = written(classes.groupBy("label").agg(F.max("rep").alias("class_id"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("sets")), "near-tops")
        of_node = written(join_groups(classes.select("label", "node", "copies"), tops, ["label"], "sets", classes.count()).select("node", "class_id", "class_size", "copies"), "near-of-node")
        discard(sketch, member, same, labels, classes, tops)
        limit = hot_limit(by_id.count())
        hot, cold = [of_node.where(F.col("copies") > limit), of_node.where(F.col("copies") <= limit)]
        parts = [by_id.where(F.coalesce("copies", F.lit(0)) <= limit).join(cold.drop("copies"), "node", "left")]
        if hot.limit(1).count():
            parts.append(by_id.where(F.col("copies") > limit).join(F.broadcast(hot.drop("copies")), "node", "left"))
        else:
            parts.append(by_id.where(F.col("copies") > limit).select("node", "id", "rep", "copies", "last", "n", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("class_size")))
        out = reduce(DataFrame.unionByName, parts)
    class_id = F.coalesce("class_id", "rep", "id")
    return out.select(F.col("id").alias(id_col), class_id.alias("class_id"), F.coalesce("class_size", "copies", "n").cast("long").alias("class_size"), F.col("id").eqNullSafe(class_id).alias("kept"))
