"""Benchmark decontamination: an FM-index per training shard answers all benchmark windows by backward search.

A shard is a run of rows of at most SHARD_BYTES of text inside an Arrow batch. Its words become symbols: 1.. for the
words that the benchmark uses, in any item; the others can't be inside a window, so each stretch of
benchmark words is a segment with an end mark of its own, and stretches shorter than the shortest window are
left out. Over that sequence: suffix array (sorted by prefix doubling), Burrows-Wheeler transform, wavelet matrix
with rank directories, and suffix positions sampled every SAMPLE places and at segment starts. All
windows are searched at once, from their last word to their first; occurrences are located by walking back
to a sampled position; their spans merge into the words to remove.

Windows are `width` consecutive words of an item; an item with fewer words, but not none, is one window. Blocks of
items of at most BLOCK_WORDS words are broadcast, one pass over the documents each (one pass for any usual benchmark); between
passes the rows are written, and a block's broadcast is gone before the next one's, so what a task and the driver hold doesn't grow with either table. Words are compared by 64-bit hashes.

Defined results: null has no words; an item without words is never found; items with equal ids count once; a row of
documents repeated gives its result twice; an empty benchmark hits nothing; other columns are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, written
from .textnum import ALNUM, slices, utf8, with_columns, words

SHARD_BYTES = 4 << 20
BLOCK_WORDS = 1 << 19
SAMPLE = 8
#: Places in a shard's sequence and ranks are packed in so many bits.
BITS = 21

N_WORDS, SPANS, ITEMS = "__n_words", "__spans", "__items"


class Phrases:
    """Distinct windows of a block of items: their symbols, and the items that each stands for."""

    def __init__(self, items: list[tuple[str, np.ndarray]], width: int):
        vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        self.vocabulary = vocabulary
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
        owners: dict[bytes, set[str]] = {}
        for item, h in items:
            s = (np.searchsorted(vocabulary, h) + 1).astype(np.int32)
            for i in range(max(1, len(s) - width + 1)):
                owners.setdefault(s[i : i + width].tobytes(), set()).add(item)
        self.owners = [sorted(x) for x in owners.values()]
        found = [np.frombuffer(k, np.int32) for k in owners]
        self.size = np.array([len(x) for x in found], np.int64)
        self.symbols = np.zeros((len(found), int(self.size.max(initial=1))), np.int32)
        for i, x in enumerate(found):
            self.symbols[i, : len(x)] = x
        self.least = int(self.size.min(initial=width))
        self.levels = max(1, int(len(vocabulary)).bit_length())

    def symbols_of(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int32)
        at = np.flatnonzero(self.seen[(h >> np.uint64(48)).astype(np.int64)])
        if len(at) and len(self.vocabulary):
            x = h[at]
            i = np.minimum(np.searchsorted(self.vocabulary, x), len(self.vocabulary) - 1)
            out[at] = np.where(self.vocabulary[i] == x, i + 1, 0)
        return out


def suffix_array(seq: np.ndarray, left: np.ndarray, symbol_bits: int) -> np.ndarray:
    """Suffixes of seq in order, where 0 ends a segment and end marks are ordered by place. left: places to the end mark."""
    n, place = len(seq), np.arange(len(seq), dtype=np.int64)
    k = max(1, (63 - BITS) // symbol_bits)
    key = np.zeros(n, np.int64)
    for j in range(k):
        ahead = np.minimum(place + j, n - 1)
        key = (key << symbol_bits) | np.where(left >= j, seq[ahead], 0)
    packed = np.sort((key << BITS) | place)
    sa, group = packed & ((1 << BITS) - 1), packed >> BITS
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    done = left[sa] < k  # holds its end mark: ties stand in order of place
    head = np.maximum.accumulate(np.where(new | done, place, 0))
    rank = np.empty(n, np.int64)
    rank[sa] = head
    size = np.diff(np.append(np.flatnonzero(new | done), n))
    open_ = np.sort(sa[np.repeat(size > 1, size)])
    while len(open_):
        packed = (rank[open_] << (2 * BITS)) | (rank[np.minimum(open_ + k, n - 1)] << BITS) | open_
        packed.sort()
        at, pair = packed & ((1 << BITS) - 1), packed >> BITS
        old = pair >> BITS
        fresh, sub = np.ones(len(at), bool), np.ones(len(at), bool)
        fresh[1:] = old[1:] != old[:-1]
        sub[1:] = pair[1:] != pair[:-1]
        here = np.arange(len(at), dtype=np.int64)
        slot = old + here - np.maximum.accumulate(np.where(fresh, here, 0))
        sa[slot] = at
        rank[at] = slot[np.maximum.accumulate(np.where(sub, here, 0))]
        size = np.diff(np.append(np.flatnonzero(sub), len(at)))
        open_ = at[np.repeat(size > 1, size)]
        k *= 2
    return sa


class FMIndex:
    def __init__(self, seq: np.ndarray, left: np.ndarray, levels: int):
        n = len(seq)
        sa = suffix_array(seq, left, levels)
        self.n, self.levels = n, levels
        self.bwt = np.where(sa > 0, seq[sa - 1], 0).astype(np.int32)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=1 << levels))])
        starts = np.zeros(n, bool)
        starts[0] = True
        starts[1:] = seq[:-1] == 0
        keep = (sa % SAMPLE == 0) | starts[sa]
        self.sampled = np.where(keep, sa, -1)
        self.zeros, self.rank0 = [], []
        cur = self.bwt
        for level in range(levels - 1, -1, -1):
            bit = (cur >> level) & 1
            below = np.zeros(n + 1, np.int32)
            np.cumsum(bit == 0, out=below[1:])
            self.rank0.append(below)
            self.zeros.append(int(below[-1]))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol in the first i places of the transform, down the wavelet matrix."""
        lo, hi = np.zeros_like(i), i
        for level, below, zeros in zip(range(self.levels - 1, -1, -1), self.rank0, self.zeros, strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = below[lo], below[hi]
            lo, hi = np.where(one, zeros + lo - a, a), np.where(one, zeros + hi - b, b)
        return hi - lo

    def search(self, phrases: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, last row) of those that occur; backward, all at once."""
        alive = np.arange(len(size))
        lo, hi = np.zeros(len(size), np.int64), np.full(len(size), self.n, np.int64)
        for step in range(phrases.shape[1]):
            on = size[alive] > step
            act = alive[on]
            if not len(act):
                break
            c = phrases[act, size[act] - 1 - step]
            lo[act], hi[act] = self.less[c] + self.rank(c, lo[act]), self.less[c] + self.rank(c, hi[act])
            alive = alive[hi[alive] > lo[alive]]
        return alive, lo[alive], hi[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes at these rows, by walking back to sampled ones."""
        out, at, walk = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(at):
            place = self.sampled[rows]
            hit = place >= 0
            out[at[hit]] = place[hit] + walk
            at, rows = at[~hit], rows[~hit]
            c = self.bwt[rows]
            rows = self.less[c] + self.rank(c, rows)
            walk += 1
        return out


def shard_hits(h: np.ndarray, row: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(word, phrase) for each occurrence of a window among the words h of a shard, word being its first."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbol = phrases.symbols_of(h)
    at = np.flatnonzero(symbol)
    if not len(at) or not len(phrases.size):
        return none
    cut = np.ones(len(at), bool)
    cut[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    begin = np.flatnonzero(cut)
    size = np.diff(np.append(begin, len(at)))
    keep = size >= phrases.least
    at, size = at[np.repeat(keep, size)], size[keep]
    if not len(at):
        return none
    out = [[], []]
    # parts with room for places and end marks in BITS bits; segments aren't cut
    ends = np.cumsum(size + 1)
    for i, j in slices(np.concatenate([[0], ends]), (1 << BITS) - 2):
        own = size[i:j]
        first = ends[i] - size[i] - 1 - i  # symbols before this part
        here = at[first : first + own.sum()]
        total = int(own.sum()) + len(own)
        marks = np.cumsum(own + 1) - 1
        body = np.ones(total, bool)
        body[marks] = False
        seq, source = np.zeros(total, np.int64), np.full(total, -1, np.int64)
        seq[body], source[body] = symbol[here], here
        left = np.repeat(marks, own + 1) - np.arange(total)
        if total >= 1 << BITS:  # one segment that is longer than a part: windows on both sides of a cut are kept by an overlap
            raise ValueError("a segment is longer than an index can hold")
        index = FMIndex(seq, left, phrases.levels)
        found, lo, hi = index.search(phrases.symbols, phrases.size)
        count = hi - lo
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum())) if len(found) else np.zeros(0, np.int64)
        out[0].append(source[index.locate(rows)])
        out[1].append(np.repeat(found, count))
    return np.concatenate(out[0]), np.concatenate(out[1])


def split_long(h: np.ndarray, row: np.ndarray, phrases: Phrases, most: int) -> Iterator[tuple[int, int]]:
    """Word ranges of at most `most` words that overlap by a window, so that none is cut."""
    step = most - phrases.symbols.shape[1]
    for i in range(0, max(1, len(h)), step):
        yield i, min(len(h), i + most)
        if i + most >= len(h):
            break


def scan(batches: Iterator[pa.RecordBatch], phrases: Phrases, text_col: str) -> Iterator[pa.RecordBatch]:
    span_type = pa.list_(pa.struct([pa.field("start", pa.int64()), pa.field("end", pa.int64())]))
    for batch in batches:
        _, offsets = utf8(batch.column(text_col))
        for i, j in slices(offsets, SHARD_BYTES):
            part = batch.slice(i, j - i)
            h, row, _, _ = words(part.column(text_col), ALNUM)
            found = [(shard_hits(h[a:b], row[a:b], phrases), a) for a, b in split_long(h, row, phrases, (1 << (BITS - 1)))]
            word = np.concatenate([x + a for (x, _), a in found])
            phrase = np.concatenate([p for (_, p), _ in found])
            n = j - i
            n_words = np.bincount(row, minlength=n)
            spans, items = [[] for _ in range(n)], [[] for _ in range(n)]
            if len(word):
                delta = np.bincount(word, minlength=len(h) + 1) - np.bincount(word + phrases.size[phrase], minlength=len(h) + 1)
                hit = np.cumsum(delta)[: len(h)] > 0
                edge = np.ones(len(h), bool)
                edge[1:] = (hit[1:] != hit[:-1]) | (row[1:] != row[:-1])
                begin = np.flatnonzero(edge)
                end = np.append(begin[1:], len(h))
                base = np.searchsorted(row, np.arange(n))
                for s, e in zip(begin[hit[begin]], end[hit[begin]], strict=True):
                    spans[row[s]].append({"start": int(s - base[row[s]]), "end": int(e - base[row[s]])})
                for r, p in np.unique(np.stack([row[word], phrase], 1), axis=0):
                    items[r].extend(phrases.owners[p])
            items = [sorted(set(x)) for x in items]
            if SPANS in part.schema.names:  # a further block of items
                spans = [merge_spans((a.as_py() or []) + b) for a, b in zip(part.column(SPANS), spans, strict=True)]
                items = [sorted({*(a.as_py() or []), *b}) for a, b in zip(part.column(ITEMS), items, strict=True)]
            yield with_columns(part, **{N_WORDS: pa.array(n_words, pa.int64()), SPANS: pa.array(spans, span_type), ITEMS: pa.array(items, pa.list_(pa.string()))})


def merge_spans(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for x in sorted(spans, key=lambda x: (x["start"], x["end"])):
        if out and x["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], x["end"])
        else:
            out.append(dict(x))
    return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Items with words, in blocks of at most BLOCK_WORDS words (an item longer than that is a block)."""
    block, held = [], 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").toLocalIterator(prefetchPartitions=True)
    for r in rows:
        h = words(pa.array([r["t"]], pa.string()), ALNUM)[0]
        if not len(h):
            continue
        if block and held + len(h) > BLOCK_WORDS:
            yield block
            block, held = [], 0
        block.append((r["i"], h))
        held += len(h)
    yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with __n_words, __spans (merged word ranges to remove, end exclusive) and __items (ids with an occurring window, sorted)."""
    spark = docs.sparkSession
    add = [
        T.StructField(N_WORDS, T.LongType()),
        T.StructField(SPANS, T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField(ITEMS, T.ArrayType(T.StringType())),
    ]
    schema = T.StructType([*[f for f in docs.schema.fields if f.name not in (N_WORDS, SPANS, ITEMS)], *add])
    out, found, waiting = docs.drop(N_WORDS, SPANS, ITEMS), blocks(benchmark, item_col, item_text), None
    block = next(found)
    while block is not None:
        more = next(found, None)
        shared = spark.sparkContext.broadcast(Phrases(block, width))
        out = out.mapInArrow(lambda batches, shared=shared: scan(batches, shared.value, text_col), schema)
        if more is not None:  # one block is alive at a time
            out = written(out, "leaks")
            shared.destroy()
            discard(waiting)
            waiting = out
        block = more
    return out


def n_hit():
    return F.aggregate(SPANS, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def leak_digest(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    found = find_leaks(docs.select("doc_id", "text"), benchmark, width)
    return found.select(
        "doc_id", F.col(N_WORDS).alias("n_words"), n_hit().alias("n_hit"), F.size(ITEMS).cast("long").alias("n_items"),
        F.sha2(F.array_join(ITEMS, ",").cast("binary"), 256).alias("items_sha256"), (F.size(SPANS) > 0).alias("contaminated"),
    )


def brute_force(texts: list[str | None], items: dict[str, str], width: int = 10) -> list[tuple[int, int, list[str]]]:
    """(words, hit words, items) of each text, window by window: the specification for tests."""
    import re

    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    windows: dict[tuple, set[str]] = {}
    for item, text in items.items():
        w = split(text)
        for i in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + width]), set()).add(item)
    out = []
    for text in texts:
        w, hit, got = split(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if own := windows.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    got |= own
        out.append((len(w), len(hit), sorted(got)))
    return out


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
