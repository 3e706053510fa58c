"""Byte-level BPE encoding and decoding on length-bucketed padded numpy matrices.

Texts are cut into pieces by the pre-tokenisation pattern, each distinct piece of a slice is encoded once: pieces of
similar byte length are rows of one padded matrix of token ids, and in every round each row merges its leftmost
pair of minimum rank; pair ranks come from a hash table with linear probing, probed for all rows at once;
merged cells are compacted to the left and finished rows leave. Pieces over MATRIX_BYTES, which would
need a round a merge, are merged by a priority queue with the same result.

Encoded pieces stay in a cache of at most CACHE_PIECES a worker, keyed by 64-bit hash. Every row is decoded again and
compared with its bytes, and a row that a hash collision had changed is encoded anew without the cache. The work on
a batch goes in slices of SLICE_BYTES, so memory is bounded by the longest text.

The vocabulary file's path and the pattern are parameters; the file is read on the driver and broadcast
(some 50,000 tokens, about 10 MB). The usual pattern is matched by run boundaries in numpy, any other by the regex module.

Defined results: null and empty text have no tokens; no special tokens are recognised in texts; other columns are
carried along; repeated rows give equal results; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textnum import K1, code_points, slices, utf8, with_columns, word_hashes

SLICE_BYTES = 1 << 20
CACHE_PIECES = 800_000
MATRIX_BYTES = 256
PIECE_SEED = 7
NONE = np.int32(2**31 - 1)

#: The pre-tokenisation pattern that pieces_by_runs() follows.
RUNS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """(left id, right id) -> rank of the joined bytes, in a hash table with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    values.append(rank)
        keys, values = np.array(keys, np.uint64), np.array(values, np.int32)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1), np.uint64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] == np.uint64(2**64 - 1)
            winner, first = np.unique(slot[left][free], return_index=True)
            put = left[free][first]
            self.keys[winner], self.values[winner] = keys[put], values[put]
            placed = np.zeros(len(keys), bool)
            placed[put] = True
            left = left[~placed[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * K1) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where there is none or a cell is padding (-1)."""
        key = (a.astype(np.int64).astype(np.uint64) << np.uint64(32)) | (b.astype(np.int64) & 0xFFFFFFFF).astype(np.uint64)
        slot, out = self._slot(key), np.full(len(key), NONE, np.int32)
        held = self.keys[slot]
        same = held == key
        out[same] = self.values[slot[same]]
        at = np.flatnonzero(~same & (held != np.uint64(2**64 - 1)))
        while len(at):
            slot[at] = (slot[at] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[at]]
            same = held == key[at]
            out[at[same]] = self.values[slot[at[same]]]
            at = at[~same & (held != np.uint64(2**64 - 1))]
        return out


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        by_rank = {r: t for t, r in ranks.items()}
        size = np.array([len(by_rank.get(i, b"")) for i in range(max(by_rank) + 1)], np.int64)
        self.token_size = size
        self.token_start = np.concatenate([[0], np.cumsum(size)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(by_rank.get(i, b"") for i in range(len(size))), np.uint8)
        self.classes = char_classes() if pattern == RUNS_PATTERN else None
        own = np.flatnonzero(size)
        hashes = word_hashes(self.token_bytes, self.token_start[own], self.token_start[own] + size[own], seed=PIECE_SEED)
        order = np.argsort(hashes)
        self.whole_hashes, self.whole_ids = hashes[order], own[order].astype(np.int32)

    def whole(self, h: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Ids of pieces that are tokens, by hash and length, -1 for the others."""
        at = np.minimum(np.searchsorted(self.whole_hashes, h), len(self.whole_hashes) - 1)
        ids = self.whole_ids[at]
        return np.where((self.whole_hashes[at] == h) & (self.token_size[ids] == size), ids, -1).astype(np.int32)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids, joined."""
        return gather(self.token_bytes, self.token_start[ids], self.token_size[ids])


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start:start+size] of each, joined."""
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    return flat[np.repeat(start - end + size, size) + np.arange(total)]


def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
        out[[ord(c) for c in regex.findall(pattern, every)]] = kind
    return out


def pieces_by_runs(raw: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """First bytes of the pieces of RUNS_PATTERN; pieces fill the texts without gaps.

    A piece begins where the class of the character changes, with three exceptions: a blank before another class
    belongs to what follows; the last character of white space before other text stands alone unless it is such a blank;
    an apostrophe that begins a piece and is followed by s, t, m, d, re, ve or ll makes a piece with it.
    """
    if not len(raw):
        return np.zeros(0, np.int64)
    cp, at = code_points(raw)
    kind = classes[cp]
    n = len(cp)
    text_first = np.zeros(n, bool)
    heads = offsets[:-1][np.diff(offsets) > 0]
    text_first[np.searchsorted(at, heads)] = True
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= text_first
    cut = change.copy()
    # the last white-space character before other text of the same row: a piece begins there
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~text_first[1:]
    cut |= last
    # a blank there takes what follows along
    joined = np.flatnonzero(last & (cp == 32)) + 1
    cut[joined] = False
    # contractions
    for i in np.flatnonzero((cp == 39) & cut):
        j = i + 1
        if j >= n or text_first[j]:
            continue
        size = 2 if cp[j] in (115, 116, 109, 100) else 0
        if not size and j + 1 < n and not text_first[j + 1]:
            size = 3 if (int(cp[j]), int(cp[j + 1])) in ((114, 101), (118, 101), (108, 108)) else 0
        if size:
            cut[i + 1 : i + size] = False
            if i + size < n:
                cut[i + size] = cut[i + size] or kind[i + size] != SPACE or change[i + size]
    return at[cut]


def pieces_by_pattern(raw: np.ndarray, offsets: np.ndarray, pattern: str) -> np.ndarray:
    """The same for any pattern whose matches fill the text."""
    import regex

    found, out = regex.compile(pattern), []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        place = int(a)
        for m in found.findall(raw[a:b].tobytes().decode("utf-8", "replace")):
            out.append(place)
            place += len(m.encode())
        if place != b:
            raise ValueError("the pattern leaves out part of a text")
    return np.array(out, np.int64)


def merge_matrix(cells: np.ndarray, size: np.ndarray, pairs: PairTable) -> None:
    """Merges rows of ids in place, padded with -1; size becomes each row's ids."""
    rows = np.arange(len(cells))
    work = cells.copy()
    left, right = work[:, :-1], work[:, 1:]
    rank = pairs.look_up(left.ravel(), right.ravel()).reshape(left.shape)
    rank[right < 0] = NONE
    while len(rows):
        p = rank.argmin(1)
        here = np.arange(len(rows))
        best = rank[here, p]
        stop = best == NONE
        if stop.any():
            done = rows[stop]
            cells[done, : work.shape[1]] = work[stop]
            cells[done, work.shape[1] :] = -1
            go = ~stop
            rows, work, rank, p, best = rows[go], work[go], rank[go], p[go], best[go]
            if not len(rows):
                break
            here = np.arange(len(rows))
        width = work.shape[1]
        work[here, p] = best
        size[rows] -= 1
        column = np.arange(width - 1)
        take = column + (column > p[:, None])
        work = np.take_along_axis(work, take, 1)  # one cell fewer in every row: compaction
        if width == 2:
            cells[rows, :1], cells[rows, 1:] = work, -1
            break
        column = column[:-1]
        rank = np.take_along_axis(rank, column + (column >= p[:, None]), 1) if width > 2 else rank
        has = p < width - 2
        r = here[has]
        rank[r, p[has]] = np.where(work[r, p[has] + 1] >= 0, pairs.look_up(work[r, p[has]], work[r, p[has] + 1]), NONE)
        has = p > 0
        r = here[has]
        rank[r, p[has] - 1] = pairs.look_up(work[r, p[has] - 1], work[r, p[has]])


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """One long piece by a queue of (rank, place): the lowest rank first, the leftmost among equals."""
    n = len(piece)
    end = list(range(1, n + 1))  # end[i] of the part that begins at i
    before = list(range(-1, n - 1))
    alive = [True] * n
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        gone = end[i]
        alive[gone] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(queue, (r, i, end[stop]))
        if before[i] >= 0 and (r := ranks.get(piece[before[i] : stop])) is not None:
            heapq.heappush(queue, (r, before[i], stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def encode_pieces(raw: np.ndarray, start: np.ndarray, size: np.ndarray, vocabulary: Vocabulary, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids joined, ids a piece) of raw[start:start+size]. Pieces that are tokens are known by the hashes h, or without them by their bytes."""
    whole = vocabulary.whole(h, size) if h is not None else np.array([vocabulary.ranks.get(raw[s : s + n].tobytes(), -1) for s, n in zip(start, size, strict=True)], np.int32)
    counts = np.ones(len(start), np.int64)
    todo = np.flatnonzero(whole < 0)
    found: list[tuple[np.ndarray, np.ndarray]] = []  # (pieces, padded ids)
    least = 1
    while least < MATRIX_BYTES:
        own = todo[(size[todo] > least) & (size[todo] <= 2 * least)]
        for i in range(0, len(own), max(1, (1 << 20) // (2 * least))):
            rows = own[i : i + max(1, (1 << 20) // (2 * least))]
            column = np.arange(2 * least)
            inside = column < size[rows][:, None]
            cells = np.where(inside, vocabulary.byte_ids[raw[np.minimum(start[rows][:, None] + column, len(raw) - 1)]], -1).astype(np.int32)
            n = size[rows].copy()
            merge_matrix(cells, n, vocabulary.pairs)
            counts[rows] = n
            found.append((rows, cells))
        least *= 2
    long_ = {int(i): merge_long(raw[start[i] : start[i] + size[i]].tobytes(), vocabulary.ranks) for i in todo[size[todo] > MATRIX_BYTES]}
    for i, ids in long_.items():
        counts[i] = len(ids)
    first = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int32)
    one = whole >= 0
    out[first[one]] = whole[one]
    for rows, cells in found:
        on = cells >= 0
        out[(first[rows][:, None] + np.arange(cells.shape[1]))[on]] = cells[on]
    for i, ids in long_.items():
        out[first[i] : first[i] + len(ids)] = ids
    return out, counts


class Encoder:
    """A worker's encoder with its cache of pieces: sorted hashes, and where their ids lie."""

    def __init__(self, vocabulary: Vocabulary, cache_pieces: int = CACHE_PIECES):
        self.v, self.most = vocabulary, cache_pieces
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.first, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _pieces(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return pieces_by_runs(raw, offsets, self.v.classes) if self.v.classes is not None else pieces_by_pattern(raw, offsets, self.v.pattern)

    def encode(self, raw: np.ndarray, offsets: np.ndarray, prove: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids joined, offsets of the rows in them); without proof two pieces could share a hash (2**-64 a pair)."""
        start = self._pieces(raw, offsets)
        size = np.diff(np.append(start, len(raw)))
        h, place, piece = np.unique(word_hashes(raw, start, start + size, seed=PIECE_SEED), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, h)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == h[known]
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.hashes) + len(new) > self.most:
                self._forget()
                new = np.arange(len(h))
            ids, count = encode_pieces(raw, start[place[new]], size[place[new]], self.v, h[new])
            into = np.searchsorted(self.hashes, h[new])  # both ascend: they merge in one pass
            self.hashes = np.insert(self.hashes, into, h[new])
            self.first = np.insert(self.first, into, len(self.ids) + np.cumsum(count) - count)
            self.count = np.insert(self.count, into, count)
            self.ids = np.concatenate([self.ids, ids])
            at = np.searchsorted(self.hashes, h)
        at = at[piece]
        ids = gather(self.ids, self.first[at], self.count[at])
        ends = np.concatenate([[0], np.cumsum(self.count[at])])
        rows = ends[np.searchsorted(start, offsets)]
        return self._proved(raw, offsets, ids, rows) if prove else (ids, rows)

    def _proved(self, raw: np.ndarray, offsets: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        back = self.v.decode(ids)
        if len(back) == len(raw) and (back == raw).all():
            return ids, rows
        parts = []
        for k in range(len(offsets) - 1):  # two pieces share a hash: those rows without the cache
            own, text = ids[rows[k] : rows[k + 1]], raw[offsets[k] : offsets[k + 1]]
            if self.v.decode(own).tobytes() != text.tobytes():
                start = self._pieces(text, np.array([0, len(text)]))
                own, _ = encode_pieces(text, start, np.diff(np.append(start, len(text))), self.v)
            parts.append(own)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


_ENCODERS: dict[int, Encoder] = {}


def worker_encoder(shared) -> Encoder:
    """One encoder a worker and broadcast, whose cache outlives a task."""
    if shared.value.key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.value.key] = Encoder(shared.value)
    return _ENCODERS[shared.value.key]


def shared_vocabulary(spark, path: str, pattern: str):
    v = Vocabulary(read_ranks(path), pattern)
    v.key = hash((path, pattern, len(v.ranks)))
    return spark.sparkContext.broadcast(v)


def usual_vocabulary() -> tuple[str, str]:
    """(path, pattern) of the public 50k vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _digests(batches: Iterator[pa.RecordBatch], shared, text_col: str, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder = worker_encoder(shared)
    for batch in batches:
        raw, offsets = utf8(batch.column(text_col))
        for i, j in slices(offsets, SLICE_BYTES):
            own = offsets[i : j + 1] - offsets[i]
            ids, rows = encoder.encode(raw[offsets[i] : offsets[j]], own)
            back = encoder.v.decode(ids).tobytes()
            sizes = np.concatenate([[0], np.cumsum(encoder.v.token_size[ids])])[rows]
            flat = ids.astype("<u4")
            columns = {
                "n_tokens": pa.array(np.diff(rows), pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(rows[:-1], rows[1:], strict=True)], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(sizes[:-1], sizes[1:], strict=True)], pa.string()),
            }
            if keep_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids, pa.int32()))
            yield with_columns(batch.slice(i, j - i), **columns)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids; columns of these names are replaced."""
    usual = usual_vocabulary() if path is None or pattern is None else ("", "")
    shared = shared_vocabulary(docs.sparkSession, path or usual[0], pattern or usual[1])
    add = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    add += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []
    schema = T.StructType([*[f for f in docs.schema.fields if f.name not in {a.name for a in add}], *add])
    return docs.mapInArrow(lambda batches: _digests(batches, shared, text_col, keep_ids), schema)


def decode_documents(encoded: DataFrame, path: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with out_col: the bytes of the ids. Null ids give null."""
    shared = shared_vocabulary(encoded.sparkSession, path or usual_vocabulary()[0], RUNS_PATTERN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [None if x is None else shared.value.decode(np.array(x, np.int64)).tobytes() for x in batch.column(ids_col).to_pylist()]
            yield with_columns(batch, **{out_col: pa.array(got, pa.binary())})

    schema = T.StructType([*[f for f in encoded.schema.fields if f.name != out_col], T.StructField(out_col, T.BinaryType())])
    return encoded.mapInArrow(run, schema)
