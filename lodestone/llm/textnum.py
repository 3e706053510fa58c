"""Texts of Arrow batches as numpy arrays: bytes, words and 64-bit word hashes, without a Python object a word."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Masks that keep the first n bytes of a little-endian load.
HEAD = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
LONG_WORD = 2048


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive row ranges of at most `most` bytes each; a longer row is a range of its own."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        out.append((i, j))
        i = j
    return out


def byte_table(word_bytes, lower: bool = True) -> np.ndarray:
    """256 entries: the (lower-cased) byte for word bytes, 0 for all others. Byte 0 is never a word byte here."""
    lut = np.zeros(256, np.uint8)
    for b in word_bytes:
        lut[b] = b + 32 if lower and 65 <= b <= 90 else b
    return lut


#: Words of letters, digits and all that is not ASCII, lower-cased A-Z.
ALNUM = byte_table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])


def word_bounds(w: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row of each word) where w is 0 between words; words end with their row."""
    n = len(w)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    on = w != 0
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1]
    last[:-1] &= ~on[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = on[edge]
    last[edge - 1] = on[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(w: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of w[start:end], eight bytes at a time over all words that are that long."""
    size = ends - starts
    padded = np.concatenate([w, np.zeros(8, np.uint8)])
    loads = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(w) + 1, 8), (1, 1))
    h = (size.astype(np.uint64) + np.uint64(seed)) * K2
    at = np.arange(len(starts)) if len(starts) else np.zeros(0, np.int64)
    step = 0
    with np.errstate(over="ignore"):
        while len(at):
            more = size[at] > step
            if not more.all():
                at = at[more]
            if not len(at):
                break
            if step >= LONG_WORD:  # rest of very long words, one by one
                for i in at:
                    rest = hashlib.blake2b(w[starts[i] + step : ends[i]].tobytes(), digest_size=8).digest()
                    h[i] = (h[i] ^ np.uint64(int.from_bytes(rest, "little"))) * K1
                break
            x = np.ascontiguousarray(loads[starts[at] + step]).view(np.uint64).ravel() & HEAD[np.minimum(size[at] - step, 8)]
            y = (h[at] ^ x) * K1
            h[at] = y ^ (y >> np.uint64(29))
            step += 8
        h *= K2
        return h ^ (h >> np.uint64(32))


def words(column, lut: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of every word of a string column."""
    raw, offsets = utf8(column)
    w = lut[raw]
    starts, ends, rows = word_bounds(w, offsets)
    return word_hashes(w, starts, ends, seed), rows, starts, ends


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code point, place of its first byte) of UTF-8 bytes."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    lead = raw[at]
    cp = lead.astype(np.int32)
    for least, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        own = np.flatnonzero((lead >= least) & (lead < {1: 0xE0, 2: 0xF0, 3: 0xF8}[more]))
        if len(own):
            value = (lead[own] & mask).astype(np.int32)
            for k in range(1, more + 1):
                value = (value << 6) | (raw[np.minimum(at[own] + k, len(raw) - 1)] & 0x3F)
            cp[own] = np.minimum(value, 0x10FFFF)
    return cp, at


def with_columns(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    """The batch with columns added; one of the same name is replaced."""
    names = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *columns.values()], names=[*names, *columns])
