"""Language ID: interpolated Kneser-Ney character models, one a language, in sorted hash arrays.

Text is lower-cased; every stretch without letters becomes one blank. An n-gram is its characters' ids packed in one
integer, spread by an invertible multiplication and stored in an ascending array with a bucket index over its high
bits. A model of order ORDER interpolates discounted counts with continuation counts of the lower orders
and, last, the uniform distribution over the alphabet. For each order the n-grams seen in any language
lie in one array beside their log-probabilities in all languages, so a character mostly costs one look-up; an
n-gram seen in none backs off, with each language's own weight of the context, to the next order.

The prediction is the language of least cross-entropy a character of the whole text. A tenth of the sample
calibrates rejection: a text is accepted if its cross-entropy is at most what own texts have, plus `spreads` times
their spread, which shrinks with the root of the length, plus a slack: a third of what the nearest other language's texts have more than own
ones, from LEAST_SLACK to MOST_SLACK nats.

Training reads a bounded sample: about SAMPLE_DOCS whole documents a language, chosen by a hash of their text among the
labelled rows, of which some SAMPLE_CHARS characters are used. It runs in one task, so that neither texts nor tables lie in the driver. The alphabet is the sample's ALPHABET most frequent
letters. Both are parameters. Predictions read every text whole.

Defined results: a text that is null or has no letter is `und` with score 0 and is rejected; equal cross-entropies go
to the first language by name; without labelled rows all texts are `und`; other columns are carried along.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textnum import code_points, slices, utf8, with_columns

ORDER = 4
SAMPLE_DOCS = 600
SAMPLE_CHARS = 1_500_000
ALPHABET = 4000
LEAST_SLACK, MOST_SLACK = 0.3, 0.5
SLICE_BYTES = 1 << 20
WIDTH = 12  # bits a character id
BLANK, UNKNOWN = 1, 2
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def mix(keys: np.ndarray) -> np.ndarray:
    """Invertible, so no two n-grams share a hash."""
    with np.errstate(over="ignore"):
        return keys.astype(np.uint64) * SPREAD


class Sorted:
    """Ascending hashes with an index over their high bits."""

    def __init__(self, keys: np.ndarray):
        h = mix(keys)
        self.order = np.argsort(h, kind="stable")
        self.h = h[self.order]
        self.shift = np.uint64(64 - max(1, int(max(1, len(h))).bit_length()))
        self.begin = np.searchsorted(self.h >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1).astype(np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 where there is none."""
        h = mix(keys)
        bucket = (h >> self.shift).astype(np.int64)
        place, stop = self.begin[bucket], self.begin[bucket + 1]
        out = np.full(len(h), -1, np.int32)
        if not len(self.h):
            return out
        at = np.arange(len(h))
        while len(at):
            on = place < stop
            at, place, stop = at[on], place[on], stop[on]
            if not len(at):
                break
            same = self.h[place] == h[at]
            out[at[same]] = place[same]
            go = ~same
            at, place, stop = at[go], place[go] + 1, stop[go]
        return out


class KneserNey:
    """One language's interpolated model, for training; probabilities by order."""

    def __init__(self, grams: list[np.ndarray], alphabet: int):
        """grams[n]: the n-grams of the sample's characters, n from 1 to the order."""
        self.alphabet, order = alphabet, len(grams) - 1
        counts: list = [None] * (order + 1)
        counts[order] = np.unique(grams[order], return_counts=True)
        for n in range(order - 1, 0, -1):  # in how many left contexts each occurs
            wider = counts[n + 1][0] if n + 1 < order else counts[order][0]
            counts[n] = np.unique(wider & ((1 << (WIDTH * n)) - 1), return_counts=True)
        self.keys, self.p, self.contexts, self.weight = [None], [None], [None], [None]
        for n in range(1, order + 1):
            keys, c = counts[n]
            once, twice = int((c == 1).sum()), int((c == 2).sum())
            d = min(0.95, max(0.1, once / (once + 2 * twice) if once else 0.5))
            context, which = np.unique(keys >> WIDTH, return_inverse=True)
            total, kinds = np.bincount(which, c), np.bincount(which)
            weight = d * kinds / total
            if n == 1:
                lower = np.full(len(keys), 1.0 / alphabet)
            else:
                lower = self.p[n - 1][np.searchsorted(self.keys[n - 1], keys & ((1 << (WIDTH * (n - 1))) - 1))]
            self.keys.append(keys)
            self.p.append((c - d) / total[which] + weight[which] * lower)
            self.contexts.append(context)
            self.weight.append(weight)

    def context_weight(self, n: int, contexts: np.ndarray) -> np.ndarray:
        """Share that order n leaves to the lower one after these contexts; all of it where they are new."""
        i = np.minimum(np.searchsorted(self.contexts[n], contexts), len(self.contexts[n]) - 1)
        return np.where(self.contexts[n][i] == contexts, self.weight[n][i], 1.0)

    def probability(self, n: int, keys: np.ndarray) -> np.ndarray:
        if n == 0:
            return np.full(len(keys), 1.0 / self.alphabet)
        i = np.minimum(np.searchsorted(self.keys[n], keys), len(self.keys[n]) - 1)
        out = np.where(self.keys[n][i] == keys, self.p[n][i], 0.0)
        new = np.flatnonzero(out == 0.0)
        if len(new):
            out[new] = self.context_weight(n, keys[new] >> WIDTH) * self.probability(n - 1, keys[new] & ((1 << (WIDTH * (n - 1))) - 1))
        return out


@dataclass
class LanguageModel:
    langs: list[str] = field(default_factory=list)
    char_ids: np.ndarray | None = None
    tables: list = field(default_factory=list)  # per order: (Sorted, log-probabilities)
    backoff: list = field(default_factory=list)  # per order: (Sorted, log-weights)
    uniform: float = 0.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    slack: np.ndarray | None = None

    @property
    def order(self) -> int:
        return len(self.tables) - 1

    def characters(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, row of each, letters a row): blanks are single, and every row begins and ends with one."""
        rows = len(offsets) - 1
        cp, at = code_points(raw)
        ids = self.char_ids[cp]
        row = np.searchsorted(offsets, at, side="right") - 1
        letters = np.bincount(row[ids != BLANK], minlength=rows)
        drop = np.zeros(len(ids), bool)
        drop[1:] = (ids[1:] == BLANK) & (ids[:-1] == BLANK) & (row[1:] == row[:-1])
        ids, row = ids[~drop], row[~drop]
        ends = np.searchsorted(row, np.arange(rows), side="right")
        begins = np.searchsorted(row, np.arange(rows), side="left")
        out = np.full(len(ids) + 2 * rows, BLANK, ids.dtype)
        own = np.repeat(np.arange(rows), ends - begins + 2)
        inner = np.ones(len(out), bool)
        inner[begins + 2 * np.arange(rows)] = False
        inner[ends + 2 * np.arange(rows) + 1] = False
        out[inner] = ids
        return out, own, letters

    def entropies(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy in nats a character [row, language], scored characters, letters)."""
        ids, row, letters = self.characters(raw, offsets)
        rows, n = len(offsets) - 1, self.order
        wide = ids.astype(np.int64)
        keys, first = wide.copy(), np.ones(len(ids), bool)
        first[1:] = row[1:] != row[:-1]
        inside = np.arange(len(ids)) - np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
        for j in range(1, n):
            back = np.full(len(ids), BLANK, np.int64)
            back[j:] = wide[:-j]
            back[inside < j] = BLANK
            keys |= back << (WIDTH * j)
        scored = ~first
        keys, own = keys[scored], row[scored]
        total = self.log_probability(keys, n)
        count = np.bincount(own, minlength=rows)
        sums = np.stack([np.bincount(own, total[:, k], minlength=rows) for k in range(len(self.langs))], 1)
        return -sums / np.maximum(count, 1)[:, None], count, letters

    def log_probability(self, keys: np.ndarray, n: int) -> np.ndarray:
        if n == 0:
            return np.full((len(keys), len(self.langs)), self.uniform, np.float32)
        index, values = self.tables[n]
        at = index.find(keys)
        out = values[at]
        new = np.flatnonzero(at < 0)
        if len(new):
            weights, logs = self.backoff[n]
            context = weights.find(keys[new] >> WIDTH)
            out[new] = np.where((context >= 0)[:, None], logs[context], 0) + self.log_probability(keys[new] & ((1 << (WIDTH * (n - 1))) - 1), n - 1)
        return out


def char_table(texts: list[str], alphabet: int) -> np.ndarray:
    """Id of every code point: blank for what is no letter, the lower-cased letter's id, or unknown."""
    seen = Counter()
    for t in texts:
        seen.update(t.lower())
    common = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if c.isalpha()][:alphabet]
    out = np.full(0x110000, BLANK, np.int16)
    ids = {c: i for i, c in enumerate(common, UNKNOWN + 1)}
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            out[code] = ids.get(c, 0) or ids.get(c.lower(), UNKNOWN)
    return out


def halves(texts: Iterable[str], chars: int) -> tuple[list[str], list[str]]:
    """(training, calibration) texts in order, of about so many characters each at most: every tenth text with letters calibrates. Each half has a text if there is one."""
    train, held, used = [], [], [0, 0]
    for i, t in enumerate(t for t in texts if any(c.isalpha() for c in t)):
        side = int(i % 10 == 9)
        if used[side] < chars:
            (train, held)[side].append(t)
            used[side] += len(t)
    return train, held or train[:1]


def fit(sample: dict[str, Iterable[str]], chars: int = SAMPLE_CHARS, **options) -> LanguageModel:
    """A model from texts by language; every tenth text calibrates."""
    return fit_halves({k: halves(v, chars) for k, v in sample.items()}, **options)


def fit_halves(parted: dict[str, tuple[list[str], list[str]]], order: int = ORDER, alphabet: int = ALPHABET) -> LanguageModel:
    """A model from (training, calibration) texts by language."""
    model = LanguageModel(langs=sorted(k for k, (own, _) in parted.items() if own))
    if not model.langs:
        return model
    train, held = {k: parted[k][0] for k in model.langs}, {k: parted[k][1] for k in model.langs}
    model.char_ids = char_table([t for v in train.values() for t in v], min(alphabet, (1 << WIDTH) - 8))
    size = int(model.char_ids.max()) + 1
    parts = []
    for k in model.langs:
        raw, offsets = utf8(pa.array(train[k], pa.large_string()))
        ids, row, _ = model.characters(raw, offsets)
        wide, first = ids.astype(np.int64), np.ones(len(ids), bool)
        first[1:] = row[1:] != row[:-1]
        inside = np.arange(len(ids)) - np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
        grams, keys = [None], wide.copy()
        for n in range(1, order + 1):
            if n > 1:
                back = np.full(len(ids), BLANK, np.int64)
                back[n - 1 :] = wide[: -(n - 1)]
                back[inside < n - 1] = BLANK
                keys = keys | (back << (WIDTH * (n - 1)))
            grams.append(keys[~first])
        parts.append(KneserNey(grams, size))
    model.uniform = -float(np.log(size))
    model.tables, model.backoff = [None], [None]
    for n in range(1, order + 1):
        for kind, out in (("keys", model.tables), ("contexts", model.backoff)):
            union = np.unique(np.concatenate([getattr(p, kind)[n] for p in parts]))
            index = Sorted(union)
            union = union[index.order]
            values = [p.probability(n, union) if kind == "keys" else p.context_weight(n, union) for p in parts]
            index.order = None
            out.append((index, np.log(np.stack(values, 1)).astype(np.float32)))
    mean, spread, under = [], [], []
    for i, k in enumerate(model.langs):
        raw, offsets = utf8(pa.array(held[k], pa.large_string()))
        e, n, _ = model.entropies(raw, offsets)
        under.append((e * n[:, None]).sum(0) / n.sum())  # of k's texts, by each model
        mean.append(float(under[i][i]))
        spread.append(float(np.sqrt(np.mean(((e[:, i] - mean[i]) ** 2) * n))))
    model.mean, model.spread = np.array(mean), np.maximum(np.array(spread), 0.5)
    foreign = np.stack(under) + np.where(np.eye(len(mean)), np.inf, 0)
    model.slack = np.clip((foreign.min(0) - model.mean) / 3, LEAST_SLACK, MOST_SLACK)
    return model


class Packed:
    """A fitted model as bytes, which the driver passes on; a worker unpacks them once."""

    def __init__(self, data: bytes):
        self.data, self.model = data, None

    def __getstate__(self) -> dict:
        return {"data": self.data, "model": None}

    def unpacked(self) -> LanguageModel:
        if self.model is None:
            self.model = pickle.loads(self.data)
        return self.model


def sample_of(docs: DataFrame, labelled: Column, text_col: str, lang_col: str, docs_a_lang: int) -> DataFrame | None:
    """(lang, h, text): about docs_a_lang whole texts of each language among the rows where labelled holds, chosen by the hash h. None without labelled rows."""
    rows = docs.where(labelled & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, docs_a_lang / n))])
    unit = F.pmod(F.xxhash64(F.col(text_col), F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.where(F.col(text_col).isNotNull() & (unit < share[F.col(lang_col)])).select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    # texts with many copies may exceed their share: equal texts count once
    return chosen.dropDuplicates(["lang", "h"])


def train(docs: DataFrame, labelled: Column, text_col: str = "text", lang_col: str = "lang", docs_a_lang: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, **options) -> Packed:
    """Fits a model in one task, which reads the bounded sample in order and holds so many characters a language; the driver gets the model's bytes."""
    sample = sample_of(docs, labelled, text_col, lang_col, docs_a_lang)
    if sample is None:
        return Packed(pickle.dumps(LanguageModel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, t) for batch in batches for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        model = fit_halves({k: halves((t for _, t in own), chars) for k, own in groupby(rows, key=lambda x: x[0])}, **options)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    ordered = sample.repartition(1).sortWithinPartitions("lang", "h").select("lang", "text")
    return Packed(bytes(ordered.mapInArrow(run, "model binary").first()[0]))


def identify(docs: DataFrame, model: LanguageModel | Packed, text_col: str = "text", spreads: float = 8.0) -> DataFrame:
    """docs with lang_pred, score, entropy (nats a character, null for `und`) and accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(model if isinstance(model, Packed) else Packed(pickle.dumps(model)))
    add = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("entropy", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    schema = T.StructType([*[f for f in docs.schema.fields if f.name not in {a.name for a in add}], *add])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.unpacked()
        for batch in batches:
            raw, offsets = utf8(batch.column(text_col))
            for i, j in slices(offsets, SLICE_BYTES):
                n = j - i
                names, score, entropy, accepted = ["und"] * n, np.zeros(n), np.full(n, np.nan), np.zeros(n, bool)
                if m.langs:
                    e, chars, letters = m.entropies(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    best = e.argmin(1)
                    own, real = e[np.arange(n), best], letters > 0
                    # share of the winner when each language's odds fall by e**-8 a nat a character
                    share = 1 / np.exp(-8 * np.minimum(e - own[:, None], 80)).sum(1)
                    limit = m.mean[best] + spreads * m.spread[best] / np.sqrt(np.maximum(chars, 1)) + m.slack[best]
                    names = [m.langs[b] if ok else "und" for b, ok in zip(best, real, strict=True)]
                    score, accepted = np.where(real, share, 0.0), real & (own <= limit)
                    entropy = np.where(real, own, np.nan)
                yield with_columns(
                    batch.slice(i, n), lang_pred=pa.array(names, pa.string()), score=pa.array(score, pa.float64()),
                    entropy=pa.array(entropy, pa.float64(), mask=np.isnan(entropy)), accepted=pa.array(accepted, pa.bool_()),
                )

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0


def predictions(docs: DataFrame) -> DataFrame:
    model = train(docs, ~held_out())
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "entropy", "accepted")
