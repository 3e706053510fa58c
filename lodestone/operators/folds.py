"""Order-dependent steps that no window expresses: per-document folds.

Small states fold inside the plan (aggregate over a sorted array); larger ones stream through Arrow batches sorted by group, or run
as grouped pandas, a document at a time. A document is the largest unit that a task holds.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..config import EngineConfig, SECTION_LABELS, SECTIONS


def greedy_statements(rows: DataFrame, keys: list[str], order: str, key: str) -> DataFrame:
    """(keys.., kept): by group, the canonical keys that are near-duplicates of none before them, in order. A group's rows stream through one task, which holds what it keeps."""
    width = len(keys)
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("kept", T.ArrayType(T.StringType()))])
    arrow = [to_arrow_type(rows.schema[k].dataType) for k in keys]

    def run(batches):
        group, said = None, SaidBefore()

        def out():
            return pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip(group, arrow, strict=True)], pa.array([said.keys], pa.list_(pa.string()))], names=schema.names)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:width] != group:
                    if group is not None:
                        yield out()
                    group, said = row[:width], SaidBefore()
                if row[width] and said.first(row[width]) is None:
                    said.add(row[width])
        if group is not None:
            yield out()

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).select(*keys, key).mapInArrow(run, schema)


def streamed(rows: DataFrame, keys: list[str], order: list[Column], pick: Callable[[], Callable[..., int | None]], columns: list[str], number: str | None = None, together: bool = False) -> DataFrame:
    """Rows that a fold keeps. A group's rows pass in order through pick(), made anew for each group, as the values of columns; it gives a row's number, from 1, None where
    the row goes, or 0 where it and the rest of its group go. number: the column that gets it. together: each group's rows are in one partition already."""
    schema = rows.schema if number is None else rows.withColumn(number, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, one = object(), None
        for batch in batches:
            kept, numbers = [], []
            values = [batch.column(c) for c in columns]
            for i, own in enumerate(zip(*[batch.column(k).to_pylist() for k in keys], strict=True)):
                if own != group:
                    group, one = own, pick()
                if one is None:
                    continue
                n = one(*[c[i].as_py() for c in values])
                if n:
                    kept.append(i)
                    numbers.append(n)
                elif n == 0:
                    one = None
            out = batch.take(pa.array(kept, pa.int64())).columns
            yield pa.RecordBatch.from_arrays(out if number is None else [*out, pa.array(numbers, pa.int64())], names=schema.names)

    return (rows if together else rows.repartition(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def canonical(text: str | None) -> str:
    """functions.text.canonical of a text, for folds that need the keys of few rows."""
    return " ".join(CANONICAL.findall((text or "").lower()))


CANONICAL = re.compile(r"[a-z0-9]+(?:\.[0-9]+)?")


class SaidBefore:
    """Canonical keys in the order they came, and which of them say the same as a new one.

    The relation is that of functions.similarity.near_duplicate. Up to FEW keys are compared one by one. Of more, word overlaps come from an
    index of words. Where one key holds another of three words or more, it has that one's second word as a whole, and keys with a long common
    beginning share their first nine words, so these are looked up as well; only keys of one or two words are compared with all.
    """

    FEW = 32

    def __init__(self):
        self.keys: list[str] = []
        self.words: list[list[str]] = []
        self.sets: list[set[str]] = []
        self.kinds = array("q")
        self.holders: dict[str, array] = {}
        self.inner: dict[str, list[int]] = {}
        self.short: list[int] = []
        self.begins: dict[tuple, list[int]] = {}
        self.gone: set[int] = set()

    def add(self, key: str) -> int:
        """The key's place."""
        place, words = len(self.keys), key.split(" ")
        self.keys.append(key)
        self.words.append(words)
        if place < self.FEW:
            self.sets.append(set(words))
            return place
        if self.sets:
            for p in range(place):
                self._index(p)
            self.sets = []
        self._index(place)
        return place

    def _index(self, place: int) -> None:
        words = self.words[place]
        kinds = set(words)
        self.kinds.append(len(kinds))
        for w in kinds:
            self.holders.setdefault(w, array("q")).append(place)
        if len(words) < 3:
            self.short.append(place)
        else:
            self.inner.setdefault(words[1], []).append(place)
        if len(words) >= 10:
            self.begins.setdefault(tuple(words[:9]), []).append(place)

    def _same(self, key: str, words: list[str], kinds: set[str], place: int) -> bool:
        """Whether this key and the one there, of the first FEW, say the same; neither is empty."""
        other, own = self.keys[place], self.sets[place]
        if key in other or other in key:
            return True
        most, least = max(len(kinds), len(own)), min(len(kinds), len(own))
        if least / most >= 0.56:
            both = len(kinds & own)
            if both / most >= 0.82 or (both / least >= 0.90 and both / most >= 0.56):
                return True
        there = self.words[place]
        short = min(len(words), len(there))
        return short >= 10 and words[:9] == there[:9] and len(commonprefix([words, there])) / short >= 0.86

    def drop(self, place: int) -> None:
        self.gone.add(place)

    def _holding(self, key: str, words: list[str], kinds: set[str]):
        """Places of keys that may hold this one or be held by it."""
        if len(words) < 3:
            yield from range(len(self.keys))
            return
        yield from min((self.holders.get(w, ()) for w in words[1:-1]), key=len)
        yield from self.short
        for w in kinds:
            yield from self.inner.get(w, ())

    def alike(self, key: str) -> list[int]:
        """Places of the keys that say the same, in order; none for an empty key."""
        if not key or not self.keys:
            return []
        words = key.split(" ")
        kinds, n = set(words), len(self.keys)
        if self.sets:
            return [p for p in range(n) if self.keys[p] and p not in self.gone and self._same(key, words, kinds, p)]
        found = [np.array(self.holders[w]) for w in kinds if w in self.holders]
        shared = np.bincount(np.concatenate(found), minlength=n) if found else np.zeros(n)
        sizes = np.array(self.kinds)
        of_larger, of_smaller = shared / np.maximum(sizes, len(kinds)), shared / np.minimum(sizes, len(kinds))
        same = set(np.flatnonzero((of_larger >= 0.82) | ((of_smaller >= 0.90) & (of_larger >= 0.56))).tolist())
        same.update(p for p in self._holding(key, words, kinds) if key in self.keys[p] or self.keys[p] in key)
        for p in self.begins.get(tuple(words[:9]), ()) if len(words) >= 10 else ():
            if len(commonprefix([words, self.words[p]])) / min(len(words), len(self.words[p])) >= 0.86:
                same.add(p)
        return sorted(p for p in same if p not in self.gone and self.keys[p])

    def first(self, key: str) -> int | None:
        if self.sets and key:
            words = key.split(" ")
            kinds = set(words)
            return next((p for p, other in enumerate(self.keys) if other and p not in self.gone and self._same(key, words, kinds, p)), None)
        return next(iter(self.alike(key)), None)


#: How columns of merged items combine: unions of lists, the greater number, both flags, the first that isn't empty.
UNIONS, GREATEST, BOTH, FIRST_SAID = ("refs", "flags"), ("confidence", "section_confidence"), ("is_untrusted",), ("anchor", "section_source", "result_evidence_type")
MOST_REFS = 8


def joined_item(old: dict, new: dict) -> dict:
    """The old item with what the new one adds."""
    out = dict(old)
    for c in UNIONS:
        if c in old:
            out[c] = list(dict.fromkeys([*(old[c] if old[c] is not None else ()), *(new[c] if new[c] is not None else ())]))[:MOST_REFS]
    out |= {c: max(old[c], new[c]) for c in GREATEST if c in old} | {c: bool(old[c] and new[c]) for c in BOTH if c in old} | {c: old[c] or new[c] for c in FIRST_SAID if c in old}
    if len(new["statement"].strip()) > len(old["statement"].strip()):
        out["statement"] = new["statement"].strip()
    return out


def merge_items(rows: DataFrame, keys: list[str], limit: int = 10**9) -> DataFrame:
    """Items (keys.., ord, key, statement, confidence, and any of the columns named above) merged by group, in order of ord.

    An item whose key is there already joins that item in its place. Else it joins the first near-duplicate, in its place too unless the
    newcomer's confidence is strictly higher: then the joined item moves to the end, under the newcomer's key. What is joined keeps the
    older one's fields and lists its references first; empty keys are left out. place: 0.. in the merged order.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        said, items, at = SaidBefore(), {}, {}
        for row in pdf.sort_values("ord").to_dict("records"):
            key = row["key"]
            if not key:
                continue
            place = at.get(key)
            if place is None and (place := said.first(key)) is None:
                items[at.setdefault(key, said.add(key))] = row
                continue
            both = joined_item(items[place], row)
            if key != said.keys[place] and row["confidence"] > items[place]["confidence"]:
                del items[place], at[said.keys[place]]
                said.drop(place)
                place = at[key] = said.add(key)
            items[place] = {**both, "key": said.keys[place]}
        out = pd.DataFrame(list(items.values())[:limit], columns=pdf.columns)
        out["place"] = range(len(out))
        return out

    return rows.groupBy(*keys).applyInPandas(merge, rows.withColumn("place", F.lit(0).cast("long")).schema)


def cross_section_winners(rows: DataFrame, document: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Drops items (document, section, ord, key, score) that say what another section's item says better.

    Over the sections in order an item joins the first cluster whose first key is alike, or begins one. A cluster's winner has the
    highest score, then the earlier section, then the lower place; all others go. A section in config.min_keep that had at least so many
    items and is left with fewer gets its best losers back. Items with an empty key stay as they are.
    """
    rank = {s: i for i, s in enumerate(SECTIONS)}
    schema = rows.schema
    arrow = [to_arrow_type(f.dataType) for f in schema]
    at = [schema.names.index(c) for c in (document, "section", "ord", "key", "score")]

    def pick(held: list[tuple]) -> list[tuple]:
        items = sorted((rank.get(r[at[1]], 9), r[at[2]], i) for i, r in enumerate(held) if r[at[3]])
        said, cluster = SaidBefore(), []
        for _, _, i in items:
            place = said.first(held[i][at[3]])
            cluster.append(said.add(held[i][at[3]]) if place is None else place)
        best_first = sorted((-held[i][at[4]], k, o, i, c) for (k, o, i), c in zip(items, cluster, strict=True))
        stay, won = set(), set()
        for *_, i, c in best_first:
            if c not in won:
                won.add(c)
                stay.add(i)
        for section, least in config.min_keep.items():
            own = [i for *_, i, _ in best_first if held[i][at[1]] == section]
            lost = [i for i in own if i not in stay]
            kept = len(own) - len(lost)
            if len(own) >= least > kept:
                stay.update(lost[: least - kept])
        return [r for i, r in enumerate(held) if not r[at[3]] or i in stay]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(arrow)], names=schema.names)

        current, held, out = object(), [], []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[at[0]] != current:
                    out += pick(held)
                    current, held = row[at[0]], []
                held.append(row)
            yield sent(out)
            out = []
        yield sent(pick(held))

    return rows.repartition(document).sortWithinPartitions(document).mapInArrow(run, schema)


def assign_slots(candidates: DataFrame, document: str, slots: list[str], reuse_anchor: bool = True) -> DataFrame:
    """Greedy slots (document, slot, statement, anchor, idx) from candidates (document, slot, idx, anchor, key, statement, score).

    A slot takes its best candidate whose index, anchor and statement no slot has yet; a second pass lets anchors repeat.
    """

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["score", "idx"], ascending=[False, True]).to_dict("records")
        used, anchors, said, out = set(), set(), SaidBefore(), {}
        for again in (False, True) if reuse_anchor else (False,):
            for slot in slots:
                if slot in out:
                    continue
                for r in rows:
                    if r["slot"] != slot or r["score"] <= 0 or r["idx"] in used or (not again and r["anchor"] in anchors) or said.first(r["key"]) is not None:
                        continue
                    out[slot] = r
                    used.add(r["idx"])
                    anchors.add(r["anchor"])
                    said.add(r["key"])
                    break
        name = pdf[document].iloc[0]
        return pd.DataFrame(
            [(name, s, out[s]["statement"] if s in out else "", out[s]["anchor"] if s in out else "", int(out[s]["idx"]) if s in out else -1, "found" if s in out else "not_found") for s in slots],
            columns=[document, "slot", "statement", "anchor", "idx", "status"],
        )

    kind = candidates.schema[document].dataType.simpleString()
    return candidates.groupBy(document).applyInPandas(assign, f"{document} {kind}, slot string, statement string, anchor string, idx long, status string")


def quota_sample(rows: DataFrame, document: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Sentences (document, chunk, pos, section, sentence, key) in order, up to each section's quota and per_chunk of a chunk; equal keys once."""

    def sample() -> Callable[..., int | None]:
        left, taken, seen = dict(config.quotas), {}, set()

        def one(section: str, chunk: int, key: str) -> int | None:
            if left.get(section, 0) <= 0 or taken.get(chunk, 0) >= config.per_chunk or key in seen:
                return None
            left[section] -= 1
            taken[chunk] = taken.get(chunk, 0) + 1
            seen.add(key)
            return len(seen)

        return one

    return streamed(rows, [document], [F.col("chunk"), F.col("pos")], sample, ["section", "chunk", "key"])


ORDER = {s: i for i, s in enumerate(SECTION_LABELS)}


def smooth_sections(rows: DataFrame, document: str, margin: float = 0.08) -> DataFrame:
    """Sequential smoothing of section votes (document, ord, position, best, best_score, second_score, explicit).

    Carries the previous label: late sections don't go back without an explicit sign, a step back needs a clear lead, and a margin
    under the limit is unknown.
    """

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord").copy()
        previous, labels, flags = "", [], []
        for r in pdf.itertuples():
            label, flag = r.best, ""
            if not label or r.best_score <= 0:
                label = "unknown"
            elif not r.explicit and ((previous == "conclusion" and label != "conclusion") or (previous == "discussion" and label in SECTIONS[:3])):
                label, flag = previous, "late_lock"
            elif previous and ORDER.get(label, 9) < ORDER.get(previous, 0) and r.position >= 0.45 and r.best_score - r.second_score < margin + 0.048 and not r.explicit:
                label, flag = previous, "no_step_back"
            elif r.best_score - r.second_score < margin:
                label, flag = "unknown", "thin_margin"
            labels.append(label)
            flags.append(flag)
            previous = label if label != "unknown" else previous
        return pdf.assign(label=labels, flag=flags)

    return rows.groupBy(document).applyInPandas(smooth, rows.withColumn("label", F.lit("")).withColumn("flag", F.lit("")).schema)


def event_gap_filter(rows: DataFrame, key: str, seconds: float = 2.0) -> DataFrame:
    """Events (key, ts, event_id) that come at least so long after the last one kept of their key.

    What is kept depends on all that came before, so a key's events pass through one task; they do so sorted, and a task holds no more than the
    time of the last one kept. Events without a time come first and are kept only where no other was.
    """
    far, kinds = int(seconds * 1e6), [rows.schema[c].dataType for c in (key, "event_id")]

    def run(batches):
        current, last = object(), None
        for batch in batches:
            keys, times, keep = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for i, (k, t) in enumerate(zip(keys, times, strict=True)):
                if k != current:
                    current, last = k, None
                    keep.append(i)
                elif last is None or t - last >= far:
                    keep.append(i)
                else:
                    continue
                last = t
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    each = rows.select(key, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return each.repartition(key).sortWithinPartitions(key, "us", "event_id").mapInArrow(run, T.StructType([T.StructField(c, k) for c, k in zip((key, "event_id"), kinds, strict=True)]))


def structured_parts(text: str) -> list[tuple[str, str]]:
    """(label, text) parts of one structured abstract: the plain form of functions.text.abstract_parts."""
    found = list(re.finditer(r"(?i)\b(objectives?|background|aims?|methods?|design|results|conclusions?)\s*:", text))
    return [(m[1].lower(), text[m.end() : (found[i + 1].start() if i + 1 < len(found) else len(text))].strip()) for i, m in enumerate(found)]
