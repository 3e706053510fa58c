"""Scores, candidates, slots and assembled reports; the interface for model-based extractors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig, SECTIONS
from ..functions import predicates as P
from ..functions import text as X
from . import aggregates as A
from . import folds
from . import joins as J


def raw_chunk_score(section: str, s: Column, position: Column) -> Column:
    """How well a raw sentence fits a section: words, signals and place."""
    hit = lambda name, weight: F.when(X.matches(s, name), weight).otherwise(0.0)
    if section == "introduction":
        return hit("intro_words", 2.2) - F.when(X.matches(s, "method_like") | X.matches(s, "concrete_result"), 1.1).otherwise(0.0) + F.greatest(F.lit(0.0), 0.8 - position)
    if section == "methods":
        return hit("methods", 2.4) + hit("method_like", 1.7) - hit("concrete_result", 1.2) + F.when(position <= 0.72, 0.8).otherwise(0.0)
    if section == "results":
        return hit("concrete_result", 2.6) + hit("high_signal", 1.8) - hit("method_like", 1.3) + F.when(position.between(0.25, 0.9), 0.8).otherwise(0.0)
    if section == "discussion":
        return hit("discussion_words", 2.5) + hit("discussion", 1.6) - hit("method_like", 1.0) + F.when(position >= 0.52, 0.8).otherwise(0.0)
    return hit("conclusion_words", 2.6) + hit("conclusion", 1.2) + F.when(s.rlike("(?i)^(?:in conclusion|overall|these findings)"), 1.5).otherwise(0.0) + F.when(position >= 0.7, 0.8).otherwise(0.0)


def method_slot_score(keyword: Column, category: Column, strict: Column, methods_anchor: Column, signal: Column, results_anchor: Column, confidence: Column, refs: Column) -> Column:
    """0 where a strict slot's keyword, or both keyword and category, are missing."""
    flag = lambda c, n: F.when(c, n).otherwise(0)
    score = flag(keyword, 80) + flag(category, 26) + flag(methods_anchor, 20 + 14) + flag(signal, 16) - flag(results_anchor, 25 + 18) + F.bround(confidence * 12).cast("int") + F.least(F.lit(8), refs * 2)
    return F.when((strict & ~keyword) | (~keyword & ~category), 0).otherwise(score)


def introduction_prefix(label: Column, order: Column, keys: list[str]) -> Column:
    """Rows that may open a document: before the first methods or results row, else the first third, at least two."""
    w = Window.partitionBy(*keys)
    first = F.min(F.when(label.isin("methods", "results"), order)).over(w)
    n, i = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(order)) - 1
    return F.when(first.isNotNull(), order < first).otherwise(i < F.greatest(F.lit(2), F.floor(n / 3)))


def needs_fallback(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(key, fallback): fewer than two of the four main sections are there."""
    return rows.groupBy(key).agg((F.count_distinct(F.when(F.col(label).isin(*SECTIONS[1:]), F.col(label))) < 2).alias("fallback"))


def paywall_notes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Documents with at least two chunks that ask for a subscription."""
    n = rows.groupBy(key).agg(F.count_if(X.matches(F.col(text), "paywall")).alias("n"))
    return n.where("n >= 2").select(key, F.lit("source appears access-limited").alias("note"))


def ranked_greedy(rows: DataFrame, keys: list[str], limit: int, per_anchor: int | None = None, text: str | None = None, together: bool = False) -> DataFrame:
    """Items (keys.., score, ord, key, anchor) by score, then place: kept unless near-duplicates of a kept one or one too many of an anchor's kept ones, up to the limit.

    text: the column whose canonical form is the key, for rows without one; only items that come before the limit is reached get theirs. together: each group's rows are in
    one partition already."""

    def pick() -> Callable[..., int | None]:
        kept, said, anchors = 0, folds.SaidBefore(), {}

        def one(key: str, anchor: str) -> int | None:
            nonlocal kept
            if kept >= limit:
                return 0
            if per_anchor and anchors.get(anchor, 0) >= per_anchor:
                return None
            key = folds.canonical(key) if text else key
            if key and said.first(key) is not None:
                return None
            kept += 1
            if key:
                said.add(key)
            anchors[anchor] = anchors.get(anchor, 0) + 1
            return kept

        return one

    return folds.streamed(rows, keys, [F.desc("score"), F.col("ord")], pick, [text or "key", "anchor"], "rank", together)


def best_unused(candidates: DataFrame, document: str, slots: list[str]) -> DataFrame:
    """(document, slot, idx, score): slots in order take the best candidate (document, slot, idx, score) that none has taken; the earliest of equals, and also one without any hit."""

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for slot in slots:
            best, at = -1.0, None
            for r in pdf[pdf["slot"] == slot].sort_values("idx").itertuples():
                if r.idx not in used and r.score > best:
                    best, at = r.score, r.idx
            if at is not None:
                used.add(at)
                out.append((pdf[document].iloc[0], slot, int(at), float(best)))
        return pd.DataFrame(out, columns=[document, "slot", "idx", "score"])

    return candidates.groupBy(document).applyInPandas(assign, f"{document} {candidates.schema[document].dataType.simpleString()}, slot string, idx long, score double")


def reconcile(claims: DataFrame, packets: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """(status of every claim, discrepancies). claims: (group, claim_id, text, refs, said_refs, value), or tone, its polarities, instead of text; packets with packet_id likewise.

    What shares references is compared pair by pair; what is related only because both have a value can conflict but not
    support, and comes from value_relations, with one packet for all such conflicts of a claim.
    """
    pairs = J.related_pairs(claims, packets, group)
    both = pairs.join(claims.select(group, "claim_id", J.tone(claims).alias("ct"), F.col("value").alias("cv")), [group, "claim_id"]).join(packets.select(group, "packet_id", J.tone(packets).alias("pt"), F.col("value").alias("pv")), [group, "packet_id"])
    rel = both.select(group, "claim_id", "packet_id", J.tones_relation(F.col("ct"), F.col("pt"), F.col("cv"), F.col("pv"), F.lit(True)).alias("relation"))
    by_value = J.value_relations(claims, packets, group).select(group, "claim_id", "packet_id", F.when(F.col("conflict"), "conflict_by_value").otherwise("unresolved").alias("relation"))
    every = rel.unionByName(by_value)
    conflict = F.col("relation").isin("magnitude_mismatch", "contradicted", "conflict_by_value")
    status = every.groupBy(group, "claim_id").agg(A.claim_status(F.bool_or(F.col("relation") == "support"), F.bool_or(conflict)).alias("status"))
    alone = J.without_partner(claims, every, [group, "claim_id"]).select(group, "claim_id", F.lit("unresolved").alias("status"))
    found = every.where(conflict).select(group, "claim_id", F.col("relation").alias("reason"), "packet_id")
    missing = alone.select(group, "claim_id", F.lit("missing_modality").alias("reason"), F.lit(None).cast("string").alias("packet_id"))
    return status.unionByName(alone), found.unionByName(missing)


def sided(rows: DataFrame, kind: str, main: tuple[str, ...]) -> DataFrame:
    """rows with the side, main or supp, on which their asset's kind puts them; an unknown kind is main."""
    return rows.withColumn("side", F.when(F.coalesce(F.col(kind), F.lit(main[0])).isin(*main), "main").otherwise("supp"))


def reviewed(status: DataFrame, claims: DataFrame, group: str, model: Callable[[pd.DataFrame], pd.DataFrame] | None, most: int = 20) -> DataFrame:
    """(group, claim_id, reason, error): what a model says of a group's claims that aren't supported, the first `most` by their ids. Without a model nothing."""
    w = Window.partitionBy(group).orderBy("claim_id")
    asked = status.where("status <> 'supported'").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).join(claims.select(group, "claim_id", "text"), [group, "claim_id"])
    return extract(asked.select(group, "claim_id", "text"), model, f"{group} {status.schema[group].dataType.simpleString()}, claim_id string, reason string")


def checked_bullets(bullets: DataFrame, anchors: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., ord, statement, refs, by): a model's bullets (keys.., ord, statement, refs) with those references that exist among anchors (first of keys, anchor), without
    bullets that have none; where keys get no bullet, the fallback's rows (keys.., ord, statement, refs)."""
    doc = keys[0]
    each = bullets.select(*keys, "ord", "statement", F.posexplode(F.array_distinct("refs")).alias("i", "anchor")).join(anchors.select(doc, "anchor").distinct(), [doc, "anchor"], "left_semi")
    refs = F.transform(F.array_sort(F.collect_list(F.struct("i", "anchor"))), lambda x: x["anchor"])
    good = each.groupBy(*keys, "ord", "statement").agg(refs.alias("refs")).withColumn("by", F.lit("model"))
    rest = fallback.join(good.select(*keys).distinct(), keys, "left_anti").select(*keys, "ord", "statement", "refs").withColumn("by", F.lit("rules"))
    return good.unionByName(rest)


def sanitise_payload(payload: Column) -> Column:
    """A report's JSON with statements cleaned and repeated ones taken out; null where it is no such JSON."""
    parsed = F.from_json(payload, "items ARRAY<STRUCT<statement: STRING, refs: ARRAY<STRING>>>")["items"]
    clean = F.transform(parsed, lambda x: F.struct(X.strip_confidence(X.strip_fallback_ids(x["statement"])).alias("statement"), F.filter(x["refs"], lambda r: P.is_ref_token(r)).alias("refs")))
    keys = F.transform(clean, lambda x: X.statement_key(x["statement"]))
    first = F.filter(clean, lambda x, i: F.array_position(keys, X.statement_key(x["statement"])) == i + 1)
    return F.when(parsed.isNotNull(), F.to_json(F.struct(first.alias("items"))))


def legacy_findings(packets: DataFrame) -> DataFrame:
    return packets.select("document_id", F.col("section").alias("category"), F.col("sentence").alias("summary"), F.to_json(F.concat(F.array("anchor"), "refs")).alias("evidence"), "confidence")


def section_items(packets: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Section items of packets, with the modality that their references imply."""
    media = F.exists("refs", lambda r: r.rlike("^[FT][0-9]"))
    return packets.select("document_id", "section", F.col("sentence").alias("statement"), "anchor", F.slice("refs", 1, 8).alias("evidence_refs"), F.when(media, "media").otherwise("text").alias("source_modality"), F.greatest(F.lit(0.7), "confidence").alias("confidence"))


def extract(rows: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame] | None, schema: str) -> DataFrame:
    """Rows through a model, batch by batch; a batch that fails gives its error in the column error instead of failing the stage. Without a model nothing is emitted."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if model is None:
                continue
            try:
                yield model(pdf).assign(error=None)[[*names, "error"]]
            except Exception as e:  # noqa: BLE001 - a model's failure is data
                yield pd.DataFrame([{**dict.fromkeys(names), "error": f"{type(e).__name__}: {e}"}])

    return rows.mapInPandas(run, f"{schema}, error string")


def override(draft: Column, proposed: Column) -> Column:
    """A model's field replaces the draft's where it says anything."""
    return F.coalesce(F.nullif(F.trim(proposed), F.lit("")), draft)
