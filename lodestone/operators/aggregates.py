"""Counts, shares, statuses, coverage, and quality scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def two_level_counts(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts by (outer, inner) and by outer alone (inner null)."""
    return rows.groupingSets([(outer, inner), (outer,)], outer, inner).agg(F.count(F.lit(1)).alias("n"))


def fill_rates(rows: DataFrame, key: str, found: Column) -> DataFrame:
    out = rows.groupBy(key).agg(F.count_if(found).alias("found"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("rate", F.when(F.col("total") > 0, F.col("found") / F.col("total")).otherwise(0.0))


def confidence_bucket(c: Column) -> Column:
    return F.when(c >= 0.75, "high").when(c >= 0.55, "medium").when(c > 0, "low").otherwise("unknown")


def confidence_histogram(rows: DataFrame, confidence: Column) -> DataFrame:
    """(bucket, n, share) of the four buckets, also empty ones."""
    kinds = ("high", "medium", "low", "unknown")
    wide = rows.agg(*[F.count_if(confidence_bucket(confidence) == k).alias(k) for k in kinds], F.count(F.lit(1)).alias("total"))
    out = wide.select("total", F.explode(F.array(*[F.struct(F.lit(k).alias("bucket"), F.col(k).alias("n")) for k in kinds])).alias("x"))
    return out.select("x.bucket", "x.n", F.when(F.col("total") > 0, F.col("x.n") / F.col("total")).otherwise(0.0).alias("share"))


def reason_counts(rows: DataFrame, note: str) -> DataFrame:
    """How often each reason, the part of a note before the first colon, occurs."""
    return rows.groupBy(F.trim(F.element_at(F.split(note, ":", 2), 1)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def claim_status(support: Column, conflict: Column) -> Column:
    """From whether any packet supports and any conflicts."""
    return F.when(conflict & ~support, "contradicted").when(conflict & support, "partial").when(support, "supported").otherwise("unresolved")


def merge_discrepancies(rows: DataFrame, severity_rank: dict[str, int]) -> DataFrame:
    """One row for each (key, reason): first spelling, all evidence and links sorted, highest confidence and severity.

    rows: (key, reason, ord, claim, evidence array, links array, confidence, severity).
    """
    rank = F.create_map(*[F.lit(x) for k, v in severity_rank.items() for x in (k, v)])
    return rows.groupBy("key", "reason").agg(
        F.min_by("claim", "ord").alias("claim"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("links")))).alias("links"),
        F.max("confidence").alias("confidence"), F.max_by("severity", rank[F.col("severity")]).alias("severity"), F.min("ord").alias("ord"),
    )


def overall_confidence(mean: Column, discrepancies: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(mean, F.lit(0.0)) - F.least(F.lit(0.5), 0.08 * discrepancies)))


def coverage(expected: DataFrame, found: DataFrame, keys: list[str], item: str) -> DataFrame:
    """For each group its expected items, how many there are, and which are missing; sorted arrays. Groups without expected items are left out."""
    marked = expected.select(*keys, item).distinct().join(found.select(*keys, item).distinct().withColumn("__in", F.lit(True)), [*keys, item], "left")
    return marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("expected"), F.count("__in").alias("covered"), F.array_sort(F.collect_list(F.when(F.col("__in").isNull(), F.col(item)))).alias("missing")
    )


def counter_delta(after: DataFrame, before: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Differences of counters; what is new counts from 0, and none goes below 0."""
    old = before.select(*keys, *[F.col(v).alias(f"__{v}") for v in values])
    return after.join(old, keys, "left").select(*keys, *[F.greatest(F.col(v) - F.coalesce(f"__{v}", F.lit(0)), F.lit(0)).alias(v) for v in values])


def recall_precision(matches: DataFrame, keys: list[str], lines: DataFrame) -> DataFrame:
    """By group: matched share of reference points (1 without any), and distinct matched lines over lines (0 without any).

    matches: (keys.., ref_id, line_id, matched); lines: (keys.., line_id). One line may match several points.
    """
    hit = matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.count_if("matched").alias("hits"), F.count_distinct(F.when(F.col("matched"), F.col("line_id"))).alias("used"))
    own = lines.groupBy(*keys).agg(F.count_distinct("line_id").alias("lines"))
    both = hit.join(own, keys, "full")
    none = F.lit(0)
    return both.select(
        *keys, F.coalesce("points", none).alias("points"), F.coalesce("hits", none).alias("hits"),
        F.when(F.coalesce("points", none) > 0, F.col("hits") / F.col("points")).otherwise(1.0).alias("recall"), F.when(F.coalesce("lines", none) > 0, F.coalesce("used", none) / F.col("lines")).otherwise(0.0).alias("precision"),
    )


def text_quality(text: Column) -> dict[str, Column]:
    """Measures of a text: tokens, diversity, sentence length, share of repeated sentences, placeholders."""
    t = F.coalesce(text, F.lit(""))
    tokens = F.regexp_extract_all(t, F.lit(r"([A-Za-z][A-Za-z0-9'-]*)"), F.lit(1))
    said = F.filter(F.transform(F.split(t, r"[.!?]+"), lambda s: F.lower(F.trim(s))), lambda s: s != "")
    n, k = F.size(tokens), F.size(said)
    return {
        "tokens": n, "diversity": F.when(n > 0, F.size(F.array_distinct(F.transform(tokens, lambda x: F.lower(x)))) / n).otherwise(0.0), "sentences": k,
        "mean_sentence": F.when(k > 0, n / k).otherwise(0.0), "repeated": F.when(k > 0, 1 - F.size(F.array_distinct(said)) / k).otherwise(1.0),
        "placeholders": F.regexp_count(F.lower(t), F.lit("not found|n/a|placeholder|lorem ipsum")),
    }


def quality_score(tokens: Column, diversity: Column, mean_sentence: Column, repeated: Column, placeholders: Column) -> Column:
    """100 less penalties, 0 to 100."""
    penalty = (
        F.when(tokens < 80, 30).when(tokens < 150, 10).otherwise(0) + F.when(diversity < 0.25, 20).otherwise(0) + F.when((mean_sentence < 4) | (mean_sentence > 45), 15).otherwise(0)
        + F.when(repeated > 0.35, 15).otherwise(0) + F.when(placeholders >= 3, 20).when(placeholders >= 1, 10).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - penalty))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 60, "fair").otherwise("needs_improvement")


def weighted_checks(checks: list[Column], weights: tuple[float, ...], parts: tuple[Column, ...]) -> Column:
    """Share of passed checks and further shares, weighted, as a score of 100."""
    passed = sum((F.when(c, 1).otherwise(0) for c in checks), F.lit(0)) / len(checks)
    return sum((w * p for w, p in zip(weights, (passed, *parts), strict=True)), F.lit(0.0))


def schema_version(payload: Column) -> Column:
    return F.coalesce(F.get_json_object(payload, "$.schema_version").try_cast("int"), F.lit(1))


def votes(rows: list[tuple[Column, Column]], labels: tuple[str, ...]) -> Column:
    """The label with the largest sum of weights, the earlier label among equals; struct(score, label)."""
    sums = [(sum((F.when(label == k, weight).otherwise(0.0) for label, weight in rows), F.lit(0.0)), i, k) for i, k in enumerate(labels)]
    return F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("rank"), F.lit(k).alias("label")) for s, i, k in sums]))
