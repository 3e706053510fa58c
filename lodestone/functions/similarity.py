"""Similarity of texts and vectors, near-duplicate statements, and the greedy filter over them. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import word_set


def token_f1(a: Column, b: Column) -> Column:
    """2PR / (P + R) over the two word sets; 0 if either is empty."""
    return set_f1(word_set(a), word_set(b))


def set_f1(x: Column, y: Column) -> Column:
    """token_f1 of word sets that are there already."""
    return F.when((F.size(x) > 0) & (F.size(y) > 0), 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    x, y = word_set(a), word_set(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)).cast("double")).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common prefix, 0 to 1; 0 where a side is empty or all zero."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), F.greatest(n, F.lit(0))), F.slice(b, F.lit(1), F.greatest(n, F.lit(0)))

    def dot(u: Column, v: Column) -> Column:
        return F.aggregate(F.zip_with(u, v, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)

    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((n > 0) & (norm > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x, y) / norm))).otherwise(0.0)


def hybrid(lexical: Column, keyword: Column, embedding: Column | None = None, weights: tuple[float, float, float] = (0.48, 0.34, 0.18)) -> Column:
    """Weighted similarity; without embeddings the lexical part has all the weight."""
    return lexical if embedding is None else weights[0] * lexical + weights[1] * keyword + weights[2] * embedding


def hybrid_reason(lexical: Column, keyword: Column, embedding: Column) -> Column:
    top = F.greatest(lexical, keyword, embedding)
    return F.when(lexical == top, "lexical").when(keyword == top, "keyword").otherwise("embedding")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y)
    return F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(n)


def near_duplicate(a: Column, b: Column) -> Column:
    """Whether two canonical keys say the same: one holds the other; or a long common prefix; or a large overlap of words."""
    x, y = F.split(a, " "), F.split(b, " ")
    short = F.least(F.size(x), F.size(y))
    u, v = F.array_distinct(x), F.array_distinct(y)
    both, most, least = F.size(F.array_intersect(u, v)), F.greatest(F.size(u), F.size(v)), F.least(F.size(u), F.size(v))
    alike = (F.instr(a, b) > 0) | (F.instr(b, a) > 0) | ((short >= 10) & (common_prefix(x, y) / short >= 0.86)) | (both / most >= 0.82) | ((both / least >= 0.90) & (both / most >= 0.56))
    return F.coalesce((a != "") & (b != "") & alike, F.lit(False))


def greedy_distinct(keys: Column) -> Column:
    """Of an ordered array of keys, those that are near-duplicates of none kept before. Order decides, as the relation isn't transitive."""
    return F.aggregate(keys, F.array().cast("array<string>"), lambda kept, k: F.when((k == "") | F.exists(kept, lambda s: near_duplicate(k, s)), kept).otherwise(F.concat(kept, F.array(k))))
