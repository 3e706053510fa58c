"""Personal data by bootstrapped contextual extraction. DataFrame functions only.

Base spans come from four patterns with their checks (email, ip, card, phone). The method then reads every chunk that
looks like an identifier, together with its lexical pattern, the two words before it. Chunks that pass a base check are
seeds. Patterns and instances (chunk texts) form a graph, scored for `rounds` rounds: a pattern's score for a
kind is the confidence of its distinct instances over their number plus PRIOR, given at least min_support confident
instances; an instance's confidence is one less the product of what its patterns leave open. A chunk that is no base
match, has the form of a kind, and stands after a pattern with a score of at least threshold for it becomes a span.

Positions are code points. They are running sums of gap and match lengths over the matches of a row, computed by windows
over few rows a document, so a text with very many matches costs linear time. Patterns are written with possessive
repeats, which match the same texts, need no stack and don't try again inside a run. Rows of a hot pattern or instance
meet one broadcast row (join_groups).

Defined results: null text counts as empty; repeated rows are separate documents; an added span never overlaps a base
one, and of two added ones the first stays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_groups, written

KINDS = ("email", "ip", "card", "phone")
LOCAL, DOMAIN = "A-Za-z0-9._%+-", "A-Za-z0-9-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{DOMAIN}]++(?:\.[{DOMAIN}]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What looks like an identifier: something with an @, or digits with the marks that part them.
CHUNK = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9.-]++|(?<![{LOCAL}@])[+(]?[0-9](?:[0-9().-]|\x20(?=[0-9(]))*+"
CONTEXT_CHARS = 80
ROUNDS, MIN_SUPPORT, THRESHOLD, PRIOR = 3, 5, 0.7, 2.0


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    """Whether the digits of c pass; every second from the right is doubled."""
    d = F.reverse(digits(c))
    terms = F.transform(
        F.sequence(F.lit(1), F.length(d)),
        lambda i: F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1) - F.when((i % 2 == 0) & (F.substring(d, i, F.lit(1)).cast("int") > 4), 9).otherwise(0),
    )
    return (F.length(d) > 0) & (F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0)


def valid(kind: str, c: Column) -> Column:
    """The check of a base match; the cheap part first, as the rest may be long."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(c, r"\.", -1), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, p).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(digits(c))
    if kind == "phone":
        return n.between(10, 15)
    return F.when(n.between(14, 19), luhn(F.when(n.between(14, 19), c))).otherwise(False)


def matches(rows: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """(uid, gap, match, start, end) of the pattern's leftmost matches in each row's text."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(F.col(text), pattern, -1), F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    each = rows.select("uid", F.posexplode(pairs).alias("i", "p")).select("uid", "i", F.length("p.gap").alias("before"), F.substring(F.col("p.gap"), F.greatest(F.length("p.gap") - CONTEXT_CHARS + 1, F.lit(1)), F.lit(CONTEXT_CHARS)).alias("gap"), "p.match")
    w = Window.partitionBy("uid").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("before") + F.length("match")).over(w).cast("long")
    return each.select("uid", "gap", "match", (end - F.length("match")).alias("start"), end.alias("end"))


def base_spans(rows: DataFrame) -> DataFrame:
    """(uid, rank, kind, start, end) of all valid base matches."""
    guard = {"email": F.col("text").contains("@"), "phone": F.col("text").contains("+")}
    parts = []
    for rank, kind in enumerate(KINDS):
        own = matches(rows.where(guard[kind]) if kind in guard else rows, PATTERNS[kind])
        parts.append(own.where(valid(kind, F.col("match"))).select("uid", F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), "start", "end"))
    return reduce(DataFrame.unionByName, parts)


def seed(kind: str, c: Column) -> Column:
    """Whether the chunk holds a valid base match."""
    found = F.regexp_extract(c, PATTERNS[kind], 0)
    return (found != "") & valid(kind, found)


def has_form(kind: str, c: Column) -> Column:
    """Whether an instance that is no base match could be of the kind."""
    n = F.length(digits(c))
    if kind == "email":
        return c.rlike(rf"^[{LOCAL}]+@[{DOMAIN}]")
    if kind == "ip":
        return c.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3,}$")
    if kind == "card":
        return c.rlike(r"^[0-9][0-9 -]*$") & n.between(13, 19)
    return c.rlike(r"^[+(]?[0-9][0-9(). -]*$") & n.between(7, 15)


def chunks(rows: DataFrame) -> DataFrame:
    """(uid, pattern, instance, start, end) of what looks like an identifier, with the two words before it."""
    found = matches(rows, CHUNK)
    words = F.filter(F.split(F.lower(F.regexp_replace("gap", r"[^\p{L}\p{N}:=#]+", " ")), " "), lambda x: x != "")
    two = F.slice(F.concat(F.array(F.lit("^"), F.lit("^")), words), F.size(words) + 1, F.lit(2))
    instance = F.regexp_replace("match", r"[^0-9A-Za-z)]+$", "")
    return found.select("uid", F.array_join(two, " ").alias("pattern"), instance.alias("instance"), "start", (F.col("start") + F.length(instance)).alias("end")).where("instance <> ''")


def score(edges: DataFrame, rounds: int, min_support: int) -> DataFrame:
    """(pattern, total, one score a kind) after so many rounds over the graph's edges (pattern, instance)."""
    kept_state = state = written(edges.select("pattern", "instance", *[seed(k, F.col("instance")).cast("double").alias(k) for k in KINDS], *[has_form(k, F.col("instance")).alias(f"{k}_form") for k in KINDS]), "pii-graph")
    n, any_seed = state.count(), reduce(lambda a, b: a | b, [F.col(k) >= 1.0 for k in KINDS])
    state = state.withColumn("seeded", any_seed)
    patterns = None
    for i in range(rounds):
        scores = [
            F.when(F.count(F.when(F.col(k) >= 0.5, 1)) >= min_support, F.sum(k) / (F.count(F.lit(1)) + PRIOR)).otherwise(0.0).alias(f"{k}_score") for k in KINDS
        ]
        discard(patterns)
        patterns = written(state.groupBy("pattern").agg(*scores, F.count(F.lit(1)).alias("total")), "pii-patterns")
        if i + 1 == rounds:
            break
        met = written(join_groups(state, patterns, ["pattern"], "total", n), "pii-met")
        confidence = [(1 - F.exp(F.sum(F.log1p(-F.least(F.col(f"{k}_score"), F.lit(0.999)))))).alias(f"{k}_new") for k in KINDS]
        instances = written(met.groupBy("instance").agg(*confidence, F.count(F.lit(1)).alias("places")), "pii-instances")
        old = kept_state
        kept = met.select("pattern", "instance", *KINDS, *[f"{k}_form" for k in KINDS], "seeded")
        state = written(
            join_groups(kept, instances, ["instance"], "places", n).select(
                "pattern", "instance", *[F.when(F.col("seeded"), F.col(k)).when(F.col(f"{k}_form"), F.col(f"{k}_new")).otherwise(0.0).alias(k) for k in KINDS], *[f"{k}_form" for k in KINDS], "seeded"
            ),
            "pii-graph",
        )
        kept_state = state
        discard(old, met, instances)
    discard(kept_state)
    return patterns


def added_spans(rows: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """(uid, rank, kind, start, end) of chunks that high-confidence patterns discover; they may still overlap base spans."""
    places = written(chunks(rows), "pii-chunks")
    patterns = score(places.groupBy("pattern", "instance").agg(F.lit(1).alias("one")), rounds, min_support)
    good = patterns.where(reduce(lambda a, b: a | b, [F.col(f"{k}_score") >= threshold for k in KINDS]))
    use = written(places.groupBy("pattern").agg(F.count(F.lit(1)).alias("uses")).join(good.drop("total"), "pattern"), "pii-good")
    hit = join_groups(places, use, ["pattern"], "uses", places.count())
    unseen = reduce(lambda a, b: a & b, [~seed(k, F.col("instance")) for k in KINDS])
    options = F.array(*[F.struct(F.when((F.col(f"{k}_score") >= threshold) & has_form(k, F.col("instance")), F.col(f"{k}_score")).alias("score"), F.lit(-rank).alias("rank"), F.lit(k).alias("kind")) for rank, k in enumerate(KINDS)])
    best = F.array_max(F.filter(options, lambda o: o["score"].isNotNull()))
    return hit.where(unseen).select("uid", best.alias("best"), "start", "end").where("best is not null").select("uid", (-F.col("best.rank")).alias("rank"), "best.kind", "start", "end")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, spans) of every row: spans is array<struct<start, rank, kind, end, added>> by start and kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    looks = text.contains("@") | text.rlike("[0-9]")
    rows = written(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.when(looks, text).alias("text")), "pii-rows")
    some = rows.where("text is not null").select("uid", "text")
    base = written(base_spans(some).withColumn("added", F.lit(False)), "pii-base")
    extra = added_spans(some, **options).withColumn("added", F.lit(True))
    both = base.unionByName(extra)
    # an added span stays if no base span and no earlier added one reaches into it
    before = Window.partitionBy("uid").orderBy("start", "added", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("uid").orderBy("start", "added", "rank").rowsBetween(1, Window.unboundedFollowing)
    clear = (F.coalesce(F.max("end").over(before), F.lit(0)) <= F.col("start")) & (F.coalesce(F.min(F.when(~F.col("added"), F.col("start"))).over(after), F.col("end")) >= F.col("end"))
    kept = both.withColumn("clear", clear).where("clear or not added")
    spans = kept.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end", "added"))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,added:boolean>>")
    return rows.select("uid", "id").join(spans, "uid", "left").select(F.col("id").alias(id_col), F.coalesce("spans", empty).alias("spans"))


def said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digest(docs: DataFrame, **options) -> DataFrame:
    found = find_personal_data(docs, **options)
    base = F.filter("spans", lambda s: ~s["added"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["added"])).cast("long").alias("n_added"))
