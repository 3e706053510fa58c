"""Queries over the relational tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EVENT_SEVERITY, EngineConfig, SEVERITY_RANK
from ..functions import similarity as S
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import ordered as O
from ..operators import reports as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = (f, sql)
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in QUERIES.items()}


#: Columns whose SQL type is wider than the query's.
TYPES = {
    **dict.fromkeys(("w02_document_order", "w14_line_flow", "t15_media_order", "t16_url_priority", "t19_severity_order", "t20_results_first"), ("place", "INTEGER")),
    "j06_hydrate": ("meta", "INTEGER"), "a24_votes": ("score", "DOUBLE"), "t13_detail_ranking": ("i", "INTEGER"), "d16_merge_compact_detail": ("k", "INTEGER"), "c08_profiles": ("threshold", "DOUBLE"),
}


def typed(name: str, sql: str) -> str:
    """The SQL with the query's own column types."""
    if name not in TYPES:
        return sql
    column, kind = TYPES[name]
    return f"SELECT * REPLACE (CAST({column} AS {kind}) AS {column}) FROM ({sql})"


def oracle_sql() -> dict[str, str]:
    return {k: typed(k, sql) for k, (_, sql) in QUERIES.items() if sql}


# joins


@query("SELECT o_orderkey, coalesce(c_mktsegment, 'main') AS c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j01_kind_lookup(spark, sf):
    return J.look_up(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "customer"), "o_custkey", "c_custkey", "c_mktsegment", "main").drop("o_custkey")


@query("""SELECT o_orderkey, o_orderstatus, o_orderdate, CASE WHEN c_name IS NOT NULL AND c_name <> '' THEN 'url' ELSE 'upload' END AS source_kind
          FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 10""")
def j02_job_page(spark, sf):
    """One page of a filtered, sorted listing with its documents' kinds: the page is a feature."""
    page = O.page(table(spark, sf, "orders").where("o_orderstatus = 'O'"), [F.desc("o_orderdate"), F.col("o_orderkey")], 10, 50)
    named = page.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left")
    return named.select("o_orderkey", "o_orderstatus", "o_orderdate", F.when(F.coalesce("c_name", F.lit("")) != "", "url").otherwise("upload").alias("source_kind"))


TONES = ("a significant gain", "a decrease was seen", "plain words", "it had no effect")


def _claims(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Claims are returned lines, packets the others; a line refers to its part and names its order. A document is a supplier's part of the parts, some lines have no value."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag").agg(F.max("l_quantity").alias("most"))
    rows = lines.select(
        (F.col("l_suppkey") * 100 + F.col("l_partkey") % 100).alias("doc"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey").alias("name"), F.array(F.concat(F.lit("p"), F.col("l_partkey"))).alias("refs"),
        F.array(F.concat_ws("/", "l_orderkey", F.lit("o"))).alias("said_refs"), F.when(F.col("l_orderkey") % 3 != 0, F.col("most")).alias("value"),
        F.element_at(F.array(*[F.lit(t) for t in TONES]), (F.col("l_orderkey") % 7 % 4).cast("int") + 1).alias("text"), "l_returnflag",
    )
    return rows.where("l_returnflag = 'R'").withColumnRenamed("name", "claim_id"), rows.where("l_returnflag = 'A'").withColumnRenamed("name", "packet_id")


CLAIMS = f"""WITH l AS (SELECT l_suppkey * 100 + l_partkey % 100 AS doc, l_orderkey AS o, l_partkey AS p, l_orderkey || '-' || l_partkey || '-' || l_suppkey AS name, CASE WHEN l_orderkey % 3 <> 0 THEN max(l_quantity) END AS value, l_returnflag AS f,
                              ({list(TONES)})[l_orderkey % 7 % 4 + 1] AS text, l_orderkey % 7 % 4 AS tone
                       FROM lineitem GROUP BY l_suppkey, l_orderkey, l_partkey, l_returnflag),
            pairs AS (SELECT DISTINCT a.doc, a.name AS claim_id, b.name AS packet_id, a.value AS cv, b.value AS pv, a.p = b.p AS same_part,
                             coalesce(abs(a.value - b.value) / greatest(abs(a.value), abs(b.value), 1e-6) > 0.35, false) AS mismatch, least(a.tone, b.tone) * 10 + greatest(a.tone, b.tone) IN (1, 3, 13, 23) AS opposed
                      FROM l a JOIN l b ON a.doc = b.doc AND a.f = 'R' AND b.f = 'A' AND (a.p = b.p OR a.o = b.o)),
            by_value AS (SELECT a.doc, a.name AS claim_id, bool_or(abs(a.value - b.value) / greatest(abs(a.value), abs(b.value), 1e-6) > 0.35 OR least(a.tone, b.tone) * 10 + greatest(a.tone, b.tone) IN (1, 3, 13, 23)) AS conflict
                         FROM l a JOIN l b ON a.doc = b.doc AND a.f = 'R' AND b.f = 'A' AND a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2),
            rel AS (SELECT doc, claim_id, mismatch OR opposed AS conflict, NOT (mismatch OR opposed) AS support FROM pairs UNION ALL SELECT doc, claim_id, conflict, false FROM by_value),
            st AS (SELECT doc, claim_id, CASE WHEN bool_or(conflict) AND NOT bool_or(support) THEN 'contradicted' WHEN bool_or(conflict) THEN 'partial' WHEN bool_or(support) THEN 'supported' ELSE 'unresolved' END AS status FROM rel GROUP BY 1, 2)"""


@query(f"{CLAIMS} SELECT DISTINCT doc, claim_id, packet_id FROM pairs")
def j03_related_pairs(spark, sf):
    """Pairs by references; what only values relate is in value_relations, not as pairs."""
    return J.related_pairs(*_claims(spark, sf), "doc")


@query(f"{CLAIMS} SELECT doc, claim_id, conflict FROM by_value")
def j03_related_by_value(spark, sf):
    return J.value_relations(*_claims(spark, sf), "doc").select("doc", "claim_id", "conflict")


@query(f"{CLAIMS} SELECT doc, name AS claim_id FROM l WHERE f = 'R' AND NOT EXISTS (SELECT 1 FROM rel WHERE rel.claim_id = l.name AND rel.doc = l.doc)")
def j05_missing_partner(spark, sf):
    claims, packets = _claims(spark, sf)
    related = J.related_pairs(claims, packets, "doc").select("doc", "claim_id").unionByName(J.value_relations(claims, packets, "doc").select("doc", "claim_id"))
    return J.without_partner(claims, related, ["doc", "claim_id"]).select("doc", "claim_id")


@query(f"{CLAIMS} SELECT DISTINCT doc, claim_id, packet_id, mismatch FROM pairs")
def n02_magnitude_mismatch(spark, sf):
    claims, packets = _claims(spark, sf)
    pairs = J.related_pairs(claims, packets, "doc").join(claims.select("doc", "claim_id", F.col("value").alias("cv")), ["doc", "claim_id"]).join(packets.select("doc", "packet_id", F.col("value").alias("pv")), ["doc", "packet_id"])
    return pairs.select("doc", "claim_id", "packet_id", J.magnitude_mismatch(F.col("cv"), F.col("pv")).alias("mismatch"))


@query(f"{CLAIMS} SELECT l.doc, l.name AS claim_id, coalesce(st.status, 'unresolved') AS status FROM l LEFT JOIN st ON st.doc = l.doc AND st.claim_id = l.name WHERE f = 'R'")
def a08_claim_status(spark, sf):
    return R.reconcile(*_claims(spark, sf), "doc")[0]


@query(f"{CLAIMS} SELECT coalesce(st.status, 'unresolved') AS status, count(*) AS claims FROM l LEFT JOIN st ON st.doc = l.doc AND st.claim_id = l.name WHERE f = 'R' GROUP BY 1")
def a07_reconcile_stats(spark, sf):
    return a08_claim_status(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("claims"))


@query("""WITH c AS (SELECT conv_id, turn, role, text FROM conversations), k AS (SELECT conv_id, role AS anchor, max_by(length(text), turn) AS meta, min(turn) AS place FROM c GROUP BY 1, 2)
    SELECT e.conv_id, e.turn, coalesce(a.meta, b.meta) AS meta, coalesce(a.place, b.place) AS place
    FROM c e LEFT JOIN k a ON a.conv_id = e.conv_id AND a.anchor = 'x' || e.role LEFT JOIN k b ON b.conv_id = e.conv_id AND b.anchor = e.role""")
def j06_hydrate(spark, sf):
    c = table(spark, sf, "conversations")
    packets = c.select("conv_id", F.col("turn").alias("packet_id"), F.concat(F.lit("x"), "role").alias("anchor"), F.array("role").alias("refs"))
    chunks = c.select("conv_id", F.col("turn").alias("ord"), F.col("role").alias("anchor"), F.length("text").alias("meta"))
    return J.hydrate(packets, chunks, "conv_id").select("conv_id", F.col("packet_id").alias("turn"), "meta", "place")


@query("""SELECT c_nationkey AS doc, 'SECTION:' || c_mktsegment || '::' || (c_custkey % 40) AS ref, 'section:' || lower(c_mktsegment) || ':' || (c_custkey % 40) AS resolved, count(*) AS n
          FROM customer GROUP BY 1, 2, 3""")
def j07_resolve_anchors(spark, sf):
    """Spellings with capitals and doubled colons resolve to the one anchor that they mean."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("doc"), "c_mktsegment", (F.col("c_custkey") % 40).alias("i"))
    refs = c.groupBy("doc", F.concat(F.lit("SECTION:"), "c_mktsegment", F.lit("::"), F.col("i")).alias("ref")).agg(F.count(F.lit(1)).alias("n"))
    anchors = c.select("doc", F.concat(F.lit("section:"), F.lower("c_mktsegment"), F.lit(":"), F.col("i")).alias("anchor")).distinct()
    return J.resolve_anchors(refs, anchors, "doc").select("doc", "ref", "resolved", "n")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY l_orderkey")
def j08_valid_refs(spark, sf):
    anchors = table(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").alias("anchor"))
    return J.valid_refs(table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("ref")), anchors, [], "ref").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT conv_id, turn, role AS ref, text FROM conversations), f AS (SELECT conv_id, ref, min_by(turn % 2, turn) AS section FROM r GROUP BY 1, 2)
    SELECT r.conv_id, bool_or(f.section = 0) AS accepted FROM r JOIN f USING (conv_id, ref) GROUP BY r.conv_id""")
def j09_section_gate(spark, sf):
    """A bullet stands if one of its references belongs to its section; a reference belongs to the first section that has it."""
    r = table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("ref"))
    first = r.groupBy("conv_id", "ref").agg(F.min_by(F.col("turn") % 2, "turn").alias("section"))
    return r.join(first, ["conv_id", "ref"]).groupBy("conv_id").agg(F.bool_or(F.col("section") == 0).alias("accepted"))


SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
def compact_sql(c: str, limit: int) -> str:
    """SQL of functions.text.compact for a column that has clean space already."""
    said = SENTENCES.replace("(text,", f"({c},")
    kept = f"""list_reduce(list_prepend({{'t': '', 'o': true}}, list_transform({said}, lambda x: {{'t': x, 'o': true}})),
        lambda a, b: CASE WHEN a.o AND length(a.t) + length(b.t) + CASE WHEN a.t = '' THEN 0 ELSE 1 END <= {limit} THEN {{'t': a.t || CASE WHEN a.t = '' THEN '' ELSE ' ' END || b.t, 'o': true}} ELSE {{'t': a.t, 'o': false}} END).t"""
    mark = "greatest(" + ", ".join(f"CASE WHEN contains({c}[1:{limit}], '{m}') THEN {limit + 1} - instr(reverse({c}[1:{limit}]), '{m}') ELSE 0 END" for m in ";:,") + ")"
    return f"CASE WHEN length({c}) <= {limit} THEN {c} ELSE coalesce(nullif({kept}, ''), CASE WHEN {mark} >= {int(limit * 0.65)} THEN rtrim({c}[1:{mark} - 1]) END, {c}) END"


def near_sql(x: str, y: str) -> str:
    """SQL of functions.similarity.near_duplicate for two keys that aren't empty."""
    u, v = (f"list_distinct(string_split({k}, ' '))" for k in (x, y))
    both, most, least = f"len(list_intersect({u}, {v}))::DOUBLE", f"greatest(len({u}), len({v}))", f"least(len({u}), len({v}))"
    short = f"least(len(string_split({x}, ' ')), len(string_split({y}, ' ')))"
    differs = f"list_position(list_transform(list_zip(string_split({x}, ' '), string_split({y}, ' ')), lambda z: coalesce(z[1] = z[2], false)), false)"
    prefix = f"CASE WHEN {differs} IS NULL OR {differs} = 0 THEN {short} ELSE least({differs} - 1, {short}) END"
    return f"(contains({x}, {y}) OR contains({y}, {x}) OR {both} / {most} >= 0.82 OR ({both} / {least} >= 0.90 AND {both} / {most} >= 0.56) OR ({short} >= 10 AND ({prefix}) / {short}::DOUBLE >= 0.86))"


#: Of a list x of lists of one key each, those that say what none before them said.
KEPT = f"list_reduce(x, lambda a, b: CASE WHEN len(list_filter(a, lambda k: {near_sql('k', 'b[1]')})) = 0 THEN list_concat(a, b) ELSE a END)"
WORDSET = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9-]*')), lambda x: x NOT IN ('a','an','and','are','as','at','be','by','for','from','in','is','it','of','on','or','that','the','to','was','were','with'))"


@query(f"""WITH d AS (SELECT doc_id, {SENTENCES} AS s FROM documents), e AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos, s[1] AS first FROM d),
    w AS (SELECT doc_id, sentence, pos, {WORDSET.format('first')} AS a, {WORDSET.format('sentence')} AS b FROM e WHERE pos > 0),
    x AS (SELECT doc_id, sentence, pos, CASE WHEN len(a) > 0 AND len(b) > 0 THEN 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) ELSE 0 END + least(0.15, length(sentence) / 2000.0) AS score FROM w)
    SELECT doc_id AS item_id, max_by(sentence, (round(score, 9), -pos)) AS sentence, round(max(score), 6) AS score FROM x GROUP BY doc_id""")
def j10_extractive_join(spark, sf):
    """For the first sentence of each document the other one that says it best."""
    said = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), X.sentences(F.col("text")).alias("s"))
    first = X.word_set(F.try_element_at("s", F.lit(1)))
    pairs = said.select("item_id", first.alias("words"), "s").select("item_id", "words", F.posexplode("s").alias("pos", "sentence")).where("pos > 0")
    out = J.best_said(pairs)
    return out.select("item_id", "sentence", F.round("score", 6).alias("score"))


@query("""SELECT o_custkey AS doc, CAST(o_orderkey % 5 AS VARCHAR) AS token, max_by(o_orderpriority || o_orderstatus, (length(o_orderpriority || o_orderstatus), -o_orderkey)) AS caption FROM orders GROUP BY 1, 2""")
def j11_longest_caption(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 5).cast("string").alias("token"), F.col("o_orderkey").alias("ord"), F.concat("o_orderpriority", "o_orderstatus").alias("caption"))
    return J.longest_by_token(o, ["doc"])


MATCHES = f"""WITH r AS (SELECT item_id AS ref_id, {WORDSET.format('text')} AS a FROM benchmark), d AS (SELECT doc_id AS line_id, {WORDSET.format('text')} AS b FROM documents),
    x AS (SELECT ref_id, line_id, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS score FROM r, d WHERE len(list_intersect(a, b)) > 0),
    m AS (SELECT ref_id, max_by(line_id, (round(score, 9), -line_id)) AS line_id, max(score) AS score FROM x GROUP BY ref_id)"""


def _matches(spark, sf) -> DataFrame:
    """Best document of each benchmark item by shared words; a part is an id's remainder by five."""
    points = table(spark, sf, "benchmark").select(F.col("item_id").alias("ref_id"), (F.col("item_id") % 5).alias("part"), X.word_set(F.col("text")).alias("words"))
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("line_id"), (F.col("doc_id") % 5).alias("part"), X.word_set(F.col("text")).alias("words"))
    return J.best_match(points, lines, 0.42)


@query(f"{MATCHES} SELECT ref_id, line_id, round(score, 9) AS score, score >= 0.42 AS matched FROM m")
def j12_reference_match(spark, sf):
    return _matches(spark, sf).select("ref_id", "line_id", F.round("score", 9).alias("score"), "matched")


@query(f"""{MATCHES}, p AS (SELECT ref_id % 5 AS section, ref_id, line_id, score >= 0.42 AS matched FROM m), l AS (SELECT doc_id % 5 AS section, count(*) AS lines FROM documents GROUP BY 1)
    SELECT section, count(*) AS points, count(*) FILTER (WHERE matched) AS hits, CAST(count(*) FILTER (WHERE matched) AS DOUBLE) / count(*) AS recall,
           CAST(count(DISTINCT line_id) FILTER (WHERE matched) AS DOUBLE) / any_value(lines) AS precision FROM p JOIN l USING (section) GROUP BY section""")
def a15_recall_precision(spark, sf):
    found = _matches(spark, sf).withColumn("section", F.col("ref_id") % 5)
    lines = table(spark, sf, "documents").select((F.col("doc_id") % 5).alias("section"), F.col("doc_id").alias("line_id"))
    return A.recall_precision(found, ["section"], lines)


@query(f"""{MATCHES}, d5 AS (SELECT ref_id, line_id, score, ref_id % 5 = line_id % 5 AS same FROM x)
    SELECT ref_id, round(max(score), 9) AS any_section, round(coalesce(max(score) FILTER (WHERE same), 0), 9) AS same_section FROM d5 GROUP BY ref_id""")
def j13_inclusion_match(spark, sf):
    return _matches(spark, sf).select("ref_id", F.round("score", 9).alias("any_section"), F.round("same_part", 9).alias("same_section"))


@query("""WITH q AS (SELECT vec_id AS id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
    x AS (SELECT q.id, v.vec_id, list_cosine_similarity(CAST(q.e AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS c FROM q JOIN embeddings v ON v.vec_id <> q.id)
    SELECT id, max_by(vec_id, (round(c, 9), -vec_id)) AS nearest, round(greatest(0, max(c)), 6) AS similarity FROM x GROUP BY id""")
def j14_vector_match(spark, sf):
    """Nearest other vector of every vector whose id is divisible by 20: a stated query set against all rows."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "id")
    return J.nearest_vectors(asked, e).select("id", "nearest", F.round("similarity", 6).alias("similarity"))


@query("SELECT source AS doc, lang AS modality, n_chars AS signature, min(doc_id) AS first_id FROM documents GROUP BY 1, 2, 3")
def j15_media_signature(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("doc"), F.col("lang").alias("modality"), F.col("n_chars").alias("signature"), F.col("doc_id").alias("first_id"))
    return J.first_by_signature(d, ["doc", "modality", "signature"], [F.col("first_id")])


@query("""WITH w AS (SELECT s_suppkey % 4 AS img, s_suppkey * 37 % 200 + 2.0 AS x, s_suppkey * 53 % 180 + 1.0 AS y, s_name AS t FROM supplier),
    c AS (SELECT i AS img, r AS "row", k AS col, k * 50.0 AS x0, r * 30.0 AS y0, k * 50.0 + 45 AS x1, r * 30.0 + 28 AS y1 FROM range(4) a(i), range(6) b(r), range(4) d(k))
    SELECT c.img, c."row", c.col, string_agg(t, ' ' ORDER BY x, t) AS text FROM w JOIN c ON w.img = c.img AND x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY 1, 2, 3""")
def j16_words_in_cells(spark, sf):
    s = table(spark, sf, "supplier")
    x, y = (F.col("s_suppkey") * 37 % 200).cast("double"), (F.col("s_suppkey") * 53 % 180).cast("double")
    words = s.select((F.col("s_suppkey") % 4).alias("img"), x.alias("x0"), y.alias("y0"), (x + 4).alias("x1"), (y + 2).alias("y1"), F.col("s_name").alias("text"))
    grid = spark.range(4).select(F.col("id").alias("img")).crossJoin(spark.range(6).select(F.col("id").alias("row"))).crossJoin(spark.range(4).select(F.col("id").alias("col")))
    cells = grid.select("img", "row", "col", (F.col("col") * 50.0).alias("x0"), (F.col("row") * 30.0).alias("y0"), (F.col("col") * 50.0 + 45).alias("x1"), (F.col("row") * 30.0 + 28).alias("y1"))
    return J.words_in_cells(words, cells, "img")


# aggregates


@query("SELECT l_returnflag AS modality, count(*) AS n FROM lineitem GROUP BY 1")
def a01_modality_counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("modality")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag))")
def a02_two_level_counts(spark, sf):
    return A.two_level_counts(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS conflicts, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low, count(*) AS total FROM orders")
def a03_conditional_counts(spark, sf):
    return table(spark, sf, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("conflicts"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("low"), F.count(F.lit(1)).alias("total"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS found, count(*) AS total, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / count(*) AS rate FROM orders GROUP BY 1")
def a04_fill_rates(spark, sf):
    return A.fill_rates(table(spark, sf, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F")


@query("""WITH b AS (SELECT CASE WHEN l_discount * 10 >= 0.75 THEN 'high' WHEN l_discount * 10 >= 0.55 THEN 'medium' WHEN l_discount > 0 THEN 'low' ELSE 'unknown' END AS bucket FROM lineitem)
    SELECT k.bucket, count(b.bucket) AS n, CAST(count(b.bucket) AS DOUBLE) / (SELECT count(*) FROM b) AS share FROM (VALUES ('high'), ('medium'), ('low'), ('unknown')) k(bucket) LEFT JOIN b USING (bucket) GROUP BY k.bucket""")
def a05_confidence_histogram(spark, sf):
    return A.confidence_histogram(table(spark, sf, "lineitem"), F.col("l_discount") * 10)


@query("SELECT trim(string_split(o_orderpriority || ':' || o_orderstatus, ':')[1]) AS reason, count(*) AS n FROM orders GROUP BY 1")
def a06_reason_counts(spark, sf):
    return A.reason_counts(table(spark, sf, "orders").select(F.concat_ws(":", "o_orderpriority", "o_orderstatus").alias("note")), "note")


@query("""SELECT l_partkey AS key, l_returnflag AS reason, CAST(min(l_orderkey) AS VARCHAR) AS claim, array_to_string(list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))), ',') AS evidence,
          max(l_discount) AS confidence, CASE WHEN max(l_linenumber % 3) = 2 THEN 'high' WHEN max(l_linenumber % 3) = 1 THEN 'medium' ELSE 'low' END AS severity FROM lineitem GROUP BY 1, 2""")
def a09_discrepancy_merge(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("key"), F.col("l_returnflag").alias("reason"), F.col("l_orderkey").alias("ord"), F.col("l_orderkey").cast("string").alias("claim"), F.array(F.col("l_suppkey").cast("string")).alias("evidence"),
        F.array(F.col("l_orderkey").cast("string")).alias("links"), F.col("l_discount").alias("confidence"), F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("l_linenumber") % 3 + 1).alias("severity"),
    )
    return A.merge_discrepancies(rows, SEVERITY_RANK).select("key", "reason", "claim", F.array_join("evidence", ",").alias("evidence"), "confidence", "severity")


@query("SELECT l_suppkey AS doc, round(greatest(0, least(1, avg(l_discount * 10) - least(0.5, 0.08 * count(*) FILTER (WHERE l_returnflag = 'R')))), 9) AS confidence FROM lineitem GROUP BY 1")
def a10_overall_confidence(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("doc")).agg(F.avg(F.col("l_discount") * 10).alias("mean"), F.count_if(F.col("l_returnflag") == "R").alias("n"))
    return g.select("doc", F.round(A.overall_confidence(F.col("mean"), F.col("n")), 9).alias("confidence"))


@query("""WITH a AS (SELECT event_type, count(*) AS n, sum(value) AS v FROM events GROUP BY 1), b AS (SELECT event_type, count(*) AS n, sum(value) AS v FROM events WHERE event_id < 2000 GROUP BY 1)
    SELECT event_type, greatest(a.n - coalesce(b.n, 0), 0) AS n, round(greatest(a.v - coalesce(b.v, 0), 0), 4) AS v FROM a LEFT JOIN b USING (event_type)""")
def a11_counter_delta(spark, sf):
    e = table(spark, sf, "events")
    sums = lambda rows: rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return A.counter_delta(sums(e), sums(e.where("event_id < 2000")), ["event_type"], ["n", "v"]).withColumn("v", F.round("v", 4))


@query("""WITH e AS (SELECT DISTINCT o_custkey AS doc, o_orderkey AS item FROM orders), f AS (SELECT DISTINCT l_orderkey AS item FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01')
    SELECT doc, count(*) AS expected, count(f.item) AS covered, coalesce(string_agg(CAST(e.item AS VARCHAR), ',' ORDER BY e.item) FILTER (WHERE f.item IS NULL), '') AS missing FROM e LEFT JOIN f USING (item) GROUP BY doc""")
def a12_coverage(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("item"))
    late = table(spark, sf, "lineitem").where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")).select(F.col("l_orderkey").alias("item")).distinct()
    return A.coverage(orders, late.join(orders, "item"), ["doc"], "item").withColumn("missing", F.array_join(F.col("missing").cast("array<string>"), ","))


@query("SELECT o_custkey AS doc, count(*) AS missing FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1")
def a13_missing_set(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").groupBy(F.col("o_custkey").alias("doc")).agg(F.count(F.lit(1)).alias("missing"))


@query("SELECT lang AS section, count(*) AS total, count(*) FILTER (WHERE n_chars > 1000) AS final, avg(least(1.0, n_chars / 5000.0)) AS confidence FROM documents GROUP BY 1")
def a14_section_diagnostics(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("lang").alias("section")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n_chars") > 1000).alias("final"), F.avg(F.least(F.lit(1.0), F.col("n_chars") / 5000.0)).alias("confidence"))


TOKENS = "regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''-]*')"
SAID = "list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: lower(trim(s))), lambda s: s <> '')"
QUALITY = f"""WITH m AS (SELECT doc_id, CAST(len({TOKENS}) AS INTEGER) AS tokens, CASE WHEN len({TOKENS}) > 0 THEN CAST(len(list_distinct(list_transform({TOKENS}, lambda x: lower(x)))) AS DOUBLE) / len({TOKENS}) ELSE 0 END AS diversity,
    CAST(len({SAID}) AS INTEGER) AS sentences, CASE WHEN len({SAID}) > 0 THEN CAST(len({TOKENS}) AS DOUBLE) / len({SAID}) ELSE 0 END AS mean_sentence,
    CASE WHEN len({SAID}) > 0 THEN 1 - CAST(len(list_distinct({SAID})) AS DOUBLE) / len({SAID}) ELSE 1 END AS repeated, CAST(len(regexp_extract_all(lower(text), 'not found|n/a|placeholder|lorem ipsum')) AS INTEGER) AS placeholders FROM documents),
    q AS (SELECT *, greatest(0, least(100, 100 - (CASE WHEN tokens < 80 THEN 30 WHEN tokens < 150 THEN 10 ELSE 0 END + CASE WHEN diversity < 0.25 THEN 20 ELSE 0 END + CASE WHEN mean_sentence < 4 OR mean_sentence > 45 THEN 15 ELSE 0 END
          + CASE WHEN repeated > 0.35 THEN 15 ELSE 0 END + CASE WHEN placeholders >= 3 THEN 20 WHEN placeholders >= 1 THEN 10 ELSE 0 END))) AS score FROM m)"""


def _quality(spark, sf) -> DataFrame:
    # spaces of all kinds are trimmed alike in both engines only where sentences hold ASCII blanks
    m = table(spark, sf, "documents").select("doc_id", *[c.alias(k) for k, c in A.text_quality(F.col("text")).items()])
    return m.withColumn("score", A.quality_score(*[F.col(c) for c in ("tokens", "diversity", "mean_sentence", "repeated", "placeholders")]))


@query(f"{QUALITY} SELECT doc_id, tokens, round(diversity, 9) AS diversity, sentences, round(mean_sentence, 9) AS mean_sentence, round(repeated, 9) AS repeated, placeholders, score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'needs_improvement' END AS grade FROM q")
def a17_content_quality(spark, sf):
    q = _quality(spark, sf)
    return q.select("doc_id", "tokens", F.round("diversity", 9).alias("diversity"), "sentences", F.round("mean_sentence", 9).alias("mean_sentence"), F.round("repeated", 9).alias("repeated"), "placeholders", "score", A.grade(F.col("score")).alias("grade"))


@query(f"{QUALITY} SELECT quality, count(*) AS n, avg(score) AS score FROM q JOIN labels USING (doc_id) GROUP BY quality")
def a17_quality_by_label(spark, sf):
    return _quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score"))


@query(f"""{QUALITY}, c AS (SELECT doc_id, (CAST(tokens >= 80 AS INTEGER) + CAST(sentences >= 3 AS INTEGER) + CAST(placeholders = 0 AS INTEGER) + CAST(diversity >= 0.25 AS INTEGER)) / 4.0 AS passed, score FROM q)
    SELECT doc_id, round(0.5 * passed + 0.25 * (score / 100.0) + 0.25 * CASE WHEN passed = 1 THEN 1.0 ELSE 0.5 END, 6) AS overall FROM c""")
def a18_report_checks(spark, sf):
    q = _quality(spark, sf)
    checks = [F.col("tokens") >= 80, F.col("sentences") >= 3, F.col("placeholders") == 0, F.col("diversity") >= 0.25]
    all_of = checks[0] & checks[1] & checks[2] & checks[3]
    return q.select("doc_id", F.round(A.weighted_checks(checks, (0.5, 0.25, 0.25), (F.col("score") / 100.0, F.when(all_of, 1.0).otherwise(0.5))), 6).alias("overall"))


@query(f"{QUALITY} SELECT count(*) AS reports, count(*) FILTER (WHERE score >= 75) AS passed, avg(score) AS mean_score FROM q")
def a19_audit_summary(spark, sf):
    return _quality(spark, sf).agg(F.count(F.lit(1)).alias("reports"), F.count_if(F.col("score") >= 75).alias("passed"), F.avg("score").alias("mean_score"))


@query(f"""{QUALITY} SELECT lang AS section, count(*) AS items, avg(tokens) AS mean_tokens, count(*) FILTER (WHERE repeated > 0.35) AS noisy,
    CASE WHEN avg(tokens) < 150 THEN 'short items' ELSE '' END || CASE WHEN count(*) FILTER (WHERE repeated > 0.35) * 10 > count(*) THEN ';repetition' ELSE '' END AS causes FROM q JOIN documents USING (doc_id) GROUP BY lang""")
def a16_diagnostics(spark, sf):
    g = _quality(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").groupBy(F.col("lang").alias("section")).agg(F.count(F.lit(1)).alias("items"), F.avg("tokens").alias("mean_tokens"), F.count_if(F.col("repeated") > 0.35).alias("noisy"))
    return g.withColumn("causes", F.concat(F.when(F.col("mean_tokens") < 150, "short items").otherwise(""), F.when(F.col("noisy") * 10 > F.col("items"), ";repetition").otherwise("")))


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY (s_nationkey % 2 = 0) DESC, s_acctbal DESC, s_suppkey LIMIT 1")
def a20_benchmark_winner(spark, sf):
    return table(spark, sf, "supplier").orderBy((F.col("s_nationkey") % 2 == 0).desc(), F.desc("s_acctbal"), "s_suppkey").limit(1).select("s_suppkey", "s_acctbal")


@query("""WITH f AS (SELECT c_nationkey AS doc, c_mktsegment AS name, min(c_custkey) AS ord FROM customer GROUP BY c_nationkey, c_mktsegment, lower(c_mktsegment))
    SELECT doc, count(*) AS total, array_to_string(list(name ORDER BY ord)[1:24], ',') AS names FROM f GROUP BY doc""")
def a21_distinct_authors(spark, sf):
    """Names in order of appearance, equal ones without case once; the first 24 are shown, all counted."""
    first = O.first_wins(table(spark, sf, "customer").select(F.col("c_nationkey").alias("doc"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("ord")), ["doc", F.lower("name")], [F.col("ord")])
    g = first.groupBy("doc").agg(F.count(F.lit(1)).alias("total"), F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("n"))
    return g.select("doc", "total", F.array_join(F.transform(F.slice("n", 1, 24), lambda x: x["name"]), ",").alias("names"))


@query("SELECT event_type AS reason, count(*) AS n FROM events WHERE value < 10 GROUP BY 1")
def a22_skip_counters(spark, sf):
    return table(spark, sf, "events").where("value < 10").groupBy(F.col("event_type").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.schema_version') AS INTEGER), 1) AS version, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k FROM events")
def a23_schema_version(spark, sf):
    return table(spark, sf, "events").select("event_id", A.schema_version(F.col("props")).alias("version"), F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0)).alias("k"))


VOTE = "round({0}, 6)"


@query("""WITH v AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'methods' WHEN 'O' THEN 'results' ELSE 'discussion' END AS a, CASE o_orderpriority[1] WHEN '1' THEN 'methods' WHEN '2' THEN 'results' WHEN '3' THEN 'conclusion' ELSE 'discussion' END AS b FROM orders)
    SELECT id, CASE WHEN a = b THEN a ELSE a END AS label, round(CASE WHEN a = b THEN 0.92 + 0.60 ELSE 0.92 END, 6) AS score FROM v""")
def a24_votes(spark, sf):
    """Two sources vote with their weights; the anchor outweighs the words."""
    o = table(spark, sf, "orders")
    a = F.when(F.col("o_orderstatus") == "F", "methods").when(F.col("o_orderstatus") == "O", "results").otherwise("discussion")
    d = F.substring("o_orderpriority", 1, 1)
    b = F.when(d == "1", "methods").when(d == "2", "results").when(d == "3", "conclusion").otherwise("discussion")
    from ..config import SECTIONS, SOURCE_WEIGHT

    best = A.votes([(a, F.lit(SOURCE_WEIGHT["anchor"])), (b, F.lit(SOURCE_WEIGHT["lexical"]))], SECTIONS)
    return o.select(F.col("o_orderkey").alias("id"), best["label"].alias("label"), F.round(best["score"], 6).alias("score"))


@query("SELECT l_returnflag, l_linestatus, approx_n > 0 AS some, CAST(q AS DOUBLE) AS median FROM (SELECT l_returnflag, l_linestatus, count(DISTINCT l_partkey) AS approx_n, quantile_cont(l_quantity, 0.5) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus))")
def a25_cube_percentiles(spark, sf):
    """Beyond parity: cube, percentile and approximate distinct counts are built in."""
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg((F.approx_count_distinct("l_partkey") > 0).alias("some"), F.percentile("l_quantity", 0.5).alias("median"))


# windows and order


@query(f"""WITH e AS (SELECT doc_id, unnest({SENTENCES}) AS s, generate_subscripts({SENTENCES}, 1) AS i, len({SENTENCES}) AS n FROM documents), p AS (SELECT doc_id, i, CAST(i - 1 AS DOUBLE) / greatest(1, n - 1) AS pos FROM e)
    SELECT doc_id, CASE WHEN pos <= 0.22 THEN 'introduction' WHEN pos <= 0.52 THEN 'methods' WHEN pos <= 0.70 THEN 'results' WHEN pos <= 0.90 THEN 'discussion' ELSE 'conclusion' END AS section, count(*) AS n FROM p GROUP BY 1, 2""")
def w01_section_by_position(spark, sf):
    said = table(spark, sf, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("i", "s"))
    placed = said.select("doc_id", O.position_section(O.relative_position(["doc_id"], [F.col("i")])).alias("section"))
    return placed.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(CASE WHEN turn % 3 > 0 THEN turn % 3 END, length(text)), length(text), turn) AS place FROM conversations")
def w02_document_order(spark, sf):
    from pyspark.sql import Window

    order = O.document_order(F.col("turn") % 3, F.length("text").cast("long"), F.col("turn"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).alias("place"))


@query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS heading FROM conversations")
def w04_heading_carry(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(O.carry_forward(F.when(F.col("role") == "user", F.col("turn")), ["conv_id"], [F.col("turn")]), F.lit(-1)).alias("heading"))


@query("SELECT conv_id, turn, turn < coalesce(min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id), 1000000) AS before FROM conversations")
def w08_prefix_cutoff(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", O.prefix_before(F.col("role") == "assistant", F.col("turn"), ["conv_id"]).alias("before"))


@query("""SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn = 0 AND x.role = c.role)) WHERE r <= 2""")
def w09_late_rescue(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    unseen = c.join(c.where("turn = 0").select("conv_id", "role"), ["conv_id", "role"], "left_anti")
    return O.top_k(unseen, ["conv_id"], [F.desc("turn")], 2).select("conv_id", "turn")


@query("SELECT conv_id, turn, role || ':e' || row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS id FROM conversations")
def w10_numbered_ids(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", O.numbered(F.concat("role", F.lit(":e")), ["conv_id", "role"], [F.col("turn")]).alias("id"))


@query("""SELECT event_id, user_id FROM (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE r = 1 OR p <> event_type""")
def w12_status_change(spark, sf):
    return table(spark, sf, "events").withColumn("c", O.changed(F.col("event_type"), ["user_id"], [F.col("ts"), F.col("event_id")])).where("c").select("event_id", "user_id")


@query("SELECT event_id, max(least(value / 100.0, 0.99)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS progress FROM events")
def w13_running_progress(spark, sf):
    return table(spark, sf, "events").select("event_id", O.running_best(F.col("value") / 100.0, ["user_id"], [F.col("ts"), F.col("event_id")]).alias("progress"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, turn) AS place FROM conversations")
def w14_line_flow(spark, sf):
    from pyspark.sql import Window

    order = [O.priority(F.col("role"), ("system", "user")), F.col("turn")]
    return table(spark, sf, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).alias("place"))


@query("SELECT event_id, event_type, value FROM events WHERE value >= 10 ORDER BY value DESC, event_id LIMIT 25 OFFSET 5")
def t01_paged_listing(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", "value", F.col("value").alias("progress")).where("value >= 10")
    return O.page(rows, O.sort_columns("progress:desc", "event_id"), 5, 25).drop("progress")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def t02_latest_per_user(spark, sf):
    return O.latest(table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT o_orderkey, 'running' AS status FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 20")
def t03_fifo_claim(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'O'").orderBy("o_orderdate", "o_orderkey").limit(20).select("o_orderkey", F.lit("running").alias("status"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 30")
def t04_top_k_per_section(spark, sf):
    return O.top_k(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), ["lang"], [F.desc("n_chars"), F.col("doc_id")], 30).drop("n_chars")


SCORED = f"""e AS (SELECT doc_id, unnest({SENTENCES}) AS sentence, generate_subscripts({SENTENCES}, 1) - 1 AS i, len({SENTENCES}) AS n FROM documents),
    p AS (SELECT doc_id, sentence, i, CAST(i AS DOUBLE) / greatest(1, n - 1) AS pos, array_to_string(regexp_extract_all(lower(sentence), '[a-z0-9]+(?:\\.[0-9]+)?'), ' ') AS key FROM e WHERE length(sentence) >= 30),
    s AS (SELECT *, CASE WHEN pos <= 0.22 THEN 'introduction' WHEN pos <= 0.52 THEN 'methods' WHEN pos <= 0.70 THEN 'results' WHEN pos <= 0.90 THEN 'discussion' ELSE 'conclusion' END AS section,
          round(len(regexp_extract_all(lower(sentence), '\\b(that|with|from|this)\\b')) + greatest(0, 1 - least(i, 40) / 40.0) + least(length(sentence), 220) / 400.0, 9) AS score FROM p),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section, key ORDER BY doc_id, i) AS k FROM s WHERE key <> '') WHERE k = 1),
    a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section, doc_id ORDER BY score DESC, doc_id, i) AS r3 FROM u) WHERE r3 <= 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, doc_id, i) AS rank FROM a)"""
CAPS = "CASE section WHEN 'introduction' THEN 10 WHEN 'methods' THEN 18 WHEN 'results' THEN 14 WHEN 'discussion' THEN 10 ELSE 8 END"


def scored_sentences(docs: DataFrame, words: str = r"\b(that|with|from|this)\b") -> DataFrame:
    """(doc_id, sentence, i, section, key, score) of every sentence of at least 30 characters; words is the lexicon."""
    said = docs.select("doc_id", X.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("n"), F.posexplode_outer("s").alias("i", "sentence"))  # without outer the plan cuts every text twice, to filter by the size
    placed = said.withColumn("section", O.position_section(F.col("i") / F.greatest(F.lit(1), F.col("n") - 1)))
    score = F.regexp_count(F.lower("sentence"), F.lit(words)) + F.greatest(F.lit(0.0), 1 - F.least(F.col("i"), F.lit(40)) / 40.0) + F.least(F.length("sentence"), F.lit(220)) / 400.0
    return placed.where(F.length("sentence") >= 30).select("doc_id", "sentence", "i", "section", X.canonical(F.col("sentence")).alias("key"), F.round(score, 9).alias("score"))


@query(f"WITH {SCORED} SELECT section, CAST(rank AS INTEGER) AS rank, doc_id, sentence, score FROM r WHERE rank <= {CAPS}")
def t12_sentence_top_k(spark, sf):
    """The flagship: sentences, sections by place, scores, first-wins dedup, three a document, a cap a section."""
    config = EngineConfig()
    rows = scored_sentences(table(spark, sf, "documents"))
    unique = O.first_wins(rows.where("key <> ''"), ["section", "key"], [F.col("doc_id"), F.col("i")])
    top = O.capped_top_k(unique, "section", "doc_id", [F.desc("score"), F.col("doc_id"), F.col("i")], config.per_anchor, config.section_caps)
    return top.select("section", "rank", "doc_id", "sentence", "score")


@query(f"WITH {SCORED} SELECT section, string_agg(sentence, '; ' ORDER BY rank) AS summary, count(*) AS items FROM r WHERE rank <= 4 GROUP BY section")
def t11_executive_report(spark, sf):
    top = t12_sentence_top_k(spark, sf).where("rank <= 4")
    return top.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sentence"))), lambda x: x["sentence"]), "; ").alias("summary"), F.count(F.lit(1)).alias("items"))


@query(f"WITH {SCORED} SELECT doc_id, i, score FROM s WHERE section = 'methods' ORDER BY score DESC, doc_id, i LIMIT 20")
def t13_detail_ranking(spark, sf):
    return scored_sentences(table(spark, sf, "documents")).where("section = 'methods'").orderBy(F.desc("score"), "doc_id", "i").limit(20).select("doc_id", "i", "score")


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END AS place FROM orders ORDER BY place, o_orderkey LIMIT 5")
def t14_fixed_priority(spark, sf):
    place = O.priority(F.col("o_orderpriority"), ("3-MEDIUM", "1-URGENT")).cast("int")
    return table(spark, sf, "orders").select("o_orderkey", place.alias("place")).orderBy("place", "o_orderkey").limit(5)


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_size % 3 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END + CASE WHEN p_size > 25 THEN 10 ELSE 0 END, p_size, p_partkey) AS place FROM part""")
def t15_media_order(spark, sf):
    """Places of the media of each document."""
    from pyspark.sql import Window

    kind = F.when(F.col("p_size") % 3 == 1, "figure").when(F.col("p_size") % 3 == 2, "table").otherwise("text")
    order = O.media_order(kind, F.col("p_size") > 25, F.concat(F.lit("Figure "), F.col("p_size")), F.col("p_partkey"))
    return table(spark, sf, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(*order)).alias("place"))


@query("SELECT page_id, url, row_number() OVER (PARTITION BY regexp_extract(url, '://([^/]+)', 1) ORDER BY (url LIKE '%.html') DESC, contains(url, '?') DESC, page_id) AS place FROM pages")
def t16_url_priority(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy(X.url_host(F.col("url"))).orderBy(F.col("url").endswith(".html").desc(), F.col("url").contains("?").desc(), "page_id")
    return table(spark, sf, "pages").select("page_id", "url", F.row_number().over(w).alias("place"))


@query("SELECT l_suppkey, count(*) AS shown FROM (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 50 GROUP BY 1")
def t17_head_caps(spark, sf):
    return O.top_k(table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), ["l_suppkey"], [F.col("l_orderkey"), F.col("l_linenumber")], 50).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("shown"))


@query("""WITH last AS (SELECT o_custkey, max(o_orderdate) AS newest FROM orders GROUP BY 1), keep AS (SELECT o_custkey FROM last ORDER BY newest DESC, o_custkey LIMIT 10)
    SELECT o_custkey, newest FROM last WHERE o_custkey NOT IN (SELECT o_custkey FROM keep) AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def t18_retention(spark, sf):
    o = table(spark, sf, "orders")
    return O.retention(o, 99, "o_custkey", "o_orderdate", o.where("o_orderstatus = 'P'"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN length(text) > 600 THEN 0 WHEN length(text) > 200 THEN 1 ELSE 2 END, turn) AS place FROM conversations")
def t19_severity_order(spark, sf):
    from pyspark.sql import Window

    level = F.when(F.length("text") > 600, "high").when(F.length("text") > 200, "medium").otherwise("low")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(O.priority(level, ("high", "medium", "low")), "turn")).alias("place"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'assistant' THEN 0 ELSE 1 END, turn) AS place FROM conversations")
def t20_results_first(spark, sf):
    from pyspark.sql import Window

    return table(spark, sf, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.when(F.col("role") == "assistant", 0).otherwise(1), "turn")).alias("place"))


# sets and deduplication


@query("SELECT 'text' AS modality, count(*) AS n FROM orders UNION ALL SELECT 'table', count(*) FROM lineitem UNION ALL SELECT 'figure', count(*) FROM part")
def d01_union_modalities(spark, sf):
    parts = [table(spark, sf, n).select(F.lit(k).alias("modality")) for k, n in (("text", "orders"), ("table", "lineitem"), ("figure", "part"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("modality").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'both' AS side, count(*) AS n FROM (SELECT o_orderkey FROM orders INTERSECT SELECT l_orderkey FROM lineitem)
          UNION ALL SELECT 'only', count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)""")
def d02_set_operations(spark, sf):
    a, b = table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return a.intersect(b).agg(F.lit("both").alias("side"), F.count(F.lit(1)).alias("n")).unionByName(a.exceptAll(b.distinct()).agg(F.lit("only").alias("side"), F.count(F.lit(1)).alias("n")))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text, lang")
def d03_first_wins(spark, sf):
    """The first document of each (text, language), with the number of its copies: an aggregate, not a sort."""
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("h"), "lang").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("h", "lang")


@query("SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2")
def d04_dedupe_by_id(spark, sf):
    return O.first_wins(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"], [F.col("l_partkey")])


@query("SELECT conv_id, min(turn) AS turn, role, text FROM conversations GROUP BY conv_id, role, text")
def d05_turn_dedupe(spark, sf):
    return O.first_wins(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id", "role", "text"], [F.col("turn")])


@query("""WITH k AS (SELECT page_id, CASE WHEN contains(regexp_replace(lower(url), '#.*$', ''), 'suppl') THEN regexp_replace(regexp_replace(lower(url), '#.*$', ''), '^[a-z]+://[^/?]+', '') ELSE regexp_replace(regexp_replace(lower(url), '#.*$', ''), '\\?.*$', '') END AS key FROM pages)
    SELECT min(page_id) AS page_id, key FROM k GROUP BY key""")
def d14_url_dedupe(spark, sf):
    return O.first_wins(table(spark, sf, "pages").select("page_id", X.url_key(F.col("url")).alias("key")), ["key"], [F.col("page_id")])


NEAR = """(contains(x, y) OR contains(y, x) OR len(list_intersect(u, v)) / greatest(len(u), len(v))::DOUBLE >= 0.82 OR (len(list_intersect(u, v)) / least(len(u), len(v))::DOUBLE >= 0.90 AND len(list_intersect(u, v)) / greatest(len(u), len(v))::DOUBLE >= 0.56))"""


@query(f"""WITH k AS (SELECT conv_id, turn, role, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+(?:\\.[0-9]+)?'), ' ') AS x FROM conversations),
    o AS (SELECT conv_id, turn, x, lag(x) OVER (PARTITION BY conv_id, role ORDER BY turn) AS y FROM k),
    p AS (SELECT *, list_distinct(string_split(x, ' ')) AS u, list_distinct(string_split(y, ' ')) AS v, least(len(string_split(x, ' ')), len(string_split(y, ' '))) AS short,
          list_position(list_transform(list_zip(string_split(x, ' '), string_split(y, ' ')), lambda z: coalesce(z[1] = z[2], false)), false) - 1 AS lcp FROM o WHERE y IS NOT NULL)
    SELECT conv_id, turn, x <> '' AND y <> '' AND ({NEAR} OR (short >= 10 AND CASE WHEN lcp IS NULL OR lcp < 0 THEN short ELSE least(lcp, short) END / short::DOUBLE >= 0.86)) AS repeats FROM p""")
def d06_near_duplicate_turns(spark, sf):
    """Whether a turn says what the speaker's turn before it said: the predicate over whole texts."""
    k = table(spark, sf, "conversations").select("conv_id", "turn", "role", X.canonical(F.col("text")).alias("x"))
    pairs = k.withColumn("y", F.lag("x").over(Window.partitionBy("conv_id", "role").orderBy("turn"))).where("y is not null")
    return pairs.select("conv_id", "turn", S.near_duplicate(F.col("x"), F.col("y")).alias("repeats"))


@query("""WITH i AS (SELECT conv_id, role AS item, min(turn) AS turn FROM conversations WHERE turn < 2 GROUP BY 1, 2), m AS (SELECT conv_id, text AS item, turn FROM conversations),
    h AS (SELECT conv_id, count(*) AS have FROM i GROUP BY 1), c AS (SELECT conv_id, item, min(turn) AS turn FROM m GROUP BY 1, 2),
    r AS (SELECT conv_id, item, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM c) SELECT r.conv_id, r.turn FROM r LEFT JOIN h USING (conv_id) WHERE k <= 4 - coalesce(have, 0)""")
def d11_backfill(spark, sf):
    c = table(spark, sf, "conversations")
    have = c.where("turn < 2").groupBy("conv_id", F.col("role").alias("item")).agg(F.min("turn").alias("turn"))
    return O.backfill(have.select("conv_id", "item"), c.select("conv_id", F.col("text").alias("item"), "turn"), ["conv_id"], "item", [F.col("turn")], 4).select("conv_id", "turn")


@query("""WITH f AS (SELECT conv_id, lower(role) AS k, min((turn, role)) AS m FROM conversations GROUP BY 1, 2) SELECT conv_id, string_agg(m[2], ',' ORDER BY m[1]) AS refs FROM f GROUP BY conv_id""")
def d13_ordered_refs(spark, sf):
    out = O.ordered_refs(table(spark, sf, "conversations").select("conv_id", "turn", F.array("role").alias("refs")), "conv_id", "turn", "refs")
    return out.select("conv_id", F.array_join("refs", ",").alias("refs"))


@query("SELECT min(page_id) AS page_id, CASE WHEN contains(url, '?') THEN url ELSE regexp_extract(url, '://([^/]+)', 1) END AS key FROM pages GROUP BY 2")
def d15_media_items(spark, sf):
    key = F.when(F.col("url").contains("?"), F.col("url")).otherwise(X.url_host(F.col("url")))
    return O.first_wins(table(spark, sf, "pages").select("page_id", key.alias("key")), ["key"], [F.col("page_id")])


@query("""WITH c AS (SELECT conv_id, 0 AS tier, turn, role AS line FROM conversations UNION ALL SELECT conv_id, 1, turn, lang FROM conversations, (SELECT DISTINCT lang FROM documents)),
    f AS (SELECT conv_id, line, min((tier, turn)) AS m FROM c GROUP BY 1, 2), r AS (SELECT conv_id, line, row_number() OVER (PARTITION BY conv_id ORDER BY m[1], m[2], line) AS k FROM f) SELECT conv_id, line, k FROM r WHERE k <= 6""")
def d16_merge_compact_detail(spark, sf):
    from pyspark.sql import Window

    c = table(spark, sf, "conversations")
    compact = c.select("conv_id", F.lit(0).alias("tier"), "turn", F.col("role").alias("line"))
    langs = F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")])
    detail = c.select("conv_id", F.lit(1).alias("tier"), "turn", F.explode(langs).alias("line"))
    first = O.first_wins(compact.unionByName(detail), ["conv_id", "line"], [F.col("tier"), F.col("turn")])
    return first.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("tier", "turn", "line"))).where("k <= 6").select("conv_id", "line", "k")


# events, saved reports and the read interface


@query("SELECT event_id, ts FROM events WHERE ts > (SELECT min(ts) + INTERVAL 20 DAY FROM events) ORDER BY ts DESC, event_id DESC LIMIT 100")
def r06_events_since_cursor(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    cursor = e.agg(F.min("ts").alias("m")).select((F.col("m") + F.expr("INTERVAL 20 DAYS")).alias("cursor"))
    return e.join(F.broadcast(cursor), F.col("ts") > F.col("cursor")).orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "ts")


SEVERITY = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_SEVERITY.items()) + " WHEN 'error' THEN 'error' ELSE 'info' END"


@query(f"SELECT event_id, {SEVERITY} AS severity, upper(event_type[1]) || lower(event_type[2:]) AS message FROM events")
def r07_event_severity(spark, sf):
    level = F.create_map(*[F.lit(x) for k, v in {**EVENT_SEVERITY, "error": "error"}.items() for x in (k, v)])
    return table(spark, sf, "events").select("event_id", F.coalesce(level[F.col("event_type")], F.lit("info")).alias("severity"), F.initcap(F.replace("event_type", F.lit("_"), F.lit(" "))).alias("message"))


@query("SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY r) AS history FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20 GROUP BY 1")
def r09_bounded_history(spark, sf):
    top = O.top_k(table(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20)
    return top.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id")), asc=False), lambda x: x["event_id"].cast("string")), ",").alias("history"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'queued' ELSE 'completed' END AS status FROM orders")
def r04_crash_recovery(spark, sf):
    """Running jobs go back to the queue."""
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    return table(spark, sf, "orders").select("o_orderkey", F.when(state == "running", "queued").otherwise(state).alias("status"))


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2""")
def r11_daily_windows(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("t", "1 day")["start"].cast("timestamp_ntz").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, k""")
def r11_sessions(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("t", "6 hours")).agg(F.min("ts").alias("began"), F.count(F.lit(1)).alias("n")).select("user_id", "began", "n")


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id DESC LIMIT 100")
def q01_list_documents(spark, sf):
    """The listing's first page."""
    return table(spark, sf, "documents").orderBy(F.desc("doc_id")).limit(100).select("doc_id", "lang", "n_chars")


@query("SELECT * FROM orders WHERE o_orderkey = 7")
def q02_point_lookup(spark, sf):
    return table(spark, sf, "orders").where("o_orderkey = 7")


@query("""SELECT c_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS report, count(*) AS reports, coalesce(sum(l.n), 0)::BIGINT AS findings
          FROM customer JOIN orders ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey GROUP BY 1""")
def q04_report_view(spark, sf):
    o, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    g = o.join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("report"), F.count(F.lit(1)).alias("reports"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"))
    return g.join(table(spark, sf, "customer").select("c_custkey"), "c_custkey", "left_semi")


@query(f"WITH {SCORED}, q AS (SELECT *, rank > 3 AS over FROM r) SELECT section, rank, CAST(row_number() OVER (ORDER BY over, section, rank) AS INTEGER) AS place FROM q QUALIFY place <= 16")
def q05_summary_cards(spark, sf):
    """Quota of three a section first, then the rest, sixteen in all."""
    from pyspark.sql import Window

    rows = t12_sentence_top_k(spark, sf).select("section", "rank").where("rank <= 16")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.col("rank") > 3, "section", "rank"))).where("place <= 16").select("section", F.col("rank").cast("long").alias("rank"), "place")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def q08_status_counts(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT o_custkey, max(o_orderdate) OVER (PARTITION BY o_custkey) AS saved_at FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def q10_saved_reports(spark, sf):
    saved = table(spark, sf, "orders").join(table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    return saved.groupBy("o_custkey").agg(F.max("o_orderdate").alias("saved_at"))


@query("SELECT doc_id, sha1(text) AS sha1 FROM documents")
def n15_text_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha1("text").alias("sha1"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, CAST(year(ts) AS INTEGER) AS year FROM events")
def n05_timestamps(spark, sf):
    from ..functions import numbers as N

    t = N.iso_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf, "events").select("event_id", N.stamp(t).alias("stamp"), F.year(t).alias("year"))


@query("SELECT l_orderkey, string_agg(x, '|' ORDER BY r) FILTER (WHERE r <= 5) AS preview, count(*) AS total FROM (SELECT l_orderkey, l_partkey || ':' || l_suppkey AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) GROUP BY 1")
def n10_table_preview(spark, sf):
    """The first five rows of each order's table, and how many it has."""
    rows = table(spark, sf, "lineitem").withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    first = F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.struct("r", F.concat_ws(":", "l_partkey", "l_suppkey").alias("x")))))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(first, lambda v: v["x"]), "|").alias("preview"), F.count(F.lit(1)).alias("total"))


@query("SELECT l_suppkey, 'orders: ' || CASE WHEN m = '' THEN 'complete' ELSE 'missing ' || m END AS line FROM (SELECT l_suppkey, coalesce(string_agg(k, ', ' ORDER BY k) FILTER (WHERE r <= 8), '') AS m FROM (SELECT l_suppkey, CASE WHEN l_returnflag = 'R' THEN CAST(l_orderkey AS VARCHAR) END AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN l_returnflag = 'R' THEN CAST(l_orderkey AS VARCHAR) END NULLS LAST) AS r FROM lineitem) GROUP BY 1)")
def n17_coverage_lines(spark, sf):
    from ..functions import numbers as N

    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey").cast("string")))).alias("missing"))
    return g.select("l_suppkey", N.coverage_line(F.lit("orders"), F.col("n"), F.col("missing")).alias("line"))
