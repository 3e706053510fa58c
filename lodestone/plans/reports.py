"""Queries over report assembly, the remaining predicates and the read interface."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import PATTERN, PROFILES
from ..functions import numbers as N
from ..functions import predicates as P
from ..functions import similarity as S
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import folds
from ..operators import joins as J
from ..operators import ordered as O
from ..operators import reports as R
from ..sources import readers
from . import documents as D
from . import relational as L
from .relational import SENTENCES, scored_sentences, table
from .statements import CLEAN, STATEMENTS_SQL, has, statements

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = (f, sql)
        return f

    return keep


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: L.typed(k, sql) for k, (_, sql) in QUERIES.items() if sql}


S_ = f"WITH s AS ({STATEMENTS_SQL})"


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 11")
def s01_scan_by_document(spark, sf):
    return table(spark, sf, "orders").where("o_custkey = 11").select("o_orderkey", "o_totalprice")


@query("SELECT event_id, event_type FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2) ORDER BY event_id")
def s02_modality_scan(spark, sf):
    e = table(spark, sf, "events")
    kinds = e.select("event_type").distinct().orderBy("event_type").limit(2)
    return e.join(kinds, "event_type", "left_semi").orderBy("event_id").select("event_id", "event_type")


@query("SELECT page_id, CASE WHEN regexp_matches(lower(html), '^\\s*(?:<!doctype html|<html)') THEN 'html' ELSE 'text' END AS kind FROM pages")
def s04_content_sniffing(spark, sf):
    return table(spark, sf, "pages").select("page_id", readers.sniff(F.encode("html", "UTF-8")).alias("kind"))


@query("SELECT r_regionkey AS k, '{\"columns\":[\"n_nationkey\",\"n_name\"],\"data\":[' || string_agg('[\"' || n_nationkey || '\",\"' || n_name || '\"]', ',' ORDER BY n_nationkey) || ']}' AS content FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def s07_table_chunks(spark, sf):
    n = table(spark, sf, "nation").withColumn("k", F.col("n_regionkey"))
    return readers.table_chunk(n, ["n_nationkey", "n_name"], ["k"], "n_nationkey", F.lit("table:nation")).select("k", "content")


@query("SELECT n_regionkey AS id, 'R' || n_regionkey AS title, count(*) AS paragraphs FROM nation GROUP BY 1, 2")
def s15_tei_metadata(spark, sf):
    """TEI made from the nations of a region, read back by paths."""
    body = F.concat_ws("", F.transform(F.array_sort(F.collect_list("n_name")), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))))
    xml = F.concat(F.lit("<TEI><titleStmt><title>R"), F.col("n_regionkey"), F.lit("</title></titleStmt><body>"), F.col("b"), F.lit("</body></TEI>"))
    rows = table(spark, sf, "nation").groupBy("n_regionkey").agg(body.alias("b")).select(F.col("n_regionkey").alias("id"), xml.alias("xml"))
    return readers.xml_paragraphs(rows).select("id", "title", F.size("paragraphs").cast("long").alias("paragraphs"))


@query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'system' THEN 'methods' WHEN role = 'user' THEN 'results' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), 'unknown') AS section FROM conversations")
def s16_item_stream(spark, sf):
    c = table(spark, sf, "conversations")
    items = c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("idx"), F.when(F.col("role").isin("system", "user"), "heading").otherwise("text").alias("type"), F.when(F.col("role") == "system", "Methods").when(F.col("role") == "user", "Results").otherwise("lower case prose that goes on.").alias("text"))
    return readers.item_stream(items).select(F.col("doc").alias("conv_id"), F.col("idx").alias("turn"), "section")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props) AND json_extract_string(props, '$.k') IS NOT NULL")
def s22_json_events(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k")).where("k is not null")


@query("SELECT item_id AS file, 'introduction' AS section, 1 AS ord, trim(regexp_replace(text, '\\s*\\n\\s*', ' ', 'g')) AS text FROM benchmark")
def s23_reference_points(spark, sf):
    """Points written as markdown bullets with continuation lines, a file each, read back."""
    written = F.split(F.concat(F.lit("# INTRODUCTION\n* "), F.trim("text")), "\n")
    lines = table(spark, sf, "benchmark").select(F.col("item_id").alias("file"), F.posexplode(written).alias("n", "line"))
    lines = lines.withColumn("line", F.when(F.col("n") > 1, F.concat(F.lit("  "), "line")).otherwise(F.col("line")))
    return readers.reference_points(lines)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def s27_unseen_keys(spark, sf):
    seen = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(seen, "c_custkey", "left_anti")


@query("SELECT user_id AS document_id, min_by(props, event_id) AS meta FROM events WHERE json_valid(props) GROUP BY 1")
def s28_first_meta(spark, sf):
    return readers.first_meta(table(spark, sf, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("id"), F.lit("meta").alias("modality"), F.col("props").alias("content")))


@query(f"{S_} SELECT id, CAST(greatest(id % 4, max(id % 4) OVER ()) + 1 AS BIGINT) AS pages, {CLEAN} AS content FROM s WHERE length({CLEAN}) >= 30")
def s25_parsed_rows(spark, sf):
    rows = statements(spark, sf).withColumn("page", F.col("id") % 4)
    pages = rows.agg((F.max("page") + 1).alias("pages"))
    return rows.select("id", X.clean_space(F.col("t")).alias("content")).where(F.length("content") >= 30).join(F.broadcast(pages)).select("id", "pages", "content")


@query(f"{S_} SELECT doc, 'source appears access-limited' AS note FROM s GROUP BY doc HAVING count(*) FILTER (WHERE {has('paywall')}) >= 2")
def p09_paywall_note(spark, sf):
    return R.paywall_notes(statements(spark, sf), "doc", "t")


LABEL = "CASE id % 5 WHEN 0 THEN 'methods' WHEN 1 THEN 'results' ELSE 'introduction' END"


def _labelled(spark, sf) -> DataFrame:
    return statements(spark, sf).withColumn("label", F.when(F.col("id") % 5 == 0, "methods").when(F.col("id") % 5 == 1, "results").otherwise("introduction"))


@query(f"{S_} SELECT doc, count(DISTINCT CASE WHEN {LABEL} IN ('methods', 'results') THEN {LABEL} END) < 2 AS fallback FROM s GROUP BY doc")
def p10_fallback_trigger(spark, sf):
    return R.needs_fallback(_labelled(spark, sf), "doc", "label")


@query(f"{S_} SELECT id FROM s WHERE {LABEL} = 'results' AND price >= 50000 AND NOT {has('boilerplate')}")
def p17_section_selection(spark, sf):
    return _labelled(spark, sf).where((F.col("label") == "results") & (F.col("price") >= 50000) & ~X.matches(F.col("t"), "boilerplate")).select("id")


@query(f"""{S_}, x AS (SELECT id, doc, min(CASE WHEN {LABEL} IN ('methods', 'results') THEN id END) OVER (PARTITION BY doc) AS first, count(*) OVER (PARTITION BY doc) AS n, row_number() OVER (PARTITION BY doc ORDER BY id) - 1 AS i FROM s)
    SELECT id FROM x WHERE CASE WHEN first IS NOT NULL THEN id < first ELSE i < greatest(2, floor(n / 3)) END""")
def p18_introduction_candidates(spark, sf):
    rows = _labelled(spark, sf)
    return rows.withColumn("ok", R.introduction_prefix(F.col("label"), F.col("id"), ["doc"])).where("ok").select("id")


@query(f"{S_} SELECT id, {has('method_words')} AS methods, {has('discussion_words')} AS discussion, {has('conclusion_words')} AND NOT {has('method_like')} AS conclusion FROM s")
def p19_fallback_candidates(spark, sf):
    c = F.col("t")
    return statements(spark, sf).select("id", X.matches(c, "method_words").alias("methods"), X.matches(c, "discussion_words").alias("discussion"), (X.matches(c, "conclusion_words") & ~X.matches(c, "method_like")).alias("conclusion"))


@query(f"{S_} SELECT id FROM s WHERE price / 400000 >= CASE WHEN {LABEL} = 'introduction' THEN 0.45 ELSE 0.55 END AND NOT {has('visual_annotation')}")
def p20_compact_candidates(spark, sf):
    least = F.when(F.col("label") == "introduction", 0.45).otherwise(0.55)
    return _labelled(spark, sf).where((F.col("price") / 400000 >= least) & ~X.matches(F.col("t"), "visual_annotation")).select("id")


@query(f"{S_} SELECT id FROM s WHERE price / 400000 >= 0.55 AND ({LABEL} <> 'results' OR {has('method_like')})")
def p21_method_candidates(spark, sf):
    return _labelled(spark, sf).where((F.col("price") / 400000 >= 0.55) & ((F.col("label") != "results") | X.matches(F.col("t"), "method_like"))).select("id")


@query(rf"""{S_} SELECT id, length(u) BETWEEN 2 AND 91 AND len(string_split(u, ' ')) BETWEEN 1 AND 10 AND NOT regexp_matches(u, '[.!?;,]$') AND regexp_matches(u, '^[A-Za-z0-9][A-Za-z0-9 &,()/:-]*$')
    AND (regexp_matches(u, '(?i){PATTERN["explicit_heading"].replace("'", "''")}') OR (CASE WHEN len(regexp_extract_all(u, '\p{{L}}')) > 0 THEN CAST(len(regexp_extract_all(u, '\p{{Lu}}')) AS DOUBLE) / len(regexp_extract_all(u, '\p{{L}}')) ELSE 0 END) >= 0.6
    OR regexp_matches(u, '^(?:[0-9.]+ )?(?:[A-Z][\w-]*(?: (?:and|of|the|in|for) | |$))+$')) AS heading FROM (SELECT id, {CLEAN} AS u FROM s)""")
def p29_heading_lines(spark, sf):
    return statements(spark, sf).select("id", P.is_heading_line(F.col("t")).alias("heading"))


@query(f"{L.CLAIMS} SELECT doc, claim_id, packet_id, bool_or(same_part) AS overlap FROM pairs GROUP BY 1, 2, 3")
def j04_overlap(spark, sf):
    claims, packets = L._claims(spark, sf)
    pairs = J.related_pairs(claims, packets, "doc").join(claims.select("doc", "claim_id", F.col("refs").alias("a")), ["doc", "claim_id"]).join(packets.select("doc", "packet_id", F.col("refs").alias("b")), ["doc", "packet_id"])
    return pairs.groupBy("doc", "claim_id", "packet_id").agg(F.bool_or(F.arrays_overlap("a", "b")).alias("overlap"))


@query("SELECT l_partkey AS key, l_returnflag AS reason, CAST(l_orderkey AS VARCHAR) AS packet_id FROM lineitem GROUP BY 1, 2, 3")
def j17_discrepancy_links(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_returnflag").alias("reason"), F.col("l_orderkey").cast("string").alias("packet_id")).distinct()


def ranked_sql(score: str, limit: int, anchor: str = "''", per_anchor: int | None = None) -> str:
    """SQL of operators.reports.ranked_greedy over scored sentences: a fold over a section's items in order of score."""
    fresh = f"len(list_filter(a, lambda t: t.k <> '' AND b[1].k <> '' AND {L.near_sql('t.k', 'b[1].k')})) = 0" + (f" AND len(list_filter(a, lambda t: t.a = b[1].a)) < {per_anchor}" if per_anchor else "")
    return f"""WITH {L.SCORED}, g AS (SELECT doc_id, section, list([{{'k': key, 'o': i, 'a': {anchor}}}] ORDER BY {score} DESC, i) AS x FROM s GROUP BY 1, 2),
        f AS (SELECT doc_id, section, list_reduce(x, lambda a, b: CASE WHEN len(a) < {limit} AND {fresh} THEN list_concat(a, b) ELSE a END) AS v FROM g)
        SELECT doc_id, section, unnest(v).o AS ord, generate_subscripts(v, 1) AS rank FROM f"""


def _dealt_sentences(spark, sf) -> DataFrame:
    """Scored sentences, those of a doc_id in one partition. Documents are dealt out before they are cut, as a file of one row group is read by one task."""
    return scored_sentences(table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id"))


@query(ranked_sql("score - length(sentence) / 10000.0", 4))
def t05_ranked_fallback(spark, sf):
    rows = _dealt_sentences(spark, sf).select("doc_id", "section", (F.col("score") - F.length("sentence") / 10_000.0).alias("score"), F.col("i").alias("ord"), "sentence", F.lit("").alias("anchor"))
    return R.ranked_greedy(rows, ["doc_id", "section"], 4, text="sentence", together=True).select("doc_id", "section", "ord", "rank")


@query(f"""{S_}, x AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY id) - 1 AS DOUBLE) / greatest(1, count(*) OVER (PARTITION BY doc) - 1) AS pos FROM s)
    SELECT id, round(CASE WHEN {has('methods')} THEN 2.4 ELSE 0 END + CASE WHEN {has('method_like')} THEN 1.7 ELSE 0 END - CASE WHEN {has('concrete_result')} THEN 1.2 ELSE 0 END + CASE WHEN pos <= 0.72 THEN 0.8 ELSE 0 END, 6)::DOUBLE AS methods,
           round(CASE WHEN {has('concrete_result')} THEN 2.6 ELSE 0 END + CASE WHEN {has('high_signal')} THEN 1.8 ELSE 0 END - CASE WHEN {has('method_like')} THEN 1.3 ELSE 0 END + CASE WHEN pos BETWEEN 0.25 AND 0.9 THEN 0.8 ELSE 0 END, 6)::DOUBLE AS results FROM x""")
def t06_raw_chunk_scores(spark, sf):
    rows = statements(spark, sf).withColumn("pos", O.relative_position(["doc"], [F.col("id")]))
    return rows.select("id", *[F.round(R.raw_chunk_score(k, F.col("t"), F.col("pos")), 6).alias(k) for k in ("methods", "results")])


def _in_order_sql() -> str:
    steps, last = ["h0 AS MATERIALIZED (SELECT doc_id, slot, idx, score FROM c WHERE false)"], "h0"
    for slot in D.SLOTS:
        best = f"SELECT doc_id, slot, idx, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS r FROM c WHERE slot = '{slot}' AND NOT EXISTS (SELECT 1 FROM {last} h WHERE h.doc_id = c.doc_id AND h.idx = c.idx)) WHERE r = 1"
        steps.append(f"h{len(steps)} AS MATERIALIZED (SELECT * FROM {last} UNION ALL {best})")
        last = f"h{len(steps) - 1}"
    return f"WITH {D.SLOT_CANDIDATES}, {', '.join(steps)} SELECT * FROM {last}"


@query(_in_order_sql())
def t08_slots_in_order(spark, sf):
    rows = D._slot_candidates(spark, sf).select("doc_id", "slot", "idx", "score")
    return R.best_unused(rows, "doc_id", list(D.SLOTS))


@query(ranked_sql("score", 6, "'para:' || i // 5", 2))
def t10_presentation(spark, sf):
    rows = _dealt_sentences(spark, sf).select("doc_id", "section", "score", F.col("i").alias("ord"), "sentence", F.concat(F.lit("para:"), (F.col("i") / 5).cast("int")).alias("anchor"))
    return R.ranked_greedy(rows, ["doc_id", "section"], 6, per_anchor=2, text="sentence", together=True).select("doc_id", "section", "ord", "rank")


@query("""WITH last AS (SELECT o_custkey, max(o_orderdate) AS newest FROM orders GROUP BY 1), keep AS (SELECT o_custkey FROM last ORDER BY newest DESC, o_custkey LIMIT 3) SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM keep)""")
def r10_retention_apply(spark, sf):
    """What is left after retention has run."""
    o = table(spark, sf, "orders")
    return o.join(O.retention(o, 3, "o_custkey", "o_orderdate").select("o_custkey"), "o_custkey", "left_anti").select("o_orderkey")


@query(rf"{S_} SELECT id, array_to_string(regexp_extract_all(lower(regexp_replace(trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)\s*\(id:text-fallback-[^)]+\)\s*', ' ', 'g'), '(?i)\s*\[id:text-fallback-[^\]]+\]\s*', ' ', 'g'), '(?i)\bid:text-fallback-[a-z0-9_.:-]+\b', '', 'g'), '\s+', ' ', 'g')), '{X.CONFIDENCE}', ' ', 'g')), '\[[^\]]*\]', ' ', 'g')), '[a-z0-9]+(?:\.[0-9]+)?'), ' ') AS key FROM s")
def f11_statement_key(spark, sf):
    return statements(spark, sf).select("id", X.statement_key(F.col("t")).alias("key"))


@query(f"{S_}, c AS (SELECT id, {CLEAN} AS c FROM s) SELECT id, {L.compact_sql('c', 60)} AS compact FROM c")
def f13_compact(spark, sf):
    return statements(spark, sf).select("id", X.compact(F.col("t"), 60).alias("compact"))


@query(f"""{S_}, c AS (SELECT id, {CLEAN} AS c FROM s), h AS (SELECT id, c, c[1:60] AS h, 61 - instr(reverse(c[1:60]), '.') AS stop, 60 - instr(reverse(c[1:60]), ' ') AS blank FROM c)
    SELECT id, CASE WHEN length(c) <= 60 THEN c WHEN contains(h, '.') AND stop >= 39 THEN h[1:stop] WHEN contains(h, ' ') THEN rtrim(h[1:blank]) ELSE h END AS cut FROM h""")
def f14_truncate(spark, sf):
    return statements(spark, sf).select("id", X.truncate_safely(F.col("t"), 60).alias("cut"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS n FROM events")
def f26_payload_normaliser(spark, sf):
    """One schema for all that a payload may hold; what doesn't fit is null and then a default."""
    return table(spark, sf, "events").select("event_id", F.coalesce(F.from_json("props", "k BIGINT, findings ARRAY<STRING>")["k"], F.lit(0)).alias("n"))


@query("SELECT conv_id, turn, CAST(least(length(text), 8000) AS INTEGER) AS budget FROM conversations")
def n03_context_budget(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.least(F.length("text"), F.lit(N.context_chars(0))).alias("budget"))


@query(f"""{S_} SELECT id, CAST(CASE WHEN NOT {has('methods')} AND id % 3 <> 0 THEN 0 ELSE CASE WHEN {has('methods')} THEN 80 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 26 ELSE 0 END + CASE WHEN {has('method_like')} THEN 16 ELSE 0 END
    + round_even(price / 500000 * 12, 0) + 2 END AS INTEGER) AS score FROM s""")
def n04_slot_score(spark, sf):
    keyword = X.matches(F.col("t"), "methods")
    score = R.method_slot_score(keyword, F.col("id") % 3 == 0, F.lit(False), F.lit(False), X.matches(F.col("t"), "method_like"), F.lit(False), F.col("price") / 500000, F.lit(1))
    return statements(spark, sf).select("id", score.cast("int").alias("score"))


@query(f"{S_}, w AS (SELECT id, list_distinct(string_split(t, ' ')) AS a, list_distinct(string_split('We found the effect in participants', ' ')) AS b FROM s) SELECT id, len(list_intersect(a, b)) / greatest(len(a), len(b))::DOUBLE AS larger, len(list_intersect(a, b)) / least(len(a), len(b))::DOUBLE AS smaller FROM w")
def n08_overlap_ratios(spark, sf):
    a, b = F.array_distinct(F.split("t", " ")), F.array_distinct(F.split(F.lit("We found the effect in participants"), " "))
    return statements(spark, sf).select("id", N.overlap_of_larger(a, b).alias("larger"), N.overlap_of_smaller(a, b).alias("smaller"))


@query("SELECT source, string_agg(lang || '=' || m, ',' ORDER BY lang) AS entries FROM (SELECT source, lang, max(n_chars) AS m, row_number() OVER (PARTITION BY source ORDER BY lang) AS r FROM documents GROUP BY 1, 2) WHERE r <= 3 GROUP BY 1")
def n09_small_maps(spark, sf):
    g = table(spark, sf, "documents").groupBy("source", "lang").agg(F.max("n_chars").cast("string").alias("m"))
    maps = g.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "m")))).alias("m"))
    return maps.select("source", F.array_join(F.transform(F.map_entries(N.small_map(F.col("m"), 3)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("entries"))


@query()
def n11_sanitised_payload(spark, sf):
    rows = statements(spark, sf).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("id", "t"))).alias("x"))
    items = F.transform("x", lambda r: F.struct(r["t"].alias("statement"), F.array(F.lit("f2"), F.lit("nonsense")).alias("refs")))
    return rows.select("doc", R.sanitise_payload(F.to_json(F.struct(items.alias("items")))).alias("payload"))


@query()
def n12_legacy_findings(spark, sf):
    return R.legacy_findings(D.packets_of(D.document_chunks(table(spark, sf, "documents")))).groupBy("document_id", "category").agg(F.count(F.lit(1)).alias("findings"))


@query()
def n16_section_items(spark, sf):
    return R.section_items(D.packets_of(D.document_chunks(table(spark, sf, "documents")))).groupBy("document_id", "section", "source_modality").agg(F.count(F.lit(1)).alias("items"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def q03_jobs(spark, sf):
    rows = table(spark, sf, "orders").where("o_orderstatus = 'P'").withColumn("created_at", F.col("o_orderdate"))
    return O.page(rows, O.sort_columns("created_at:asc", "o_orderkey"), 0, 50).select("o_orderkey", "o_orderstatus")


@query("SELECT p_brand AS doc, p_type AS modality, p_size AS signature, min(p_partkey) AS chunk FROM part GROUP BY 1, 2, 3")
def q06_media(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("doc"), F.col("p_type").alias("modality"), F.col("p_size").alias("signature"), F.col("p_partkey").alias("chunk"))
    return J.first_by_signature(rows, ["doc", "modality", "signature"], [F.col("chunk")])


@query("SELECT page_id AS document_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host, 'queued' AS status FROM pages WHERE regexp_matches(url, '^https?://[^\\s/]+\\.[^\\s]+$')")
def q09_ingest(spark, sf):
    """Documents and jobs that valid addresses give."""
    none = F.lit(None).cast("string")
    return table(spark, sf, "pages").where(P.valid_source(F.lit("url"), F.col("url"), none, none) == "").select(F.col("page_id").alias("document_id"), X.url_host(F.col("url")).alias("host"), F.lit("queued").alias("status"))


@query("SELECT CAST(count(*) AS INTEGER) AS n, 0 AS errors FROM pages WHERE page_id % 2 = 0")
def u07_isolated_extractor(spark, sf):
    """A model that fails on a batch gives an error row; this one doesn't."""
    out = R.extract(table(spark, sf, "pages").select("page_id"), lambda pdf: pdf[pdf["page_id"] % 2 == 0], "page_id long")
    return out.agg(F.count("page_id").cast("int").alias("n"), F.count("error").cast("int").alias("errors"))


@query("SELECT conv_id, turn, CASE WHEN trim(text) <> '' AND turn % 2 = 1 THEN trim(text) ELSE role END AS said FROM conversations")
def u04_overrides(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", R.override(F.col("role"), F.when(F.col("turn") % 2 == 1, F.col("text"))).alias("said"))


@query("SELECT vec_id, len(embedding) AS width, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm FROM embeddings")
def u08_embeddings(spark, sf):
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    return table(spark, sf, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("width"), F.round(norm, 4).alias("norm"))


@query(rf"{S_} SELECT id, {CLEAN} AS cleaned FROM s")
def u09_registered_functions(spark, sf):
    """The SQL functions that register() offers, over a temporary view."""
    from ..functions import register

    register(spark)
    statements(spark, sf).createOrReplaceTempView("lode_statements")
    return spark.sql("SELECT id, lode_clean(t) AS cleaned FROM lode_statements")


@query(f"""{L.CLAIMS}, found AS (SELECT doc, claim_id, CASE WHEN mismatch THEN 'magnitude_mismatch' ELSE 'contradicted' END AS reason FROM pairs WHERE mismatch OR opposed GROUP BY doc, claim_id, packet_id, mismatch, opposed
    UNION ALL SELECT doc, claim_id, 'conflict_by_value' FROM by_value WHERE conflict UNION ALL SELECT doc, name, 'missing_modality' FROM l WHERE f = 'R' AND NOT EXISTS (SELECT 1 FROM rel WHERE rel.claim_id = l.name AND rel.doc = l.doc))
    SELECT doc, claim_id, reason, count(*) AS n FROM found GROUP BY 1, 2, 3""")
def c02_reconcile(spark, sf):
    """Every claim's discrepancies by reason; a08 has the statuses."""
    _, found = R.reconcile(*L._claims(spark, sf), "doc")
    return found.groupBy("doc", "claim_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query()
def c03_synthesis(spark, sf):
    """Report rows of every document: ranked non-redundant items of each section, with the items that other sections say better left out."""
    rows = scored_sentences(table(spark, sf, "documents")).select("doc_id", "section", F.col("i").alias("ord"), "key", "score", F.concat(F.lit("para:"), (F.col("i") / 5).cast("int")).alias("anchor"))
    top = R.ranked_greedy(rows, ["doc_id", "section"], 12, per_anchor=2)
    return folds.cross_section_winners(top.select("doc_id", "section", "ord", "key", "score"), "doc_id").select("doc_id", "section", "ord", "score")


@query(f"""{L.MATCHES} SELECT 'overall' AS scope, count(*) AS points, count(*) FILTER (WHERE score >= 0.42) AS hits, round(CAST(count(*) FILTER (WHERE score >= 0.42) AS DOUBLE) / count(*), 9) AS recall, round(avg(score), 9) AS mean_score FROM m""")
def c06_evaluation(spark, sf):
    m = L._matches(spark, sf)
    return m.agg(F.lit("overall").alias("scope"), F.count(F.lit(1)).alias("points"), F.count_if("matched").alias("hits"), F.round(F.count_if("matched") / F.count(F.lit(1)), 9).alias("recall"), F.round(F.avg("score"), 9).alias("mean_score"))


@query(rf"WITH {D.PACKETS} SELECT 'chunks' AS stage, count(*) AS n FROM c UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'sentences', count(*) FROM e")
def c07_stage_counts(spark, sf):
    docs = table(spark, sf, "documents")
    chunks = D.document_chunks(docs)
    said = chunks.select(F.explode(X.sentences(F.col("content"))))
    return docs.agg(F.lit("documents").alias("stage"), F.count(F.lit(1)).alias("n")).unionByName(chunks.agg(F.lit("chunks").alias("stage"), F.count(F.lit(1)).alias("n"))).unionByName(said.agg(F.lit("sentences").alias("stage"), F.count(F.lit(1)).alias("n")))


@query("SELECT s_nationkey AS model, max(s_acctbal) AS best, rank() OVER (ORDER BY max(s_acctbal) DESC, s_nationkey) = 1 AS winner FROM supplier GROUP BY 1")
def c09_model_benchmark(spark, sf):
    g = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("model")).agg(F.max("s_acctbal").alias("best"))
    return g.withColumn("winner", F.rank().over(Window.orderBy(F.desc("best"), "model")) == 1)


@query(f"{L.QUALITY} SELECT lang, count(*) AS reports, avg(score) AS mean_score, count(*) FILTER (WHERE score < 60) AS failing FROM q JOIN documents USING (doc_id) GROUP BY lang")
def c10_report_audit(spark, sf):
    q = L._quality(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return q.groupBy("lang").agg(F.count(F.lit(1)).alias("reports"), F.avg("score").alias("mean_score"), F.count_if(F.col("score") < 60).alias("failing"))


@query("SELECT conv_id, turn, text || ' [turn:' || turn || '] (refs: ' || role || ', r' || turn % 3 || ')' AS said FROM conversations")
def f17_provenance(spark, sf):
    c = table(spark, sf, "conversations").withColumn("anchor", F.concat(F.lit("turn:"), F.col("turn")))
    refs = F.array("anchor", "role", F.concat(F.lit("r"), F.col("turn") % 3), "role")
    return c.select("conv_id", "turn", X.with_provenance(F.col("text"), F.col("anchor"), refs).alias("said"))


@query("SELECT page_id, 'https://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)) || regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z]+://[^/?#]+', ''), '#.*$', ''), '/+$', '') AS url FROM pages")
def f28_normal_urls(spark, sf):
    """Addresses in other spellings come back to one."""
    host = F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]+)", 1)
    rest = F.regexp_replace("url", r"^[A-Za-z]+://[^/?#]+", "")
    return table(spark, sf, "pages").select("page_id", X.normal_url(F.concat(F.lit("HTTPS://"), host, rest, F.lit("/#top"))).alias("url"))


@query("SELECT event_id, date_trunc('second', ts) AS from_seconds, date_trunc('second', ts) AS from_millis FROM events")
def n05_epochs(spark, sf):
    """Seconds and milliseconds, told apart by their digits."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    at = [N.epoch_timestamp(x).cast("timestamp_ntz").alias(name) for x, name in ((seconds, "from_seconds"), (seconds * 1000, "from_millis"))]
    return table(spark, sf, "events").select("event_id", *at)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'F') THEN lower(o_orderstatus) ELSE 'p' END AS status FROM orders")
def n14_domain(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", N.one_of(F.col("o_orderstatus"), ("o", "f"), "p").alias("status"))
