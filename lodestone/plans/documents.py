"""Composite operators over documents, pages and conversations: chunking, packets, reports, evaluation, streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EngineConfig, PROFILES, SECTIONS
from ..functions import predicates as P
from ..functions import similarity as S
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import folds
from ..operators import ordered as O
from ..operators import reports as RP
from ..sources import readers as R
from ..sources import sinks as K
from ..streaming import jobs
from ..workspace import scratch, written
from .relational import KEPT, SCORED, SENTENCES, WORDSET, compact_sql, near_sql, scored_sentences, table

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
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}


# chunks and packets


def document_chunks(docs: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(document_id, ord, anchor, content) of the paragraphs of at least min_paragraph characters, numbered by place; all of them, as text files have no limit (max_chunks is that of pages)."""
    lines = docs.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", r"\n")).alias("i", "line"))
    rows = lines.select("document_id", "i", X.clean_space(F.col("line")).alias("content")).where(F.length("content") >= config.min_paragraph)
    w = Window.partitionBy("document_id").orderBy("i")
    return rows.withColumn("ord", F.row_number().over(w)).select("document_id", "ord", F.concat(F.lit("para:"), "ord").alias("anchor"), "content")


def packets_of(chunks: DataFrame) -> DataFrame:
    """Sentence packets of chunks: section by place, numbers, references, canonical key; noise is left out."""
    place = O.relative_position(["document_id"], [F.col("ord")])
    said = chunks.withColumn("section", O.position_section(place)).select("document_id", "ord", "anchor", "section", F.posexplode(X.sentences(F.col("content"))).alias("pos", "sentence"))
    s = F.col("sentence")
    return said.where((F.length("sentence") >= 24) & ~P.is_noise(s)).select(
        "document_id", F.col("ord").alias("chunk"), "pos", "anchor", "section", "sentence", X.canonical(s).alias("key"), X.all_refs(s).alias("refs"), X.first_number(s).alias("value"), X.p_value(s).alias("p"),
        F.least(F.lit(0.95), 0.5 + F.length("sentence") / 1000.0).alias("confidence"),
    )


PACKETS = rf"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ord FROM (SELECT doc_id, i, trim(regexp_replace(line, '\s+', ' ', 'g')) AS text FROM l) WHERE length(text) >= 30),
    k AS (SELECT *, CAST(ord - 1 AS DOUBLE) / greatest(1, count(*) OVER (PARTITION BY doc_id) - 1) AS pos FROM c),
    e AS (SELECT doc_id, ord, pos, unnest({SENTENCES}) AS sentence, generate_subscripts({SENTENCES}, 1) - 1 AS j FROM k)"""


#: Packets that are no noise.
NOISE_FREE = r"""length(sentence) >= 24 AND NOT regexp_matches(sentence, '^[0-9\s.,;:%()-]+$') AND NOT contains(sentence, '$^{') AND NOT (length(sentence) >= 16 AND CAST(len(regexp_extract_all(sentence, '\p{Lu}')) AS DOUBLE) / greatest(1, len(regexp_extract_all(sentence, '\p{L}'))) > 0.85)
    AND NOT regexp_matches(sentence, '(?i)\b(doi:|received [a-z]+ \d{1,2}, \d{4}|revision received|accepted [a-z]+ \d{1,2}, \d{4}|published online|address correspondence|presented at|supported by nih|financial relationships|customer service|table\s+\d+|figure\s+\d+)\b')"""


@query(rf"WITH {PACKETS} SELECT doc_id AS document_id, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM c GROUP BY 1")
def s06_document_chunks(spark, sf):
    return document_chunks(table(spark, sf, "documents")).groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("chars"))


@query(rf"""WITH {PACKETS} SELECT doc_id AS document_id, CASE WHEN pos <= 0.22 THEN 'introduction' WHEN pos <= 0.52 THEN 'methods' WHEN pos <= 0.70 THEN 'results' WHEN pos <= 0.90 THEN 'discussion' ELSE 'conclusion' END AS section, count(*) AS packets
    FROM e WHERE {NOISE_FREE} GROUP BY 1, 2""")
def u01_text_packets(spark, sf):
    """The deterministic extractor: what a model would be asked for, by rules."""
    return packets_of(document_chunks(table(spark, sf, "documents"))).groupBy("document_id", "section").agg(F.count(F.lit(1)).alias("packets"))


@query(rf"""WITH {PACKETS}, p AS (SELECT doc_id, ord, j, CASE WHEN pos <= 0.22 THEN 'introduction' WHEN pos <= 0.52 THEN 'methods' WHEN pos <= 0.70 THEN 'results' WHEN pos <= 0.90 THEN 'discussion' ELSE 'conclusion' END AS section, sentence,
    array_to_string(regexp_extract_all(lower(sentence), '[a-z0-9]+(?:\.[0-9]+)?'), ' ') AS key FROM e WHERE {NOISE_FREE}),
    g AS (SELECT doc_id, list([{{'c': ord, 'p': j, 's': section, 't': sentence, 'k': key}}] ORDER BY ord, j) AS x FROM p GROUP BY 1),
    r AS (SELECT doc_id, unnest(list_reduce(x, lambda a, b: CASE WHEN len(list_filter(a, lambda t: t.s = b[1].s)) < CASE b[1].s {' '.join(f"WHEN '{k}' THEN {v}" for k, v in EngineConfig().quotas.items())} ELSE 0 END
        AND len(list_filter(a, lambda t: t.c = b[1].c)) < {EngineConfig().per_chunk} AND len(list_filter(a, lambda t: t.k = b[1].k)) = 0 THEN list_concat(a, b) ELSE a END)) AS v FROM g)
    SELECT doc_id AS document_id, v.c AS chunk, v.p AS pos, v.s AS section, v.t AS sentence, v.k AS key FROM r""")
def d12_quota_sample(spark, sf):
    return folds.quota_sample(packets_of(document_chunks(table(spark, sf, "documents"))).select("document_id", "chunk", "pos", "section", "sentence", "key"), "document_id")


@query(rf"""WITH {PACKETS}, p AS (SELECT doc_id, ord, j, CASE WHEN pos <= 0.22 THEN 'introduction' WHEN pos <= 0.52 THEN 'methods' WHEN pos <= 0.70 THEN 'results' WHEN pos <= 0.90 THEN 'discussion' ELSE 'conclusion' END AS section,
    array_to_string(regexp_extract_all(lower(sentence), '[a-z0-9]+(?:\.[0-9]+)?'), ' ') AS key FROM e WHERE {NOISE_FREE}), g AS (SELECT doc_id AS document_id, section, list([key] ORDER BY ord, j) FILTER (WHERE key <> '') AS x FROM p GROUP BY 1, 2),
    r AS (SELECT document_id, section, CASE WHEN x IS NULL THEN [] ELSE {KEPT} END AS v FROM g) SELECT document_id, section, CAST(len(v) AS INTEGER) AS kept, array_to_string(v, '|') AS keys FROM r""")
def d07_greedy_statements(spark, sf):
    """Sentences of each section of a document that repeat none before them there."""
    rows = packets_of(document_chunks(table(spark, sf, "documents"))).withColumn("ord", F.struct("chunk", "pos"))
    kept = folds.greedy_statements(rows, ["document_id", "section"], "ord", "key")
    return kept.select("document_id", "section", F.size("kept").alias("kept"), F.array_join("kept", "|").alias("keys"))


@query()
def d08_merge_items(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("ord"), X.canonical(F.col("text")).alias("key"), F.col("text").alias("statement"), F.array("role").alias("refs"), (F.length("text") % 100 / 100.0).alias("confidence"))
    return folds.merge_items(rows, ["conv_id"]).select("conv_id", "ord", "place", "confidence", F.size("refs").alias("n_refs"))


@query()
def d09_cross_section(spark, sf):
    rows = scored_sentences(table(spark, sf, "documents")).select("doc_id", "section", F.col("i").alias("ord"), "key", "score")
    return folds.cross_section_winners(rows, "doc_id").groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("left"))


@query(r"""WITH p AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, text ORDER BY length(role) DESC, turn) AS r FROM conversations) SELECT conv_id, turn, CASE WHEN r = 1 OR role <> 'user' THEN text ELSE '' END AS statement FROM p""")
def d10_slot_dedupe(spark, sf):
    """Of rows that say exactly the same, losers of the protected kind keep their text, the others are blanked."""
    w = Window.partitionBy("conv_id", "text").orderBy(F.length("role").desc(), "turn")
    c = table(spark, sf, "conversations").withColumn("r", F.row_number().over(w))
    return c.select("conv_id", "turn", F.when((F.col("r") == 1) | (F.col("role") != "user"), F.col("text")).otherwise("").alias("statement"))


def _slot_candidates(spark, sf) -> DataFrame:
    rows = scored_sentences(table(spark, sf, "documents"))
    hit = F.array(*[F.when(F.regexp_count(F.lower("sentence"), F.lit(rf"\b{w}\b")) > 0, F.lit(s)) for s, w in SLOTS.items()])
    each = rows.withColumn("slot", F.explode(F.filter(hit, lambda x: x.isNotNull())))
    score = 80.0 + F.col("score") * 10
    return each.select("doc_id", "slot", F.col("i").cast("long").alias("idx"), F.concat(F.lit("para:"), (F.col("i") / 5).cast("int")).alias("anchor"), "key", F.col("sentence").alias("statement"), score.alias("score"))


SLOTS = {"design": "that", "sample": "with", "measures": "from", "analysis": "this"}
SLOT_CANDIDATES = rf"""{SCORED}, c AS (SELECT doc_id, slot, i AS idx, 'para:' || i // 5 AS anchor, key, sentence AS statement, 80.0 + score * 10 AS score FROM s, (VALUES {', '.join(f"('{k}', '{w}')" for k, w in SLOTS.items())}) w(slot, word) WHERE regexp_matches(lower(sentence), '\b' || word || '\b'))"""


def _assigned_sql() -> str:
    """CTEs whose last, f, has every document's slots as the greedy assignment fills them: a step a slot, and again for what is left, where anchors may repeat."""
    steps, last = ["h0 AS MATERIALIZED (SELECT * EXCLUDE (score) FROM c WHERE false)"], "h0"
    for again in (False, True):
        for slot in SLOTS:
            taken = f"h.slot = '{slot}' OR h.idx = c.idx OR (c.key <> '' AND h.key <> '' AND {near_sql('c.key', 'h.key')})" + ("" if again else " OR h.anchor = c.anchor")
            best = f"SELECT * EXCLUDE (score, r) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS r FROM c WHERE slot = '{slot}' AND score > 0 AND NOT EXISTS (SELECT 1 FROM {last} h WHERE h.doc_id = c.doc_id AND ({taken}))) WHERE r = 1"
            steps.append(f"h{len(steps)} AS MATERIALIZED (SELECT * FROM {last} UNION ALL {best})")
            last = f"h{len(steps) - 1}"
    every = f"(SELECT DISTINCT doc_id FROM c) d, (VALUES {', '.join(f"('{k}')" for k in SLOTS)}) w(slot)"
    return f"WITH {SLOT_CANDIDATES}, {', '.join(steps)}, f AS (SELECT d.doc_id, w.slot, coalesce(h.statement, '') AS statement, coalesce(h.anchor, '') AS anchor, coalesce(h.idx, -1) AS idx, CASE WHEN h.idx IS NULL THEN 'not_found' ELSE 'found' END AS status FROM {every} LEFT JOIN {last} h ON h.doc_id = d.doc_id AND h.slot = w.slot)"


@query(f"{_assigned_sql()} SELECT * FROM f")
def t07_slot_assignment(spark, sf):
    return folds.assign_slots(_slot_candidates(spark, sf), "doc_id", list(SLOTS))


@query(f"""{_assigned_sql()}, gap AS (SELECT doc_id, slot, row_number() OVER (PARTITION BY doc_id ORDER BY slot) AS n FROM f WHERE status = 'not_found'),
    spare AS (SELECT doc_id, statement, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM (SELECT DISTINCT doc_id, idx, statement FROM c) x WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = x.doc_id AND f.idx = x.idx))
    SELECT gap.doc_id, gap.slot, coalesce(statement, '') AS statement FROM gap LEFT JOIN spare USING (doc_id, n)""")
def t09_slot_rescue(spark, sf):
    """Empty slots take unused candidates in order: gaps and candidates are numbered and joined on the number."""
    filled = t07_slot_assignment(spark, sf)
    gap = filled.where("status = 'not_found'").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("slot"))).select("doc_id", "slot", "n")
    spare = _slot_candidates(spark, sf).select("doc_id", "idx", "statement").distinct().join(filled.select("doc_id", "idx"), ["doc_id", "idx"], "left_anti")
    spare = spare.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")))
    return gap.join(spare, ["doc_id", "n"], "left").select("doc_id", "slot", F.coalesce("statement", F.lit("")).alias("statement"))


@query()
def w03_section_smoothing(spark, sf):
    rows = scored_sentences(table(spark, sf, "documents"))
    lexical = F.when(F.lower("sentence").rlike(r"\bthis\b"), "methods").when(F.lower("sentence").rlike(r"\bfrom\b"), "results").otherwise("")
    best = A.votes([(F.col("section"), F.lit(0.46)), (lexical, F.lit(0.60))], SECTIONS)
    place = O.relative_position(["doc_id"], [F.col("i")])
    voted = rows.select("doc_id", F.col("i").alias("ord"), place.alias("position"), best["label"].alias("best"), best["score"].alias("best_score"), F.when(lexical == F.col("section"), 0.0).when(lexical == "", 0.0).otherwise(0.46).alias("second_score"), F.lit(False).alias("explicit"))
    return folds.smooth_sections(voted, "doc_id").select("doc_id", "ord", "label", "flag")


@query(f"""WITH {SCORED} SELECT doc_id, i, coalesce(last_value(CASE WHEN section <> 'conclusion' THEN section END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unknown') AS section FROM s""")
def w05_previous_carry(spark, sf):
    """The unlabelled tail takes the label before it."""
    rows = scored_sentences(table(spark, sf, "documents")).withColumn("known", F.when(F.col("section") != "conclusion", F.col("section")))
    return rows.select("doc_id", "i", F.coalesce(O.carry_forward(F.col("known"), ["doc_id"], [F.col("i")]), F.lit("unknown")).alias("section"))


@query()
def w06_abstract_parts(spark, sf):
    from .statements import statements

    rows = statements(spark, sf).select("id", F.posexplode(X.abstract_parts(F.col("t"))).alias("part", "p"))
    return rows.select("id", "part", "p.label", "p.text")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), b AS (SELECT *, sum(CASE WHEN length(line) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM l),
    t AS (SELECT *, min(CASE WHEN length(line) = 0 THEN i END) OVER (PARTITION BY doc_id, block) AS stop FROM b), k AS (SELECT doc_id, block, sum(len(string_split(line, ' '))) AS words FROM t WHERE stop IS NULL OR i < stop GROUP BY 1, 2)
    SELECT doc_id, CAST(max(words) AS BIGINT) AS words, count(*) AS blocks FROM k WHERE words >= 8 GROUP BY 1""")
def w07_legend_blocks(spark, sf):
    """Lines between a title and the next stop belong to the title's block; the longest block of a token stays."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", r"\n")).alias("i", "line"))
    block = F.sum(F.when(F.length("line") < 60, 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("i"))
    rows = lines.withColumn("block", block)
    stop = F.min(F.when((F.length("line") == 0), F.col("i"))).over(Window.partitionBy("doc_id", "block"))
    kept = rows.withColumn("stop", stop).where("stop is null or i < stop").groupBy("doc_id", "block").agg(F.sum(F.size(F.split("line", " "))).alias("words"))
    return kept.where("words >= 8").groupBy("doc_id").agg(F.max("words").alias("words"), F.count(F.lit(1)).alias("blocks"))


@query("""WITH l AS (SELECT event_type, list({'t': ts, 'ids': [event_id]} ORDER BY ts, event_id) AS x FROM events GROUP BY 1)
    SELECT event_type, unnest(list_reduce(x, lambda a, b: CASE WHEN b.t - a.t >= INTERVAL 2 HOUR THEN {'t': b.t, 'ids': list_concat(a.ids, b.ids)} ELSE a END).ids) AS event_id FROM l""")
def w11_event_gap(spark, sf):
    return folds.event_gap_filter(table(spark, sf, "events").select("event_type", "ts", "event_id"), "event_type", 7200.0)


# pages


@query()
def s09_page_paragraphs(spark, sf):
    return R.paragraph_chunks(R.page_parts(table(spark, sf, "pages"))).select("page_id", "anchor", "content", "section_norm", "paragraph_index")


@query("SELECT page_id, len(regexp_extract_all(html, '<a href=\"[^\"]*\"')) AS links FROM pages")
def s12_page_links(spark, sf):
    parts = R.page_parts(table(spark, sf, "pages")).where("kind = 'link'").groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))
    return table(spark, sf, "pages").select("page_id").join(parts, "page_id", "left").select("page_id", F.coalesce("links", F.lit(0)).alias("links"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'),
    '(?s)<!--.*?-->', ' ', 'g'), '(?i)<(?:br|/p|/li|/h[1-6]|/div|/tr|p|li|h[1-6]|div|tr)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t]+', ' ', 'g'), '\s*\n\s*\n\s*\n+', chr(10) || chr(10), 'g')) AS text FROM pages""")
def s13_readable_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", R.readable_text(F.col("html")).alias("text"))


@query("""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
    SELECT page_id, href, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || href ELSE regexp_extract(regexp_replace(url, '[?#].*$', ''), '^([A-Za-z]+://.*/)[^/]*$', 1) || href END AS target, count(*) AS n FROM l GROUP BY 1, 2, 3""")
def f29_link_targets(spark, sf):
    links = table(spark, sf, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("page_id", "href", X.join_url(F.col("url"), F.col("href")).alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, array_to_string(regexp_extract_all(lower(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '[a-z0-9]+')[1:8], '_') AS slug FROM pages")
def k04_export_names(spark, sf):
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return table(spark, sf, "pages").select("page_id", title.alias("title"), X.slug(title).alias("slug"))


@query("""WITH f AS (SELECT o_custkey % 10 AS family, o_orderdate AS stamp, o_orderkey AS path FROM orders) SELECT family, path FROM (SELECT *, dense_rank() OVER (PARTITION BY family ORDER BY stamp DESC) AS r FROM f) WHERE r > 5""")
def k10_prune_artifacts(spark, sf):
    f = table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("family"), F.col("o_orderdate").alias("stamp"), F.col("o_orderkey").alias("path"))
    return K.prune_artifacts(f, 5).select("family", "path")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def k02_cascade_delete(spark, sf):
    gone = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return K.without_documents(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), gone, "o_custkey")


@query("SELECT page_id FROM pages WHERE length(html) >= 1200")
def k09_main_fallback(spark, sf):
    return K.main_fallback(table(spark, sf, "pages"), "html").select("page_id")


@query("""SELECT conv_id, string_agg(body, chr(10) || chr(10) ORDER BY role) AS markdown FROM (SELECT conv_id, role, '## ' || upper(role[1]) || role[2:] || chr(10) || string_agg('- ' || line || ' [' || role || ']', chr(10) ORDER BY turn) AS body
    FROM (SELECT conv_id, turn, role, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:6], '_') AS line FROM conversations) GROUP BY conv_id, role) GROUP BY conv_id""")
def k05_markdown(spark, sf):
    items = table(spark, sf, "conversations").select("conv_id", F.col("role").alias("section"), F.col("turn").alias("ord"), F.lit(0).alias("section_ord"), X.slug(F.col("text"), 6).alias("statement"), F.array("role").alias("refs"))
    return K.markdown(items, "conv_id")


@query("SELECT source AS key, '{' || string_agg('\"' || lang || '\":\"' || m || '\"', ',' ORDER BY lang) || '}' AS json FROM (SELECT source, lang, CAST(max(n_chars) AS VARCHAR) AS m FROM documents GROUP BY 1, 2) GROUP BY 1")
def k07_legend_map(spark, sf):
    rows = table(spark, sf, "documents").groupBy(F.col("source").alias("key"), F.col("lang").alias("token")).agg(F.max("n_chars").cast("string").alias("caption"))
    return K.legend_map(rows, "key")


# whole runs


@query()
def c01_full_analysis(spark, sf):
    """Every document in one plan: chunks, packets, quota sample, coverage, reconciliation of what is claimed with what was found, and the report's items."""
    every = packets_of(document_chunks(table(spark, sf, "documents"))).withColumn("tone", P.polarities(F.col("sentence")))
    packets = written(every.drop("sentence", "p"), "c01-packets")
    sample = folds.quota_sample(packets.select("document_id", "chunk", "pos", "section", "key"), "document_id")
    chosen = sample.groupBy("document_id").agg(F.count(F.lit(1)).alias("chosen"), F.count_distinct("section").alias("sections"))
    every = packets.groupBy("document_id").agg(F.count(F.lit(1)).alias("packets"), F.avg("confidence").alias("mean"), F.count("value").alias("with_numbers"))
    found = F.col("section").isin("methods", "results")
    said = packets.select("document_id", F.concat_ws("-", "chunk", "pos").alias("name"), "tone", F.array("anchor").alias("refs"), F.col("refs").alias("said_refs"), "value", found.alias("found"))
    status, _ = RP.reconcile(said.where("not found").withColumnRenamed("name", "claim_id"), said.where("found").withColumnRenamed("name", "packet_id"), "document_id")
    judged = status.groupBy("document_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("status").isin("contradicted", "partial")).alias("conflicting"))
    items = packets.select(F.col("document_id").alias("doc_id"), "section", (F.col("chunk") * 1000 + F.col("pos")).alias("ord"), "key", F.col("confidence").alias("score"), "anchor")
    kept = folds.cross_section_winners(RP.ranked_greedy(items, ["doc_id", "section"], 12, per_anchor=2).select("doc_id", "section", "ord", "key", "score"), "doc_id")
    report = kept.groupBy(F.col("doc_id").alias("document_id")).agg(F.count(F.lit(1)).alias("items"))
    whole = every.join(chosen, "document_id", "left").join(judged, "document_id", "left").join(report, "document_id", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("chosen", "sections", "claims", "conflicting", "items")]
    return whole.select("document_id", "packets", "with_numbers", *counts, F.round(A.overall_confidence(F.col("mean"), F.lit(0)), 6).alias("confidence"))


@query(f"""WITH {SCORED}, t AS (SELECT *, CASE WHEN score >= 2.0 THEN 0 WHEN score >= 1.2 THEN 1 ELSE 2 END AS tier, CASE section {' '.join(f"WHEN '{k}' THEN {v}" for k, v in PROFILES['balanced'].section_targets.items())} ELSE 6 END AS target FROM s),
    w AS (SELECT *, CASE WHEN count(*) FILTER (WHERE tier = 0) OVER g >= target THEN 0 WHEN count(*) FILTER (WHERE tier <= 1) OVER g >= target THEN 1 ELSE 2 END AS wanted FROM t WINDOW g AS (PARTITION BY doc_id, section))
    SELECT doc_id, section, count(*) AS items, max(tier) AS tier FROM w WHERE tier <= wanted GROUP BY 1, 2""")
def c04_section_tiers(spark, sf):
    """Tiers of candidates: a section takes the next tier only while it has too few rows."""
    config = PROFILES["balanced"]
    rows = scored_sentences(table(spark, sf, "documents")).withColumn("tier", F.when(F.col("score") >= 2.0, 0).when(F.col("score") >= 1.2, 1).otherwise(2))
    counts = rows.groupBy("doc_id", "section").agg(*[F.count_if(F.col("tier") <= t).alias(f"upto{t}") for t in (0, 1)])
    target = F.coalesce(F.create_map(*[F.lit(x) for k, v in config.section_targets.items() for x in (k, v)])[F.col("section")], F.lit(6))
    wanted = F.when(F.col("upto0") >= target, 0).when(F.col("upto1") >= target, 1).otherwise(2)
    return rows.join(counts, ["doc_id", "section"]).where(F.col("tier") <= wanted).groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("items"), F.max("tier").alias("tier"))


@query(f"""WITH {SCORED}, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY score DESC, i) AS r FROM s), c AS (SELECT doc_id, section, trim(regexp_replace(string_agg(sentence, ' ' ORDER BY i), '\\s+', ' ', 'g')) AS c FROM t WHERE r <= 3 GROUP BY 1, 2)
    SELECT doc_id, section, {compact_sql('c', 400)} AS summary FROM c""")
def c05_executive_summary(spark, sf):
    """The best three sentences of each of a document's sections, joined and cut at a sentence."""
    top = O.top_k(scored_sentences(table(spark, sf, "documents")), ["doc_id", "section"], [F.desc("score"), F.col("i")], 3)
    said = top.groupBy("doc_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "sentence"))), lambda x: x["sentence"]), " ").alias("s"))
    return said.select("doc_id", "section", X.compact(F.col("s"), 400).alias("summary"))


@query(f"""WITH k AS (SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+(?:\\.[0-9]+)?'), ' ') AS key FROM conversations), g AS (SELECT conv_id, list([key] ORDER BY turn) FILTER (WHERE key <> '') AS x FROM k GROUP BY 1)
    SELECT conv_id, CAST(CASE WHEN x IS NULL THEN 0 ELSE len({KEPT}) END AS INTEGER) AS kept FROM g""")
def d06_near_duplicate_fold(spark, sf):
    """Conversation turns that say nothing new, by the greedy filter inside each conversation."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", X.canonical(F.col("text")).alias("key"))
    return folds.greedy_statements(rows, ["conv_id"], "turn", "key").select("conv_id", F.size("kept").alias("kept"))


@query(f"""WITH w AS (SELECT a.conv_id, a.turn, {WORDSET.format('a.text')} AS x, {WORDSET.format('b.text')} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    m AS (SELECT *, CASE WHEN len(x) > 0 AND len(y) > 0 THEN 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) ELSE 0.0 END::DOUBLE AS l, CASE WHEN len(x) > 0 AND len(y) > 0 THEN CAST(len(list_intersect(x, y)) AS DOUBLE) / (len(x) + len(y) - len(list_intersect(x, y))) ELSE 0.0 END AS k FROM w)
    SELECT conv_id, turn, round(0.48 * l + 0.34 * k + 0.18 * 0.5, 9)::DOUBLE AS score, CASE WHEN l >= k AND l >= 0.5 THEN 'lexical' WHEN k >= 0.5 THEN 'keyword' ELSE 'embedding' END AS reason FROM m""")
def f07_hybrid_scores(spark, sf):
    """Hybrid similarity of neighbouring turns."""
    c = table(spark, sf, "conversations")
    pairs = c.select("conv_id", "turn", "text").join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next")), ["conv_id", "turn"])
    lexical, keyword = S.token_f1(F.col("text"), F.col("next")), S.jaccard(F.col("text"), F.col("next"))
    return pairs.select("conv_id", "turn", F.round(S.hybrid(lexical, keyword, F.lit(0.5)), 9).alias("score"), S.hybrid_reason(lexical, keyword, F.lit(0.5)).alias("reason"))


# streams


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    batch = table(spark, sf, name)
    return spark.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf}/{name}.parquet*")


def _run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Rows of a stream over what is there now, through files in the shared folder: all that it gave, with the number of the batch, or in complete mode what the last batch gave."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession, "stream")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={n}")
    q = stream.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", scratch(spark, "stream-state")).start()
    q.awaitTermination()
    schema = stream.schema if mode == "complete" else T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(out)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def r01_stream_counts(spark, sf):
    """The queue's consumer over all events that are there: counts by kind."""
    return _run_to_end(_stream(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "complete")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS began, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def r11_stream_windows(spark, sf):
    events = _stream(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return _run_to_end(jobs.windowed_counts(events, "t", "event_type", size="1 day"), "complete").select(F.col("began").cast("timestamp_ntz").alias("began"), "event_type", "n")


@query("""WITH l AS (SELECT user_id AS job_id, list({'s': CASE event_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE 'queued' END, 'm': 0} ORDER BY ts) AS x FROM events GROUP BY 1),
    r AS (SELECT job_id, list_reduce(list_prepend({'s': 'queued', 'm': 0}, x), lambda a, b: CASE WHEN (a.s = 'queued' AND b.s IN ('running', 'failed')) OR (a.s = 'running' AND b.s IN ('completed', 'failed', 'queued')) OR (a.s = 'failed' AND b.s = 'queued')
        THEN {'s': b.s, 'm': a.m + 1} ELSE a END) AS r FROM l) SELECT job_id, r.s AS status, CAST(r.m AS BIGINT) AS moves FROM r""")
def r03_status_stream(spark, sf):
    """Jobs' states kept as state a job: moves follow the events in order, forbidden ones are ignored."""
    events = _stream(spark, sf, "events").select(F.col("user_id").alias("job_id"), "ts", F.element_at(F.array(*[F.lit(s) for s in ("running", "completed", "failed", "queued")]), (F.col("event_id") % 4).cast("int") + 1).alias("status"))
    return _run_to_end(jobs.status_stream(events), "update").groupBy("job_id").agg(F.max_by("status", "batch").alias("status"), F.max_by("moves", "batch").alias("moves"))


@query("SELECT o_orderkey AS job_id, max_by(o_orderstatus, o_orderdate) AS status FROM orders GROUP BY 1")
def r03_latest_status(spark, sf):
    e = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"))
    return jobs.latest_status(e).select("job_id", "status")
