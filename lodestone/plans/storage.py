"""Queries that write and read back: sinks, archives, workbooks, made pages, the queue and its polls, with the SQL of what must come back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import PROFILES
from ..functions import predicates as P
from ..operators import joins as J
from ..operators import reports as O
from ..sources import readers as R
from ..sources import sinks as K
from ..streaming import jobs
from ..workspace import scratch
from . import relational as L
from .relational import table

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


# sinks


@query("SELECT n_regionkey AS document_id, n_nationkey, CASE WHEN n_regionkey < 2 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation WHERE n_regionkey >= 2 OR n_nationkey % 2 = 0")
def k01_replaced_partitions(spark, sf):
    """All documents are written; then two of them again with other rows, which replace what they had and nothing else."""
    rows, path = table(spark, sf, "nation").select(F.col("n_regionkey").alias("document_id"), "n_nationkey", "n_name"), scratch(spark, "k01")
    K.replace_documents(rows, path)
    K.replace_documents(rows.where("document_id < 2 and n_nationkey % 2 = 0").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!"))), path)
    return spark.read.schema(rows.schema).parquet(path)


@query("SELECT doc_id, json_object('source', source, 'lang', lang) AS payload FROM documents")
def k03_json_artifact(spark, sf):
    """One JSON artifact a document, read back as text."""
    path = scratch(spark, "k03")
    K.json_artifacts(table(spark, sf, "documents").select("doc_id", "source", "lang"), path)
    back = spark.read.schema("doc_id long, source string, lang string").json(path)
    return back.select("doc_id", F.to_json(F.struct("source", "lang"), {"ignoreNullFields": "false"}).alias("payload"))


@query("SELECT lang AS section, count(*) AS hits, '- ' || lang || ': ' || count(*) || ' items' AS line FROM documents GROUP BY lang")
def k06_metric_lines(spark, sf):
    counts = table(spark, sf, "documents").groupBy(F.col("lang").alias("section")).agg(F.count(F.lit(1)).alias("hits"))
    return K.metric_lines(counts, "section", "hits")


@query("SELECT event_type AS event, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1")
def k08_event_lines(spark, sf):
    """Events appended in two turns as JSON lines, and read as a log."""
    e, path = table(spark, sf, "events"), scratch(spark, "k08")
    lines = e.select(F.col("event_type").alias("event"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.create_map(F.lit("id"), F.col("event_id").cast("string")).alias("details"))
    for part in (lines.where("cast(details['id'] as long) % 2 = 0"), lines.where("cast(details['id'] as long) % 2 = 1")):
        K.append_events(part, path)
    found = F.col("details")["id"].cast("long")
    return R.event_log(spark, path).groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.min(found).alias("first_id"), F.max(found).alias("last_id"))


def _bundles(spark, sf) -> DataFrame:
    """An archive a region: a CSV of its nations, a text, and a member whose name leaves the archive."""
    n = table(spark, sf, "nation")
    body = F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(",", F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), "n_name"))))
    files = n.groupBy("n_regionkey").agg(F.concat(F.lit("key,name\n"), body).alias("csv"), F.count(F.lit(1)).alias("c"))
    member = F.explode(F.array(*[F.struct(F.lit(name).alias("member"), c.alias("content")) for name, c in (("supp/nations.csv", F.col("csv")), ("notes.txt", F.concat(F.lit("nations: "), "c")), ("../out.txt", F.lit("no")))]))
    each = files.select(F.concat(F.lit("region-"), "n_regionkey", F.lit(".zip")).alias("path"), member.alias("m")).select("path", "m.member", F.encode("m.content", "UTF-8").alias("content"))
    return K.bundle(each, "path")


@query("""WITH f AS (SELECT n_regionkey AS r, 'key,name' || chr(10) || string_agg(lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || ',' || n_name, chr(10) ORDER BY n_nationkey) AS csv, count(*) AS c FROM nation GROUP BY 1)
    SELECT 'region-' || r || '.zip!supp/nations.csv' AS path, 'nations.csv' AS name, 'tabular' AS kind, csv AS said FROM f UNION ALL SELECT 'region-' || r || '.zip!notes.txt', 'notes.txt', 'text', 'nations: ' || c FROM f""")
def s19_archive_members(spark, sf):
    """Members of archives that the diagnostics sink packed; the one that leaves its archive is left out."""
    rows = _bundles(spark, sf).withColumn("kind", F.lit("archive"))
    return R.archive_members(rows).select("path", "name", "kind", F.decode("content", "UTF-8").alias("said"))


@query("SELECT 'region-' || n_regionkey || '.zip' AS path, true AS is_archive FROM nation GROUP BY n_regionkey")
def k11_diagnostics_zip(spark, sf):
    return _bundles(spark, sf).select("path", (R.sniff(F.col("content")) == "archive").alias("is_archive"))


# sources


def _workbooks(spark, sf) -> DataFrame:
    """A workbook a region with its nations: shared, inline and plain cells, and a gap."""
    n, ns = table(spark, sf, "nation"), R.SHEET.strip("{}")
    rank = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    row = F.concat(F.lit('<row r="'), F.col("k") + 1, F.lit('"><c r="A'), F.col("k") + 1, F.lit('"><v>'), "n_nationkey", F.lit('</v></c><c r="C'), F.col("k") + 1, F.lit('" t="inlineStr"><is><t>'), "n_name", F.lit("</t></is></c></row>"))
    rows = n.withColumn("k", rank).groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", row.alias("x")))), lambda v: v["x"]), "").alias("rows"))
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c></row>'
    parts = {
        "xl/workbook.xml": F.lit(f'<workbook xmlns="{ns}" xmlns:r="urn:r"><sheets><sheet name="nations" sheetId="1" r:id="rId1"/></sheets></workbook>'),
        "xl/_rels/workbook.xml.rels": F.lit('<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>'),
        "xl/sharedStrings.xml": F.lit(f'<sst xmlns="{ns}"><si><t>key</t></si><si><t>gap</t></si><si><r><t>na</t></r><r><t>me</t></r></si></sst>'),
        "xl/worksheets/sheet1.xml": F.concat(F.lit(f'<worksheet xmlns="{ns}"><sheetData>{head}'), "rows", F.lit("</sheetData></worksheet>")),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("member"), v.alias("content")) for k, v in parts.items()]))
    return K.bundle(rows.select(F.concat(F.lit("r"), "n_regionkey", F.lit(".xlsx")).alias("path"), each.alias("m")).select("path", "m.member", F.encode("m.content", "UTF-8").alias("content")), "path")


@query("""WITH r AS (SELECT n_regionkey AS g, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS row FROM nation), c AS (SELECT 'r' || g || '.xlsx/sheet:nations' AS anchor, row, n_nationkey, n_name FROM r)
    SELECT anchor, row, 'key' AS "column", CAST(n_nationkey AS VARCHAR) AS value FROM c UNION ALL SELECT anchor, row, 'gap', '' FROM c UNION ALL SELECT anchor, row, 'name', n_name FROM c""")
def s08_spreadsheets(spark, sf):
    chunks = R.spreadsheets(_workbooks(spark, sf))
    return R.table_cells(chunks.select(F.concat_ws("/", "path", "anchor").alias("anchor"), "content"))


def _made_pages(spark, sf) -> DataFrame:
    """A page an order with figures, loose images, a logo, a table with a short row, and links; the pages table has none of these."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey").cast("string")
    parts = [
        '<html><body><h2>Results</h2><figure><img src="/img/fig', k, '.png" alt="alt"><figcaption>Figure ', k, '. Map of ', F.col("o_orderpriority"), '</figcaption></figure><img src="/logo.png" alt="our logo"><img src="https://cdn.org/p', k, '.jpg" alt="Photo">',
        "<table><tr><th>status</th><th>priority</th></tr><tr><td>", F.col("o_orderstatus"), "</td><td>", F.col("o_orderpriority"), "</td></tr><tr><td>", k, '</td></tr></table><a href="/supp/s', k, '.pdf">Supplementary material</a><a href="/supp/s', k, '.pdf">again</a><a href="/next">next</a></body></html>',
    ]
    return o.select(F.col("o_orderkey").alias("page_id"), F.lit("https://a.org/x/y").alias("url"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("html"))


@query("""SELECT o_orderkey AS page_id, 'figure' AS kind, '/img/fig' || o_orderkey || '.png' AS url, 'Figure ' || o_orderkey || '. Map of ' || o_orderpriority AS text FROM orders
    UNION ALL SELECT o_orderkey, 'image', 'https://cdn.org/p' || o_orderkey || '.jpg', 'Photo' FROM orders""")
def s10_page_media(spark, sf):
    parts = R.page_parts(_made_pages(spark, sf)).where(F.col("kind").isin("figure", "image"))
    return parts.where(P.is_content_image(F.col("url"), F.col("text"))).select("page_id", "kind", "url", "text")


@query("""WITH c AS (SELECT o_orderkey AS page_id, o_orderstatus AS s, o_orderpriority AS p FROM orders)
    SELECT page_id, 0 AS row, 'status' AS "column", s AS value FROM c UNION ALL SELECT page_id, 0, 'priority', p FROM c UNION ALL SELECT page_id, 1, 'status', CAST(page_id AS VARCHAR) FROM c UNION ALL SELECT page_id, 1, 'priority', '' FROM c""")
def s11_page_tables(spark, sf):
    parts = R.page_parts(_made_pages(spark, sf)).where("kind = 'table'")
    cells = R.table_cells(parts.select(F.concat(F.lit("table:html:"), "page_id").alias("anchor"), F.col("extra").alias("content")))
    return cells.select(F.regexp_extract("anchor", r"(\d+)$", 1).cast("long").alias("page_id"), "row", "column", "value")


@query("SELECT o_orderkey AS page_id, 1 AS rank, 'https://a.org/supp/s' || o_orderkey || '.pdf' AS href FROM orders")
def s26_supplement_links(spark, sf):
    """The part of discovery that needs no network: links of stored pages that name supplements."""
    pages = _made_pages(spark, sf)
    return R.supplement_links(R.page_parts(pages), pages)


@query("SELECT CASE WHEN page_id % 7 = 0 THEN 'supp' ELSE 'main' END AS kind, count(*) AS assets, count(*) FILTER (WHERE page_id % 11 <> 0) AS read, count(*) FILTER (WHERE page_id % 11 = 0) AS failed FROM pages GROUP BY 1")
def s05_asset_driver(spark, sf):
    """Assets of a kind that could be read and that couldn't: broken archives among pages packed one by one are counted, not raised."""
    p = table(spark, sf, "pages").withColumn("kind", F.when(F.col("page_id") % 7 == 0, "supp").otherwise("main"))
    packed = K.bundle(p.select(F.col("page_id").cast("string").alias("path"), F.lit("page.html").alias("member"), F.encode("html", "UTF-8").alias("content")), "path")
    broken = packed.withColumn("content", F.when(F.col("path").cast("long") % 11 == 0, F.substring("content", 1, 20)).otherwise(F.col("content"))).withColumn("kind", F.lit("archive"))
    read = R.archive_members(broken).select(F.regexp_extract("path", r"^(\d+)!", 1).cast("long").alias("page_id")).withColumn("ok", F.lit(1))
    return p.join(read, "page_id", "left").groupBy("kind").agg(F.count(F.lit(1)).alias("assets"), F.count("ok").alias("read"), F.count_if(F.col("ok").isNull()).alias("failed"))


# queue and polls


@query("SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS turns FROM orders WHERE o_orderstatus = 'O'")
def r02_enqueue(spark, sf):
    """Jobs enqueued in two turns, and what the queue's consumer then gets of each."""
    path, got, seen = scratch(spark, "queue"), scratch(spark, "consumed"), scratch(spark, "r02")
    rows = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("job_id"), F.lit("queued").alias("status"))
    jobs.enqueue(rows, path)
    jobs.enqueue(rows.where("job_id % 5 = 0"), path)
    stream = spark.readStream.schema(rows.schema).json(path)
    jobs.consume(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{got}/batch={n}"), seen).awaitTermination()
    return spark.read.schema("job_id long, status string, batch int").parquet(got).groupBy("job_id").agg(F.count(F.lit(1)).cast("int").alias("turns"))


@query("SELECT o_orderkey AS pid FROM orders WHERE o_custkey % 3 = 0 OR o_orderkey % 10 = 0")
def r05_orphans(spark, sf):
    """Workers whose owner is gone, or whose number another process has by now."""
    o = table(spark, sf, "orders")
    workers = o.select(F.col("o_orderkey").alias("pid"), F.sha1(F.concat_ws(":", "o_orderkey", "o_custkey")).alias("fingerprint"))
    living = o.where("o_custkey % 3 <> 0").select(F.col("o_orderkey").alias("pid"), F.sha1(F.concat_ws(":", "o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.lit(-1)).otherwise(F.col("o_custkey")))).alias("fingerprint"))
    return jobs.orphans(workers, living, "pid", "fingerprint").select("pid")


@query("SELECT event_id, ts FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS r FROM events) WHERE r BETWEEN 26 AND 75")
def r08_poll(spark, sf):
    """Three polls of 25 events: a cursor takes up where the one before ended. The page is the feature."""
    e = table(spark, sf, "events").select("event_id", "ts")
    first = jobs.since(e, ("1900-01-01 00:00:00", -1), 25).orderBy(F.desc("ts"), F.desc("event_id")).first()
    second = jobs.since(e, (first["ts"], first["event_id"]), 25)
    last = second.orderBy(F.desc("ts"), F.desc("event_id")).first()
    return second.unionByName(jobs.since(e, (last["ts"], last["event_id"]), 25))


@query("SELECT o_orderstatus AS tenant, CASE WHEN bool_or(o_orderkey % 1000 = 1) THEN 1.0 ELSE 4.0 END::DOUBLE AS seconds FROM orders GROUP BY 1")
def r08_next_poll(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("tenant"), F.when(F.col("o_orderkey") % 1000 == 1, "running").otherwise("completed").alias("status"))
    return jobs.next_poll(rows.groupBy("tenant")).select("tenant", "seconds")


# extractors and profiles


@query(r"""SELECT item_id, modality, coalesce(nullif(seen, ''), nullif(read, '')) AS said, CASE WHEN seen <> '' THEN 'vision' ELSE 'ocr' END AS by FROM (
    SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' ELSE 'supplement' END AS modality, CASE WHEN item_id % 4 = 0 THEN 'seen: ' || text ELSE '' END AS seen, CASE WHEN item_id % 4 < 3 THEN text ELSE '' END AS read FROM benchmark) WHERE seen <> '' OR read <> ''""")
def u02_model_extractors(spark, sf):
    """Packets of media rows by the first strategy that gives any: a vision model, the text that was read, nothing."""
    rows = table(spark, sf, "benchmark").select(
        "item_id", F.when(F.col("item_id") % 3 == 0, "table").when(F.col("item_id") % 3 == 1, "figure").otherwise("supplement").alias("modality"), "text", F.when(F.col("item_id") % 4 < 3, F.col("text")).otherwise("").alias("read")
    )
    model = lambda pdf: pdf[pdf["item_id"] % 4 == 0].assign(said=lambda x: "seen: " + x["text"])[["item_id", "said"]]
    seen = O.extract(rows.select("item_id", "text"), model, "item_id long, said string").where("error is null").select("item_id", F.col("said").alias("seen"))
    both = rows.join(seen, "item_id", "left")
    said = F.coalesce(F.nullif("seen", F.lit("")), F.nullif("read", F.lit("")))
    return both.where(said.isNotNull()).select("item_id", "modality", said.alias("said"), F.when(F.coalesce("seen", F.lit("")) != "", "vision").otherwise("ocr").alias("by"))


@query(f"""{L.MATCHES} SELECT profile, threshold, count(*) AS points, count(*) FILTER (WHERE score >= threshold) AS hits
    FROM m, (VALUES {', '.join(f"('{k}', {c.match_threshold}::DOUBLE)" for k, c in PROFILES.items())}) p(profile, threshold) GROUP BY 1, 2""")
def c08_profiles(spark, sf):
    """What each profile's threshold makes of the same matches."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("profile"), F.lit(float(c.match_threshold)).alias("threshold")) for k, c in PROFILES.items()]))
    rows = L._matches(spark, sf).select("score", each.alias("p")).select("score", "p.*")
    return rows.groupBy("profile", "threshold").agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("score") >= F.col("threshold")).alias("hits"))


@query("SELECT coalesce(c_custkey % 50, -1) AS doc, o_orderkey AS id, 'order:' || o_orderkey AS anchor, coalesce(c_mktsegment, 'main') AS asset_kind, CASE WHEN coalesce(c_mktsegment, 'main') IN ('main', 'BUILDING') THEN 'main' ELSE 'supp' END AS side FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 > 0) c ON o_custkey = c_custkey")
def p01_chunk_record(spark, sf):
    """Records of chunks with their asset's kind, main where the asset is unknown, and the side that this puts them on."""
    assets = table(spark, sf, "customer").where("c_custkey % 4 > 0")
    chunks = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("doc"), F.col("o_custkey"), F.col("o_orderkey").alias("id"), F.concat(F.lit("order:"), "o_orderkey").alias("anchor"))
    named = J.look_up(chunks, assets, "o_custkey", "c_custkey", "c_mktsegment", "main").withColumnRenamed("c_mktsegment", "asset_kind")
    known = F.when(F.col("o_custkey") % 4 > 0, F.col("doc")).otherwise(F.lit(-1))
    return O.sided(named.withColumn("doc", known).drop("o_custkey"), "asset_kind", ("main", "BUILDING"))


@query("SELECT side, CASE l_linenumber % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'table' WHEN 2 THEN 'figure' ELSE 'meta' END AS modality, count(*) AS n FROM (SELECT *, CASE WHEN l_returnflag IN ('A', 'N') THEN 'main' ELSE 'supp' END AS side FROM lineitem) GROUP BY 1, 2")
def p02_kind_modality(spark, sf):
    modality = F.element_at(F.array(*[F.lit(m) for m in ("text", "table", "figure", "meta")]), F.col("l_linenumber") % 4 + 1)
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("asset_kind"), modality.alias("modality"))
    return O.sided(rows, "asset_kind", ("A", "N")).groupBy("side", "modality").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT n_regionkey AS id, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n FROM nation)
    SELECT id, n, CASE WHEN n < 2 THEN 'unknown' WHEN n < 4 THEN 'methods' ELSE 'results' END AS section, 'About ' || n_name || ' & more' AS content FROM n""")
def s14_tei_paragraphs(spark, sf):
    """TEI made from the nations of a region, a part each, of which some heads name a section, and a broken file."""
    n = table(spark, sf, "nation").withColumn("n", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    head = F.when(F.col("n") == 2, "<head>Methods</head>").when(F.col("n") == 4, "<head>RESULTS</head>").otherwise("<head>More of it</head>")
    part = F.concat(F.lit("<div>"), head, F.lit("<p>About  "), "n_name", F.lit(" &amp; more</p><p> </p></div>"))
    made = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("x")))), lambda v: v["x"]), "").alias("parts"))
    xml = made.select(F.col("n_regionkey").alias("id"), F.concat(F.lit("<TEI><text><body>"), "parts", F.lit("</body></text></TEI>")).alias("xml"))
    return R.tei_paragraphs(xml.unionByName(xml.select((F.col("id") + 1000).alias("id"), F.lit("<TEI><text><body><div>").alias("xml"))))


@query("""WITH o AS (SELECT o_custkey AS doc, string_agg('order number ' || o_orderkey || ' of this customer was placed', ' ' ORDER BY o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS even, string_agg('order number ' || o_orderkey || ' of this customer was placed', ' ' ORDER BY o_orderkey) FILTER (WHERE o_orderkey % 2 = 1) AS odd FROM orders GROUP BY 1),
    b AS (SELECT doc, 0 AS k, 'methods' AS section, even AS content FROM o UNION ALL SELECT doc, 1, 'results', odd FROM o)
    SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY k) AS n, section, content FROM b WHERE content IS NOT NULL""")
def s24_page_lines(spark, sf):
    """Lines of a customer's pages: a heading, even orders, noise, a heading, odd orders."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("k"), F.concat(F.lit("  order number "), "o_orderkey", F.lit(" of this  customer was placed")).alias("line"))
    docs, even = o.select("doc").distinct(), F.col("k") % 2 == 0
    extra = docs.select("doc", F.explode(F.array(*[F.struct(F.lit(p).alias("page"), F.lit(n).cast("long").alias("n"), F.lit(t).alias("line")) for p, n, t in ((0, 0, "Methods"), (3, 0, ""), (3, 1, "page 3"), (3, 2, "RESULTS"))])).alias("x")).select("doc", "x.*")
    rows = o.select("doc", F.when(even, 1).otherwise(4).alias("page"), F.col("k").alias("n"), "line")
    return R.page_line_paragraphs(extra.unionByName(rows))


@query(f"""{L.CLAIMS}, u AS (SELECT l.doc, l.name AS claim_id, text, row_number() OVER (PARTITION BY l.doc ORDER BY l.name) AS r FROM l LEFT JOIN st ON st.doc = l.doc AND st.claim_id = l.name WHERE f = 'R' AND coalesce(st.status, 'unresolved') <> 'supported')
    SELECT doc, claim_id, 'unsupported' AS reason FROM u WHERE r <= 2 AND contains(text, 'plain')""")
def u03_reviewer(spark, sf):
    """A model that finds plain words unsupported reviews the first two open claims of each document."""
    claims, packets = L._claims(spark, sf)
    status, _ = O.reconcile(claims, packets, "doc")
    model = lambda pdf: pdf[pdf["text"].str.contains("plain")].assign(reason="unsupported")
    return O.reviewed(status, claims, "doc", model, 2).where("error is null").select("doc", "claim_id", "reason")


@query("""WITH c AS (SELECT conv_id, role, turn, text FROM conversations), g AS (SELECT a.conv_id, a.role, a.turn, a.text, 't' || (a.turn + 2) AS ref FROM c a WHERE EXISTS (SELECT 1 FROM c b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 2))
    SELECT conv_id, role, turn AS ord, text AS statement, ref AS refs, 'model' AS by FROM g UNION ALL
    SELECT conv_id, role, turn, upper(role), '', 'rules' FROM c WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.conv_id = c.conv_id AND g.role = c.role)""")
def u05_section_bullets(spark, sf):
    """Bullets that point to a later turn, kept where it exists; speakers without any get rows by rule."""
    c = table(spark, sf, "conversations")
    bullets = c.select("conv_id", "role", F.col("turn").alias("ord"), F.col("text").alias("statement"), F.array(F.concat(F.lit("t"), F.col("turn") + 2), F.lit("nowhere")).alias("refs"))
    rules = c.select("conv_id", "role", F.col("turn").alias("ord"), F.upper("role").alias("statement"), F.array().cast("array<string>").alias("refs"))
    out = O.checked_bullets(bullets, c.select("conv_id", F.concat(F.lit("t"), "turn").alias("anchor")), rules, ["conv_id", "role"])
    return out.select("conv_id", "role", "ord", "statement", F.array_join("refs", ",").alias("refs"), "by")
