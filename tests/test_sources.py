"""Readers, writers and streams on small files."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.sources import readers as R
from lodestone.sources import sinks as K
from lodestone.streaming import jobs


def test_files_archives_and_text(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("hello")
    (tmp_path / "in/b").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "in/c.bin").write_text("<!doctype html><p>x")
    (tmp_path / "in/bad.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "in/z.zip", "w") as z:
        z.writestr("supp/t.csv", "a,b\n1,2")
        z.writestr("../escape.txt", "x")
    rows = R.files(spark, str(tmp_path / "in"))
    assert {r.name: r.kind for r in rows.collect()} == {"a.txt": "text", "b": "pdf", "c.bin": "html", "bad.zip": "archive", "z.zip": "archive"}
    assert [(r.anchor, r.content) for r in R.text_chunks(rows).collect()] == [("file:a.txt", "hello")]
    assert [(r.name, r.kind, bytes(r.content)) for r in R.archive_members(rows).collect()] == [("t.csv", "tabular", b"a,b\n1,2")]


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("x,y\n1,2\n3,\n")
    t = R.delimited(spark, str(tmp_path / "t.csv")).withColumn("n", F.monotonically_increasing_id()).withColumn("k", F.lit(1))
    chunk = R.table_chunk(t, ["x", "y"], ["k"], "n", F.lit("file:t.csv"))
    assert json.loads(chunk.first().content) == {"columns": ["x", "y"], "data": [["1", "2"], ["3", ""]]}
    assert {(r.row, r.column, r.value) for r in R.table_cells(chunk).collect()} == {(0, "x", "1"), (0, "y", "2"), (1, "x", "3"), (1, "y", "")}


PAGE = """<html><body><script>var x="</p>"</script><h2>Results</h2><p>Connectivity increased in all of the patients we saw.</p><p>short</p>
<p>Connectivity increased in all of the patients we saw.</p><figure><img src="/f2_mock.png" alt="x"><figcaption>Figure 2. A map</figcaption></figure>
<table><tr><th>a<th>b</tr><tr><td>1</td></tr></table><a href="/t1.html">Table 1</a><a href="//cdn.org/fig3">Figure 3</a><a href="plain.html">more</a></body></html>"""


def test_page_parts(spark):
    pages = spark.createDataFrame([(1, "http://a.org/dir/p.html?x", PAGE), (2, "u", None)], "page_id long, url string, html string")
    parts = R.page_parts(pages)
    paragraphs = R.paragraph_chunks(parts).collect()
    assert [(r.anchor, r.section_norm) for r in paragraphs] == [("html:para:1", "results")]
    assert {(r.modality, r.href) for r in R.media_links(parts, pages).collect()} == {("table", "http://a.org/t1.html"), ("figure", "http://cdn.org/fig3")}
    figure = parts.where("kind = 'figure'").first()
    assert (figure.url, figure.text) == ("/f2_mock.png", "Figure 2. A map")
    cells = R.table_cells(parts.where("kind = 'table'").select(F.lit("t").alias("anchor"), F.col("extra").alias("content"))).collect()
    assert {(r.column, r.value) for r in cells} == {("a", "1"), ("b", "")}


def test_abstract_and_chunk_limit(spark):
    page = "<p>Objective: to test the thing in detail. Methods: many scans were read.</p>" + "".join(f"<p>Paragraph number {i} of a long page here</p>" for i in range(450))
    chunks = R.paragraph_chunks(R.page_parts(spark.createDataFrame([(1, page)], "page_id long, html string"))).orderBy("paragraph_index").collect()
    assert len(chunks) == 400 and [c.section_norm for c in chunks[:2]] == ["introduction", "methods"]


def test_reference_points_and_items(spark):
    lines = ["# INTRODUCTION", "* first", "  goes on", "- second", "", "# RESULTS", "1. third"]
    rows = R.reference_points(spark.createDataFrame([(f, n, x) for f in "ab" for n, x in enumerate(lines)], "file string, n int, line string")).orderBy("file", "ord").collect()
    assert [(r.file, r.section, r.ord, r.text) for r in rows] == [(f, *x) for f in "ab" for x in [("introduction", 1, "first goes on"), ("introduction", 2, "second"), ("results", 3, "third")]]
    items = spark.createDataFrame([(1, 0, "text", "before it all began in earnest."), (1, 1, "heading", "Methods"), (1, 2, "text", "we measured a lot of things today.")], "doc int, idx int, type string, text string")
    assert [r.section for r in R.item_stream(items).orderBy("idx").collect()] == ["unknown", "methods", "methods"]
    xml = "<TEI><titleStmt><title>T</title></titleStmt><author><persName><surname>Li</surname></persName></author><body><div><p>one</p><p>two</p></div></body></TEI>"
    got = R.xml_paragraphs(spark.createDataFrame([(1, xml)], "id int, xml string")).first()
    assert (got.title, got.authors, got.paragraphs) == ("T", ["Li"], ["one", "two"])
    meta = spark.createDataFrame([(1, 5, "meta", "{bad"), (1, 6, "meta", '{"a":1}'), (1, 7, "meta", '{"a":2}')], "document_id int, id int, modality string, content string")
    assert R.first_meta(meta).first().meta == '{"a":1}'


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "reports")
    K.replace_documents(spark.createDataFrame([(1, "a"), (2, "b")], "document_id int, v string"), path)
    K.replace_documents(spark.createDataFrame([(2, "c")], "document_id int, v string"), path)
    assert {(r.document_id, r.v) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}
    items = spark.createDataFrame([(1, "results", 1, 0, "said <b>", ["r1", "r2", "r3", "r4"])], "doc int, section string, ord int, section_ord int, statement string, refs array<string>")
    md = K.markdown(items, "doc")
    assert md.first().markdown == "## Results\n- said <b> [r1, r2, r3]"
    assert "<li>said &lt;b&gt; [r1, r2, r3]</li>" in K.html(md, "doc").first().html
    name = spark.range(1).select(K.export_name(F.lit("Common dimensional reward deficits across mood and psychotic disorders"), F.lit("American Journal of"), F.lit("2017-07-01"))).first()[0]
    assert "deficits_across" in name and "american_journal_of_2017" in name


def test_event_log(spark, tmp_path):
    K.append_events(spark.createDataFrame([("startup", "2024-01-01T10:00:00Z", {"a": "1"})], "event string, timestamp string, details map<string,string>"), str(tmp_path / "log"))
    (tmp_path / "log/broken.json").write_text("{bad\n")
    assert [r.event for r in R.event_log(spark, str(tmp_path / "log")).collect()] == ["startup"]


def test_queue_and_states(spark, tmp_path):
    seen = []
    schema = "job_id long, ts long, status string"
    log = [(1, 1, "running"), (1, 2, "queued"), (1, 3, "running"), (1, 4, "completed"), (1, 5, "running"), (2, 1, "completed"), (2, 2, "running"), (2, 3, "failed")]
    jobs.enqueue(spark.createDataFrame(log, schema).coalesce(1), str(tmp_path / "q"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "q"))
    query = jobs.consume(stream, lambda batch, n: seen.append(batch.count()), str(tmp_path / "cp1"))
    query.awaitTermination()
    assert sum(seen) == len(log)
    again = jobs.consume(spark.readStream.schema(schema).json(str(tmp_path / "q")), lambda batch, n: seen.append(batch.count()), str(tmp_path / "cp1"))
    again.awaitTermination()
    assert sum(seen) == len(log)  # nothing twice
    q = jobs.status_stream(spark.readStream.schema(schema).json(str(tmp_path / "q"))).writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination()
    want = {k: jobs.fold_status([(t, s) for j, t, s in log if j == k]) for k in (1, 2)}
    assert {r.job_id: r.status for r in spark.table("states").collect()} == want == {1: "completed", 2: "failed"}
    assert [r.status for r in jobs.recover(spark.createDataFrame([(1, "running")], "id int, status string")).collect()] == ["queued"]


@pytest.mark.parametrize("slide", [None, "1 minute"])
def test_windows_stream_equals_batch(spark, tmp_path, slide):
    rows = spark.createDataFrame([(f"2024-01-01 00:{m:02}:00", k) for m in range(0, 40, 3) for k in "ab"], "t string, k string").withColumn("t", F.col("t").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "e"))
    q = jobs.windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e")), "t", "k", slide=slide).writeStream.format("memory").queryName(f"w{slide is None}").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table(f"w{slide is None}").collect())) == sorted(map(tuple, jobs.windowed_counts(rows, "t", "k", slide=slide).collect()))


def test_broken_workbooks_and_bundles(spark):
    members = spark.createDataFrame([("a", "m.txt", b"x"), ("a", "b.txt", b""), ("b", "n.txt", b"y")], "k string, member string, content binary")
    packed = K.bundle(members, "k").withColumnRenamed("k", "path").withColumn("kind", F.lit("archive"))
    assert {(r.path, bytes(r.content)) for r in R.archive_members(packed).select("path", "content").collect()} == {("a!m.txt", b"x"), ("a!b.txt", b""), ("b!n.txt", b"y")}
    assert [bytes(r.content) for r in packed.orderBy("path").collect()] == [bytes(r.content) for r in K.bundle(members.repartition(3), "k").orderBy("k").collect()]
    broken = spark.createDataFrame([("x", b"no zip"), ("y", None)], "path string, content binary")
    assert R.spreadsheets(broken.unionByName(packed.select("path", "content"))).count() == 0


def test_polls_follow_ties_and_end(spark):
    events = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 0)], "ts long, event_id long")
    cursor, got = (0, 0), []
    while True:
        rows = jobs.since(events.repartition(3), cursor, 2).collect()
        if not rows:
            break
        got += [tuple(r) for r in rows]
        cursor = max(tuple(r) for r in rows)
    assert got == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 0)]
    statuses = spark.createDataFrame([("running",), ("failed",)], "status string")
    assert [jobs.next_poll(s).first().seconds for s in (statuses, statuses.where("status = 'failed'"), statuses.where("false"))] == [1.0, 4.0, 4.0]


def test_distinct_events_and_sessions(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:0{s}", k) for s, k in ((0, "a"), (1, "a"), (1, "b"), (9, "a"))]
    spark.createDataFrame(rows, "t string, k string").select(F.col("t").cast("timestamp").alias("t"), "k").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("t timestamp, k string").parquet(str(tmp_path / "e"))
    for name, made, mode in (("distinct", jobs.distinct_events(stream, "k", "t"), "append"), ("sessions", jobs.sessions(stream, "t", "k", gap="5 seconds"), "complete")):
        made.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
    assert sorted(r.k for r in spark.table("distinct").collect()) == ["a", "b"]
    assert sorted((r.k, r.n) for r in spark.table("sessions").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_no_shared_folder_is_an_error_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from lodestone import workspace

    unset = SimpleNamespace(get=lambda *a: None, set=lambda *a: None)
    session = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="yarn", getConf=lambda: unset))
    with pytest.raises(RuntimeError):
        workspace.work_dir(session)
    session.sparkContext.master = "local[2]"
    assert workspace.work_dir(session).startswith("file:")
