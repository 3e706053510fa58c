"""Report operators on small rows."""

import json
import random
import re

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import folds
from lodestone.operators import reports as R
from lodestone.plans import reports
from oracle import assert_same


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranked_greedy_counts_only_kept_rows_of_an_anchor(spark):
    rows = [(1, 5.0, 0, "a b c", "x"), (1, 4.0, 1, "a b c d", "x"), (1, 3.0, 2, "q r", "x"), (1, 2.0, 3, "s t", "x"), (1, 1.0, 4, "u v", "y"), (1, 1.0, 5, "w z", "y")]
    out = R.ranked_greedy(spark.createDataFrame(rows, "doc int, score double, ord int, key string, anchor string"), ["doc"], 4, per_anchor=2).orderBy("rank").collect()
    assert [r.ord for r in out] == [0, 2, 4, 5]


def test_slots_take_candidates_without_hits_and_the_earliest_of_equals(spark):
    rows = [(1, "a", 3, 0.0), (1, "a", 5, 0.0), (1, "b", 3, 9.0), (1, "b", 4, 2.0)]
    out = R.best_unused(spark.createDataFrame(rows, "doc int, slot string, idx long, score double"), "doc", ["a", "b", "c"]).collect()
    assert {(r.slot, r.idx) for r in out} == {("a", 3), ("b", 4)}


def test_reconcile(spark):
    schema = "doc int, {} string, text string, refs array<string>, said_refs array<string>, value double"
    claims = spark.createDataFrame([(1, "c1", "a significant increase", ["r"], [], 40.0), (1, "c2", "an increase", [], ["f1"], None), (1, "c3", "alone", ["z"], [], None)], schema.format("claim_id"))
    packets = spark.createDataFrame([(1, "p1", "it was", ["r"], [], 10.0), (1, "p2", "a decrease", [], ["f1"], None), (2, "p3", "x", ["z"], [], None)], schema.format("packet_id"))
    status, found = R.reconcile(claims, packets, "doc")
    assert {(r.claim_id, r.status) for r in status.collect()} == {("c1", "contradicted"), ("c2", "contradicted"), ("c3", "unresolved")}
    assert {(r.claim_id, r.reason, r.packet_id) for r in found.collect()} == {("c1", "magnitude_mismatch", "p1"), ("c1", "conflict_by_value", "p1"), ("c2", "contradicted", "p2"), ("c3", "missing_modality", None)}


def test_payloads(spark):
    payload = json.dumps({"items": [{"statement": "One thing (confidence 80%)", "refs": ["f2", "nonsense"]}, {"statement": "one thing [section:x:1]", "refs": []}, {"statement": "Other (id:text-fallback-a-1)", "refs": ["section:a:1"]}]})
    got = [r[0] for r in spark.createDataFrame([(0, payload), (1, "{bad"), (2, None)], "i int, p string").orderBy("i").select(R.sanitise_payload(F.col("p"))).collect()]
    assert json.loads(got[0]) == {"items": [{"statement": "One thing", "refs": ["f2"]}, {"statement": "Other", "refs": ["section:a:1"]}]}
    assert got[1] is None and got[2] is None


def test_extractor_reports_failures(spark):
    rows = spark.createDataFrame([(i,) for i in range(4)], "i long").coalesce(1)

    def model(pdf):
        raise ValueError("no model")

    out = R.extract(rows, model, "i long").collect()
    assert [r.error for r in out] == ["ValueError: no model"]
    assert R.extract(rows, None, "i long").count() == 0
    assert [r.i for r in R.extract(rows, lambda pdf: pdf * 2, "i long").collect()] == [0, 2, 4, 6]


def test_fallbacks_and_notes(spark):
    rows = spark.createDataFrame([(1, "methods", "purchase this article"), (1, "results", "access your subscription now"), (2, "methods", "x"), (2, "introduction", "purchase this article")], "doc int, label string, t string")
    assert {(r.doc, r.fallback) for r in R.needs_fallback(rows, "doc", "label").collect()} == {(1, False), (2, True)}
    assert [r.doc for r in R.paywall_notes(rows, "doc", "t").collect()] == [1]
    draft = spark.createDataFrame([("d", " "), ("d", "better"), ("d", None)], "a string, b string").select(R.override(F.col("a"), F.col("b")))
    assert [r[0] for r in draft.collect()] == ["d", "better", "d"]


def test_few_keys_are_compared_as_many_are():
    r = random.Random(3)
    said, few, indexed = [f"w{i}" for i in range(12)], folds.SaidBefore(), folds.SaidBefore()
    indexed.FEW, few.FEW = 0, 1000
    for n in range(400):
        begin = "a b c d e f g h i j k l".split() if n % 4 == 0 else []
        key = " ".join(begin + [r.choice(said) for _ in range(r.choice([0, 1, 2, 3, 6, 9]))])
        assert few.alike(key) == indexed.alike(key) and few.first(key) == indexed.first(key)
        few.add(key), indexed.add(key)
        if n % 9 == 0:
            few.drop(n), indexed.drop(n)


def test_synthesis_streams_documents(spark, tiny):
    assert "FlatMapGroupsInPandas" not in plan(reports.c03_synthesis(spark, tiny))
    texts = [" ".join(f"d{i}s{k}w{j}" for j in range(8)) for i in range(3) for k in range(6)]
    rows = [(i // 6, ("introduction", "results")[i % 2], i % 6, t, float(i % 5)) for i, t in enumerate(texts)] + [(d, "discussion", 9, texts[d * 6], 9.0) for d in range(3)] + [(2, "results", 10, "", 0.0)]
    df = spark.createDataFrame(rows, "doc long, section string, ord int, key string, score double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = sorted(map(tuple, folds.cross_section_winners(df, "doc").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    lost = {(d, d * 6) for d in range(3)}  # the discussion says it better
    assert got == sorted(r for r in rows if (r[0], r[0] * 6 + r[2]) not in lost or r[1] == "discussion")


def _documents(spark, path) -> str:
    """Documents of which two have one id."""
    text = lambda d, n: " ".join(f"The {d} sentence {i} {'that ' * (i % 3)}says thing{d}x{i} and other{d}x{i}." for i in range(n))
    spark.createDataFrame([(1, text("a", 5)), (1, text("bbbbbbb", 40)), (2, text("c", 7)), (3, None)], "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


def _same_as_sql(spark, path, name):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    assert_same(reports.queries()[name](spark, path), reports.oracle_sql()[name], db)


def test_ranked_fallback_places_sentences_in_their_own_text(spark, tiny, tmp_path):
    assert not {w for w in ("Window", "FlatMapGroupsInPandas") if w in plan(reports.t05_ranked_fallback(spark, tiny))}
    _same_as_sql(spark, _documents(spark, tmp_path), "t05_ranked_fallback")


def test_presentation_places_sentences_in_their_own_text(spark, tiny, tmp_path):
    assert plan(reports.t10_presentation(spark, tiny)).count("Exchange") == 1 and "FlatMapGroupsInPandas" not in plan(reports.t10_presentation(spark, tiny))
    _same_as_sql(spark, _documents(spark, tmp_path), "t10_presentation")


def _cut_once_after_dealing(text: str) -> bool:
    """Of a plan, which is read from the top: documents are dealt out before they are cut, and cut once."""
    return text.count("Exchange") == 1 and text.index("Generate") < text.index("Exchange") and len(re.findall(r"split\(", text)) == 1


def test_ranked_fallback_cuts_documents_once_after_dealing_them_out(spark, tiny):
    assert _cut_once_after_dealing(plan(reports.t05_ranked_fallback(spark, tiny)))


def test_presentation_cuts_documents_once_after_dealing_them_out(spark, tiny):
    assert _cut_once_after_dealing(plan(reports.t10_presentation(spark, tiny)))


def test_a_fold_ends_its_group_and_takes_keys_from_texts(spark):
    said = ["One two THREE 4.5!", "one, two three 4.5", "Kelvin İs Ä Σ x", "Other words here", "And the last ones"]
    rows = [(d, 9.0 - i, i, t, "") for d in (1, 2) for i, t in enumerate(said)]
    df = spark.createDataFrame(rows, "doc int, score double, ord int, text string, anchor string").repartition(3)
    by_key = R.ranked_greedy(df.withColumn("key", X.canonical(F.col("text"))), ["doc"], 3).select("doc", "ord", "rank")
    by_text = R.ranked_greedy(df, ["doc"], 3, text="text").select("doc", "ord", "rank")
    assert sorted(map(tuple, by_text.collect())) == sorted(map(tuple, by_key.collect())) == [(d, o, r) for d in (1, 2) for o, r in ((0, 1), (2, 2), (3, 3))]
    assert [r[0] for r in df.where("doc = 1").orderBy("ord").select(X.canonical(F.col("text"))).collect()] == [folds.canonical(t) for _, _, _, t, _ in rows[:5]]
