"""Composite document queries on hand-made tables."""

from lodestone.plans import documents as D


def test_chunks_of_long_documents_are_whole(spark):
    docs = spark.createDataFrame([(1, "\n".join(f"Paragraph number {i} of a very long document." for i in range(450)))], "doc_id long, text string")
    rows = D.document_chunks(docs).orderBy("ord").collect()
    assert [r.ord for r in rows] == list(range(1, 451)) and "number 449 " in rows[-1].content
    last = D.packets_of(D.document_chunks(docs)).where("chunk = 450").collect()
    assert [r.section for r in last] == ["conclusion"]


def test_turns_that_differ_late_are_kept(spark, tmp_path):
    same = " ".join(f"w{i}" for i in range(90))
    ends = [" ".join(f"{x}{i}" for i in range(90)) for x in "ab"]
    spark.createDataFrame([(1, t, "user", f"{same} {end}") for t, end in enumerate(ends)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.kept for r in D.d06_near_duplicate_fold(spark, str(tmp_path)).collect()] == [2]
    assert D.d08_merge_items(spark, str(tmp_path)).count() == 2


def test_statements_of_all_sections(spark, tmp_path):
    lines = [" ".join(f"s{i}w{k}" for k in range(9)) + "." for i in range(11)]
    spark.createDataFrame([(1, "\n".join([*lines, lines[-1]]))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.section: r.kept for r in D.d07_greedy_statements(spark, str(tmp_path)).collect()}
    assert got == {"introduction": 3, "methods": 3, "results": 2, "discussion": 2, "conclusion": 1}


def test_extractive_scores_that_differ_beyond_nine_decimals_are_equal(spark, tmp_path):
    """The later sentence's score is greater in its last bit only; documents with one id keep their own first sentences."""
    import duckdb

    from lodestone.plans import relational
    from oracle import assert_same

    pad = lambda words, n: f"{words}{',' * (n - 1 - len(words))}."
    early, late = pad("alpha beta gamma", 31), pad("alpha delta epsilon zeta", 231)
    assert 2 / 5 + len(late) / 2000 > 2 / 4 + len(early) / 2000
    rows = [(1, f"Alpha. {early} {late}"), (2, "One two. One two three."), (2, "Four five. Three one. Six."), (3, None), (4, "alone")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = relational.j10_extractive_join(spark, str(tmp_path))
    assert {r.item_id: r.sentence for r in got.collect()}[1] == early
    assert_same(got, relational.oracle_sql()["j10_extractive_join"], db)


def test_full_analysis_keeps_no_sentence_and_runs_no_pandas(spark, tiny):
    out = D.c01_full_analysis(spark, tiny)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "sentence" not in plan
    assert out.where("items > 0 and chosen > 0").count() > 0
