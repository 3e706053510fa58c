"""Functions and operators against the fixtures that define them."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone import functions
from lodestone.config import EngineConfig, PROFILES
from lodestone.functions import numbers as N
from lodestone.functions import predicates as P
from lodestone.functions import similarity as S
from lodestone.functions import text as X
from lodestone.operators import aggregates as A
from lodestone.operators import folds
from lodestone.operators import joins as J
from lodestone.operators import ordered as O


def of(spark, f, *values):
    rows = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], "i int, " + ", ".join(f"c{k} string" for k in range(len(values[0]) if isinstance(values[0], tuple) else 1)))
    width = len(rows.columns) - 1
    return [r[0] for r in rows.orderBy("i").select(f(*[F.col(f"c{k}") for k in range(width)])).collect()]


def test_references(spark):
    t = "See Figure 1-3 and Fig S1 plus Table 2."
    assert of(spark, X.all_refs, t)[0] == ["1", "2", "3", "S1"]
    assert "2" in of(spark, X.table_refs, t)[0] and "S1" in of(spark, X.figure_refs, t)[0]
    assert of(spark, X.all_refs, "Figures 1-3")[0] == []  # a plural names none
    assert of(spark, X.table_refs, "Figure 1-3")[0] == ["1", "2", "3"]  # ranges count for both
    assert of(spark, X.figure_token, "Figure 2", "2A", "none", "Fig. S03b") == ["2", "2A", None, "S3B"]


def test_cleaning(spark):
    assert of(spark, X.strip_citations, "7 Normative modeling works", "4, 5 In contrast", "(12) Overall", "3 cats") == ["Normative modeling works", "In contrast", "Overall", "3 cats"]
    assert of(spark, X.clean_text, "a\x00b  ﬁne ﬂow­ x\u00a0y", None) == ["a b fine flow x y", ""]
    assert of(spark, X.sentences, "One. Two? Three!  Four 1.5 x")[0] == ["One.", "Two?", "Three!", "Four 1.5 x"]
    assert of(spark, X.trim_dangling, "an effect of the and of", "kept") == ["an effect of the", "kept"]
    long_ = "word " * 60 + "end"
    assert of(spark, lambda c: X.compact(c, 160), long_)[0] == long_  # without a boundary the whole text
    assert of(spark, lambda c: X.compact(c, 30), "First sentence here. Second one is longer than that.")[0] == "First sentence here."
    assert of(spark, lambda c: X.truncate_safely(c, 20), "aaaa bbbb cccc dddd eeee")[0] == "aaaa bbbb cccc dddd"
    assert of(spark, X.human_ref, "f2", "t3a", "section:results:4", "x") == ["Figure 2", "Table 3A", "Results (4)", "x"]
    assert of(spark, X.html_escape, '<a "b">&') == ["&lt;a &quot;b&quot;&gt;&amp;"]


def test_sections(spark):
    assert of(spark, X.prefix_section, "Objective: x", "Methods: y", "none") == ["introduction", "methods", ""]
    assert of(spark, X.heading_section, "2.1 Results", "Materials and  Methods", "Conclusions:", "Results of x") == ["results", "methods", "conclusion", ""]
    parts = of(spark, X.abstract_parts, "Objective: a b. Method: c. Results: d. Conclusions: e.", "no labels")
    assert [(p.label, p.text) for p in parts[0]] == folds.structured_parts("Objective: a b. Method: c. Results: d. Conclusions: e.")
    assert [(p.label, p.text) for p in parts[1]] == [("", "no labels")]
    other = dict.fromkeys(("introduction", "methods", "results", "discussion", "conclusion"), "zzz") | {"results": "plum"}
    assert of(spark, lambda c: X.lexical_section(c, lexicon=other), "a Plum", "overall") == ["results", "unknown"]


def test_numbers(spark):
    assert of(spark, N.clamp, "1.7", "-0.2", "x", None, "0.5") == [1.0, 0.0, 0.0, 0.0, 0.5]
    assert of(spark, X.first_number, "up 12.5 % at 3", "none") == [12.5, None]
    assert of(spark, X.p_value, "p<0.01", "P = .04") == [0.01, 0.04]
    assert of(spark, X.effect_size, "Cohen's d = 0.8", "OR: 1.4") == [0.8, 1.4]
    assert N.context_chars(4096) == 10752 and N.context_chars(0) == 8000
    got = spark.range(1).select(J.magnitude_mismatch(F.lit(100.0), F.lit(66.0)), J.magnitude_mismatch(F.lit(100.0), F.lit(60.0)), J.magnitude_mismatch(F.lit(40.0), F.lit(10.0))).first()
    assert tuple(got) == (False, True, True)
    stamps = of(spark, N.iso_timestamp, "2024-01-02T03:04:05Z", "2024-01-02T03:04:05", "2024-01-02T03:04:05+02:00", "bad")
    assert stamps[0] == stamps[1] and (stamps[0] - stamps[2]).seconds == 7200 and stamps[3] is None


def test_predicates(spark):
    assert of(spark, P.is_author_name, "Jane Q. Public", "Department of Psychiatry", "J", "a@b.c d", "Li Wei") == [True, False, False, False, True]
    assert of(spark, P.safe_member, "../etc/passwd", "nested/../../escape.txt", "supp/data/table.csv", "/abs", "C:\\x") == ["", "", "supp/data/table.csv", "", ""]
    assert of(spark, P.is_result_statement, "Figure 3 shows connectivity maps.", "Connectivity increased in patients (p<0.01).", "MDMR was used to test the model.") == [False, True, False]
    assert of(spark, lambda c: P.contradicts(F.lit("a significant effect"), c), "nonsignificant change", "same") == [True, False]  # words are matched inside words
    assert of(spark, P.is_incomplete, "(mean [SD], 0.", "A whole sentence.", "It depends on", "cut...", None) == [True, False, True, True, True]
    assert of(spark, P.is_ref_token, "f2", "section:x", "id:a", "word", "T12b") == [True, True, True, False, True]
    assert of(spark, P.is_ref_token, " F3 ", "t", "f2ab", "figure:", "table:9", "supplement", "xsection:1", "", None) == [True, False, False, True, True, True, False, False, False]
    assert of(spark, P.asset_kind, "a.CSV", "b.pdf", "c", "d.zip", "e.htm") == ["tabular", "pdf", "", "archive", "html"]
    assert of(spark, lambda c: P.valid_source(F.lit("url"), c, F.lit(None).cast("string"), c), "https://a.org/x", "ftp://x", None) == ["", "give a full address or a DOI", "give a full address or a DOI"]


def says_the_same(a, b):
    """The rule in words: one key holds the other; the common prefix is 86 % of the shorter of at least ten words; the common words
    are 82 % of the larger set, or 90 % of the smaller and 56 % of the larger."""
    if a == "" or b == "":
        return False
    x, y = a.split(" "), b.split(" ")
    n = min(len(x), len(y))
    prefix = 0
    while prefix < n and x[prefix] == y[prefix]:
        prefix += 1
    larger, smaller = sorted((set(x), set(y)), key=len, reverse=True)
    common = len([w for w in larger if w in smaller])
    return a in b or b in a or (n >= 10 and prefix / n >= 0.86) or common / len(larger) >= 0.82 or (common / len(smaller) >= 0.90 and common / len(larger) >= 0.56)


def random_keys(seed, n, letters="a b c d e f g h i j k l"):
    r = random.Random(seed)
    out = [" ".join(r.choices(letters.split(), k=r.randrange(1, 16))) for _ in range(n)]
    return [r.choice(out) if r.random() < 0.1 else k for k in out] + [""]


def test_similarity(spark):
    keys = [random.Random(i).choices("a b c d e f g h i j k l".split(), k=random.Random(i).randrange(1, 16)) for i in range(60)]
    pairs = [(" ".join(x), " ".join(y)) for x in keys for y in keys[:12]]
    assert of(spark, S.near_duplicate, *pairs) == [says_the_same(a, b) for a, b in pairs]
    rows = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0, 9.0]), ([0.0], [1.0]), ([], [1.0]), ([1.0], [-1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in rows.select(S.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]
    order = spark.createDataFrame([(1, ["a b c d e", "a b c d f", "a b c x f"]), (2, ["a b c d f", "a b c d e", "a b c x f"])], "i int, k array<string>")
    alike = lambda k: [x for i, x in enumerate(k) if not any(says_the_same(x, y) for y in greedy(k[:i]))]

    def greedy(k):
        out = []
        for x in k:
            if x and not any(says_the_same(x, y) for y in out):
                out.append(x)
        return out

    each = [(g, i, k) for g in range(8) for i, k in enumerate(random_keys(g, 30, "a b c d e f g"))]
    streamed = folds.greedy_statements(spark.createDataFrame(each, "g int, i int, k string").repartition(5), ["g"], "i", "k")
    assert {r.g: r.kept for r in streamed.collect()} == {g: greedy([k for h, _, k in each if h == g]) for g in range(8)}
    for r in order.select("k", S.greedy_distinct(F.col("k")).alias("kept")).collect():
        assert r.kept == greedy(r.k) and alike(r.k)


def test_anchor_resolution(spark):
    anchors = spark.createDataFrame([(1, "section:Results::2"), (1, "section:CONCLUSIONS:38"), (2, "section:a:1"), (2, "section:b:1")], "doc int, anchor string")
    refs = spark.createDataFrame([(1, r) for r in ("section:results:2", "section:Results:2", "section:conclusions:38", "section:conclusion:38", "missing:1")] + [(2, "section:x:1"), (2, "SECTION:A:1")], "doc int, ref string")
    got = {(r.doc, r.ref): r.resolved for r in J.resolve_anchors(refs, anchors, "doc").collect()}
    assert got[1, "section:results:2"] == got[1, "section:Results:2"] == "section:Results::2"
    assert got[1, "section:conclusions:38"] == got[1, "section:conclusion:38"] == "section:CONCLUSIONS:38"
    assert got[1, "missing:1"] is None and got[2, "section:x:1"] is None and got[2, "SECTION:A:1"] == "section:a:1"


def test_hydration_takes_last_meta_and_first_place(spark):
    chunks = spark.createDataFrame([(1, 0, "a", "old"), (1, 5, "a", "new"), (1, 7, "b", None)], "doc int, ord int, anchor string, meta string")
    packets = spark.createDataFrame([(1, 1, "x", ["b", "a"]), (1, 2, "a", [])], "doc int, packet_id int, anchor string, refs array<string>")
    got = {r.packet_id: (r.meta, r.place) for r in J.hydrate(packets, chunks, "doc").collect()}
    assert got == {1: ("new", 7), 2: ("new", 0)}


def test_retention_and_order(spark):
    reports = spark.createDataFrame([(d, f"2024-01-01 00:{d:02}:00") for d in range(12)], "document_id int, created_at string")
    assert sorted(r.document_id for r in O.retention(reports, 99, "document_id", "created_at").collect()) == [0, 1]
    busy = spark.createDataFrame([(0,)], "document_id int")
    assert [r.document_id for r in O.retention(reports, 10, "document_id", "created_at", busy).collect()] == [1]
    with pytest.raises(ValueError):
        O.sort_columns("name:up", "id")
    rows = spark.createDataFrame([(1, 90), (2, 12)], "i int, paragraph int")
    assert [r.i for r in rows.orderBy(*O.document_order(F.col("paragraph"), F.lit(-1), F.col("i"))).collect()] == [2, 1]


def test_order_does_not_depend_on_partitions(spark):
    rows = [(i % 5, i, f"k{i % 7}", (i * 37 % 11) / 10) for i in range(200)]
    frame = spark.createDataFrame(rows, "section int, i int, k string, score double")
    results = [sorted(map(tuple, O.capped_top_k(frame.repartition(n).withColumn("section", F.col("section").cast("string")), "section", "k", [F.desc("score"), F.col("i")], 3, {str(s): 6 for s in range(5)}).collect())) for n in (1, 7, 64)]
    assert results[0] == results[1] == results[2] and len(results[0]) == 30


def test_folds(spark):
    candidates = [(1, "design", 0, "a1", "k one", "s one", 90.0), (1, "sample", 0, "a1", "k one", "s one", 95.0), (1, "sample", 1, "a2", "other words", "s two", 80.0), (1, "sample", 2, "a1", "third thing", "s3", 85.0)]
    slots = {r.slot: r for r in folds.assign_slots(spark.createDataFrame(candidates, "doc int, slot string, idx long, anchor string, key string, statement string, score double"), "doc", ["design", "sample", "none"]).collect()}
    assert (slots["design"].idx, slots["sample"].idx, slots["none"].status) == (0, 1, "not_found")
    votes = [(1, 0, 0.1, "conclusion", 1.5, 0.2, False), (1, 1, 0.2, "methods", 0.9, 0.1, False), (1, 2, 0.3, "results", 0.9, 0.1, True), (1, 3, 0.4, "discussion", 0.5, 0.46, False)]
    smooth = folds.smooth_sections(spark.createDataFrame(votes, "doc int, ord int, position double, best string, best_score double, second_score double, explicit boolean"), "doc").orderBy("ord").collect()
    assert [r.label for r in smooth] == ["conclusion", "conclusion", "results", "unknown"]


def test_said_before():
    for seed in range(40):
        keys, said = random_keys(seed, 40, "a b c d e f g h i j k l" if seed < 20 else "a ab ba aba b bb cab c abc"), folds.SaidBefore()
        if seed % 2:  # long beginnings, and keys cut inside their words
            base = [f"w{i}" for i in range(22)]
            keys += [" ".join(base[:n] + [f"x{seed}{n}{i}" for i in range(m)]) for n in (8, 9, 10, 12, 19) for m in (0, 1, 2, 9)]
            keys += [k[i:-i] for k in keys[:20] for i in (1, 2) if len(k) > 6]
        for i, k in enumerate(keys):
            assert said.alike(k) == [j for j in range(i) if says_the_same(k, keys[j])]
            said.add(k)
        said.drop(3)
        assert 3 not in said.alike(keys[3])


def expected_merge(items, limit=10**9):
    """Merging by its rules: an ordered map by key, an equal key first, then the first alike."""
    merged = {}
    for new in items:
        if not new["key"]:
            continue
        near = new["key"] if new["key"] in merged else next((k for k in merged if says_the_same(new["key"], k)), None)
        if near is None:
            merged[new["key"]] = dict(new)
            continue
        old = merged[near]
        both = dict(old)
        both["confidence"], both["section_confidence"] = max(old["confidence"], new["confidence"]), max(old["section_confidence"], new["section_confidence"])
        both["is_untrusted"] = old["is_untrusted"] and new["is_untrusted"]
        for c in ("refs", "flags"):
            both[c] = list(dict.fromkeys(old[c] + new[c]))[:8]
        both["anchor"] = old["anchor"] or new["anchor"]
        if len(new["statement"]) > len(old["statement"]):
            both["statement"] = new["statement"]
        if near != new["key"] and new["confidence"] > old["confidence"]:
            del merged[near]
            near = new["key"]
        merged[near] = both
    return [(x["ord"], k, x["statement"], x["refs"], x["flags"], x["confidence"], x["section_confidence"], x["is_untrusted"], x["anchor"]) for k, x in merged.items()][:limit]


def test_merge_items_by_its_rules(spark):
    columns = "doc int, ord int, key string, statement string, refs array<string>, flags array<string>, confidence double, section_confidence double, is_untrusted boolean, anchor string"
    rows, want = [], {}
    for doc in range(25):
        r, items = random.Random(doc), []
        for i, k in enumerate(random_keys(doc, 14, "a b c d e f")):
            items.append({"doc": doc, "ord": i, "key": k, "statement": k + "x" * r.randrange(4), "refs": [f"r{r.randrange(9)}" for _ in range(r.randrange(5))], "flags": [f"f{r.randrange(3)}"], "confidence": r.randrange(5) / 4, "section_confidence": r.random(), "is_untrusted": r.random() < 0.5, "anchor": r.choice(["", "a1", "a2"])})
        want[doc] = expected_merge(items)
        rows += [tuple(x.values()) for x in items]
    frame = spark.createDataFrame(rows, columns)
    for parts in (1, 5):
        got = {}
        for r in folds.merge_items(frame.repartition(parts), ["doc"]).orderBy("doc", "place").collect():
            got.setdefault(r.doc, []).append((r.ord, r.key, r.statement, r.refs, r.flags, r.confidence, r.section_confidence, r.is_untrusted, r.anchor))
        assert got == want
    # a surer newcomer moves the item to the end, whose references still come first
    three = [(1, 0, "a b c d e", "short", ["r1"], 0.5), (1, 1, "x y z", "x", ["r2"], 0.5), (1, 2, "a b c d e f", "the longest", ["r3"], 0.9)]
    merged = folds.merge_items(spark.createDataFrame(three, "doc int, ord int, key string, statement string, refs array<string>, confidence double"), ["doc"]).orderBy("place").collect()
    assert [(r.ord, r.statement, r.refs, r.confidence) for r in merged] == [(1, "x", ["r2"], 0.5), (0, "the longest", ["r1", "r3"], 0.9)]


def expected_winners(items, least):
    """Cross-section clustering by its rules; items are (section, ord, key, score) in section order."""
    order = ["introduction", "methods", "results", "discussion", "conclusion"]
    clusters = {}
    for x in sorted((x for x in items if x[2]), key=lambda x: (order.index(x[0]), x[1])):
        clusters.setdefault(next((k for k in clusters if says_the_same(x[2], k)), x[2]), []).append(x)
    kept = {max(c, key=lambda x: (x[3], -order.index(x[0]), -x[1])) for c in clusters.values()}
    for section, n in least.items():
        own = sorted((x for x in items if x[2] and x[0] == section), key=lambda x: (-x[3], x[1]))
        if len(own) >= n:
            for x in own:
                if len([k for k in kept if k[0] == section]) < n:
                    kept.add(x)
    return kept | {x for x in items if not x[2]}


def test_cross_section_winners_by_their_rules(spark):
    from lodestone.config import EngineConfig, SECTIONS

    rows, want = [], {}
    for doc in range(30):
        r = random.Random(doc)
        items = [(r.choice(SECTIONS[:5]), i, k, r.randrange(6) / 2) for i, k in enumerate(random_keys(doc, r.choice([3, 8, 20]), "a b c d e f g"))]
        want[doc] = expected_winners(items, EngineConfig().min_keep)
        rows += [(doc, *x) for x in items]
    frame = spark.createDataFrame(rows, "doc int, section string, ord int, key string, score double")
    for parts in (1, 5):
        got = {}
        for r in folds.cross_section_winners(frame.repartition(parts), "doc").collect():
            got.setdefault(r.doc, set()).add((r.section, r.ord, r.key, r.score))
        assert got == want
    # fewer candidates than the least that a section keeps: the loser goes
    same = [("results", 0, "a b c d e f", 1.9), ("conclusion", 0, "a b c d e f", 0.9), ("conclusion", 1, "z y x", 0.5)]
    few = folds.cross_section_winners(spark.createDataFrame([(1, *x) for x in same], "doc int, section string, ord int, key string, score double"), "doc").collect()
    assert {(r.section, r.ord) for r in few} == {("results", 0), ("conclusion", 1)}


def test_event_gaps_against_a_plain_fold(spark):
    import datetime as dt

    r, base = random.Random(2), dt.datetime(2024, 1, 1)
    rows = [(r.choice("abc"), base + dt.timedelta(seconds=r.randrange(3000)), i) for i in range(800)]
    want, last = set(), {}
    for k, t, i in sorted(rows, key=lambda x: (x[1], x[2])):
        if k not in last or (t - last[k]).total_seconds() >= 40:
            last[k] = t
            want.add((k, i))
    frame = spark.createDataFrame(rows, "k string, ts timestamp_ntz, event_id long")
    for parts in (1, 6):
        assert {tuple(x) for x in folds.event_gap_filter(frame.repartition(parts), "k", 40.0).collect()} == want


def test_merge_discrepancies_and_coverage(spark):
    rows = [("k", "r", 2, "second", ["b"], ["2"], 0.4, "low"), ("k", "r", 1, "First", ["a", "b"], ["1"], 0.3, "high")]
    got = A.merge_discrepancies(spark.createDataFrame(rows, "key string, reason string, ord int, claim string, evidence array<string>, links array<string>, confidence double, severity string"), {"low": 0, "medium": 1, "high": 2}).first()
    assert (got.claim, got.evidence, got.links, got.confidence, got.severity) == ("First", ["a", "b"], ["1", "2"], 0.4, "high")
    empty = spark.createDataFrame([], "s string, ref_id int, line_id int, matched boolean")
    lines = spark.createDataFrame([("x", 1)], "s string, line_id int")
    assert tuple(A.recall_precision(empty, ["s"], lines).select("recall", "precision").first()) == (1.0, 0.0)
    points = spark.createDataFrame([("x", 1, 5, True), ("x", 2, 5, True), ("x", 3, 6, False)], "s string, ref_id int, line_id int, matched boolean")
    got = A.recall_precision(points, ["s"], spark.createDataFrame([("x", 5), ("x", 6)], "s string, line_id int")).first()
    assert (round(got.recall, 3), got.precision) == (0.667, 0.5)


def test_related_pairs_plan_has_no_nested_loop(spark):
    rows = spark.createDataFrame([(1, "c", ["r"], ["s"], 1.0)], "doc int, claim_id string, refs array<string>, said_refs array<string>, value double")
    pairs = J.related_pairs(rows, rows.withColumnRenamed("claim_id", "packet_id"), "doc")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert pairs.count() == 1 and J.related_pairs(rows, rows.withColumnRenamed("claim_id", "packet_id"), "doc", numeric=True).count() == 1


def test_registered_functions(spark):
    assert functions.register(spark)
    assert spark.sql("SELECT lode_clean('  a  b '), lode_canonical('P < 0.05!'), lode_slug('A b C', 2), lode_clamp(1.5), lode_relative_difference(4, 1)").first()[:4] == ("a b", "p 0.05", "a_b", 1.0)


def test_profiles():
    assert set(PROFILES) == {"fast", "balanced", "section_sensitive", "high_recall", "full"} and PROFILES["balanced"] == EngineConfig()


def test_best_match_in_blocks(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    lines = [(i, i % 3, r.sample(words, r.randrange(0, 12))) for i in range(90)] + [(90, 0, None)]
    points = [(i, i % 3, r.sample(words, r.randrange(0, 9))) for i in range(25)] + [(25, 1, ["nowhere"])]
    want = {}
    for i, part, w in points:
        scores = {j: (round(2 * len(set(w) & set(x or [])) / (len(w) + len(x or [])), 9) if set(w) & set(x or []) else 0, p) for j, p, x in lines}
        top = max(s for s, _ in scores.values())
        if top:
            want[i] = (min(j for j, (s, _) in scores.items() if s == top), top, max([s for s, p in scores.values() if p == part]), top >= 0.42)
    frames = [spark.createDataFrame(x, f"{k} long, part int, words array<string>") for k, x in (("ref_id", points), ("line_id", lines))]
    for block in (1 << 19, 20):
        monkeypatch.setattr(J, "BLOCK_WORDS", block)
        got = {r.ref_id: (r.line_id, round(r.score, 9), round(r.same_part, 9), r.matched) for r in J.best_match(frames[0], frames[1].repartition(3), 0.42).collect()}
        assert got == want


def test_nearest_vectors_in_cells(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, [r.uniform(-1, 1) for _ in range(r.choice([4, 4, 6]))]) for i in range(300)] + [(300, []), (301, None), (302, [0.0] * 4), (303, [1.0, 0.0, 0.0, 0.0]), (304, [2.0, 0.0, 0.0, 0.0])]

    def cosine(a, b):
        n = min(len(a or []), len(b or []))
        norm = sum(x * x for x in (a or [])[:n]) ** 0.5 * sum(x * x for x in (b or [])[:n]) ** 0.5
        return round(max(0.0, min(1.0, sum(x * y for x, y in zip((a or [])[:n], (b or [])[:n])) / norm)), 9) if norm else 0.0

    want = {}
    for i, v in rows[::9] + rows[-5:]:
        scores = [(-cosine(v, x), j) for j, x in rows if j != i]
        want[i] = (min(scores)[1], -min(scores)[0])
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    asked = frame.where(F.col("vec_id").isin(*want)).withColumnRenamed("vec_id", "id")
    for queries, down in ((2048, 1 << 14), (7, 40)):
        monkeypatch.setattr(J, "BLOCK_QUERIES", queries)
        monkeypatch.setattr(J, "BLOCK_ROWS", down)
        assert {r.id: (r.nearest, r.similarity) for r in J.nearest_vectors(asked, frame).collect()} == {i: (j, pytest.approx(c)) for i, (j, c) in want.items()}
    empty = frame.where("vec_id < 0")
    assert J.nearest_vectors(asked.where("id < 0"), frame).count() == 0 and J.nearest_vectors(asked, empty).count() == 0


def test_relations_by_value_against_all_pairs(spark):
    r = random.Random(7)
    texts = ["a significant gain", "a decrease was seen", "plain", "it had no effect", "a worse effect"]
    side = lambda key, n: [(r.randrange(6), f"{key}{i}", r.choice(texts), r.choice([None, 0.0, 10.0, 12.0, 14.0, -10.0, 30.0])) for i in range(n)]
    claims, packets = side("c", 60), side("p", 25)
    opposed = lambda a, b: (("significant" in a) and any(w in b for w in ("decrease", "worse", "no effect"))) or (("significant" in b) and any(w in a for w in ("decrease", "worse", "no effect"))) or (("no effect" in a) != ("no effect" in b))
    want = {}
    for doc, name, text, value in claims:
        own = [(v, t) for d, _, t, v in packets if d == doc and v is not None]
        if value is not None and own:
            want[name] = any(abs(value - v) / max(abs(value), abs(v), 1e-6) > 0.35 or opposed(text, t) for v, t in own)
    frames = [spark.createDataFrame(x, f"doc int, {k} string, text string, value double") for k, x in (("claim_id", claims), ("packet_id", packets))]
    got = J.value_relations(*frames, "doc").collect()
    assert {x.claim_id: x.conflict for x in got} == want and all((x.packet_id is not None) == x.conflict for x in got)
