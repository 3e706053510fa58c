"""Operators on documents against plain Python, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import attention, bpe, decontam, exact, langid, lines, lm, neardup, pii
from lodestone.llm.textnum import ALNUM, utf8, words

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (1, None), (2, ""), (3, "Ab É"), (4, "aB É"), (5, "ab é"), (6, "x" * 200_000), (7, "\n\n"), (8, "AB É"), (8, "AB É"),
    (9, "the same long line here indeed\nA\x0b The Same long line here indeed \nother"), (10, "THE same long line here indeed\r"), (11, " the same long line here indeed\nthe same long line here indeed"),
    (12, "a\x00b <s> [INST] \\ � 🙂"), (13, "é" * 30 + "\n" + "e" * 20), (14, "É" * 30 + "\nE" + "e" * 19), (15, "\t" + "e" * 20 + "\n" + "é" * 30),
]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_exact_dedup(spark):
    rows = ODD + [(100 + i, "copy " * (i % 7)) for i in range(300)]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_dedup(frame(spark, rows)).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    assert got == {(i, max(groups[k]), len(groups[k]), i == max(groups[k]), sha(k)) for i, t in rows for k in [(t or "").translate(FOLD)]}


def test_exact_dedup_filter_lets_no_copy_pass(spark):
    fp = exact.fingerprints(frame(spark, [(i, str(i // 2)) for i in range(2000)]))
    cells = exact.with_cells(fp, 6)  # far too small a filter: everything may repeat
    assert exact.maybe_repeated(cells, exact.repeated_cells(cells)).where("not maybe").count() == 0
    cells = exact.with_cells(exact.fingerprints(frame(spark, [(i, str(i)) for i in range(2000)])), exact.filter_bits(2000))
    assert exact.maybe_repeated(cells, exact.repeated_cells(cells)).where("maybe").count() < 200


def test_exact_dedup_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(exact, "MAX_BITS", 11)
    rows = [(i, f"text {i // 2 if i % 3 else i}") for i in range(600)] + [(None, "none"), (7, None), (7, "")]
    assert exact.ranges_of(len(rows)) == 5
    marked, parts = exact.marked_rows(exact.fingerprints(frame(spark, rows)), len(rows))
    assert len(parts) == 5 and marked.where("not maybe").count() > 100
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(frame(spark, rows)).collect())
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    top = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
    assert got == Counter((i, top[t or ""], len(groups[t or ""]), i == top[t or ""]) for i, t in rows)


def expected_lines(rows):
    blanks = " \t\n\x0b\x0c\r"
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = x.strip(blanks).translate(FOLD)
            if len(k) >= 20:
                holders.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        keys = [x.strip(blanks).translate(FOLD) for x in own]
        kept = [x for x, k in zip(own, keys) if not (k in holders and len(holders[k]) >= 3 and i != max(holders[k]))]
        out.append((i, len(own), len(own) - len(kept), sha("\n".join(kept))))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup(spark, batches):
    r = random.Random(3)
    rows = ODD + [(50 + i, "\n".join(f"line number {r.randrange(12)} of the corpus" for _ in range(r.randrange(6)))) for i in range(60)]
    assert sorted(map(tuple, lines.line_digest(frame(spark, rows), batches=batches).collect())) == expected_lines(rows)


@pytest.mark.parametrize("fanout", [2, 5])
def test_line_runs_share_no_key_and_need_no_exchange(spark, fanout):
    store = lines.LineRuns(4, fanout)
    for batch in ([("a", 9), ("b", 9)], [("a", 5), ("c", 5)], [("a", 1), ("c", 1), ("a", 1)]):
        store.add(spark.createDataFrame(batch, "key string, id long"))
    assert sorted((r.key, r.owner) for run in store.runs() for r in run.collect()) == [("a", 9), ("b", 9), ("c", 5)]
    assert len(store.runs()) == (3 if fanout == 5 else 2)
    plan = store.tallies[1].join(store.runs()[0].select("key").hint("merge"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert {(r.key, r.docs, r.owner) for r in store.repeated(1).collect()} == {("a", 3, 9), ("b", 1, 9), ("c", 2, 5)}
    store.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lodestone_line")]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_line_dedup_of_ids_with_several_texts(spark, parts):
    line = "a line that many documents hold"
    rows = [(3, "unique line that nobody else holds\nb"), (3, f"{line}\nc"), (3, f"x\n{line}"), (4, line), (5, line), (None, f"{line}\ny"), (None, None), (5, f"{line}\n{line}\nz"), (5, "only here, in the id that owns it")]
    got = sorted(map(tuple, lines.line_digest(frame(spark, rows).repartition(parts), batches=3).collect()), key=str)
    assert got == sorted([(i, len((t or "").split("\n")), *own) for i, t in rows for kept in [[x for x in (t or "").split("\n") if x != line or i == 5]] for own in [(len((t or "").split("\n")) - len(kept), sha("\n".join(kept)))]], key=str)


def test_clashing_columns_are_carried(spark):
    rows = [(1, "some line that is long enough\nx", "k", 5), (2, "some line that is long enough", "l", 6), (3, "some line that is long enough", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, pos int")
    out = lines.drop_repeated_lines(docs)
    assert {(r.doc_id, r.text, r.key, r.pos) for r in out.collect()} == {(1, "x", "k", 5), (2, "", "l", 6), (3, rows[2][1], None, 7)}
    names = spark.createDataFrame([(1, "a b", "own", 3)], "doc_id long, text string, lang_pred string, n_tokens int")
    assert bpe.encode_documents(names).columns == ["doc_id", "text", "lang_pred", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert langid.identify(names, langid.LanguageModel()).first().lang_pred == "und"


def brute_spans(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def test_pii_base_and_discovery(spark):
    texts = [
        None, "", "a@b.c_d@e.f x.y@z.w.v.", "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.1.1 " + "9" * 30 + ".1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111", "+1 (743) 555-3824 227.5.221.1",
        "é🙂 a@b.co 🙂 +49 170 1234567.", "1 " * 9000, "9" * 30000, "..@a.b", "a@b.c@d.e", "+1+12345678901", "no numbers here", "x" * 30000 + "@y.z",
    ]
    r = random.Random(5)
    texts += ["".join(r.choice("a1+@. -(4") for _ in range(r.randrange(80))) for _ in range(300)]
    calls = [f"please call me at +1 (555) 010-{1000 + i} soon" for i in range(8)]
    rows = list(enumerate(texts + calls + ["please call me at 555-3824 soon, order 12345678", "please call me at 555-3824 soon, order 12345678"]))
    got = {r.doc_id: r for r in pii.span_digest(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        base = brute_spans(t)
        assert got[i].base_sha256 == sha(",".join(base)), t
        assert set(base) <= set(got[i].spans.split(",")) | {""}
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(b.startswith(k) for b in base) for k in pii.KINDS)
    assert got[rows[-1][0]].spans == "phone:18:26"


def test_pii_discovery_precision_and_recall(spark):
    """Identifiers that no base pattern matches, planted after contexts that bring known ones, among numbers in other contexts."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abdeiklmnorstu") for _ in range(r.randint(2, 7)))
    contexts = {"phone": ["call me", "mobile number"], "card": ["card no"], "ip": ["server address"]}
    def card():
        body = [4, *(r.randrange(10) for _ in range(14))]
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(body))
        return "".join(map(str, [*body, -total % 10]))

    known = {"phone": lambda: f"+1 555 010 {r.randrange(1000, 9999)}", "card": card, "ip": lambda: f"10.{r.randrange(256)}.0.{r.randrange(256)}"}
    unseen = {"phone": lambda: f"555-{r.randrange(100, 999)}-{r.randrange(1000, 9999)}", "card": lambda: f"4{r.randrange(10**13, 10**14)}", "ip": lambda: f"300.{r.randrange(256)}.1.{r.randrange(256)}"}
    rows, planted, others = [], {}, 0
    for i in range(600):
        kind = r.choice(list(contexts))
        context, what = r.choice(contexts[kind]), r.random()
        value = known[kind]() if what < 0.6 else unseen[kind]()
        if what > 0.8:
            context, value, others = f"{word()} {r.choice(['order', 'page', 'year'])}", str(r.randrange(10**6, 10**9)), others + 1
        before = f"{' '.join(word() for _ in range(5))} {context} "
        rows.append((i, f"{before}{value} {' '.join(word() for _ in range(4))}"))
        if 0.6 <= what <= 0.8:
            planted[i] = f"{kind}:{len(before)}:{len(before) + len(value)}"
    added = {(x.doc_id, s) for x in pii.span_digest(frame(spark, rows)).where("n_added > 0").collect() for s in set(x.spans.split(",")) - set(brute_spans(rows[x.doc_id][1]))}
    want = {(i, s) for i, s in planted.items() if s not in brute_spans(rows[i][1])}
    assert others > 80 and len(want) > 80
    assert len(added & want) / len(want) >= 0.9 and len(added & want) / max(1, len(added)) >= 0.95


def test_language_id_is_a_distribution_and_tells_languages_apart():
    r = random.Random(1)
    syllables = {"aa": ["ba", "du", "ki", "lo"], "bb": ["eth", "orn", "ist", "ul"]}
    text = lambda k, n: " ".join("".join(r.choice(syllables[k]) for _ in range(r.randint(1, 3))) for _ in range(n))
    model = langid.fit({k: [text(k, 60) for _ in range(40)] for k in syllables})
    texts = [text("aa", 30), text("bb", 30), "123 ...", "", "Ba KIlo", "qqq xxx zzz jjj qqq xxx www vvv jjj " * 4]
    raw, offsets = utf8(pa.array(texts))
    e, n, letters = model.entropies(raw, offsets)
    assert [model.langs[k] for k in e[[0, 1, 4]].argmin(1)] == ["aa", "bb", "aa"]
    assert list(letters[2:4]) == [0, 0]
    own = e.min(1)
    limit = model.mean[e.argmin(1)] + 8 * model.spread[e.argmin(1)] / np.sqrt(n) + model.slack[e.argmin(1)]
    assert own[0] <= limit[0] and own[1] <= limit[1] and own[5] > limit[5]
    # every context's probabilities sum to one, seen or not
    for context in ([3, 4, 5], [5, 5, 5], [1, 3, 9]):
        high = sum(c << (langid.WIDTH * (3 - i)) for i, c in enumerate(context))
        size = round(math.exp(-model.uniform))
        p = np.exp(model.log_probability(high | np.arange(size), 4))
        assert p.sum(0) == pytest.approx([1, 1], abs=0.02)


def test_language_id_held_out_accuracy(spark, tiny):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98
    assert all(0 <= r.score <= 1 for r in out) and sum(not r.accepted for r in out) <= 0.01 * len(out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)


def test_language_id_equals_plain_kneser_ney():
    """Every order's probabilities by the definition, over dictionaries, without hashes or arrays."""
    texts = ["abab cab bac", "cabba abc ca", "bbac ab a", "ab"]
    model = langid.fit({"aa": texts, "bb": ["xyx zxy yyz zz", "zyx xyz"]}, order=3)
    train, size = langid.halves(texts, 10**9)[0], round(math.exp(-model.uniform))
    grams = {n: Counter() for n in (1, 2, 3)}
    for t in train:
        own = f"  {t} "  # the context of the first letters is blanks
        for i in range(2, len(own)):
            for n in (1, 2, 3):
                grams[n][own[i - n + 1 : i + 1]] += 1
    kinds = {3: dict(grams[3])} | {n: dict(Counter(g[1:] for g in grams[n + 1])) for n in (2,)}
    kinds[1] = dict(Counter(g[1:] for g in kinds[2]))

    def p(gram):
        if not gram:
            return 1 / size
        n, c = len(gram), kinds[len(gram)]
        once, twice = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
        d = min(0.95, max(0.1, once / (once + 2 * twice) if once else 0.5))
        of = [x for g, x in c.items() if g[:-1] == gram[:-1]]
        if not of:
            return p(gram[1:])
        return max(0.0, c.get(gram, 0) - d if gram in c else 0.0) / sum(of) + d * len(of) / sum(of) * p(gram[1:])

    ids = {ch: int(model.char_ids[ord(ch)]) for ch in "abcxyz"} | {" ": langid.BLANK}
    for gram in ("  a", " ab", "aba", "bac", "cca", "xab", "abx", "zzz", "a b"):
        key = sum(ids[ch] << (langid.WIDTH * (2 - i)) for i, ch in enumerate(gram))
        assert math.exp(model.log_probability(np.array([key]), 3)[0, 0]) == pytest.approx(p(gram), rel=1e-4), gram


def test_language_id_rejects_other_languages_and_keeps_its_own():
    import pyarrow.parquet as pq

    by = {}
    for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text", "lang"]).to_pylist():
        if r["lang"] and any(c.isalpha() for c in r["text"] or ""):
            by.setdefault(r["lang"], []).append(r["text"])

    def accepted(model, texts):
        e, n, _ = model.entropies(*utf8(pa.array(texts, pa.large_string())))
        best = e.argmin(1)
        return float((e.min(1) <= model.mean[best] + 8 * model.spread[best] / np.sqrt(n) + model.slack[best]).mean())

    model = langid.fit({k: v[::2] for k, v in by.items()})
    assert accepted(model, [t for v in by.values() for t in v[1::2]]) >= 0.99
    for gone in by:
        foreign = accepted(langid.fit({k: v[::2] for k, v in by.items() if k != gone}), by[gone])
        assert foreign <= 0.15, (gone, foreign)


def usual():
    path, pattern = bpe.usual_vocabulary()
    return bpe.Vocabulary(bpe.read_ranks(path), pattern)


def test_bpe_equals_tiktoken():
    import tiktoken

    v = usual()
    reference = tiktoken.Encoding("own", pat_str=v.pattern, mergeable_ranks=v.ranks, special_tokens={})
    r = random.Random(2)
    alphabet = "aAbzZé ß'  \n\t'sreveldmt019²½.,!?- 　中文字🙂é\r'’\x00\x85 "
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(4000)]
    texts += ["", "a" * 3000, " " * 300, "\n" * 40 + "x", "ab" * 700, "🙂" * 300, "don't we'll 'tis ''s 's's x'reed I'VE", "<|endoftext|> x", "th" * 900, "'s", "''ll", "x' s"]
    raw, offsets = utf8(pa.array(texts))
    encoder = bpe.Encoder(v, cache_pieces=2000)
    for i in range(0, len(texts), 500):
        j = min(i + 500, len(texts))
        ids, rows = encoder.encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for k in range(i, j):
            assert ids[rows[k - i] : rows[k - i + 1]].tolist() == reference.encode_ordinary(texts[k]), texts[k]
    assert bpe.pieces_by_pattern(raw, offsets, v.pattern).tolist() == bpe.pieces_by_runs(raw, offsets, v.classes).tolist()


def test_bpe_digests_and_round_trip(spark):
    import tiktoken

    v = usual()
    reference = tiktoken.Encoding("own", pat_str=v.pattern, mergeable_ranks=v.ranks, special_tokens={})
    out = bpe.encode_documents(frame(spark, ODD), keep_ids=True)
    for r in bpe.decode_documents(out).collect():
        ids = reference.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(r.text or ""))
        assert r.ids == ids and bytes(r.decoded) == (r.text or "").encode()


def test_hash_collisions_are_found_out():
    v = usual()
    encoder = bpe.Encoder(v)
    raw, offsets = utf8(pa.array(["zebra quilt", "other"]))
    want = encoder.encode(raw, offsets)[0].tolist()
    encoder.first[:] = encoder.first[::-1].copy()  # as if pieces had shared hashes
    encoder.count[:] = encoder.count[::-1].copy()
    assert encoder.encode(raw, offsets)[0].tolist() == want


def test_decontamination_against_windows(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)] + ["Zé", "of"]
    items = {str(i): " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(25)} | {"dup": "w1 w2 w3", "dup2": "W1, w2; w3"}
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(60))) for _ in range(80)] + [None, "", "--", items["3"], " ".join(items.values()), "w1 w2 w3 " * 3000]
    want = decontam.brute_force(texts, items)
    docs, benchmark = frame(spark, list(enumerate(texts))), spark.createDataFrame([(k, v) for k, v in items.items()] + [("null", None)], "item_id string, text string")
    got = {r.doc_id: r for r in decontam.leak_digest(docs, benchmark).collect()}
    for i, (n, hit, found) in enumerate(want):
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (n, hit, len(found), sha(",".join(found)), hit > 0)


def test_decontamination_in_blocks_and_shards(spark, monkeypatch):
    items = {str(i): f"alpha{i} beta{i} gamma{i}" for i in range(20)}
    texts = ["start alpha3 beta3 gamma3 alpha4 beta4 gamma4 alpha5", "alpha9 beta9", None]
    docs, benchmark = frame(spark, list(enumerate(texts))), spark.createDataFrame(list(items.items()), "item_id string, text string")
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 7)
    rows = {r.doc_id: r for r in decontam.find_leaks(docs, benchmark).collect()}
    assert [(s.start, s.end) for s in rows[0][decontam.SPANS]] == [(1, 7)] and rows[0][decontam.ITEMS] == ["3", "4"]
    assert not rows[1][decontam.SPANS] and rows[2][decontam.N_WORDS] == 0


def test_suffix_array_and_search():
    r = np.random.default_rng(0)
    for n in (1, 5, 300):
        for sigma in (2, 5):
            seq = r.integers(0, sigma, n)
            seq[-1] = 0
            left = np.array([int(np.flatnonzero(seq[i:] == 0)[0]) for i in range(n)])
            sa = decontam.suffix_array(seq, left, 3)
            key = lambda i: [(int(seq[j]), j if seq[j] == 0 else 0) for j in range(i, i + left[i] + 1)]  # noqa: B023, E731
            assert sa.tolist() == sorted(range(n), key=key)
            index = decontam.FMIndex(seq, left, 3)
            pattern = np.array([[1, 1]], np.int32)
            _, lo, hi = index.search(pattern, np.array([2]))
            places = sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) if len(lo) else []
            assert places == [i for i in range(n - 1) if seq[i] == 1 and seq[i + 1] == 1]


def test_dart_signatures_agree_like_jaccard_and_weights():
    r = np.random.default_rng(1)
    for similarity in (0.5, 0.8):
        gaps = []
        for _ in range(60):
            n = int(r.integers(5, 200))
            common = round(2 * n * similarity / (1 + similarity))
            pool = r.integers(0, 1 << 43, 2 * n)
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:common], pool[n : 2 * n - common]]))
            s = neardup.dart_signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2, 150)
            gaps.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(gaps)) < 0.02
    element, w1, w2 = r.integers(0, 1 << 43, 40), r.random(40) * 3, r.random(40) * 3
    s = neardup.dart_signatures(np.repeat([0, 1], 40), np.concatenate([element, element]), 2, 4000, np.concatenate([w1, w2]))
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum(), abs=0.04)
    assert (neardup.dart_signatures(np.zeros(0, np.int64), np.zeros(0, np.int64), 2, 10) == -1).all()


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[min(x, y)] = max(x, y)
    return {i: find(i) for i in ids}


def test_near_classes_against_all_pairs(spark):
    r = random.Random(6)
    rows, n = [(1, None), (2, ""), (3, "one two"), (4, "One, two"), (5, "--")], 10
    for _ in range(6):  # stars of copies that are like their original, not like each other
        base = [f"t{r.randrange(10**6)}" for _ in range(120)]
        for _ in range(8):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2, 2])):
                copy[r.randrange(120)] = f"x{r.randrange(10**6)}"
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n + i, " ".join(f"u{r.randrange(10**6)}" for _ in range(50))) for i in range(10)] + [(3, "one two")]
    got = {r.doc_id: r for r in neardup.near_classes(frame(spark, rows)).collect()}
    want = brute_classes(rows)
    assert {i: x.class_id for i, x in got.items()} == want
    sizes = Counter(want[i] for i, _ in rows)
    assert all(x.class_size == sizes[x.class_id] and x.kept == (i == x.class_id) for i, x in got.items())


def test_near_classes_of_documents_against_all_pairs(spark):
    """No class of the documents table differs from that of all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert len(set(want.values())) < len(want)
    assert {r.doc_id: r.class_id for r in neardup.near_classes(docs).collect()} == want


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_near_classes_of_ids_with_several_texts(spark, parts):
    """An id's texts join its class, however the rows lie; rows without an id have a class of their own."""
    a, b, c = ([f"{k}{i}" for i in range(60)] for k in "abc")
    near = lambda w, x: " ".join([*w[:-1], x])
    rows = [(10, " ".join(a)), (10, " ".join(b)), (3, near(a, "x")), (4, near(b, "y")), (4, near(b, "y")), (5, " ".join(c)), (None, " ".join(a)), (None, " ".join(c)), (7, None), (7, near(c, "z")), (8, ""), (8, "")]
    got = {r.doc_id: (r.class_id, r.class_size, r.kept) for r in neardup.near_classes(frame(spark, rows).repartition(parts)).collect()}
    assert got == {10: (10, 5, True), 3: (10, 5, False), 4: (10, 5, False), 5: (7, 2, False), 7: (7, 2, True), 8: (8, 2, True), None: (None, 2, True)}


def test_near_classes_reads_its_own_columns_only(spark):
    rows = [(1, "a b c d e f g h", 5, "n"), (2, "a b c d e f g h", 6, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long, bands string")
    assert {(r.doc_id, r.class_id) for r in neardup.near_classes(docs).collect()} == {(1, 2), (2, 2)}


def test_block_links_join_what_all_pairs_join():
    r = random.Random(8)
    for trial in range(60):
        base = [sorted(r.sample(range(400), 40)) for _ in range(3)]
        sets = []
        for _ in range(r.randrange(2, 30)):
            own = set(r.choice(base)) ^ set(r.sample(range(400), r.randrange(0, 8)))
            sets.append(np.array(sorted(own), "<u4").tobytes())
        nodes, labels = np.arange(len(sets)) + 100, np.array([r.randrange(len(sets)) for _ in sets]) if trial % 2 else np.arange(len(sets))
        left = r.randrange(1, len(sets)) if trial % 3 == 0 else None
        own = [set(np.frombuffer(x, "<u4").tolist()) for x in sets]

        def classes(links):
            top = {("n", int(n)): ("l", int(k)) for n, k in zip(nodes, labels, strict=True)}
            find = lambda x: find(top[x]) if top.get(x, x) != x else x
            for a, b in links:
                x, y = find(("n", int(a))), find(("n", int(b)))
                if x != y:
                    top[x] = y
            return {frozenset(int(n) for n in nodes if find(("n", int(n))) == k) for k in {find(("n", int(n))) for n in nodes}}

        every = [(nodes[i], nodes[j]) for i in range(len(sets)) for j in range(i + 1, len(sets)) if (left is None or i < left <= j) and len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])]
        assert classes(neardup.block_links(nodes, labels, left, sets, 0.8)) == classes(every)


@pytest.mark.parametrize("block", [2048, 60])
def test_near_classes_in_large_buckets_of_classes_of_two(spark, monkeypatch, block):
    """A family whose members are 0.78 alike, but 0.81 two by two: large buckets in which only pairs belong together."""
    monkeypatch.setattr(neardup, "BLOCK", block, raising=False)
    family, n = [f"t{i}" for i in range(104)], 600
    rows = [(i, " ".join([*family, *[f"p{i // 2}w{k}" for k in range(2)], *[f"d{i}w{k}" for k in range(12)]])) for i in range(n)]
    got = {r.doc_id: (r.class_id, r.class_size) for r in neardup.near_classes(frame(spark, rows)).collect()}
    assert got == {i: (i | 1, 2) for i in range(n)}


def test_lm_base_scores(spark):
    rows = ODD + [(None, "no id"), (500, "word0"), (500, "word0")] + [(500 + i, f"word{i % 5} and The the word") for i in range(60)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))) for i, t in rows]
    c = Counter(w for i, own in split if not held(i) for w in [*own, None])
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(own) + 1, sum(c[w] > 0 for w in [*own, None]), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*own, None]), 6)) for i, own in split)
    docs = frame(spark, rows)
    training = F.coalesce(F.crc32(docs.doc_id.cast("string").cast("binary")) % 10 != 0, F.lit(True))
    got = lm.score_documents(docs, training, steps=20).collect()
    assert sorted((str(r.doc_id), not r.train, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def windows_of(model, ids, ends):
    w = model.windows(model.symbols(ids, ends)[0])
    return w[(w[:, model.context : -1] < model.finish).any(1)]


def small_model(n, ids, ends, **sizes):
    counts = np.bincount(ids, minlength=n)
    return attention.AttentionLM(n, counts, windows_of(attention.AttentionLM(n, counts, np.zeros((0, 33), np.int32), **sizes), ids, ends), **sizes)


def plain_log10(m, ids):
    """Attention token by token: the specification."""
    p, symbols, total = m.p, [m.begin, *ids, m.finish], 0.0
    emb = lambda s: p["emb"][m.row[s]]
    for t in range(len(symbols) - 1):
        # a window has its own context: up to `context` back of its first position, but never farther than `context` from the position
        back = [s for s in range(max(0, t - m.context), t + 1)]
        q = emb(symbols[t]) @ p["wq"] * m.scale
        a = np.array([math.exp(min(20, q @ (emb(symbols[s]) @ p["wk"]))) * math.exp(min(20, p["far"][t - s])) for s in back])
        h = emb(symbols[t]) @ p["wx"] + p["b"] + sum(w * (emb(symbols[s]) @ p["wv"]) for w, s in zip(a / (a.sum() + 1e-12), back))
        h = np.maximum(h, 0)
        log_share = lambda x, k: x[k] - math.log(np.exp(x).sum())
        to = symbols[t + 1]
        total += log_share(h @ p["wo"] + p["bo"], m.cluster[to]) + m.share[to]
        if m.cluster[to] < m.clusters:
            total += log_share(h @ p["ws"][m.cluster[to]] + p["bs"][m.cluster[to]], m.slot[to])
    return total / math.log(10)


def test_attention_equals_plain_attention():
    r = np.random.default_rng(0)
    ids, ends = r.integers(0, 40, 3000) % r.integers(1, 41, 3000), np.arange(0, 3001, 100)
    for sizes in ({"size": 4, "clusters": 6, "rows": 20}, {"size": 8, "clusters": 3, "rows": 9, "context": 8, "stride": 4}, {"size": 8, "clusters": 3, "rows": 9, "context": 5, "stride": 8}):
        model = small_model(40, ids, ends, **sizes)
        model.train(windows_of(model, ids, ends), 60)
        texts = [r.integers(0, 40, n) for n in (0, 1, 15, 16, 17, 33, 70)]
        cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        together = model.log10(np.concatenate(texts), cuts, block=3)
        assert together == pytest.approx([plain_log10(model, t) for t in texts], rel=1e-4)
        # no block size or neighbour changes a text's score
        assert together == pytest.approx([model.log10(t, np.array([0, len(t)]))[0] for t in texts], rel=1e-4)


def test_attention_scores_are_probabilities_and_learn():
    ids = np.tile(np.array([3, 5, 7, 9, 11]), 400)
    ends = np.arange(0, len(ids) + 1, 50)
    model = small_model(20, ids, ends, size=2, clusters=2)
    before = model.log10(ids, ends).sum()
    model.train(windows_of(model, ids, ends), 150)
    assert model.log10(ids, ends).sum() > 0.3 * before
    head = [3, 5, 7, 2]
    alone = lambda t: 10 ** model.log10(np.array(t), np.array([0, len(t)]))[0]
    w = model.windows(model.symbols(np.array(head), np.array([0, 4]))[0])
    assert (w[0, : model.context] == model.pad).all() and w[0, model.context : model.context + 6].tolist() == [model.begin, *head, model.finish]
    # texts of no id and of one id are some of all texts
    assert alone([]) + sum(alone([x]) for x in range(20)) < 1


def test_clusters_hold_every_frequent_id_once():
    r = np.random.default_rng(4)
    ids, ends = r.integers(0, 300, 20_000) % r.integers(1, 301, 20_000), np.array([0, 9_000, 20_000])
    m = small_model(310, ids, ends, size=16, clusters=10)
    inside = m.cluster[:310] < m.clusters
    assert inside.sum() == 160 and len(set(zip(m.cluster[:310][inside].tolist(), m.slot[:310][inside].tolist()))) == 160 and m.slot.max() < 16
    for g in range(m.clusters, m.end):
        own = m.cluster[:310] == g
        assert not own.any() or np.exp(m.share[:310][own]).sum() == pytest.approx(1, abs=1e-4)


def test_attention_gradient():
    r = np.random.default_rng(3)
    ids, ends = r.integers(0, 12, 60), np.array([0, 20, 60])
    m = small_model(12, ids, ends, size=3, clusters=2, rows=6, width=5, head=3, hidden=6, context=4, stride=4)
    m.p = {k: np.where(x < -29, -2.0, x).astype(np.float64) for k, x in m.p.items()}
    w = windows_of(m, ids, ends)
    _, g = m._gradient(w)
    for k, x in m.p.items():
        for _ in range(4):
            at = tuple(r.integers(0, n) for n in x.shape)
            keep, up = x[at], 1e-5
            x[at] = keep + up
            high, _ = m._gradient(w)
            x[at] = keep - up
            low, _ = m._gradient(w)
            x[at] = keep
            assert g[k][at] == pytest.approx((high - low) / (2 * up), abs=2e-4), k


def test_lm_learns_from_every_training_row(spark):
    """Ids are counted in all rows, and each row sends windows; held-out rows send nothing. Shards give one mean model."""
    v = bpe.shared_vocabulary(spark, *bpe.usual_vocabulary())
    ids = len(v.value.token_size)
    rows = [(i, f"word{i} and the other words of text number {i} " * (1 + i % 9), i % 5 > 0, i * 7919) for i in range(200)] + [(None, None, True, 1), (7, "", True, 2)]
    docs = spark.createDataFrame(rows, "id long, text string, training boolean, h long")
    texts = lm.written(lm.encoded(docs, v), "test-ids")
    encoder = bpe.Encoder(v.value)
    want, windows = np.zeros(ids, np.int64), 0
    for _, t, training, _ in rows:
        own = encoder.encode(*utf8(pa.array([t or ""])))[0]
        want += training * np.bincount(own, minlength=ids)
        windows += training * min(2, -(-(len(own) + 1) // 16))
    assert (lm.id_counts(texts, ids) == want).all()
    found = lm.written(lm.training_windows(texts, ids, 2), "test-windows")
    assert found.count() == windows == len({(r.u, bytes(r.window)) for r in found.repartition(5).collect()}) + windows - found.distinct().count()
    start = lm.first_fit(found, want, 5)
    import pickle

    means = [pickle.loads(lm.mean_fit(found.repartition(n), 3, start)).p for n in (1, 4)]
    assert all(np.allclose(means[0][k], means[1][k], atol=1e-4) for k in means[0]) and not np.allclose(means[0]["wo"], pickle.loads(start).p["wo"])


def test_lm_beats_its_base_on_held_out_rows(spark):
    out = lm.scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert out["sum(score)"] > out["sum(base_score)"]


def test_word_hashes_do_not_depend_on_place():
    texts = ["alpha beta gamma", "gamma " + "z" * 5000 + " beta", "z" * 5000, "alphab alphabe alphabet alphabets"]
    h, row, start, end = words(pa.array(texts), ALNUM)
    seen = {}
    for x, i, s, e in zip(h, row, start, end):
        word = "".join(texts).encode()[s:e]
        assert seen.setdefault(word, x) == x
    assert len(set(seen.values())) == len(seen)


def test_empty_tables(spark):
    docs = frame(spark, [])
    assert exact.exact_dedup(docs).count() == 0 and lines.line_digest(docs).count() == 0 and pii.span_digest(docs).count() == 0
    assert bpe.encode_documents(docs).count() == 0 and neardup.near_classes(docs).count() == 0
    assert decontam.leak_digest(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert langid.predictions(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    assert lm.scores(docs).count() == 0


def test_lm_learns_from_every_window_of_a_long_text(spark, monkeypatch):
    v = bpe.shared_vocabulary(spark, *bpe.usual_vocabulary())
    ids = len(v.value.token_size)
    docs = spark.createDataFrame([(i, f"text {i} goes on and on " * 40, i < 3, i) for i in range(4)], "id long, text string, training boolean, h long")
    texts, sizes = lm.written(lm.encoded(docs, v), "test-ids"), []
    want = sum(-(-(len(bpe.Encoder(v.value).encode(*utf8(pa.array([r.text])))[0]) + 1) // 16) for r in docs.where("training").collect())
    fit = lm.mean_fit
    monkeypatch.setattr(lm, "mean_fit", lambda windows, *rest: sizes.append(windows.count()) or fit(windows, *rest))
    lm.fitted(texts, ids=ids, steps=1, size=4)
    assert sizes == [want] and want > 3 * 4


def test_lm_windows_travel_packed_and_are_never_stored(spark, monkeypatch):
    v = bpe.shared_vocabulary(spark, *bpe.usual_vocabulary())
    ids, words = len(v.value.token_size), "some other words that go around in texts of many kinds and ways".split()
    rows = [(i, " ".join(words[(i * k * k + k // 7) % len(words)] + str(i * k % 97) for k in range(700)), i < 5, i * 7919) for i in range(6)]
    texts = lm.written(lm.encoded(spark.createDataFrame(rows, "id long, text string, training boolean, h long"), v), "test-ids")
    windows = lm.training_windows(texts, ids)
    sent, want = lm.packed(windows, 3).collect(), sorted(bytes(r.window) for r in windows.collect())
    got = [x.astype("<i4").tobytes() for r in sent for x in lm.unpacked(r.n, r.size, bytes(r.block))]
    assert sorted(got) == want and {r.shard for r in sent} == {0, 1, 2}
    assert sum(len(r.block) for r in sent) < 0.35 * sum(map(len, want))
    first = sorted(bytes(r.window) for r in lm.training_windows(texts, ids, shards=3).collect())
    assert first == sorted(x.astype("<i4").tobytes() for r in sent if r.shard == 0 for x in lm.unpacked(r.n, r.size, bytes(r.block)))
    wide = lm.packed(spark.createDataFrame([(5, np.full(33, 70_000, "<i4").tobytes())], "u long, window binary"), 1).first()
    assert (lm.unpacked(wide.n, wide.size, bytes(wide.block)) == 70_000).all()
    names, write = [], lm.written
    monkeypatch.setattr(lm, "written", lambda df, name: names.append(name) or write(df, name))
    lm.fitted(texts, ids, steps=1, size=100)
    assert not names


def test_lm_sums_of_models_travel_in_parts(spark, monkeypatch):
    """However many shards there are, no row that an exchange moves holds a whole model, and few tasks send sums."""
    from pyspark.sql.classic.dataframe import DataFrame

    v = bpe.shared_vocabulary(spark, *bpe.usual_vocabulary())
    ids = len(v.value.token_size)
    rows = [(i, f"word{i} and the other words of text number {i} " * 9, True, i * 0x9E3779B97F4A7C15 % 2**63) for i in range(80)]
    texts = lm.written(lm.encoded(spark.createDataFrame(rows, "id long, text string, training boolean, h long"), v), "test-ids")
    windows, moved, deal = lm.training_windows(texts, ids), [], DataFrame.repartition
    start = lm.first_fit(windows, lm.id_counts(texts, ids), 2)
    monkeypatch.setattr(lm, "TASKS", 3, raising=False)
    monkeypatch.setattr(DataFrame, "repartition", lambda self, *to: moved.append(self) or deal(self, *to))
    lm.mean_fit(windows, 12, start)
    monkeypatch.undo()
    sums = moved[-1]
    name = next(f.name for f in sums.schema if f.dataType.typeName() == "binary")
    sizes = [r[0] for r in sums.select(F.octet_length(name)).collect()]
    assert len(start) > 1 << 17 and max(sizes) <= 1 << 17
    assert sum(sizes) <= 3 * len(start)
