"""HTML extraction, chat formatting, and the pipeline."""

import hashlib
import random

from pyspark.sql import functions as F

from lodestone.llm import chat, html
from lodestone.llm.html import Walk


def test_main_text():
    page = (
        '<!doctype html><head><title>T</title><style>p{}</style></head><body><div class="cookie-bar">We use cookies</div><header>Site</header><nav><ul><li>Home</ul></nav>'
        '<article><h1>Head &amp; more</h1><p>One <b>bo</b>ld&nbsp;x<br>two<p>Three<div class="share">tweet</div><ul><li>a<li>b</ul><form>f</form><section id="comments"><p>first!</p></section>'
        "<script>if (a < b) { '</p>' }</script></article><aside>side</aside><footer>&copy; x</footer>"
    )
    assert Walk(page).text() == "Head & more\n\nOne bold x two\n\nThree\n\na\n\nb"
    assert Walk("").text() == "" and Walk("plain < text & more <3").text() == "plain < text & more <3"
    assert Walk("<p>a<p>b<table><tr><td>c<td>d</table>e").text() == "a\n\nb\n\nc\n\nd\n\ne"
    assert Walk("<!-- <p>x</p> --><p>&lt;tag&gt; &#233;&am</p><!-- open").text() == "<tag> é&am"
    assert Walk("<div>" * 20000 + "deep").text() == "deep"
    assert Walk('<main><p>m</p></main><article class="comment">no</article>').text() == "m"
    assert Walk("<p a='>'>x</p><p b=\"open>y").text().startswith("x")


def test_named_elements_go_but_never_articles():
    article = "<article><h1>T</h1><p>real text</p></article>"
    for wrapper in ('<div class="layout has-sidebar">', '<div class="no-header">', '<div class="container search-page">', '<div class="sidebar">', '<div id="widget">', '<section class="comments">', '<div class="banner"><div class="related posts">'):
        end = "</section>" if wrapper.startswith("<section") else "</div>" * wrapper.count("<div")
        assert Walk(f"<body>{wrapper}{article}{end}</body>").text() == "T\n\nreal text", wrapper
        assert Walk(f"<body>{wrapper}{article.replace('article', 'main')}{end}<div class='footer-links'>f</div></body>").text() == "T\n\nreal text", wrapper
    assert Walk('<article><p>a</p><section class="share-price"><p>3.10</p></section><div class="widget-text">b</div><div class="share-buttons">x</div><div class="ad">y</div></article>').text() == "a\n\n3.10\n\nb"
    # teasers in a named wrapper don't count beside the article, nor beside main
    teaser = '<div class="related"><article><p>teaser</p></article></div>'
    assert Walk(f"<body>{article}{teaser}</body>").text() == "T\n\nreal text"
    assert Walk(f"<body><main><p>m</p>{teaser}<p>n</p></main></body>").text() == "m\n\nn"
    assert Walk(f"<body>{teaser}<p>loose</p></body>").text() == "teaser"
    # comments inside the article and comment articles go
    assert Walk('<article><p>a</p><div id="comments"><div class="comment-list"><p>c</p></div></div></article><article class="comment"><p>d</p></article>').text() == "a"
    assert Walk('<div class="footer">f</div>').text() == ""
    nested = "<article><p>outer</p><article><p>inner</p></article><p>end</p></article>"
    assert Walk(f'<div class="sidebar"><p>s</p></div><span class="ad"><span class="ad">x</span>y</span>{nested}').text() == "outer\n\ninner\n\nend"


def test_precision_and_recall_on_planted_templates(spark):
    """Sites with their own menus, notices, sidebars, adverts and comments, in plain and in named elements; hosts of one page too."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abdeiklmnorstu") for _ in range(r.randint(3, 8)))
    said = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for host in range(12):
        menu, notice, side, foot = said(8), said(12), said(15), said(10)
        kind = r.choice(["article", "main", "div"])
        wrapper = r.choice(["layout has-sidebar", "no-header page", "site search-page", "wrap"])
        for k in range(1 if host < 3 else 12):
            i, blocks = len(rows), [said(r.randint(2, 25)) for _ in range(r.randint(2, 6))]
            body = "".join(f"<p>{b}</p>" for b in blocks)
            extra = "" if host < 3 and kind == "div" else f"<div><ul><li>{menu}</li></ul></div><div><p>{notice} for everybody</p></div>" if kind == "div" else f"<div>{menu}</div><div>{notice}</div>"
            page = f'<body><nav>{menu}</nav><div class="{wrapper}">{extra}<{kind}>{body}<div class="ad">{said(6)}</div><section class="comments"><p>{said(9)}</p></section></{kind}><div class="sidebar-box">{side}</div></div><footer>{foot}</footer></body>'
            rows.append((i, f"https://h{host}.example/{k}", page))
            want[i] = blocks
    got = {x.page_id: x.text.split("\n\n") if x.text else [] for x in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    both = sum(len([b for b in got[i] if b in want[i]]) for i in want)
    precision, recall = both / sum(map(len, got.values())), both / sum(map(len, want.values()))
    assert recall == 1.0 and precision > 0.97, (precision, recall)


def test_templates_go_and_articles_stay(spark):
    rows = []
    for i in range(12):
        host = "a.example" if i < 8 else "b.example"
        rows.append((i, f"http://{host}/{i}", f"<body><div><p>Subscribe to our letter today please</p></div><div><p>Text number {i} of this site</p><p>The.</p></div></body>"))
    same = "<body><article><h1>Copy</h1><ul><li>kept point one</li></ul><p>The.</p></article></body>"
    rows += [(100 + i, "http://a.example/c", same) for i in range(9)] + [(200, None, None), (201, "http://[bad", ""), (0, "http://a.example/0", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, r.text, r.n_chars) for r in html.main_text(pages).collect()]
    assert len(got) == len(rows)
    for i, text, n in got:
        want = "" if i >= 200 else "Copy\n\nkept point one\n\nThe." if i >= 100 else f"Text number {i} of this site\n\nThe." if i < 8 else f"Subscribe to our letter today please\n\nText number {i} of this site\n\nThe."
        assert (text, n) == (want, len(want)), i


def test_generated_pages(spark, tiny):
    import html as entities
    import re

    rows = html.main_text(spark.read.parquet(f"{tiny}/pages.parquet")).collect()
    raw = {r.page_id: r.html for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", raw[r.page_id], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[a-z/!][^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_escapes_are_reversible():
    r = random.Random(0)
    parts = ["<", "</s>", "<s>", "[INST]", "[/INST]", "\\", "<<SYS>>", "<</SYS>>", "[ROLE:", "[/ROLE]", "s>", " ", "x", "[", "]", "/", "\n", "<\\s>", "[\\\\INST]"]
    for _ in range(5000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(8)))
        role = r.choice(["user", "assistant", "system", "tool", "", "a] b", "<s>"])
        segment, start, end = chat.render(role, text)
        assert list(chat.read(segment)) == [(role, text)]
        assert chat.unescape(segment[start:end]) == (text if role == "assistant" else "")
    turns = [(r.choice(["user", "assistant", "system", "x"]), "".join(r.choice(parts) for _ in range(5))) for _ in range(200)]
    assert list(chat.read("".join(chat.render(*t)[0] for t in turns))) == turns


def test_fold_edits_and_regenerations():
    log = [
        (1, 0, 0, "message", "user", "q"), (1, 1, 1, "message", "assistant", ""), (1, 1, 2, "delta", None, "wro"), (1, 1, 3, "delta", None, "ng"),
        (1, 1, 6, "regenerate", None, None), (1, 1, 7, "delta", None, "right"), (1, 2, 4, "message", "user", "said before"), (1, 2, 8, "message", "user", "thanks"),
        (2, 0, 0, "message", "user", "a"), (2, 0, 5, "edit", None, "b"), (2, 1, 1, "message", "assistant", "to a"), (2, 1, 6, "message", "assistant", None),
    ]
    assert list(chat.fold(log)) == [(1, 0, "user", "q"), (1, 1, "assistant", "right"), (1, 2, "user", "thanks"), (2, 0, "user", "b"), (2, 1, "assistant", "")]


def test_chat_digest(spark):
    rows = [(1, 1, "assistant", "é" * 3000), (1, 0, "user", None), (2, 0, "tool", "x"), (2, 0, "tool", "x"), (None, 0, "system", "s"), (3, 5, None, ""), (1, 2, "assistant", " </s> ")]
    got = {r.conv_id: r for r in chat.format_digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256) == (3, digest(f"user\n\nassistant\n{'é' * 3000}\nassistant\n </s> \n"))
    assert (got[1].loss_chars, got[1].loss_sha256) == (3006, digest("é" * 3000 + " </s> "))
    assert got[2].n_turns == 2 and got[3].turns_sha256 == digest("\n\n") and got[None].n_turns == 1
    said = "</s>[INST] ok [/INST]"
    assert (got[-1].turns_sha256, got[-1].loss_sha256) == (digest(f"user\n{said}\nassistant\n{said}\n"), digest(said))
    assert chat.format_digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 1


def test_pipeline(spark, tiny):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, tiny)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes, name
        assert out.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        before = spark.createDataFrame(out.collect(), out.schema)
    assert 0 < before.count() <= docs.count()
    assert before.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows and ids, extra columns that clash, and an empty table, through every stage."""
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))
    import corpus_pipeline

    r = random.Random(3)
    said = lambda n: " ".join(r.choice(["the", "sun", "shines", "over", "green", "hills", "and", "quiet", "rivers", "today"]) + r.choice("abcdefgh") for _ in range(n))
    base = said(80)
    rows = [(i, said(60), "en", "s", 0, "x", i) for i in range(30)]
    rows += [(100, base, "en", "s", 0, "x", 1), (101, base + " more", "en", "s", 0, "x", 2), (102, base, "en", "s", 0, "x", 3)]  # copies: 102 stays
    rows += [(200, None, "en", "s", 0, "x", 4), (201, "", None, None, None, None, None), (202, "12 34", "en", "s", 0, "x", 5), (None, said(50), "en", "s", 0, "x", 6), (None, said(50), "en", "s", 0, "x", 7)]
    rows += [(300, said(70), "en", "s", 0, "x", 8), (300, said(70), "en", "s", 0, "x", 9), (301, said(6000), "en", "s", 0, "x", 10), (5, rows[5][1], "en", "s", 0, "x", 5)]
    leak = said(15)
    rows += [(400, f"{said(30)} {leak} {said(30)}", "en", "s", 0, "x", 11)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, __kept int"
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for given in (rows, []):
        docs, seen = spark.createDataFrame(given, schema), []
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if i < len(corpus_pipeline.STAGES) - 1:
                assert sorted(out.columns) == sorted(docs.columns), name
            out.write.parquet(path := str(tmp_path / f"{len(given)}-{i}"))
            docs = spark.read.schema(out.schema).parquet(path)
            seen.append(sorted((x.doc_id if x.doc_id is not None else -1) for x in docs.select("doc_id").collect()))
        if not given:
            assert seen == [[]] * 5
            continue
        first = [x[0] if x[0] is not None else -1 for x in rows]
        assert seen[0] == sorted(x for x in first if x not in (200, 201, 202)) == seen[1]
        gone = set(seen[1]) - set(seen[2])
        assert gone == {100, 101} and seen[2].count(-1) == 2 and seen[2].count(300) == 1 and seen[2].count(5) == 1
        assert set(seen[2]) - set(seen[3]) == {400} and seen[4] == seen[3]
