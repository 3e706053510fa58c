"""HTML extraction with site template removal.

Pass one walks every page and gives each container element a hash of its subtree (tag, class, texts, children) and of its
parent's. Spark counts, for each host, under how many different parents a subtree stands; counting
parents and not pages keeps whole copies of an article from looking like a template. Subtrees under at least min_parents
parents of a host are its templates. Pass two walks the pages again with the hashes to delete, drops what by tag or role
is a menu, header, footer, sidebar, notice, advert, form, script, style or comment, and returns the text of the articles
(else of the main element, else of the body). What recurs nowhere, as comments and single adverts, is known by class and id: by a
whole name such as `comments` or `sidebar-box`, each part of which names boilerplate or a place, never by a part of another name
(`has-sidebar`, `share-price`). Such an element goes only if it holds no article or main element; one that does is a wrapper, whose
articles are taken where the page has no article or main text outside such wrappers.

Headings and paragraphs of an article, articles themselves and what holds them are never templates. A paragraph outside
any article counts as one only from MIN_TEMPLATE_CHARS code points on. Walking is a loop over tags with a stack, so
deep pages cost no recursion; a page is the largest unit held.

Text: character references decoded, white space inside a block to one blank, trimmed, blocks joined in page order by a
blank line; `br` is white space. Defined results: null html is an empty page with text ''; a null or odd url has the
host ''; rows that repeat a page_id share deletions; an empty table gives no rows; other columns are carried along
by extract_pages.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_KEYS, discard, written
from .textnum import with_columns

MIN_PARENTS = 5
MIN_TEMPLATE_CHARS = 40

# Fixed values of HTML: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
DROP = frozenset("script style xmp iframe noembed noframes textarea title noscript template svg math nav footer aside form button select option input datalist menu dialog object embed canvas audio video map head".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li listing main menu nav ol option p plaintext pre search section select summary table tbody td tfoot th thead tr ul xmp caption head".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINER = frozenset("div section ul ol dl table aside nav header footer form fieldset menu center figure details blockquote".split())
NAMED = CONTAINER | frozenset("p span li a td tr tbody summary hgroup".split())
#: What an opening tag closes, up to the nearest element in SCOPE.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select", "datalist"}, "tbody": {"table"}, "tfoot": {"table"}}
P_SCOPE = frozenset("table td th caption button object html body article main section div li dd dt blockquote".split())

# Words in class and id, and roles, that name boilerplate.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer gdpr header "
    "login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended recommendations related replies "
    "reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Words that may stand beside one of NAMES in a class or id.
PLACES = frozenset("area articles bar block body button buttons bottom box column container entry form global group inline inner icons item items left link links list main media meta mobile module more news outer panel posts primary reader readers right row secondary section site slot social stories thread top unit user users wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())

TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S
)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/\"']|$)", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
M64 = (1 << 64) - 1


def text_hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


_TAG_HASHES: dict[str, int] = {}


def names_boilerplate(name: str) -> bool:
    """Whether a whole class or id says so: one of NAMES, beside others of them or PLACES at most."""
    words = {w.lower() for w in PARTS.findall(name)}
    return not NAMES.isdisjoint(words) and words <= NAMES | PLACES | {w for w in words if w.isdigit()}


def marked_boilerplate(tag: str, attributes: str) -> tuple[bool, bool, str]:
    """(whether role or state say that it is none of the text, whether class or id name boilerplate, the class and id)."""
    hidden, named, names = False, False, []
    for m in ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or "").strip("\"'")
        if kind in ("class", "id"):
            names.append(value)
            if tag in NAMED:
                named = named or any(map(names_boilerplate, value.split()))
            elif tag == "article":
                hidden = hidden or not {"comment", "reply", "related", "promo", "ad", "advert"}.isdisjoint(w.lower() for w in value.split())
        elif kind == "role":
            hidden = hidden or value.lower() in ROLES
        elif kind == "style":
            hidden = hidden or HIDDEN.search(value) is not None
        elif kind == "hidden" or value.lower() == "true":
            hidden = True
    return hidden and tag not in ("html", "body", "main"), named, " ".join(names)


BREAK = None


class Walk:
    """One pass over a page. subtrees: (hash, parent's hash) of candidates; text(): the main text without the subtrees in drops."""

    def __init__(self, page: str, drops: frozenset[int] = frozenset()):
        self.out: list[str | None] = []  # pieces of text; None parts blocks
        self.regions: dict[str, list[tuple[int, int, bool]]] = {"article": [], "main": []}  # with whether a named wrapper is around it
        self.named: list[tuple[int, int, bool]] = []  # what class or id name, with whether it holds an article
        self.found: list[list] = []  # [hash, index of the parent's record]
        self.hashes: list[int] = []  # of closed elements by number
        self.drops = drops
        # of an open element: tag, number, hash so far, skipped, first piece, code points, whether it holds an article, region, only headings, inside (1 article, 2 main, 4 named), whether it is named
        self.stack: list[list] = [["#", 0, 1, False, 0, 0, False, None, False, 0, False]]
        self.numbers = 1
        self.parents: list[int] = [0]
        self._run(page)

    def _run(self, page: str) -> None:
        place, size = 0, len(page)
        search = TAG.search
        while place < size:
            m = search(page, place)
            stop = m.start() if m else size
            if stop > place:
                self._text(page[place:stop])
            if not m:
                break
            place = m.end()
            tag = m[2] or m[5]
            if tag is None:
                if m[0].startswith("<![CDATA["):
                    self._text(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                self._close(tag)
                continue
            attributes = m[3] or m[6] or ""
            self._open(tag, attributes)
            if tag in RAW and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, place)
                stop = end.start() if end else size
                if stop > place:
                    self._text(page[place:stop])
                place = stop
        while len(self.stack) > 1:
            self._pop()

    def _text(self, s: str) -> None:
        top = self.stack[-1]
        if not s.isspace():
            top[2] = (top[2] * 1099511628211 + text_hash(s)) & M64
            top[5] += len(s)
        if not top[3] and (not top[8] or any(e[0] in HEADING for e in self.stack[-4:])):
            self.out.append(s)

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCK and tag not in ("html", "body", "head"):
            self._close_implied({"p"}, P_SCOPE)
        if tag in CLOSES:
            self._close_implied(CLOSES[tag], SCOPE[tag])
        top = self.stack[-1]
        if tag in VOID:
            top[2] = (top[2] * 1099511628211 + _tag_hash(tag)) & M64
            if not top[3]:
                self.out.append(BREAK if tag == "hr" else " " if tag == "br" else "")
            return
        bad, named, names = marked_boilerplate(tag, attributes) if attributes else (False, False, "")
        skipped = top[3] or bad or tag in DROP
        inside = top[9] & 1
        heads = top[8]
        if tag == "header" and not skipped:
            skipped, heads = not inside, heads or bool(inside)
        if tag in BLOCK:
            self.out.append(BREAK)
        region = tag if tag in self.regions and not skipped else None
        named = named and not skipped
        self.stack.append([tag, self.numbers, (_tag_hash(tag) * 31 + (text_hash(names) if names else 7)) & M64, skipped, len(self.out), 0, False, region, heads, top[9] | {"article": 1, "main": 2}.get(tag, 0) | 4 * named, named])
        self.parents.append(top[1])
        self.numbers += 1
        if attributes.endswith("/") and tag in ("svg", "math", "path"):
            self._pop()

    def _close_implied(self, tags: set[str], scope) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in tags:
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i][0] in scope:
                return

    def _close(self, tag: str) -> None:
        if tag == "br":
            self._open("br", "")
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                while len(self.stack) > i:
                    self._pop()
                return
            if tag not in BLOCK and self.stack[i][0] in BLOCK:
                return  # formatting isn't closed across a block
            if tag in ("p", "li") and self.stack[i][0] in P_SCOPE and self.stack[i][0] != "li":
                return

    def _pop(self) -> None:
        tag, number, h, skipped, first, chars, holds, region, _, inside, named = self.stack.pop()
        top = self.stack[-1]
        top[2] = (top[2] * 1099511628211 + h) & M64
        top[5] += chars
        top[6] = top[6] or holds or region is not None
        if chars and not holds and (tag in CONTAINER or (tag in ("p", "li", "span") and chars >= MIN_TEMPLATE_CHARS and not top[9] & 3)):
            self.found.append([h, number])
            if h in self.drops:
                del self.out[first:]
                while self.named and self.named[-1][0] >= first:
                    self.named.pop()
        if region is not None:
            self.regions[region].append((first, len(self.out), bool(inside & 4)))
        if named:
            self.named.append((first, len(self.out), holds))
        if tag in BLOCK:
            self.out.append(BREAK)
        while len(self.hashes) <= number:
            self.hashes.append(0)
        self.hashes[number] = h

    def subtrees(self) -> set[tuple[int, int]]:
        self.hashes += [0] * (self.numbers - len(self.hashes))
        self.hashes[0] = self.stack[0][2]
        return {(h, self.hashes[self.parents[number]]) for h, number in self.found}

    def _between(self, a: int, b: int, wrappers: bool) -> list[str | None]:
        """The pieces from a to b without what is named; wrappers: nor named elements that hold articles, if they begin there."""
        out, at = [BREAK], a
        for x, y, holds in sorted(self.named, key=lambda n: (n[0], -n[1])):
            if x >= at and y <= b and (wrappers or not holds):
                out += self.out[at:x]
                at = y
        return [*out, *self.out[at:b], BREAK]

    def text(self) -> str:
        for wrapped in (False, True):
            for kind in ("article", "main"):
                spans: list[tuple[int, int]] = []
                for a, b, inside in sorted(self.regions[kind], key=lambda x: (x[0], -x[1])):
                    if b > a and inside == wrapped and (not spans or a >= spans[-1][1]):  # not inside another
                        spans.append((a, b))
                found = blocks_of([p for a, b in spans for p in self._between(a, b, not wrapped)])
                if found:
                    return found
        return blocks_of(self._between(0, len(self.out), False))


def _tag_hash(tag: str) -> int:
    h = _TAG_HASHES.get(tag)
    if h is None:
        h = text_hash("<" + tag)
        if len(_TAG_HASHES) < 1000:
            _TAG_HASHES[tag] = h
    return h


def blocks_of(pieces: list[str | None]) -> str:
    out, held = [], []
    for p in (*pieces, BREAK):
        if p is not BREAK:
            held.append(entities.unescape(p) if "&" in p else p)
        elif held:
            block = " ".join("".join(held).split())
            if block:
                out.append(block)
            held = []
    return "\n\n".join(out)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def page_subtrees(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page, host, hash, parent) of every candidate subtree, once a page and parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, host_of(u), h, p) for i, u, page in zip(*(c.to_pylist() for c in batch.columns), strict=True) if page for h, p in Walk(page).subtrees()]
            columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            signed = [[x - (1 << 64) if x >> 63 else x for x in columns[k]] for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.string()), pa.array(signed[0], pa.int64()), pa.array(signed[1], pa.int64())], names=["page", "host", "hash", "parent"])

    schema = T.StructType([T.StructField("page", pages.schema[id_col].dataType), T.StructField("host", T.StringType()), T.StructField("hash", T.LongType()), T.StructField("parent", T.LongType())])
    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", out_col: str = "text", min_parents: int = MIN_PARENTS) -> DataFrame:
    """pages with out_col, the main text."""
    pages = pages.drop("__page", "__drops")
    found = written(page_subtrees(pages, id_col, url_col, html_col), "html-subtrees")
    known = found.groupBy("host", "hash", "parent").agg(F.count(F.lit(1)).alias("n")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("parents"), F.sum("n").alias("n"))
    known = written(known.where(F.col("parents") >= min_parents).select("host", "hash", "n"), "html-templates")
    limit = max(1, found.count() // HOT_KEYS)
    hot = F.broadcast(known.where(F.col("n") > limit).select("host", "hash"))  # fewer than HOT_KEYS rows
    own = found.join(hot, ["host", "hash"], "left_semi").unionByName(found.join(hot, ["host", "hash"], "left_anti").join(known.select("host", "hash"), ["host", "hash"], "left_semi"))
    drops = written(own.groupBy(F.col("page").alias("__page")).agg(F.collect_set("hash").alias("__drops")), "html-drops")
    discard(found, known)
    joined = pages.join(drops.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("__page")), "left").drop("__page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Walk(page or "", frozenset(x & M64 for x in drop or ())).text() for page, drop in zip(batch.column(html_col).to_pylist(), batch.column("__drops").to_pylist(), strict=True)]
            plain = pa.RecordBatch.from_arrays([c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "__drops"], names=[n for n in batch.schema.names if n != "__drops"])
            yield with_columns(plain, **{out_col: pa.array(texts, pa.string())})

    schema = T.StructType([*[f for f in pages.schema.fields if f.name != out_col], T.StructField(out_col, T.StringType())])
    return joined.mapInArrow(run, schema)


def main_text(pages: DataFrame) -> DataFrame:
    out = extract_pages(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
