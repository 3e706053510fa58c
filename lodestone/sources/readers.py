"""Readers: files of all kinds into chunks. Spark reads; Python parses only what needs a parser, a batch at a time."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import predicates as P
from ..functions import text as X
from ..operators import ordered as O
from ..schemas import EVENT, TABLE_CONTENT


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, kind, content) of binary files; kind by name, else by the first bytes."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    named = raw.select("path", X.file_name(F.col("path")).alias("name"), "content")
    return named.withColumn("kind", F.coalesce(F.nullif(P.asset_kind(F.col("name")), F.lit("")), sniff(F.col("content"))))


def sniff(content: Column) -> Column:
    """Kind by magic bytes; text if nearly all of the first 4096 bytes are printable."""
    head = F.substring(content, 1, 8)
    start = F.hex(head)
    latin = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    printable = F.regexp_count(latin, F.lit(r"[\t\n\r\x20-\x7E\xA0-\xFF]")) / F.greatest(F.length(latin), F.lit(1))
    return (
        F.when(start.startswith("255044462D"), "pdf").when(start.startswith("504B0304"), "archive").when(start.startswith("89504E47") | start.startswith("FFD8FF") | start.startswith("47494638"), "image")
        .when(F.lower(latin).rlike(r"^\s*(?:<!doctype html|<html)"), "html").when(printable >= 0.92, "text").otherwise("")
    )


def text_chunks(rows: DataFrame) -> DataFrame:
    """(path, anchor, modality, content): one chunk a text file."""
    return rows.where("kind = 'text'").select("path", F.concat(F.lit("file:"), "name").alias("anchor"), F.lit("text").alias("modality"), F.decode("content", "UTF-8").alias("content"))


def table_chunk(rows: DataFrame, columns: list[str], keys: list[str], order: str, anchor: Column) -> DataFrame:
    """A table's rows as one chunk of {columns, data} JSON a key."""
    cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    data = F.transform(F.array_sort(F.collect_list(F.struct(order, cells.alias("cells")))), lambda r: r["cells"])
    return rows.groupBy(*keys).agg(F.to_json(F.struct(F.array(*[F.lit(c) for c in columns]).alias("columns"), data.alias("data"))).alias("content")).withColumn("anchor", anchor).withColumn("modality", F.lit("table"))


def delimited(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    return spark.read.csv(path, sep=separator, header=True, inferSchema=False)


SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheets(content: bytes) -> list[tuple[str, list[str], list[list[str]]]]:
    """(name, header, rows) of every sheet of a workbook; cells keep their columns, gaps are empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")] if "xl/sharedStrings.xml" in names else []
        links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{SHEET}sheet"):
            target = links[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
            rows = []
            for row in ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{SHEET}row"):
                cells: list[str] = []
                for c in row.iter(f"{SHEET}c"):
                    letters = "".join(x for x in c.get("r", "") if x.isalpha())
                    at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else len(cells)
                    value = "".join(t.text or "" for t in c.iter(f"{SHEET}t")) if c.get("t") == "inlineStr" else (c.findtext(f"{SHEET}v") or "")
                    cells += [""] * (at - len(cells)) + [shared[int(value)] if c.get("t") == "s" and value else value]
                rows.append(cells)
            header = rows[0] if rows else []
            out.append((sheet.get("name", ""), header, [[*r, *[""] * (len(header) - len(r))][: len(header)] for r in rows[1:]]))
        return out


def spreadsheets(rows: DataFrame) -> DataFrame:
    """(path, anchor, modality, content): a table chunk a sheet of workbooks (path, content); what is no workbook gives none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    sheets = _sheets(bytes(content or b""))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, StopIteration):
                    continue
                out += [(path, f"sheet:{name}", "table", json.dumps({"columns": header, "data": data}, ensure_ascii=False, separators=(",", ":"))) for name, header, data in sheets]
            yield pd.DataFrame(out, columns=["path", "anchor", "modality", "content"])

    return rows.select("path", "content").mapInPandas(parse, "path string, anchor string, modality string, content string")


def table_cells(chunks: DataFrame) -> DataFrame:
    """(anchor, row, column, value) of table chunks; ragged rows are padded, surplus cells dropped."""
    t = chunks.select("anchor", F.from_json("content", TABLE_CONTENT).alias("t")).where("t.columns is not null")
    rows = t.select("anchor", "t.columns", F.posexplode("t.data").alias("row", "cells"))
    each = rows.select("anchor", "row", F.posexplode("columns").alias("i", "column"), "cells")
    return each.select("anchor", "row", "column", F.coalesce(F.try_element_at("cells", F.col("i") + 1), F.lit("")).alias("value"))


class PageParts(HTMLParser):
    """Paragraphs, figures, tables and links of one page, in order."""

    HEADINGS = ("h1", "h2", "h3", "h4")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.drop, self.tag, self.held, self.heading, self.link, self.figure, self.table, self.cell = 0, "", [], ("", 0), None, None, None, None

    def add(self, kind: str, text: str, **more) -> None:
        self.rows.append({"ord": len(self.rows), "kind": kind, "tag": self.tag, "text": " ".join(text.split()), "heading": self.heading[0], "level": self.heading[1], "url": "", "extra": ""} | more)

    def flush(self) -> None:
        said = " ".join("".join(self.held).split())
        if self.tag in self.HEADINGS and said:
            self.heading = (said, int(self.tag[1]))
            self.add("heading", said)
        elif self.tag in ("p", "li") and said:
            self.add("paragraph", said)
        self.tag, self.held = "", []

    def handle_starttag(self, tag, attributes):
        a = {k: v or "" for k, v in attributes}
        if tag in ("script", "style", "noscript", "template", "svg"):
            self.drop += 1
        elif tag in ("p", "li", *self.HEADINGS):
            self.flush()
            self.tag = tag
        elif tag == "a" and a.get("href"):
            self.link = [a["href"], []]
        elif tag == "figure":
            self.figure = {"url": "", "alt": "", "caption": []}
        elif tag == "img" and a.get("src"):
            if self.figure is not None:
                self.figure |= {"url": a["src"], "alt": a.get("alt", "")}
            else:
                self.add("image", a.get("alt", ""), url=a["src"])
        elif tag == "figcaption" and self.figure is not None:
            self.tag = "figcaption"
        elif tag == "table":
            self.table = []
        elif tag == "tr" and self.table is not None:
            self.close_cell()
            self.table.append([])
        elif tag in ("td", "th") and self.table:
            self.close_cell()
            self.cell = [tag, []]

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript", "template", "svg"):
            self.drop = max(0, self.drop - 1)
        elif tag in ("p", "li", "article", "main", "body", *self.HEADINGS):
            self.flush()
        elif tag == "a" and self.link:
            self.add("link", "".join(self.link[1]), url=self.link[0])
            self.link = None
        elif tag == "figure" and self.figure:
            self.add("figure", "".join(self.figure["caption"]) or self.figure["alt"], url=self.figure["url"])
            self.figure, self.tag = None, ""
        elif tag in ("td", "th", "tr"):
            self.close_cell()
        elif tag == "table" and self.table is not None:
            self.close_cell()
            self._table()

    def close_cell(self) -> None:
        if self.cell and self.table:
            self.table[-1].append((self.cell[0], " ".join("".join(self.cell[1]).split())))
        self.cell = None

    def _table(self) -> None:
        rows = [r for r in self.table if r]
        self.table = None
        if rows:
            head = [x for _, x in rows[0]] if any(k == "th" for k, _ in rows[0]) else []
            body = rows[1:] if head else rows
            width = len(head) or max(len(r) for r in body)
            names = head or [f"col_{i + 1}" for i in range(width)]
            data = [([x for _, x in r] + [""] * width)[:width] for r in body]
            self.add("table", "", extra=json.dumps({"columns": names, "data": data}))

    def handle_data(self, data):
        if self.drop:
            return
        if self.cell is not None:
            self.cell[1].append(data)
        elif self.figure is not None and self.tag == "figcaption":
            self.figure["caption"].append(data)
        elif self.tag:
            self.held.append(data)
        if self.link:
            self.link[1].append(data)


PARTS = "page_id long, ord int, kind string, tag string, text string, heading string, level int, url string, extra string"


def page_parts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, ord, kind, tag, text, heading, level, url, extra) of every page's parts. Null html has none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, page in zip(pdf["page_id"], pdf["html"], strict=True):
                parser = PageParts()
                parser.feed(page or "")
                parser.close()
                parser.flush()
                out += [{"page_id": key, **r} for r in parser.rows]
            yield pd.DataFrame(out, columns=["page_id", "ord", "kind", "tag", "text", "heading", "level", "url", "extra"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInPandas(parse, PARTS)


def paragraph_chunks(parts: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Paragraphs of at least min_paragraph characters, first of equals, structured abstracts split, numbered, up to max_chunks a page."""
    rows = parts.where((F.col("kind") == "paragraph") & (F.length("text") >= config.min_paragraph))
    once = O.first_wins(rows.withColumn("__k", F.lower("text")), ["page_id", "__k"], [F.col("ord")]).drop("__k")
    split = once.select("page_id", "ord", "heading", "level", F.posexplode(X.abstract_parts(F.col("text"))).alias("part", "p"))
    w = Window.partitionBy("page_id").orderBy("ord", "part")
    numbered = split.withColumn("n", F.row_number().over(w)).where(F.col("n") <= config.max_chunks)
    section = F.coalesce(F.nullif(X.heading_section(F.concat("p.label", F.lit(":"))), F.lit("")), F.nullif(X.heading_section(F.col("heading")), F.lit("")), F.lit("unknown"))
    return numbered.select("page_id", F.concat(F.lit("html:para:"), F.col("n")).alias("anchor"), F.lit("text").alias("modality"), F.col("p.text").alias("content"), "heading", section.alias("section_norm"), F.col("n").alias("paragraph_index"))


def media_links(parts: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, modality, href, text) of links that lead to figures or tables, once each, absolute."""
    links = parts.where("kind = 'link'").join(pages.select("page_id", F.col("url").alias("base")), "page_id")
    href = X.join_url(F.col("base"), F.col("url"))
    said = F.lower(F.concat_ws(" ", "url", "text"))
    modality = F.when(said.rlike(r"\b(?:figure|fig)\b|/f\d+"), "figure").when(said.rlike(r"\btables?\b|/t\d+"), "table")
    return O.first_wins(links.select("page_id", "ord", modality.alias("modality"), href.alias("href"), "text").where("modality is not null"), ["page_id", "modality", "href"], [F.col("ord")]).drop("ord")


def supplement_links(parts: DataFrame, pages: DataFrame, most: int = 10) -> DataFrame:
    """(page_id, rank, href): links whose address or words name a supplement, absolute, once each, the first `most` of a page in its order."""
    links = parts.where("kind = 'link'").join(pages.select("page_id", F.col("url").alias("base")), "page_id")
    named = links.where(P.names_supplement(F.concat_ws(" ", "url", "text"))).withColumn("href", X.join_url(F.col("base"), F.col("url")))
    once = O.first_wins(named.select("page_id", "ord", "href"), ["page_id", "href"], [F.col("ord")])
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("ord")))
    return ranked.where(F.col("rank") <= most).select("page_id", "rank", "href")


def readable_text(c: Column) -> Column:
    """Text of a page by patterns alone: without scripts and styles, a line a block, at most two line ends in a row."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style|noscript|template|svg)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<(?:br|/p|/li|/h[1-6]|/div|/tr|p|li|h[1-6]|div|tr)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\s*\n\s*\n\s*\n+", "\n\n"))


def archive_members(rows: DataFrame) -> DataFrame:
    """(path, name, kind, content) of the members of archives; names that leave the archive and broken archives give none."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        out += [(path, m.filename, z.read(m)) for m in z.infolist() if not m.is_dir()]
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError):
                    continue
            yield pd.DataFrame(out, columns=["path", "member", "content"])

    members = rows.where("kind = 'archive'").select("path", "content").mapInPandas(unpack, "path string, member string, content binary")
    safe = members.withColumn("member", P.safe_member(F.col("member"))).where("member <> ''")
    return safe.select(F.concat("path", F.lit("!"), "member").alias("path"), X.file_name(F.col("member")).alias("name"), F.coalesce(F.nullif(P.asset_kind(F.col("member")), F.lit("")), sniff(F.col("content"))).alias("kind"), "content")


def event_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Events of JSON lines; malformed ones are left out."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(EVENT).option("mode", "DROPMALFORMED").json(path)


def reference_points(lines: DataFrame) -> DataFrame:
    """(file, section, ord, text) from markdown lines (file, n, line): '# SECTION' headers, bullets, and lines that go on with the last bullet. ord counts a file's bullets."""
    header = F.nullif(F.regexp_extract("line", r"^#\s*([A-Z][A-Z ]+)\s*$", 1), F.lit(""))
    bullet = F.nullif(F.regexp_extract("line", r"^\s*(?:[-*]\s+|\d+\.\s+)(.+?)\s*$", 1), F.lit(""))
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("section", F.lower(F.last(header, ignorenulls=True).over(w))).withColumn("is_bullet", bullet.isNotNull()).withColumn("said", F.coalesce(bullet, F.when(header.isNull(), F.nullif(F.trim("line"), F.lit("")))))
    rows = rows.withColumn("ord", F.sum(F.when(F.col("is_bullet"), 1).otherwise(0)).over(w)).where("said is not null and section is not null and ord > 0")
    return rows.groupBy("file", "section", "ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "said"))), lambda x: x["said"]), " ").alias("text"))


def xml_paragraphs(rows: DataFrame, xml_col: str = "xml") -> DataFrame:
    """(id, title, authors, paragraphs) of well-formed TEI by paths; broken XML gives nulls through the caller's filter."""
    return rows.select(
        "id", F.expr(f"xpath_string({xml_col}, '//titleStmt/title')").alias("title"), F.expr(f"xpath({xml_col}, '//author/persName/surname/text()')").alias("authors"), F.expr(f"xpath({xml_col}, '//body//p/text()')").alias("paragraphs"),
    )


TEI_BODY = "text STRUCT<body: STRUCT<div: ARRAY<STRUCT<head: STRING, p: ARRAY<STRING>>>>>"


def tei_paragraphs(rows: DataFrame, xml_col: str = "xml", least: int = 1) -> DataFrame:
    """(id, n, section, content) of the paragraphs of TEI, in order; a part whose head names no section goes on with the one before. Broken XML gives none."""
    body = F.from_xml(xml_col, TEI_BODY, {"rowTag": "TEI", "mode": "PERMISSIVE"})["text"]["body"]["div"]
    parts = rows.select("id", F.posexplode(body).alias("part", "d"))
    own = F.nullif(X.heading_section(F.coalesce("d.head", F.lit(""))), F.lit(""))
    named = parts.withColumn("section", F.coalesce(O.carry_forward(own, ["id"], [F.col("part")]), F.lit("unknown")))
    each = named.select("id", "part", "section", F.posexplode("d.p").alias("i", "content")).withColumn("content", X.clean_space(F.col("content"))).where(F.length("content") >= least)
    return each.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("part", "i"))).select("id", "n", "section", "content")


def page_line_paragraphs(lines: DataFrame, least: int = 40) -> DataFrame:
    """(doc, n, section, content) from the lines (doc, page, n, line) of pages: headings and empty lines part paragraphs, which go on over pages; short ones are noise."""
    order = [F.col("page"), F.col("n")]
    said = X.clean_space(F.col("line"))
    is_head = (X.heading_section(said) != "") & P.is_heading_line(said)
    rows = lines.select("doc", "page", "n", said.alias("said"), is_head.alias("is_head"))
    section = O.carry_forward(F.when(F.col("is_head"), X.heading_section(F.col("said"))), ["doc"], order)
    block = F.sum(((F.col("said") == "") | F.col("is_head")).cast("int")).over(Window.partitionBy("doc").orderBy(*order))
    parted = rows.withColumn("section", F.coalesce(section, F.lit("unknown"))).withColumn("block", block).where("said <> '' and not is_head")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "n", "said"))), lambda x: x["said"]), " ")
    whole = parted.groupBy("doc", "block", "section").agg(text.alias("content")).where(F.length("content") >= least)
    return whole.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("block"))).select("doc", "n", "section", "content")


def item_stream(items: DataFrame) -> DataFrame:
    """Layout items (doc, idx, type, text) with the section that the last heading before them names."""
    heading = F.when((F.col("type") == "heading") | P.is_heading_line(F.col("text")), F.struct(F.col("text").alias("title"), X.heading_section(F.col("text")).alias("section")))
    current = O.carry_forward(heading, ["doc"], [F.col("idx")])
    return items.select("doc", "idx", "type", "text", current["title"].alias("heading"), F.coalesce(F.nullif(current["section"], F.lit("")), F.lit("unknown")).alias("section"))


def first_meta(chunks: DataFrame) -> DataFrame:
    """The first meta chunk of each document that is JSON."""
    ok = chunks.where("modality = 'meta'").where(F.try_parse_json("content").isNotNull())
    return ok.groupBy("document_id").agg(F.min_by("content", "id").alias("meta"))
