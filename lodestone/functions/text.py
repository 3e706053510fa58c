"""String functions, Column to Column: cleaning, canonical forms, sentences, references, numbers, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DANGLING, HEADING_LABEL, PATTERN, SECTIONS, STOPWORDS


def matches(c: Column, name: str) -> Column:
    """Whether one of the named patterns occurs, without case; null is no match."""
    return F.coalesce(c.rlike("(?i)" + PATTERN[name]), F.lit(False))


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match, null where there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def clean_space(c: Column) -> Column:
    """White space to single blanks, trimmed; null is ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def clean_text(c: Column) -> Column:
    """Control characters and soft hyphens go, ligatures become letters, then clean_space."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0b-\x1f\x7f­]", " ")
    return clean_space(F.replace(F.replace(out, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")))


def canonical_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z0-9]+(?:\.[0-9]+)?)"), F.lit(1))


def canonical(c: Column) -> Column:
    """Lower-case words and numbers, joined by blanks: the key under which statements are equal."""
    return F.array_join(canonical_tokens(c), " ")


def word_set(c: Column) -> Column:
    """Distinct words without stopwords, in order of appearance."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z0-9][a-z0-9-]*)"), F.lit(1))
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in STOPWORDS]))


def sentences(c: Column) -> Column:
    """Trimmed non-empty sentences, cut after . ! ? before white space."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: s != "")


# Fixed value: how a statement states its confidence. The patterns inside the functions below are fixed values too: results depend on them.
CONFIDENCE = r"(?i)\s*(?:\((?:model\s+)?confidence[:\s]*\d{1,3}(?:\.\d+)?%?\)|(?:model\s+)?confidence[:\s]+\d{1,3}(?:\.\d+)?%|\(\d{1,3}(?:\.\d+)?%\))\s*"


def strip_confidence(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), CONFIDENCE, " "))


def strip_citations(c: Column) -> Column:
    """Leading reference numbers such as '4, 5 ' or '(7) ' before a capital, as often as they stand there."""
    one = r"[(\[{]?\s*\d{1,3}(?:\s*[-–]\s*\d{1,3})?(?:\s*[,;]\s*\d{1,3}(?:\s*[-–]\s*\d{1,3})?)*\s*[)\]}]?(?:\s*[,;:])?\s*"
    return F.regexp_replace(F.coalesce(c, F.lit("")), rf"^\s*(?:{one})+([A-Z])", "$1")


def strip_fallback_ids(c: Column) -> Column:
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\s*\(id:text-fallback-[^)]+\)\s*", " ")
    out = F.regexp_replace(out, r"(?i)\s*\[id:text-fallback-[^\]]+\]\s*", " ")
    return clean_space(F.regexp_replace(out, r"(?i)\bid:text-fallback-[a-z0-9_.:-]+\b", ""))


def statement_key(c: Column) -> Column:
    """The key of a displayed statement: without fallback ids, evidence in brackets and confidences."""
    return canonical(F.regexp_replace(strip_confidence(strip_fallback_ids(c)), r"\[[^\]]*\]", " "))


def strip_hedges(c: Column) -> Column:
    """Without 'the authors report that' and the like, capitalised."""
    out = F.regexp_replace(clean_space(c), r"(?i)^(?:the authors (?:report|state|note|describe)(?:ed|d)? that|we found that|it was found that|the study found that)\s+", "")
    return F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, F.lit(2), F.greatest(F.length(out) - 1, F.lit(0))))


def compact(c: Column, limit: int) -> Column:
    """The whole sentences that fit in limit; else up to the last clause mark in the last third; else all of it."""
    s = clean_space(c)
    kept = F.aggregate(
        sentences(s),
        F.struct(F.lit("").alias("text"), F.lit(True).alias("open")),
        lambda a, x: F.when(a["open"] & (F.length(a["text"]) + F.length(x) + F.when(a["text"] == "", 0).otherwise(1) <= limit), F.struct(F.concat(a["text"], F.when(a["text"] == "", "").otherwise(" "), x).alias("text"), F.lit(True).alias("open"))).otherwise(F.struct(a["text"].alias("text"), F.lit(False).alias("open"))),
        lambda a: a["text"],
    )
    head = F.substring(s, 1, limit)
    mark = F.greatest(*[F.lit(limit) - F.instr(F.reverse(head), m) + 1 - F.when(F.instr(head, m) == 0, limit + 1).otherwise(0) for m in (";", ":", ",")])
    clause = F.when(mark >= int(limit * 0.65), F.rtrim(F.substring(s, F.lit(1), (mark - 1).cast("int"))))
    return F.when(F.length(s) <= limit, s).otherwise(F.coalesce(F.nullif(kept, F.lit("")), clause, s))


def truncate_safely(c: Column, limit: int) -> Column:
    """At most limit characters, cut at the last sentence end in the last third, else at the last blank."""
    s = clean_space(c)
    head = F.substring(s, 1, limit)
    stop = F.lit(limit) - F.instr(F.reverse(head), ".") + 1
    blank = F.lit(limit) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, ".") > 0) & (stop >= int(limit * 0.65)), F.substring(head, F.lit(1), stop.cast("int"))).when(F.instr(head, " ") > 0, F.rtrim(F.substring(head, F.lit(1), blank.cast("int")))).otherwise(head)
    return F.when(F.length(s) <= limit, s).otherwise(cut)


def trim_dangling(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?i)(?:\s+(?:{'|'.join(DANGLING)}))+[\s,;:]*$", "")


def span_start(text: Column, excerpt: Column) -> Column:
    """0-based place of the excerpt without case, null where it isn't."""
    return F.nullif(F.instr(F.lower(text), F.lower(excerpt)), F.lit(0)) - 1


def human_ref(c: Column) -> Column:
    """f2 -> Figure 2, t3 -> Table 3, section:Results:4 -> Results (4); anything else as it is."""
    return (
        F.when(c.rlike(r"(?i)^f\d+[a-z]?$"), F.concat(F.lit("Figure "), F.upper(F.substring(c, 2, 16))))
        .when(c.rlike(r"(?i)^t\d+[a-z]?$"), F.concat(F.lit("Table "), F.upper(F.substring(c, 2, 16))))
        .when(c.rlike(r"(?i)^section:.*:\d+$"), F.concat(F.initcap(F.regexp_extract(c, r"(?i)^section:(.*?):+\d+$", 1)), F.lit(" ("), F.regexp_extract(c, r"(\d+)$", 1), F.lit(")")))
        .otherwise(c)
    )


def with_provenance(statement: Column, anchor: Column, refs: Column) -> Column:
    more = F.slice(F.array_except(refs, F.array(anchor)), 1, 3)
    return F.concat(statement, F.when(anchor != "", F.concat(F.lit(" ["), anchor, F.lit("]"))).otherwise(""), F.when(F.size(more) > 0, F.concat(F.lit(" (refs: "), F.array_join(more, ", "), F.lit(")"))).otherwise(""))


def bracket_refs(c: Column) -> Column:
    """Entries of all [a, b] brackets in order."""
    inside = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[([^\]]+)\]"), F.lit(1))
    return F.filter(F.transform(F.flatten(F.transform(inside, lambda x: F.split(x, ","))), lambda x: F.trim(x)), lambda x: x != "")


def lexical_section(c: Column, order: tuple[str, ...] = ("conclusion", "discussion", "introduction", "results", "methods"), lexicon: dict[str, str] = PATTERN) -> Column:
    """The first section of the order whose pattern occurs, else unknown. The lexicon is a parameter."""
    out = None
    for s in order:
        hit = F.coalesce(c.rlike("(?i)" + lexicon[s]), F.lit(False))
        out = F.when(hit, s) if out is None else out.when(hit, s)
    return out.otherwise("unknown")


def prefix_section(c: Column) -> Column:
    """The section that a 'Label:' at the beginning names, else ''."""
    return F.coalesce(F.element_at(_labels(), F.nullif(F.lower(F.regexp_extract(c, "(?i)" + PATTERN["statement_prefix"], 1)), F.lit(""))), F.lit(""))


def heading_section(c: Column) -> Column:
    """The section that a whole-line heading names, else ''."""
    return F.coalesce(F.element_at(_labels(), F.nullif(F.lower(F.regexp_replace(F.regexp_extract(c, "(?i)" + PATTERN["explicit_heading"], 1), r"\s+", " ")), F.lit(""))), F.lit(""))


def _labels() -> Column:
    return F.create_map(*[F.lit(x) for k, v in sorted(HEADING_LABEL.items()) for x in (k, v)])


def heading_style(level: Column, bold: Column, size_ratio: Column, words: Column, upper_share: Column) -> Column:
    """How much an item looks like a heading, 0 to 1."""
    score = (
        F.when(level.between(1, 2), 0.45).when(level.between(3, 4), 0.30).otherwise(0.0) + F.when(bold, 0.20).otherwise(0.0)
        + F.when(size_ratio >= 1.2, 0.20).when(size_ratio >= 1.05, 0.10).otherwise(0.0) + F.when(words <= 8, 0.10).otherwise(0.0) + F.when(upper_share >= 0.8, 0.05).otherwise(0.0)
    )
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def _ids(c: Column, name: str) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?i)" + PATTERN[name]), F.lit(1)), F.upper)


def ref_ranges(c: Column) -> Column:
    """Ids inside 'figure 2-4' and 'table S1-S3' ranges, which count for figures and tables alike."""
    s = F.coalesce(c, F.lit(""))
    begins = _ids(s, "ref_range")
    ends = F.transform(F.regexp_extract_all(s, F.lit("(?i)" + PATTERN["ref_range"]), F.lit(2)), F.upper)

    def inside(a: Column, b: Column) -> Column:
        mark = F.regexp_extract(a, "^(S?)", 1)
        x, y = F.regexp_extract(a, r"(\d+)", 1).try_cast("int"), F.regexp_extract(b, r"(\d+)", 1).try_cast("int")
        ok = x.isNotNull() & y.isNotNull() & (y >= x) & (y - x <= 50)
        return F.when(ok, F.transform(F.sequence(x, F.when(ok, y).otherwise(x)), lambda i: F.concat(mark, i.cast("string")))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.zip_with(begins, ends, inside))


def figure_refs(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(_ids(c, "figure_ref"), ref_ranges(c))))


def table_refs(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(_ids(c, "table_ref"), ref_ranges(c))))


def all_refs(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(_ids(c, "figure_ref"), _ids(c, "table_ref"), ref_ranges(c))))


def figure_token(c: Column) -> Column:
    """'Figure 02a' -> '2A', null where there is no number."""
    s = F.upper(F.coalesce(c, F.lit("")))
    n = F.regexp_extract(s, r"(S?)0*(\d+)([A-Z]?)\s*$", 2)
    return F.when(n != "", F.concat(F.regexp_extract(s, r"(S?)0*(\d+)([A-Z]?)\s*$", 1), n, F.regexp_extract(s, r"(S?)0*(\d+)([A-Z]?)\s*$", 3)))


NUMBER, P_VALUE, EFFECT = r"(-?\d+(?:\.\d+)?)\s*([a-zA-Z%]+)?", r"(?i)\bp\s*[=<]\s*(0?\.\d+|\d+)", r"(?i)\b(?:cohen'?s?\s*d|hedges'?g|or|rr)\s*[=:]?\s*(-?\d+(?:\.\d+)?)"


def first_number(c: Column) -> Column:
    return F.regexp_extract(c, NUMBER, 1).try_cast("double")


def first_unit(c: Column) -> Column:
    return first_match(c, NUMBER, 2)


def p_value(c: Column) -> Column:
    return F.regexp_extract(c, P_VALUE, 1).try_cast("double")


def effect_size(c: Column) -> Column:
    return F.regexp_extract(c, EFFECT, 1).try_cast("double")


def salvage_json(c: Column) -> Column:
    """The text of a fenced or surrounding {...} or [...], null where it is no JSON."""
    fenced = first_match(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    inside = first_match(F.coalesce(fenced, c), r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when(F.try_parse_json(inside).isNotNull(), inside)


def headed_section(c: Column, name: str) -> Column:
    """What stands after 'Name:' up to the next section's name."""
    others = "|".join(s.capitalize() for s in SECTIONS)
    return F.trim(F.coalesce(first_match(c, rf"(?s)(?:^|\s){name.capitalize()}:\s*(.*?)(?:\s(?:{others})s?:|$)", 1), F.lit("")))


def find_doi(c: Column) -> Column:
    return F.rtrim(first_match(c, "(?i)" + PATTERN["doi"]), F.lit(".,;)"))


def normal_url(c: Column) -> Column:
    """Scheme and host in lower case, without fragment and without a trailing slash."""
    host = F.lower(F.regexp_extract(c, r"^([A-Za-z]+://[^/?#]+)", 1))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z]+://[^/?#]+", ""), "#.*$", ""), "/+$", "")
    return F.when(host != "", F.concat(host, rest)).otherwise(c)


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z]+://([^/?#:]+)", 1))


def url_key(c: Column) -> Column:
    """Supplement addresses are told apart by path and query, others without query and fragment."""
    plain = F.regexp_replace(F.lower(c), "#.*$", "")
    return F.when(plain.rlike("suppl"), F.regexp_replace(plain, r"^[a-z]+://[^/?]+", "")).otherwise(F.regexp_replace(plain, r"\?.*$", ""))


def join_url(base: Column, link: Column) -> Column:
    """An absolute address from a page's and a link's."""
    root = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([A-Za-z]+://.*/)[^/]*$", 1)
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z]+:)", 1), link)).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(folder, link))


def file_name(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(c, r"[?#].*$", ""), r"([^/]*)$", 1)


def slug(c: Column, words: int = 8) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)), 1, words), "_")


def safe_stem(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")


def html_escape(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def friendly_error(c: Column) -> Column:
    """What a user is told about a failure."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(low.contains("timeout") | low.contains("timed out"), "The source took too long to answer.").when(low.contains("404") | low.contains("not found"), "The source was not found.")
        .when(low.contains("403") | low.contains("forbidden"), "The source refused access.").when(low.contains("no main"), "No readable main document was found.").otherwise("Processing failed.")
    )


def category_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def abstract_parts(c: Column) -> Column:
    """array<struct<label, text>> of a structured abstract; one part without a label where it has none."""
    label = r"(?i)\b(?:objectives?|background|aims?|methods?|design|results|conclusions?)\s*:"
    labels = F.transform(F.regexp_extract_all(c, F.lit(r"(?i)\b(objectives?|background|aims?|methods?|design|results|conclusions?)\s*:"), F.lit(1)), F.lower)
    texts = F.transform(F.slice(F.split(c, label), F.lit(2), F.greatest(F.size(labels), F.lit(0))), lambda x: F.trim(x))
    parts = F.zip_with(labels, texts, lambda a, b: F.struct(a.alias("label"), b.alias("text")))
    return F.when(F.size(labels) > 0, F.filter(parts, lambda p: p["text"] != "")).otherwise(F.array(F.struct(F.lit("").alias("label"), clean_space(c).alias("text"))))
