"""Boolean columns over statements, chunks, links and names. Null text matches nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EXTENSIONS, PDF_HINTS, SHORT_TAILS, SUPPLEMENT_WORDS
from .text import clean_space, matches


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def upper_share(c: Column) -> Column:
    """Upper-case letters over letters, 0 without letters."""
    letters = F.regexp_count(text(c), F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(text(c), F.lit(r"\p{Lu}")) / letters).otherwise(0.0)


def digit_share(c: Column) -> Column:
    return F.when(F.length(text(c)) > 0, F.regexp_count(text(c), F.lit(r"[0-9]")) / F.length(text(c))).otherwise(0.0)


def is_noise(c: Column) -> Column:
    """Empty, formula rests, journal boilerplate, bare numbers, or nearly all capitals."""
    s = clean_space(c)
    return (s == "") | s.contains("$^{") | matches(s, "boilerplate") | s.rlike(r"^[0-9\s.,;:%()-]+$") | ((F.length(s) >= 16) & (upper_share(s) > 0.85))


def is_layout_artifact(c: Column) -> Column:
    s = clean_space(c)
    directions = F.regexp_count(F.lower(s), F.lit(r"\b(left|right|anterior|posterior|superior|inferior)\b"))
    return matches(s, "layout_artifact") | ((directions >= 2) & s.rlike(r"(?i)\bpanel\b")) | (s.rlike(r"(?i)^figure\b") & (directions >= 1))


def is_noisy_sentence(c: Column) -> Column:
    """What an evaluation leaves out: runs of numbers, tables, references, headers."""
    s = clean_space(c)
    share = digit_share(s)
    return (s == "") | s.rlike(r"(?:\d+(?:\.\d+)?\s+){6,}\d+(?:\.\d+)?") | ((share > 0.34) & matches(s, "table_noise")) | ((share > 0.42) & (F.length(s) > 220)) | (matches(s, "reference_noise") & (F.length(s) < 180))


def looks_supplementary(anchor: Column, meta: Column, content: Column) -> Column:
    return matches(F.concat_ws(" ", anchor, meta, content), "supplement")


def is_supplementary_media(url: Column, caption: Column, anchor: Column) -> Column:
    return matches(F.concat_ws(" ", caption, anchor), "supplement_media") | text(url).rlike(r"(?i)suppl|/s\d+[./]")


def is_result_statement(c: Column) -> Column:
    """Concrete or telling, and neither a method nor the description of a picture unless it is concrete."""
    concrete, high = matches(c, "concrete_result"), matches(c, "high_signal")
    return ~matches(c, "visual_annotation") & (concrete | ~(matches(c, "method_like") | matches(c, "generic_visual"))) & (concrete | high)


def is_result_media(c: Column) -> Column:
    return matches(c, "concrete_result") & ~matches(c, "method_like")


def is_fragment(c: Column) -> Column:
    s = clean_space(c)
    subject = F.substring(s, 1, 80).rlike(r"(?i)\b(we|they|it|this|these|the|patients|participants|results|study)\b")
    return ((F.length(s) >= 36) & matches(s, "fragment_start") & ~subject) | s.rlike(r"^[\])}]") | ((F.length(s) < 60) & s.rlike(r"(?:\.\.\.|…)\s*$"))


def is_incomplete(c: Column) -> Column:
    s = clean_space(c)
    tail = F.lower(F.regexp_extract(s, r"([A-Za-z0-9'-]+)[.!?)\s]*$", 1))
    from ..config import DANGLING

    return (
        (s == "") | s.rlike(r"(?:\.\.\.|…)\s*$") | s.rlike(r"[,;:(\[-]\s*$") | (F.regexp_count(s, F.lit(r"\(")) > F.regexp_count(s, F.lit(r"\)"))) | tail.isin(*DANGLING)
        | ((F.length(s) >= 110) & (F.length(tail).between(1, 3)) & ~s.rlike(r"[.!?)]$") & ~tail.isin(*SHORT_TAILS))
    )


def passes_fidelity(section: Column, c: Column) -> Column:
    """Whether a statement may stand in a section."""
    concrete, method = matches(c, "concrete_result"), matches(c, "method_like")
    return (
        F.when(is_noise(c) | is_incomplete(c), False)
        .when(section == "introduction", ~concrete & ~method)
        .when(section == "methods", method | ~concrete)
        .when(section == "results", is_result_statement(c))
        .when(section == "discussion", ~method)
        .when(section == "conclusion", ~method & ~matches(c, "generic_visual"))
        .otherwise(False)
    )


def keeps_packet(statement: Column, refs: Column, flags: Column, confidence: Column) -> Column:
    """Has references that exist, is no noise, and no doubtful claim of absence."""
    return (F.size(F.coalesce(refs, F.array().cast("array<string>"))) > 0) & ~F.coalesce(F.array_contains(flags, "missing_evidence"), F.lit(False)) & ~is_noise(statement) & ~(matches(statement, "absence") & (confidence < 0.6))


def is_author_name(c: Column) -> Column:
    s = F.regexp_replace(clean_space(c), r"^[,;:.\s-]+|[,;:.\s-]+$", "")
    words = F.size(F.split(s, r"\s+"))
    return (F.length(s).between(3, 96)) & words.between(2, 7) & ~s.rlike(r"[0-9@]|https?:|www\.") & ~matches(s, "affiliation")


def is_verifiable(refs: Column, statement_refs: Column, value: Column, p: Column, effect: Column, flags: Column) -> Column:
    return (F.size(refs) > 0) | (F.size(statement_refs) > 0) | ((value.isNotNull() | p.isNotNull() | effect.isNotNull()) & ~F.coalesce(F.array_contains(flags, "missing_evidence"), F.lit(False)))


def polarity(c: Column, words: tuple[str, ...]) -> Column:
    """Whether any word occurs, inside longer words too."""
    low = F.lower(text(c))
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.instr(low, w) > 0)


def polarities(c: Column) -> Column:
    """What a text says of an effect: (positive, negative, none)."""
    from ..config import NEGATIVE, POSITIVE

    return F.struct(polarity(c, POSITIVE).alias("positive"), polarity(c, NEGATIVE).alias("negative"), F.lower(text(c)).contains("no effect").alias("none"))


def opposed(a: Column, b: Column) -> Column:
    """Whether two texts' polarities contradict each other."""
    return (a["positive"] & b["negative"]) | (a["negative"] & b["positive"]) | (a["none"] != b["none"])


def contradicts(claim: Column, other: Column) -> Column:
    return opposed(polarities(claim), polarities(other))


def fits_section(section: Column, c: Column, label: Column) -> Column:
    """The parser's label decides where it is known, else words."""
    by_words = (
        F.when(section == "introduction", ~matches(c, "statistic")).when(section == "methods", matches(c, "method_words")).when(section == "results", matches(c, "result_words") | matches(c, "statistic"))
        .when(section == "discussion", matches(c, "discussion_words")).when(section == "conclusion", matches(c, "conclusion_words")).otherwise(False)
    )
    return F.when(F.coalesce(label, F.lit("unknown")) != "unknown", label == section).otherwise(by_words)


def is_content_image(url: Column, alt: Column) -> Column:
    u = F.lower(text(url))
    return ~u.rlike(r"logo|icon|sprite|avatar|banner|spacer|pixel|tracking|advert|\.svg") & (u.rlike(r"\.(?:png|jpe?g|gif|webp|tiff?)(?:\?|$)") | matches(alt, "figure_ref")) & ~u.startswith("data:")


def is_generic_legend(c: Column) -> Column:
    s = clean_space(c)
    return (s == "") | matches(s, "generic_legend") | s.rlike(r"(?i)^(?:figure|fig\.?|table)\s*s?\d+[a-z]?\.?$")


def is_sentence_legend(c: Column) -> Column:
    s = clean_space(c)
    return (F.regexp_count(s, F.lit(r"[A-Za-z][A-Za-z'-]*")) >= 10) & matches(s, "legend_stopword") & matches(s, "legend_verb") & ~s.rlike(r"^(?:\(?[A-Ha-h]\)|[A-H][.:])\s")


def is_heading_line(c: Column) -> Column:
    s = clean_space(c)
    words = F.size(F.split(s, " "))
    return (F.length(s).between(2, 91)) & words.between(1, 10) & ~s.rlike(r"[.!?;,]$") & s.rlike(r"^[A-Za-z0-9][A-Za-z0-9 &,()/:-]*$") & (matches(s, "explicit_heading") | (upper_share(s) >= 0.6) | s.rlike(r"^(?:[0-9.]+ )?(?:[A-Z][\w-]*(?: (?:and|of|the|in|for) | |$))+$"))


def valid_source(mode: Column, url: Column, doi: Column, file: Column) -> Column:
    """'' where the input can be read, else what is wrong."""
    return (
        F.when(mode == "url", F.when(text(url).rlike(r"^https?://[^\s/]+\.[^\s]+$"), "").when(text(doi).rlike(r"(?i)^10\.\d{4,9}/\S+$"), "").otherwise("give a full address or a DOI"))
        .when(mode == "upload", F.when(F.lower(text(file)).rlike(r"\.(?:pdf|html?|docx|txt|zip)$"), "").otherwise("give a main file of a known kind")).otherwise("unknown mode")
    )


def is_ref_token(c: Column) -> Column:
    return matches(F.lower(F.trim(text(c))), "ref_token")


def suggests_pdf(url: Column) -> Column:
    low = F.lower(text(url))
    return F.exists(F.array(*[F.lit(h) for h in PDF_HINTS]), lambda h: F.instr(low, h) > 0)


def names_supplement(c: Column) -> Column:
    low = F.lower(text(c))
    return F.exists(F.array(*[F.lit(w) for w in SUPPLEMENT_WORDS]), lambda w: F.instr(low, w) > 0)


def asset_kind(name: Column) -> Column:
    """What reads a file of this name, '' where its content must tell."""
    ext = F.lower(F.regexp_extract(text(name), r"\.([A-Za-z0-9]+)$", 1))
    out = F.when(ext == "pdf", "pdf")
    for kind, known in EXTENSIONS.items():
        out = out.when(ext.isin(*known), kind)
    return out.otherwise("")


def safe_member(name: Column) -> Column:
    """An archive member's path, '' where it leaves the archive."""
    s = F.replace(text(name), F.lit("\\"), F.lit("/"))
    return F.when(s.rlike(r"^/|^[A-Za-z]:|(?:^|/)\.\.(?:/|$)"), "").otherwise(s)
