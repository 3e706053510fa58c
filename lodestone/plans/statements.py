"""A view of statements made from orders in the same way by both engines, and the scalar functions over it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DANGLING, HEADING_LABEL, NEGATIVE, PATTERN, PDF_HINTS, POSITIVE, SHORT_TAILS, STOPWORDS, SUPPLEMENT_WORDS
from ..functions import numbers as N
from ..functions import predicates as P
from ..functions import similarity as S
from ..functions import text as X

TEMPLATES = (
    "We found increased connectivity of {n} ms (p<0.0{n}) in participants with depression.",
    "See Figure 1-3 and Fig S1 plus Table 2 for the {n} regions.",
    "Methods: {n} participants were randomized to the intervention arm; sample size was set by power analysis.",
    "Conclusion: overall, these findings suggest future research (confidence 80%) on {n} items.",
    "doi: 10.1176/appi.ajp.2016.1607{n} received January 12, 2017",
    "4, 5 In contrast, Normative modeling shows a decrease of {n}% (Cohen's d = 0.{n}).",
    "Purchase this article or access your subscription to read {n} more pages.",
    "FIGURE {n} SHOWS THE CORTICAL PROJECTION OF THE LEFT AND RIGHT PANEL",
    "Objective: to test the hypothesis. Methods: {n} scans were processed. Results: no effect was found. Conclusions: the null holds.",
    "and the effect was not reported for group {n} in the",
    "  Table S{n}   lists\tthe   supplementary results (id:text-fallback-results-{n}) [section:Results:{n}]  ",
    "was lower than that of the second and third control cohort ({n}",
    "Background: reward deficits are consistent with longitudinal data in {n} cohorts.",
    "1 2 3 4 5 6 7 8 {n}",
    "The authors report that t = -{n}.5 was significant, z=2.1; however",
    "Supplementary Figure S2 displays the distribution of outcome {n}, p = .04, OR = 1.{n}",
    "Results",
    "2.1 Discussion:",
    "Dr. Jane Q. Public",
    "Department of Psychiatry, University of {n}",
    "https://Example.org/suppl_file/data{n}.pdf?download=1#top",
    "id:abc{n}, f{n}, t2, section:Methods:{n}",
    '{"schema_version": {n}, "value": [1, 2]}',
    "",
)


def literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pattern(name: str) -> str:
    return literal("(?i)" + PATTERN[name])


STATEMENTS_SQL = f"""
    SELECT o_orderkey AS id, o_custkey AS doc, o_totalprice AS price,
           replace(list_extract([{", ".join(literal(t) for t in TEMPLATES)}], CAST(o_orderkey % {len(TEMPLATES)} AS INTEGER) + 1), '{{n}}', CAST(o_orderkey % 97 AS VARCHAR)) AS t
    FROM orders"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, doc, price, t): one statement an order, of the template that the key picks."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    of = F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), (F.col("o_orderkey") % len(TEMPLATES)).cast("int") + 1)
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("doc"), F.col("o_totalprice").alias("price"), F.replace(of, F.lit("{n}"), (F.col("o_orderkey") % 97).cast("string")).alias("t"))


def has(name: str) -> str:
    return f"regexp_matches(t, {pattern(name)})"


CLEAN = r"trim(regexp_replace(t, '\s+', ' ', 'g'))"
TOKENS = "regexp_extract_all(lower(t), '[a-z0-9]+(?:\\.[0-9]+)?')"
WORDS = f"list_filter(list_distinct(regexp_extract_all(lower(t), '[a-z0-9][a-z0-9-]*')), lambda x: x NOT IN ({', '.join(map(literal, STOPWORDS))}))"
UPPER = r"CASE WHEN len(regexp_extract_all(t, '\p{L}')) > 0 THEN CAST(len(regexp_extract_all(t, '\p{Lu}')) AS DOUBLE) / len(regexp_extract_all(t, '\p{L}')) ELSE 0 END"
DIGITS = "CASE WHEN length(t) > 0 THEN CAST(len(regexp_extract_all(t, '[0-9]')) AS DOUBLE) / length(t) ELSE 0 END"


def _cleaned(sql: str) -> str:
    """The expression over cleaned text."""
    return f"(SELECT {sql} FROM (SELECT u AS t FROM (SELECT {CLEAN} AS u)))"


NOISE = _cleaned(f"t = '' OR contains(t, '$^{{') OR {has('boilerplate')} OR regexp_matches(t, '^[0-9\\s.,;:%()-]+$') OR (length(t) >= 16 AND ({UPPER}) > 0.85)")
RESULT = f"NOT {has('visual_annotation')} AND ({has('concrete_result')} OR NOT ({has('method_like')} OR {has('generic_visual')})) AND ({has('concrete_result')} OR {has('high_signal')})"
TAIL = "lower(regexp_extract(t, '([A-Za-z0-9''-]+)[.!?)\\s]*$', 1))"
INCOMPLETE = _cleaned(
    rf"t = '' OR regexp_matches(t, '(?:\.\.\.|…)\s*$') OR regexp_matches(t, '[,;:(\[-]\s*$') OR len(regexp_extract_all(t, '\(')) > len(regexp_extract_all(t, '\)')) OR {TAIL} IN ({', '.join(map(literal, DANGLING))})"
    rf" OR (length(t) >= 110 AND length({TAIL}) BETWEEN 1 AND 3 AND NOT regexp_matches(t, '[.!?)]$') AND {TAIL} NOT IN ({', '.join(map(literal, SHORT_TAILS))}))"
)
LABEL_MAP = "MAP {" + ", ".join(f"{literal(k)}: {literal(v)}" for k, v in sorted(HEADING_LABEL.items())) + "}"
PREFIX = f"coalesce({LABEL_MAP}[lower(regexp_extract(t, {pattern('statement_prefix')}, 1))], '')"
LEXICAL = "CASE " + " ".join(f"WHEN {has(s)} THEN '{s}'" for s in ("conclusion", "discussion", "introduction", "results", "methods")) + " ELSE 'unknown' END"


def any_word(words: tuple[str, ...], of: str = "lower(t)") -> str:
    return "(" + " OR ".join(f"contains({of}, {literal(w)})" for w in words) + ")"


def ids(name: str) -> str:
    return f"list_transform(regexp_extract_all(t, {pattern(name)}, 1), lambda x: upper(x))"


RANGES = f"""flatten(list_transform(list_zip(regexp_extract_all(t, {pattern("ref_range")}, 1), regexp_extract_all(t, {pattern("ref_range")}, 2)),
    lambda z: list_transform(CASE WHEN TRY_CAST(regexp_extract(z[2], '[0-9]+') AS INTEGER) - TRY_CAST(regexp_extract(z[1], '[0-9]+') AS INTEGER) BETWEEN 0 AND 50
                             THEN range(TRY_CAST(regexp_extract(z[1], '[0-9]+') AS INTEGER), TRY_CAST(regexp_extract(z[2], '[0-9]+') AS INTEGER) + 1) ELSE [] END,
                        lambda i: upper(regexp_extract(z[1], '^[sS]?')) || CAST(i AS VARCHAR))))"""


def refs(*names: str) -> str:
    return "array_to_string(list_sort(list_distinct(" + "list_concat(" * len(names) + ids(names[0]) + "".join(f", {ids(n)})" for n in names[1:]) + f", {RANGES}))), ',')"


Scalar = tuple[Callable[[Column], Column], str]
#: Query -> column -> (function of the text column, SQL over t).
SCALARS: dict[str, dict[str, Scalar]] = {
    "f01_clean_space": {"cleaned": (X.clean_space, CLEAN)},
    "f02_clean_text": {"cleaned": (X.clean_text, r"trim(regexp_replace(regexp_replace(t, '[\x00-\x08\x0b-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g'))")},
    "f03_canonical": {"canonical": (X.canonical, f"array_to_string({TOKENS}, ' ')")},
    "f04_word_set": {"n_words": (lambda c: F.size(X.word_set(c)), f"CAST(len({WORDS}) AS INTEGER)"), "words": (lambda c: F.array_join(F.array_sort(X.word_set(c)), " "), f"array_to_string(list_sort({WORDS}), ' ')")},
    "f08_sentences": {
        "n_sentences": (lambda c: F.size(X.sentences(c)), r"CAST(len(list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS INTEGER)"),
        "joined": (lambda c: F.array_join(X.sentences(c), "|"), r"array_to_string(list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> ''), '|')"),
    },
    "f09_strip_prefixes": {
        "no_confidence": (X.strip_confidence, f"trim(regexp_replace(t, {literal(X.CONFIDENCE)}, ' ', 'g'))"),
        "no_citation": (X.strip_citations, r"regexp_replace(t, '^\s*(?:[(\[{]?\s*\d{1,3}(?:\s*[-–]\s*\d{1,3})?(?:\s*[,;]\s*\d{1,3}(?:\s*[-–]\s*\d{1,3})?)*\s*[)\]}]?(?:\s*[,;:])?\s*)+([A-Z])', '\1')"),
    },
    "f10_strip_fallback_ids": {"stripped": (X.strip_fallback_ids, r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)\s*\(id:text-fallback-[^)]+\)\s*', ' ', 'g'), '(?i)\s*\[id:text-fallback-[^\]]+\]\s*', ' ', 'g'), '(?i)\bid:text-fallback-[a-z0-9_.:-]+\b', '', 'g'), '\s+', ' ', 'g'))")},
    "f12_strip_hedges": {"stripped": (X.strip_hedges, rf"(SELECT upper(u[1:1]) || u[2:] FROM (SELECT regexp_replace({CLEAN}, '(?i)^(?:the authors (?:report|state|note|describe)(?:ed|d)? that|we found that|it was found that|the study found that)\s+', '') AS u))")},
    "f15_trim_dangling": {"trimmed": (X.trim_dangling, rf"regexp_replace(t, '(?i)(?:\s+(?:{'|'.join(DANGLING)}))+[\s,;:]*$', '')")},
    "f16_span": {"span_start": (lambda c: F.coalesce(X.span_start(c, F.lit("Participants")), F.lit(-1)), "CAST(instr(lower(t), 'participants') - 1 AS INTEGER)")},
    "f17_human_ref": {
        "shown": (
            lambda c: X.human_ref(X.file_name(F.concat(F.lit("f"), F.length(c)))), "'Figure ' || CAST(length(t) AS VARCHAR)",
        ),
    },
    "f18_bracket_refs": {"inside": (lambda c: F.array_join(X.bracket_refs(c), "|"), r"array_to_string(list_filter(list_transform(flatten(list_transform(regexp_extract_all(t, '\[([^\]]+)\]', 1), lambda x: string_split(x, ','))), lambda x: trim(x)), lambda x: x <> ''), '|')")},
    "f19_lexical_section": {"section": (X.lexical_section, LEXICAL)},
    "f20_prefix_and_heading": {
        "prefix": (X.prefix_section, PREFIX),
        "heading": (X.heading_section, rf"coalesce({LABEL_MAP}[lower(regexp_replace(regexp_extract(t, {pattern('explicit_heading')}, 1), '\s+', ' ', 'g'))], '')"),
    },
    "f21_heading_style": {
        "style": (
            lambda c: X.heading_style(F.length(c) % 6, F.length(c) % 2 == 0, F.lit(1.1), F.size(F.split(X.clean_space(c), " ")), P.upper_share(c)),
            f"least(1.0, CASE WHEN length(t) % 6 BETWEEN 1 AND 2 THEN 0.45 WHEN length(t) % 6 BETWEEN 3 AND 4 THEN 0.30 ELSE 0.0 END + CASE WHEN length(t) % 2 = 0 THEN 0.20 ELSE 0.0 END + 0.10 + CASE WHEN len(string_split({CLEAN}, ' ')) <= 8 THEN 0.10 ELSE 0.0 END + CASE WHEN {UPPER} >= 0.8 THEN 0.05 ELSE 0.0 END)::DOUBLE",
        )
    },
    "f22_refs": {
        "figures": (lambda c: F.array_join(X.figure_refs(c), ","), refs("figure_ref")), "tables": (lambda c: F.array_join(X.table_refs(c), ","), refs("table_ref")),
        "refs": (lambda c: F.array_join(X.all_refs(c), ","), refs("figure_ref", "table_ref")),
    },
    "f23_figure_token": {"token": (X.figure_token, r"CASE WHEN regexp_matches(upper(t), '(S?)0*(\d+)([A-Z]?)\s*$') THEN regexp_extract(upper(t), '(S?)0*(\d+)([A-Z]?)\s*$', 1) || regexp_extract(upper(t), '(S?)0*(\d+)([A-Z]?)\s*$', 2) || regexp_extract(upper(t), '(S?)0*(\d+)([A-Z]?)\s*$', 3) END")},
    "f24_numbers": {
        "value": (X.first_number, f"TRY_CAST(regexp_extract(t, {literal(X.NUMBER)}, 1) AS DOUBLE)"), "unit": (X.first_unit, f"nullif(regexp_extract(t, {literal(X.NUMBER)}, 2), '')"),
        "p": (X.p_value, f"TRY_CAST(regexp_extract(t, {literal(X.P_VALUE)}, 1) AS DOUBLE)"), "effect": (X.effect_size, f"TRY_CAST(regexp_extract(t, {literal(X.EFFECT)}, 1) AS DOUBLE)"),
    },
    "f25_salvage_json": {"json": (lambda c: F.get_json_object(X.salvage_json(F.concat(F.lit("Answer: ```json\n"), c, F.lit("\n```"))), "$.schema_version"), "CASE WHEN json_valid(t) AND t <> '' THEN json_extract_string(t, '$.schema_version') END")},
    "f27_headed_section": {"results": (lambda c: X.headed_section(c, "results"), r"CASE WHEN t LIKE '%Results: %' THEN trim(string_split(regexp_extract(t, '\sResults:\s*(.*)$', 1), ' Conclusions:')[1]) ELSE '' END")},
    "f28_doi_and_urls": {
        "doi": (X.find_doi, f"nullif(rtrim(regexp_extract(t, {pattern('doi')}), '.,;)'), '')"), "host": (X.url_host, "lower(regexp_extract(t, '^[A-Za-z]+://([^/?#:]+)', 1))"),
        "file": (lambda c: F.when(c.startswith("http"), X.file_name(c)), r"CASE WHEN starts_with(t, 'http') THEN regexp_extract(regexp_replace(t, '[?#].*$', ''), '([^/]*)$', 1) END"),
        "pdf": (P.suggests_pdf, any_word(PDF_HINTS)),
    },
    "f30_slug": {"slug": (X.slug, "array_to_string(regexp_extract_all(lower(t), '[a-z0-9]+')[1:8], '_')"), "stem": (X.safe_stem, "regexp_replace(regexp_replace(t, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g')")},
    "f31_friendly_error": {"message": (X.friendly_error, "CASE WHEN contains(lower(t), 'timeout') OR contains(lower(t), 'timed out') THEN 'The source took too long to answer.' WHEN contains(lower(t), '404') OR contains(lower(t), 'not found') THEN 'The source was not found.' WHEN contains(lower(t), '403') OR contains(lower(t), 'forbidden') THEN 'The source refused access.' WHEN contains(lower(t), 'no main') THEN 'No readable main document was found.' ELSE 'Processing failed.' END")},
    "n01_clamp": {"score": (lambda c: N.clamp(F.nullif(F.regexp_extract(c, r"(\d+\.\d+)", 1), F.lit(""))), r"greatest(0.0, least(1.0, coalesce(TRY_CAST(nullif(regexp_extract(t, '(\d+\.\d+)', 1), '') AS DOUBLE), 0.0)))")},
    "n06_year": {"year": (lambda c: F.coalesce(N.year_of(c), F.lit(0)), r"coalesce(TRY_CAST(regexp_extract(t, '((?:19|20)\d{2})', 1) AS INTEGER), 0)")},
    "n07_arrays": {"padded": (lambda c: F.array_join(N.pad(N.text_list(F.split(c, " ")), 6, "-"), "|"), "array_to_string(list_resize(u.l, 6, '-'), '|')")},
    "n13_category_tokens": {"tokens": (lambda c: F.array_join(X.category_tokens(c), " "), "array_to_string(list_filter(regexp_split_to_array(lower(t), '[^a-z0-9]+'), lambda x: x <> ''), ' ')")},
    "n14_labels": {"label": (lambda c: N.section_label(F.regexp_extract(c, r"^(\w+)", 1)), r"CASE WHEN lower(regexp_extract(t, '^(\w+)', 1)) IN ('introduction', 'methods', 'results', 'discussion', 'conclusion', 'unknown') THEN lower(regexp_extract(t, '^(\w+)', 1)) ELSE 'unknown' END")},
    "n15_hash": {"sha1": (F.sha1, "sha1(t)")},
    "p03_supplement": {"supplement": (lambda c: P.looks_supplementary(F.lit("section:x:1"), F.lit(None).cast("string"), c), has("supplement"))},
    "p04_supplement_media": {"supplement": (lambda c: P.is_supplementary_media(c, c, F.lit("")), f"{has('supplement_media')} OR regexp_matches(t, '(?i)suppl|/s\\d+[./]')")},
    "p05_noise": {"noise": (P.is_noise, NOISE), "upper": (P.upper_share, f"({UPPER})::DOUBLE")},
    "p06_layout": {"layout": (P.is_layout_artifact, _cleaned(rf"{has('layout_artifact')} OR (len(regexp_extract_all(lower(t), '\b(left|right|anterior|posterior|superior|inferior)\b')) >= 2 AND regexp_matches(t, '(?i)\bpanel\b')) OR (regexp_matches(t, '(?i)^figure\b') AND len(regexp_extract_all(lower(t), '\b(left|right|anterior|posterior|superior|inferior)\b')) >= 1)"))},
    "p07_evaluation_noise": {"noise": (P.is_noisy_sentence, _cleaned(rf"t = '' OR {has('digit_runs')} OR (({DIGITS}) > 0.34 AND {has('table_noise')}) OR (({DIGITS}) > 0.42 AND length(t) > 220) OR ({has('reference_noise')} AND length(t) < 180)"))},
    "p08_packet_filter": {"kept": (lambda c: P.keeps_packet(c, X.all_refs(c), F.array(F.when(F.length(c) % 5 == 0, "missing_evidence").otherwise("ok")), F.lit(0.5)), f"len({ids('figure_ref')}) + len({ids('table_ref')}) > 0 AND length(t) % 5 <> 0 AND NOT ({NOISE}) AND NOT {has('absence')}")},
    "p11_result_filter": {"kept": (P.is_result_statement, RESULT)},
    "p12_result_media": {"kept": (P.is_result_media, f"{has('concrete_result')} AND NOT {has('method_like')}")},
    "p13_visual": {"generic": (lambda c: X.matches(c, "generic_visual"), has("generic_visual")), "annotation": (lambda c: X.matches(c, "visual_annotation"), has("visual_annotation"))},
    "p14_fragment": {"fragment": (P.is_fragment, _cleaned(rf"(length(t) >= 36 AND {has('fragment_start')} AND NOT regexp_matches(t[1:80], '(?i)\b(we|they|it|this|these|the|patients|participants|results|study)\b')) OR regexp_matches(t, '^[\])}}]') OR (length(t) < 60 AND regexp_matches(t, '(?:\.\.\.|…)\s*$'))"))},
    "p15_incomplete": {"incomplete": (P.is_incomplete, INCOMPLETE)},
    "p16_fidelity": {"introduction": (lambda c: P.passes_fidelity(F.lit("introduction"), c), f"NOT ({NOISE}) AND NOT ({INCOMPLETE}) AND NOT {has('concrete_result')} AND NOT {has('method_like')}"), "results": (lambda c: P.passes_fidelity(F.lit("results"), c), f"NOT ({NOISE}) AND NOT ({INCOMPLETE}) AND {RESULT}")},
    "p22_author": {"author": (P.is_author_name, rf"(SELECT length(u) BETWEEN 3 AND 96 AND len(regexp_split_to_array(u, '\s+')) BETWEEN 2 AND 7 AND NOT regexp_matches(u, '[0-9@]|https?:|www\.') AND NOT regexp_matches(u, {pattern('affiliation')}) FROM (SELECT regexp_replace({CLEAN}, '^[,;:.\s-]+|[,;:.\s-]+$', '', 'g') AS u))")},
    "p23_verifiable": {"verifiable": (lambda c: P.is_verifiable(X.figure_refs(c), X.table_refs(c), X.first_number(c), X.p_value(c), X.effect_size(c), F.array(F.lit("ok"))), rf"len({ids('figure_ref')}) + len({ids('table_ref')}) > 0 OR regexp_matches(t, '\d')")},
    "p24_contradiction": {"contradicts": (lambda c: P.contradicts(F.lit("a significant improvement"), c), f"{any_word(NEGATIVE)} OR contains(lower(t), 'no effect')"), "negative": (lambda c: P.polarity(c, NEGATIVE), any_word(NEGATIVE)), "positive": (lambda c: P.polarity(c, POSITIVE), any_word(POSITIVE))},
    "p25_section_fit": {"fits": (lambda c: P.fits_section(F.lit("results"), c, X.lexical_section(c)), f"CASE WHEN ({LEXICAL}) <> 'unknown' THEN ({LEXICAL}) = 'results' ELSE {has('result_words')} OR {has('statistic')} END")},
    "p26_content_image": {"image": (lambda c: P.is_content_image(F.concat(F.replace(c, F.lit(" "), F.lit("")), F.lit(".png")), c), "NOT regexp_matches(lower(replace(t, ' ', '') || '.png'), 'logo|icon|sprite|avatar|banner|spacer|pixel|tracking|advert|\\.svg') AND NOT starts_with(lower(t), 'data:')")},
    "p27_generic_legend": {"generic": (P.is_generic_legend, _cleaned(rf"t = '' OR {has('generic_legend')} OR regexp_matches(t, '(?i)^(?:figure|fig\.?|table)\s*s?\d+[a-z]?\.?$')"))},
    "p28_sentence_legend": {"sentence": (P.is_sentence_legend, _cleaned(rf"len(regexp_extract_all(t, '[A-Za-z][A-Za-z''-]*')) >= 10 AND {has('legend_stopword')} AND {has('legend_verb')} AND NOT regexp_matches(t, '^(?:\(?[A-Ha-h]\)|[A-H][.:])\s')"))},
    "p30_source_input": {"problem": (lambda c: P.valid_source(F.lit("url"), c, F.lit(None).cast("string"), c), r"CASE WHEN regexp_matches(t, '^https?://[^\s/]+\.[^\s]+$') THEN '' ELSE 'give a full address or a DOI' END")},
    "p31_ref_token": {"token": (lambda c: P.is_ref_token(F.element_at(F.split(c, ","), 1)), f"regexp_matches(lower(trim(string_split(t, ',')[1])), {pattern('ref_token')})")},
    "p32_line_classes": {
        "method": (lambda c: X.matches(c, "method_words"), has("method_words")), "result": (lambda c: X.matches(c, "result_words"), has("result_words")),
        "intro": (lambda c: X.matches(c, "intro_words"), has("intro_words")), "conclusion": (lambda c: X.matches(c, "conclusion_words"), has("conclusion_words")),
    },
    "s03_asset_dispatch": {"kind": (lambda c: P.asset_kind(X.file_name(c)), "CASE lower(regexp_extract(regexp_extract(regexp_replace(t, '[?#].*$', ''), '([^/]*)$', 1), '\\.([A-Za-z0-9]+)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'csv' THEN 'tabular' WHEN 'txt' THEN 'text' WHEN 'zip' THEN 'archive' ELSE '' END")},
    "f05_token_f1": {"f1": (lambda c: S.token_f1(c, F.lit("participants found increased connectivity results")), f"(SELECT CASE WHEN len(a) > 0 THEN 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) ELSE 0 END FROM (SELECT {WORDS} AS a, ['participants', 'found', 'increased', 'connectivity', 'results'] AS b))::DOUBLE")},
    "f06_jaccard": {"jaccard": (lambda c: S.jaccard(c, F.lit("participants found increased connectivity results")), f"(SELECT CASE WHEN len(a) > 0 THEN CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))) ELSE 0 END FROM (SELECT {WORDS} AS a, ['participants', 'found', 'increased', 'connectivity', 'results'] AS b))::DOUBLE")},
}
SCALARS["n07_arrays"]["padded"] = (SCALARS["n07_arrays"]["padded"][0], "array_to_string(list_resize(list_filter(list_transform(list_filter(string_split(t, ' '), lambda x, i: list_position(string_split(t, ' '), x) = i), lambda x: trim(x)), lambda x: x <> ''), 6, '-'), '|')")


def scalar_query(columns: dict[str, Scalar]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: statements(spark, sf_dir).select("id", *[f(F.col("t")).alias(name) for name, (f, _) in columns.items()])


def scalar_sql(columns: dict[str, Scalar]) -> str:
    return f"WITH s AS ({STATEMENTS_SQL}) SELECT id, {', '.join(f'{sql} AS {name}' for name, (_, sql) in columns.items())} FROM s"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: scalar_query(columns) for name, columns in SCALARS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: scalar_sql(columns) for name, columns in SCALARS.items()}
