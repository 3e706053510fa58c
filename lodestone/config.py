"""Limits, thresholds and word lists. Lists and patterns below are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

SECTIONS = ("introduction", "methods", "results", "discussion", "conclusion")
SECTION_LABELS = (*SECTIONS, "unknown")

# Ends of the sections as shares of a document, by the caller that asks.
POSITION_ENDS = {
    "packets": (0.22, 0.52, 0.70, 0.90),
    "quota": (0.22, 0.45, 0.70, 0.93),
    "layout": (0.20, 0.52, 0.74, 0.90),
    "validated": (0.18, 0.40, 0.74, 0.90),
}
# Weight and rank of the sources of a section vote.
SOURCE_WEIGHT = {
    "meta": 1.00, "explicit_heading": 1.08, "structured_abstract": 0.98, "anchor": 0.92, "heading": 0.91, "heading_style": 0.90,
    "statement_prefix": 0.84, "category": 0.72, "lexical": 0.60, "position": 0.46, "fallback": 0.28,
}
SOURCE_RANK = ("meta", "explicit_heading", "heading", "heading_style", "structured_abstract", "anchor", "statement_prefix", "category", "lexical", "position", "fallback")

# Words of the polarity test, severities, event kinds.
POSITIVE = ("increase", "improve", "higher", "reduction", "benefit", "better", "positive", "significant")
NEGATIVE = ("decrease", "worse", "lower", "null", "no effect", "negative", "nonsignificant")
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2}
EVENT_SEVERITY = {
    "startup_failed": "error", "backend_shutdown": "warning", "stop_requested": "warning", "stop_completed": "info",
    "backend_startup": "info", "shutdown_requested": "warning", "shutdown_completed": "info",
}
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "were", "with")
DANGLING = (
    "and", "or", "with", "without", "to", "of", "in", "on", "for", "by", "from", "as", "than", "that", "which", "whose", "while", "when", "where",
    "because", "therefore", "however", "thus", "including", "beginning", "using", "via", "consistent",
)
SHORT_TAILS = ("adhd", "fdr", "ci", "sd", "msn", "auc", "sex", "age")

# Patterns, without case (each is used as (?i)pattern).
PATTERN = {
    "introduction": r"\b(intro|background|objective|aim|rationale|hypoth)\b",
    "methods": r"\b(methods?|materials?|participants?|procedure|analysis|acquisition|design|protocol|covariate)\b",
    "results": r"\b(finding|outcome|revealed|identified|demonstrated|showed|significant|increased|decreased|higher|lower)\b",
    "discussion": r"\b(discussion|interpretation|implication|limitation|to date|in our study|consistent with|may reflect|suggests that)\b",
    "conclusion": r"\b(conclusion|concluding|summary|overall|future research|longitudinal)\b",
    "method_like": r"\b(participants?|scanner|acquisition|processing|covariates?|post hoc|seed-based|was used to test|model(?:ing)?|protocol|procedure|inclusion|exclusion|measured using|analysis was conducted)\b",
    "concrete_result": r"\b(p\s*[<=>]\s*0?\.\d+|t\s*=\s*-?\d+(?:\.\d+)?|f\s*=\s*-?\d+(?:\.\d+)?|z\s*=\s*-?\d+(?:\.\d+)?|\d+(?:\.\d+)?\s*(?:%|ms|mm|sd|ci|or|hr)\b|increased|decreased|higher|lower|hyperconnectivity|hypoconnectivity|dysconnectivity|associated with|correlated with|significant|found|identified\s+(?:foci|clusters|regions|differences))\b",
    "high_signal": r"\b(identified|revealed|demonstrated|showed|stratif(?:y|ication)|biotype|cluster(?:ing)?|subtype|replicat(?:ed|ion)|validation cohort|normative model(?:ing)?|deviation pattern|network pattern)\b",
    "generic_visual": r"^(figure|table|supplement(?:ary)?\s+figure|supplement(?:ary)?\s+table)\b.*\b(shows?|displays?|illustrates?|depicts?|presents?)\b",
    "visual_annotation": r"\b(solid dots indicate|outer circles?|distance from center|each axis represents|panel [a-h]|axis represents|color bar|heatmap scale|nodes? exhibiting|rings? indicate|circle size indicates)\b",
    "layout_artifact": r"\b(left right|right left|cortical projection|brain (?:surface|map)|color bar|axial|coronal|sagittal|panel [a-z]|projection displaying|surface rendering)\b",
    "boilerplate": r"\b(doi:|received [a-z]+ \d{1,2}, \d{4}|revision received|accepted [a-z]+ \d{1,2}, \d{4}|published online|address correspondence|presented at|supported by nih|financial relationships|customer service|table\s+\d+|figure\s+\d+)\b",
    "absence": r"\b(not described|not reported|not mentioned|not provided|not detailed|no mention|no details|absence of|lacking in detail|not explicitly described)\b",
    "paywall": r"\b(purchase this article|already a subscriber|access your subscription|full access to this article|ppv articles|subscription options|customer service|citation manager)\b",
    "supplement": r"\b(supplement(?:ary|al)?|suppl|appendix|extended data|supporting (?:information|info|data))\b",
    "supplement_media": r"\b(supplement(?:ary|al)?|suppl|appendix|extended data|supporting (?:information|info|data)|figure\s*s\d+|fig(?:ure)?\s*s\d+|table\s*s\d+|s\d+\s*(?:fig(?:ure)?|table))\b",
    "statistic": r"\b(t|f|z|p)\s*[=<>]\s*[-+]?\d+(?:\.\d+)?",
    "reference_noise": r"\b(doi:|et al\b|copyright|all rights reserved)\b",
    "table_noise": r"\b(characteristic|mean\s+sd|n\s*%|education\s*\(years\)|in-scanner motion)\b",
    "digit_runs": r"(?:\d+(?:\.\d+)?\s+){6,}\d+(?:\.\d+)?",
    "citation": r"\(\d{1,3}(?:\s*,\s*\d{1,3})*\)",
    "fragment_start": r"^\s*(?:was|were|is|are|been|being|as in|for a list|finally|next\b|and\b|or\b|but\b)\b",
    "statement_prefix": r"^\s*(objective|objectives|background|aim|aims|method|methods|design|results|conclusion|conclusions)\s*:",
    "explicit_heading": r"^\s*(?:\d+(?:\.\d+){0,3}\s+)?(abstract|introduction|background|objective|objectives|aim|aims|method|methods|materials?\s+and\s+methods?|results?|discussion|conclusions?|summary|supplementary|supplementary\s+materials?|references?)[\s\-:.;\)]*$",
    "affiliation": r"\b(department|university|hospital|institute|school|laborator(?:y|ies)|center|centre|college|faculty|clinic|academy|medical|research|radiology|psychiatry|original investigation|key laboratory|road|street|avenue|china|australia|usa|uk|email|correspondence|psychoradiology|imaging)\b",
    "generic_legend": r"^(?:page\s+\d+\s+(?:raster(?:\s+fallback)?|image(?:\s+fallback)?)|supplementary material|image)$",
    "legend_stopword": r"\b(the|and|of|in|to|with|for|that|this|was|were|from|across|between)\b",
    "legend_verb": r"\b(show|shows|showed|indicate|indicates|indicated|reveal|reveals|revealed|demonstrate|demonstrates|demonstrated|identify|identifies|identified|compare|compares|compared|was|were|is|are)\b",
    "figure_ref": r"\bfig(?:ure)?\.?\s*(s?\d+)([a-z])?",
    "table_ref": r"\btable\s*(s?\d+)([a-z])?",
    "ref_range": r"\b(?:fig(?:ure)?\.?|table)\s*(s?\d+)\s*[-–]\s*(s?\d+)",
    "ref_token": r"^(id:|section:|figure:|table:|supp)|^[ft][0-9]+[a-z]?$",
    "doi": r"10\.\d{4,9}/[-._;()/:A-Z0-9]+",
    "intro_words": r"\b(background|objective|aim|hypothesis|rationale|anhedonia|reward)\b",
    "method_words": r"\b(participants?|sample|cohort|scanner|acquisition|preprocess|covariate|regression|mdmr|seed-based|protocol|exclusion|inclusion)\b",
    "result_words": r"\b(found|identified|associated|increased|decreased|significant|connectivity|effect|cluster|module)\b",
    "discussion_words": r"\b(suggest|interpret|implication|limitation|consistent|may reflect|speculate)\b",
    "conclusion_words": r"\b(in conclusion|overall|these findings|support|future|clinical implication|longitudinal)\b",
    "outcome": r"\b(found|identified|revealed|associated|increased|decreased|higher|lower|significant|t\s*=|p\s*[<=>])\b",
}
HEADING_LABEL = {
    "materials and methods": "methods", "materials": "methods", "analysis": "methods", "participants": "methods", "objective": "introduction", "objectives": "introduction",
    "aim": "introduction", "aims": "introduction", "purpose": "introduction", "background": "introduction", "abstract": "introduction", "introduction": "introduction",
    "method": "methods", "methods": "methods", "design": "methods", "finding": "results", "findings": "results", "result": "results", "results": "results", "discussion": "discussion",
    "limitation": "discussion", "limitations": "discussion", "implication": "discussion", "conclusion": "conclusion", "conclusions": "conclusion", "summary": "conclusion",
}
PDF_HINTS = (".pdf", "/pdf", "download=", "pdf?", "pdf=")
SUPPLEMENT_WORDS = ("supplement", "supplementary", "appendix", "additional file", "additional data", "supporting information", "supporting info", "supplemental", "dataset")
EXTENSIONS = {"tabular": ("csv", "tsv", "xlsx", "xls"), "image": ("png", "jpg", "jpeg", "tif", "tiff", "gif", "webp"), "text": ("txt",), "html": ("html", "htm", "xhtml"), "archive": ("zip",)}


@dataclass(frozen=True)
class EngineConfig:
    """What runs may change. parity keeps the known quirks of order and labels."""

    parity: bool = True
    per_anchor: int = 3
    section_caps: dict[str, int] = field(default_factory=lambda: {"introduction": 10, "methods": 18, "results": 14, "discussion": 10, "conclusion": 8})
    quotas: dict[str, int] = field(default_factory=lambda: {"introduction": 3, "methods": 8, "results": 6, "discussion": 4, "conclusion": 2})
    per_chunk: int = 2
    match_threshold: float = 0.42
    weights: tuple[float, float, float] = (0.48, 0.34, 0.18)
    mismatch: float = 0.35
    max_chunks: int = 400
    min_paragraph: int = 30
    keep_reports: int = 10
    min_keep: dict[str, int] = field(default_factory=lambda: {"discussion": 4, "conclusion": 3})
    section_targets: dict[str, int] = field(default_factory=lambda: {"methods": 8, "results": 12, "discussion": 6, "conclusion": 4})


PROFILES = {
    "fast": EngineConfig(max_chunks=120, per_chunk=1),
    "balanced": EngineConfig(),
    "section_sensitive": replace(EngineConfig(), match_threshold=0.36),
    "high_recall": replace(EngineConfig(), match_threshold=0.30, per_anchor=5),
    "full": replace(EngineConfig(), max_chunks=2000, per_anchor=8, per_chunk=4),
}
