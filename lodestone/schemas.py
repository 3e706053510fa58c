"""Stored tables and intermediate rows as explicit schemas, in DDL, which readers and from_json take."""

DOCUMENT = "id BIGINT, title STRING, source_url STRING, doi STRING, created_at TIMESTAMP"
ASSET = "id BIGINT, document_id BIGINT, kind STRING, filename STRING, content_type STRING, path STRING, created_at TIMESTAMP"
JOB = "id BIGINT, document_id BIGINT, status STRING, progress DOUBLE, message STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
CHUNK = "id BIGINT, document_id BIGINT, asset_id BIGINT, anchor STRING, modality STRING, content STRING, meta STRING"
CHUNK_META = (
    "source STRING, asset_kind STRING, section_raw_title STRING, section_norm STRING, section_source STRING, section_confidence DOUBLE, heading_style_score DOUBLE, heading_level INT, section_anchor_token STRING, "
    "paragraph_index INT, caption STRING, figure_id STRING, table_id STRING, source_url STRING, ocr_text STRING, page INT, quality_flags ARRAY<STRING>"
)
TABLE_CONTENT = "columns ARRAY<STRING>, data ARRAY<ARRAY<STRING>>"
PACKET = (
    "document_id BIGINT, ord BIGINT, finding_id STRING, modality STRING, anchor STRING, statement STRING, evidence_refs ARRAY<STRING>, confidence DOUBLE, quality_flags ARRAY<STRING>, value DOUBLE, unit STRING, "
    "p_value DOUBLE, effect_size DOUBLE, category STRING, section_label STRING, section_confidence DOUBLE, section_source STRING, result_evidence_type STRING"
)
CLAIM = "claim_id STRING, claim STRING, evidence ARRAY<STRING>, support_packets ARRAY<STRING>, conflict_packets ARRAY<STRING>, unresolved_packets ARRAY<STRING>, status STRING, confidence DOUBLE"
DISCREPANCY = "claim STRING, reason STRING, evidence ARRAY<STRING>, severity STRING, confidence DOUBLE, linked_packet_ids ARRAY<STRING>"
SECTION_ITEM = (
    "section STRING, ord INT, statement STRING, anchor STRING, evidence_refs ARRAY<STRING>, source_modality STRING, section_source STRING, confidence DOUBLE, section_confidence DOUBLE, is_untrusted BOOLEAN, flags ARRAY<STRING>, result_evidence_type STRING"
)
EVENT = "event STRING, timestamp STRING, details MAP<STRING,STRING>"
REPORT = "id BIGINT, document_id BIGINT, payload STRING, created_at TIMESTAMP"
