"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

import corpus_pipeline
from larkspur.llm import exact, html, langid, linededup, media, packing, pieces, pii, quality, simhash

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_packing": packing.op1,
    "op2_line_dedup": linededup.op2,
    "op3_quality": quality.op3,
    "op4_exact_dedup": exact.op4,
    "op5_language_id": langid.op5,
    "op6_simhash": simhash.op6,
    "op7_pii": pii.op7,
    "op8_html": html.op8,
    "op9_sentencepiece": pieces.op9,
    "op10_media": media.op10,
}

ORACLES = {
    "op4_exact_dedup": r"""
        WITH texts AS (
            SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
            row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
        FROM texts WINDOW w AS (PARTITION BY norm ORDER BY cp DESC, doc_id)""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
