"""The contract queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, exact_dedup, html_extract, language_id, license_scan, lm_score, matroska, near_dedup, packing, substring_dedup


def queries() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_language_id": language_id.op3_language_id,
        "op4_media_columns": matroska.op4_media_columns,
        "op5_license_scan": license_scan.op5_license_scan,
        "op6_html_extract": html_extract.op6_html_extract,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_packing": packing.op8_packing,
        "op9_lm_score": lm_score.op9_lm_score,
        "op10_bpe": bpe.op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.OP2_SQL}
