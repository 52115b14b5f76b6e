"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontam, html_extract, langid, lm_score, mixing, parity_join, substring_dedup, suffix_dedup, warc, webp


def queries() -> dict:
    return {
        "op1_language_id": langid.query,
        "op2_ngram_jaccard_join": parity_join.query,
        "op3_suffix_array_dedup": suffix_dedup.query,
        "op4_html_extraction": html_extract.query,
        "op5_benchmark_decontamination": decontam.query,
        "op6_warc_derivatives": warc.query,
        "op7_substring_dedup": substring_dedup.query,
        "op8_lm_scoring": lm_score.query,
        "op9_lossless_webp": webp.query,
        "op10_source_mixing": mixing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_source_mixing": mixing.SQL}
