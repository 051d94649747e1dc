"""Registry of the subpackage's queries and their SQL oracles."""

from __future__ import annotations

from . import chat_format, decontaminate, exact_dedup, html_text, line_dedup, near_dedup, quality, source_mix, suffix_dedup, token_counts


def queries() -> dict:
    return {
        "op1_html_text": html_text.op1_html_text,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_perspectives": chat_format.op3_perspectives,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_quality": quality.op5_quality,
        "op6_near_dedup": near_dedup.op6_near_dedup,
        "op7_source_mix": source_mix.op7_source_mix,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_perspectives": chat_format.ORACLE,
        "op6_near_dedup": near_dedup.ORACLE,
        "op7_source_mix": source_mix.ORACLE,
        "op9_line_dedup": line_dedup.ORACLE,
        "op10_exact_dedup": exact_dedup.ORACLE,
    }
