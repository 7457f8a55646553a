"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import automata, decontaminate, exact, html, minhash, packing, suffixes, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_repeated_passages": automata.op1_repeated_passages,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_exact_dedup": exact.op3_exact_dedup,
        "op4_suffix_array": suffixes.op4_suffix_array,
        "op5_html_extraction": html.op5_html_extraction,
        "op6_url_filters": urls.op6_url_filters,
        "op7_decontamination": decontaminate.op7_decontamination,
        "op8_order_minhash": minhash.op8_order_minhash,
        "op9_token_output": packing.op9_token_output,
        "op10_online_packing": packing.op10_online_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": exact.OP3_SQL,
        "op6_url_filters": urls.OP6_SQL,
    }
