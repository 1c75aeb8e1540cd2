"""Queries of the training-data operators and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import byte_bpe, decontamination, fixity, html_layout, language_id, line_dedup, near_dedup, quality, sharding, vector_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.op1_language_id,
    "op2_layout_text": html_layout.op2_layout_text,
    "op3_pivot_search": vector_search.op3_pivot_search,
    "op4_quality": quality.op4_quality,
    "op5_order_minhash": near_dedup.op5_order_minhash,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_virtual_slots": sharding.op7_virtual_slots,
    "op8_merkle_audit": fixity.op8_merkle_audit,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
}

ORACLES: dict[str, str] = {
    "op3_pivot_search": vector_search.OP3_SQL,
    "op6_decontamination": decontamination.OP6_SQL,
    "op8_merkle_audit": fixity.OP8_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
}
