"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dwellpath.llm import (
    bpe,
    chat,
    decontaminate,
    divergence,
    imatch,
    lexical,
    lines,
    minhash,
    mixing,
    neighbours,
    secrets,
    toxicity,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_forest": minhash.op1_minhash_forest,
    "op2_context_mixing": mixing.op2_context_mixing,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_chat_windows": chat.op5_chat_windows,
    "op6_imatch": imatch.op6_imatch,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_warc": warc.op9_warc,
    "op10_secrets": secrets.op10_secrets,
    "op11_lexical": lexical.op11_lexical,
    "op12_divergence": divergence.op12_divergence,
    "op13_learned_partitions": neighbours.op13_learned_partitions,
}

ORACLE_SQL: dict[str, str] = {
    "op8_line_dedup": lines.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
    "op11_lexical": lexical.OP11_SQL,
    "op12_divergence": divergence.OP12_SQL,
}
