"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, licenses, line_dedup, merkle, mixing, near_dedup, pii, quality, token_blocks, warc_archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": near_dedup.op1,
    "op2_mixing": mixing.op2,
    "op3_pii": pii.op3,
    "op4_warc_archive": warc_archive.op4,
    "op5_line_dedup": line_dedup.op5,
    "op6_token_blocks": token_blocks.op6,
    "op7_quality": quality.op7,
    "op8_licenses": licenses.op8,
    "op9_decontaminate": decontaminate.op9,
    "op10_merkle": merkle.op10,
}

ORACLES: dict[str, str] = {
    "op2_mixing": mixing.ORACLE,
    "op4_warc_archive": warc_archive.ORACLE,
    "op10_merkle": merkle.ORACLE,
}
