"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citemill.llm import decontam, licenses, linededup, lmscore, mixing, neardup, quality, sharding, tokencounts, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": tokencounts.op1_token_counts,
    "op2_decontamination": decontam.op2_decontamination,
    "op3_near_dedup": neardup.op3_near_dedup,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_sharding": sharding.op5_sharding,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_quality": quality.op7_quality,
    "op8_mixing": mixing.op8_mixing,
    "op9_lm_score": lmscore.op9_lm_score,
    "op10_topk": topk.op10_topk,
}

SQL: dict[str, str] = {
    "op2_decontamination": decontam.ORACLE_SQL,
    "op4_license_scan": licenses.ORACLE_SQL,
    "op5_sharding": sharding.ORACLE_SQL,
    "op6_line_dedup": linededup.ORACLE_SQL,
    "op8_mixing": mixing.ORACLE_SQL,
    "op10_topk": topk.ORACLE_SQL,
}
