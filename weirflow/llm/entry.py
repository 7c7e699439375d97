"""The queries of this subpackage, for __spark_entry__.py, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontam, lm_score, mixing, neardup, pii, quality, secrets, substring, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.op1_pii,
        "op2_warc_revisits": warc.op2_warc_revisits,
        "op3_mixing": mixing.op3_mixing,
        "op4_near_duplicates": neardup.op4_near_duplicates,
        "op5_lm_score": lm_score.op5_lm_score,
        "op6_nearest_neighbours": ann.op6_nearest_neighbours,
        "op7_substring_dedup": substring.op7_substring_dedup,
        "op8_secrets": secrets.op8_secrets,
        "op9_decontamination": decontam.op9_decontamination,
        "op10_quality": quality.op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_revisits": warc.ORACLE, "op3_mixing": mixing.ORACLE}
