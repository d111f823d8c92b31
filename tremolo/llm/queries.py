"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, licences, mixing, near_dedup, periodic_runs, personal_data, quality, token_count, toxicity, vector_codes, warc_zip, wavelet


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_wavelet": wavelet.op1_wavelet,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_quality": quality.op3_quality,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_licences": licences.op5_licences,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_warc": warc_zip.op8_warc,
        "op9_mixing": mixing.op9_mixing,
        "op10_token_count": token_count.op10_token_count,
        "op11_periodic_runs": periodic_runs.op11_periodic_runs,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_personal_data": personal_data.op13_personal_data,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.ORACLE, "op8_warc": warc_zip.ORACLE, "op9_mixing": mixing.ORACLE, "op12_vector_codes": vector_codes.ORACLE}
