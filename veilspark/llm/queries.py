"""The registered queries of the training-data operators and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import (
    bloom_lm,
    collocations,
    decontaminate,
    licenses,
    mixing,
    order_minhash,
    periodic_runs,
    quality_fm,
    simhash,
    token_counts,
    toxicity,
    url_filter,
    warc,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_source_mix": mixing.op1_source_mix,
        "op2_token_counts": token_counts.op2_token_counts,
        "op3_quality": quality_fm.op3_quality,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_bloom_lm": bloom_lm.op5_bloom_lm,
        "op6_order_minhash": order_minhash.op6_order_minhash,
        "op7_warc": warc.op7_warc,
        "op8_licenses": licenses.op8_licenses,
        "op9_decontamination": decontaminate.op9_decontamination,
        "op10_simhash": simhash.op10_simhash,
        "op11_periodic_runs": periodic_runs.op11_periodic_runs,
        "op12_url_filter": url_filter.op12_url_filter,
        "op13_collocations": collocations.op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_source_mix": mixing.OP1_SQL,
        "op2_token_counts": token_counts.OP2_SQL,
        "op7_warc": warc.OP7_SQL,
        "op12_url_filter": url_filter.OP12_SQL,
        "op13_collocations": collocations.OP13_SQL,
    }
