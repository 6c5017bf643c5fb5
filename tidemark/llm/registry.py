"""The queries of this subpackage for the driver, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, language, mixing, pii, quality, simhash, substrings, urls, vectors, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_pii": pii.op1_pii,
        "op2_url_filter": urls.op2_url_filter,
        "op3_vectors": vectors.op3_vectors,
        "op4_simhash": simhash.op4_simhash,
        "op5_substrings": substrings.op5_substrings,
        "op6_language": language.op6_language,
        "op7_bpe": bpe.op7_bpe,
        "op8_warc": warc.op8_warc,
        "op9_mixing": mixing.op9_mixing,
        "op10_quality_rules": quality.op10_quality_rules,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": urls.OP2_SQL,
        "op3_vectors": vectors.OP3_SQL,
        "op5_substrings": substrings.OP5_SQL,
        "op8_warc": warc.OP8_SQL,
        "op10_quality_rules": quality.OP10_SQL,
    }
