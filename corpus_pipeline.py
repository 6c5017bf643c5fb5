"""A training corpus from raw documents: quality rules, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; run() writes each stage's result as Parquet to the
shared folder and reads it again for the next one. All but the last return the columns of documents. When a stage begins, the result of the
one before is written: intermediate tables that the earlier one left are deleted then.

Nulls, empty texts and tables: quality rejects null and wordless texts (under 50 words); near_dedup keeps rows without doc_id as they are;
pii passes null texts on; mixing takes null sources as one source and never takes a document without words; bpe encodes null as no tokens.
Ties and repeated rows: rows that repeat a document of the same words become one in near_dedup; of a group the smallest doc_id stays. An empty
table gives empty results with the same columns. Extra columns, whatever their names (but for a leading "__"), are carried to the end; one
that has the name of a token column (n_tokens, ids, ids_sha256, decoded_sha256) gives way to it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, mixing, pii, quality, simhash
from tidemark.llm.common import held, release, release_paths, store

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def _freed(stage: Stage) -> Stage:
    """stage, after what the stage before it left behind is deleted."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_paths(spark, _left)
        _left.clear()
        before = set(held())
        out = stage(spark, docs, sf_dir)
        _left.extend(p for p in held() if p not in before)
        return out

    return run_stage


@_freed
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the adaptive thresholds reject go."""
    return quality.filter_documents(docs)


@_freed
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of at least 0.8 on five-word shingles join, that with the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs)


@_freed
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data becomes its kind in brackets."""
    return pii.redact(docs).select(*docs.columns)


@_freed
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix takes it; the rows are dealt to the output shards and ordered by hash inside each."""
    mixed = mixing.mix(docs)
    return mixed.repartition("__shard").sortWithinPartitions("__shard", "__rank").select(*docs.columns)


@_freed
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids instead of texts."""
    import public_tokenizers

    return bpe.tokenized(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("pii", personal_data), ("mixing", mix_sources), ("bpe", tokens)]

#: Set similarity, the span classifier, the permutations and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, store(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
