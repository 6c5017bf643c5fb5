"""Refreshing a view: plan the ranges, recompute each from complete source rows, upsert it in one commit."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import ViewError
from ..functions.buckets import expand, floor, walk
from ..plans.viewdef import ParsedView
from ..sources.tablelog import SnapshotTable
from .detect import source_range, target_bucket_max


@dataclass(frozen=True)
class QueryInfo:
    query_id: str
    info_uri: str
    stage: str
    started_at: datetime
    elapsed_ms: int
    processed_rows: int
    processed_bytes: int
    range: tuple[datetime, datetime] | None = None
    chunks_done: int | None = None
    chunks_total: int | None = None
    rows_written: int = 0


def view_over(spark: SparkSession, view: ParsedView, source: DataFrame) -> DataFrame:
    """The view's query with its relation read from source."""
    name = f"tidemark_{uuid.uuid4().hex}"
    source.createOrReplaceTempView(name)
    try:
        return spark.sql(view.over(name))  # analysed here, so the temporary name can go
    finally:
        spark.catalog.dropTempView(name)


def output_schema(spark: SparkSession, view: ParsedView, source: SnapshotTable):
    """The query's schema, by analysis alone."""
    return view_over(spark, view, spark.createDataFrame([], source.schema)).schema


def backfill_ranges(view: ParsedView, source: SnapshotTable, target: SnapshotTable, chunk: str | None) -> list[tuple[datetime, datetime]]:
    """The ranges of a full refresh: one, or one for each chunk from where the target got to; the chunk that holds its last bucket is done again."""
    found = source_range(source, view.filter_column)
    if found is None:
        return []
    if not chunk:
        return [expand(*found, view.granularity)]
    start, end = expand(*found, chunk)
    done = target_bucket_max(target, view.range_alias) if view.range_alias else None
    if done is not None:
        start = max(start, floor(_as(done, start), chunk))
    return list(walk(start, end, chunk))


def _as(value: datetime, other: datetime) -> datetime:
    return value.replace(tzinfo=other.tzinfo) if value.tzinfo is None or other.tzinfo is None else value


def refresh(
    spark: SparkSession, view: ParsedView, source: SnapshotTable, target: SnapshotTable, incremental: tuple[datetime, datetime] | None = None, chunk: str | None = None, replace_range: bool = False, snapshot: int | None = None
) -> Iterator[QueryInfo]:
    """One QueryInfo for each committed range; stopping the iteration stops between commits.

    The source is pinned to snapshot. Views with HAVING always replace their range, as a group may stop to qualify.
    """
    if replace_range and view.range_alias is None:
        raise ViewError("replace_range needs the bucket in the output, as date_trunc itself or cast to a timestamp")
    ranges = [incremental] if incremental else backfill_ranges(view, source, target, chunk)
    chunked = not incremental and bool(chunk)
    for done, (start, end) in enumerate(ranges, 1):
        began, clock = datetime.now(UTC), time.monotonic()
        query_id = f"refresh-{uuid.uuid4().hex}"
        spark.addTag(query_id)
        try:
            seen = Observation(query_id)
            rows = source.read(snapshot, view.filter_column, start, end).observe(seen, F.count(F.lit(1)).alias("rows"))
            commit = target.upsert(view_over(spark, view, rows), view.merge_keys, view.range_alias, (start, end), replace_range or view.has_having, cluster=not incremental)
        finally:
            spark.removeTag(query_id)
        files = commit.added if commit else ()
        # the plan of an empty range may never have run, and then nothing was seen
        read = seen.get.get("rows", 0) if any(not f.carried for f in files) else 0
        yield QueryInfo(
            query_id, f"spark-tag:{query_id}", "chunk_merge" if chunked else "merge", began, int((time.monotonic() - clock) * 1000), read, source.bytes_in(snapshot, view.filter_column, start, end), (start, end),
            done if chunked else None, len(ranges) if chunked else None, sum(f.rows for f in files if not f.carried),
        )
