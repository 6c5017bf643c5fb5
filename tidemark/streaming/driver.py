"""A view driven by Structured Streaming instead of polling.

Each micro-batch says which range it touched; the range is widened to whole buckets and rebuilt from the complete source. There is no
watermark: rows of any age reopen their bucket. A batch that runs again rebuilds the same rows, so delivery is effectively once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.buckets import expand
from ..operators.refresh import output_schema, refresh
from ..plans.viewdef import parse_view
from ..sources.tablelog import SnapshotTable


def stream_view(spark: SparkSession, stream: DataFrame, query: str, source: SnapshotTable, target_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append each micro-batch of stream to source and keep the view at target_path equal to query over it."""
    parsed = parse_view(spark, query)
    target = SnapshotTable.create(spark, target_path, output_schema(spark, parsed, source))
    return stream.writeStream.foreachBatch(batch_refresh(query, source, target, checkpoint)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def batch_refresh(query: str, source: SnapshotTable, target: SnapshotTable, checkpoint: str) -> Callable[[DataFrame, int], None]:
    """What a stream does with each batch. checkpoint names the stream: its batches are numbered there, and the source's log says which of
    them it has, also after it was expired."""
    stream = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex

    def run(batch: DataFrame, batch_id: int) -> None:
        key = f"__stream:{stream}"
        if batch_id > source.last_batch(stream):
            added = source._write(batch)
            if not added:
                return
            source.commit("append", added, changed={key: (str(batch_id), str(batch_id))})
        else:  # appended before a crash: only the view may lack it
            added = [f for s in source.log() if s.changed.get(key, ("",))[0] == str(batch_id) for f in s.added]
        parsed = parse_view(source.spark, query)
        ranges = [r for f in added if (r := f.range(source.column(parsed.filter_column))) is not None]
        if ranges:
            whole = expand(min(a for a, _ in ranges), max(b for _, b in ranges), parsed.granularity)
            for _ in refresh(source.spark, parsed, source, target, whole):
                pass

    return run
