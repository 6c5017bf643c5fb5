"""Calendar buckets: floors, successors, the inverse of date_trunc, bucket iteration and the chunk compatibility order."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The granularities, finest first.
GRANULARITIES = ("millisecond", "second", "minute", "hour", "day", "week", "month", "quarter", "year")
_STEP = {"millisecond": timedelta(milliseconds=1), "second": timedelta(seconds=1), "minute": timedelta(minutes=1), "hour": timedelta(hours=1), "day": timedelta(days=1), "week": timedelta(weeks=1)}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}


def _check(granularity: str) -> None:
    if granularity not in GRANULARITIES:
        raise ValueError(f"unsupported granularity: {granularity!r}")


def floor(ts: datetime, granularity: str) -> datetime:
    """The start of ts's bucket."""
    _check(granularity)
    if granularity in _MONTHS:
        span = _MONTHS[granularity]
        return ts.replace(month=(ts.month - 1) // span * span + 1, day=1, hour=0, minute=0, second=0, microsecond=0)
    if granularity == "millisecond":
        return ts.replace(microsecond=ts.microsecond // 1000 * 1000)
    zero = {"second": ("microsecond",), "minute": ("microsecond", "second"), "hour": ("microsecond", "second", "minute")}.get(granularity, ("microsecond", "second", "minute", "hour"))
    out = ts.replace(**dict.fromkeys(zero, 0))
    return out - timedelta(days=out.weekday()) if granularity == "week" else out


def following(start: datetime, granularity: str) -> datetime:
    """The start of the bucket after the one that begins at start."""
    _check(granularity)
    if granularity in _STEP:
        return start + _STEP[granularity]
    months = start.year * 12 + start.month - 1 + _MONTHS[granularity]
    return start.replace(year=months // 12, month=months % 12 + 1)


def expand(low: datetime, high: datetime, granularity: str) -> tuple[datetime, datetime]:
    """The smallest half-open range of whole buckets that holds low and high: the inverse of date_trunc."""
    return floor(low, granularity), following(floor(high, granularity), granularity)


def walk(start: datetime, end: datetime, granularity: str) -> Iterator[tuple[datetime, datetime]]:
    """Contiguous bucket ranges from start to end; the last is clamped to end."""
    _check(granularity)
    while start < end:
        nxt = min(following(floor(start, granularity), granularity), end)
        yield start, nxt
        start = nxt


def chunks_for(granularity: str) -> tuple[str, ...]:
    """Backfill chunks whose boundaries are boundaries of granularity too; weeks fit into nothing larger, and no chunk is under a minute."""
    _check(granularity)
    if granularity == "week":
        return ("week",)
    at = max(GRANULARITIES.index(granularity), GRANULARITIES.index("minute"))
    return tuple(g for g in GRANULARITIES[at:] if g != "week" or GRANULARITIES.index(granularity) < GRANULARITIES.index("week"))


def as_datetime(value: datetime | date | str) -> datetime:
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    return value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)


def metric_bounds(files: DataFrame, column: str) -> DataFrame:
    """(low, high, files), one row: the bounds of a time column over a table of files whose readable_metrics is a map or struct of
    {lower_bound, upper_bound} by column, or the same as JSON text; files: how many have them.

    Bounds are compared as instants, whatever zone they are written in, not as text; without a zone they are in the session's.
    """
    metrics = F.col("readable_metrics")
    if files.schema["readable_metrics"].dataType.typeName() == "string":
        metrics = F.from_json(metrics, "map<string, struct<lower_bound: string, upper_bound: string>>")
    own = metrics[column]
    low, high = (F.to_timestamp(own[k]) for k in ("lower_bound", "upper_bound"))
    return files.agg(F.min(low).alias("low"), F.max(high).alias("high"), F.count(F.when(low.isNotNull() & high.isNotNull(), 1)).alias("files"))


def literal(value: datetime, kind: str) -> Column:
    """value as a literal of a column's type (timestamp, timestamp_ntz or date)."""
    text = value.replace(tzinfo=None).isoformat(sep=" ", timespec="microseconds")
    return F.lit(text + ("+00:00" if kind == "timestamp" else "")).cast("timestamp" if kind == "timestamp" else "timestamp_ntz")


def between(column: str, start: datetime, end: datetime, kind: str) -> Column:
    """column in [start, end), in a form that reaches the Parquet scan."""
    return (F.col(f"`{column}`") >= literal(start, kind)) & (F.col(f"`{column}`") < literal(end, kind))
