"""The view engine's queries for the driver: each target is built through the engine, and DuckDB's one-shot aggregate is its oracle."""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.buckets import GRANULARITIES, chunks_for, expand, walk
from ..operators.detect import Action, detect_changes
from ..operators.refresh import output_schema, refresh
from ..sources.tablelog import SnapshotTable
from .viewdef import parse_view

Query = Callable[[SparkSession, str], DataFrame]


def _folder(spark: SparkSession) -> str:
    """A folder for the tables of one query: on the cluster's shared file system where it names one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        from uuid import uuid4

        return f"{base.rstrip('/')}/views-{uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="tidemark-views-")
    atexit.register(shutil.rmtree, path, True)
    return f"file://{path}"


class Lab:
    """A source table and the views over it, refreshed by hand."""

    def __init__(self, spark: SparkSession, schema, base: str | None = None) -> None:
        spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
        self.spark, self.base = spark, base or _folder(spark)
        self.source = SnapshotTable.create(spark, f"{self.base}/source", schema)
        self.bookmarks: dict[str, int] = {}

    def refresh(self, sql: str, name: str = "target", source: SnapshotTable | None = None, chunk: str | None = None, stop_after: int | None = None, replace_range: bool = False) -> tuple[SnapshotTable, Action]:
        """One tick of the view; stop_after interrupts a backfill after so many commits, without a bookmark."""
        source = source or self.source
        parsed = parse_view(self.spark, sql)
        target = SnapshotTable.create(self.spark, f"{self.base}/{name}", output_schema(self.spark, parsed, source))
        found = detect_changes(source, parsed.filter_column, parsed.granularity, self.bookmarks.get(name))
        if found.action is not Action.NO_CHANGE:
            for done, _ in enumerate(refresh(self.spark, parsed, source, target, found.filter_range, chunk, replace_range, found.current_snapshot), 1):
                if done == stop_after:
                    return target, found.action
        if found.current_snapshot is not None:
            self.bookmarks[name] = found.current_snapshot
        return target, found.action


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _whole(name: str, sql: str, chunk: str | None = None) -> Query:
    """The view by a full refresh; the table's own files are the source's files."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lab = Lab(spark, _table(spark, sf_dir, name).schema)
        lab.source.add_files([f"{sf_dir}/{name}.parquet"])
        return lab.refresh(sql, chunk=chunk)[0].read()

    return run


def _slices(df: DataFrame, column: str, cuts: list[datetime]) -> list[DataFrame]:
    at = lambda d: F.lit(d.isoformat(sep=" ")).cast("timestamp_ntz")
    out = []
    for a, b in itertools.pairwise([None, *cuts, None]):
        test = F.col(column).isNotNull()
        test = test & (F.col(column) >= at(a)) if a else test
        out.append(df.where(test & (F.col(column) < at(b)) if b else test))
    return out


def _fed(sql: str, order: list[int], compact: tuple[int, ...] = (), days: tuple[int, ...] = (4, 8, 13, 19, 25)) -> Query:
    """The view kept up to date while slices of events arrive in this order; compact: after which arrivals the source is compacted."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = _table(spark, sf_dir, "events")
        # cut inside hours, so that a later slice changes groups that an earlier one began
        parts = _slices(events, "ts", [datetime(2024, 1, d, 12, 37, 11) for d in days])
        lab, target = Lab(spark, events.schema), None
        for i, k in enumerate(order):
            lab.source.append(parts[k])
            target, _ = lab.refresh(sql)
            if i in compact:
                lab.source.compact()
                _, action = lab.refresh(sql)
                assert action is Action.NO_CHANGE, action
        return target.read()

    return run


def _ohlcv(granularity: str) -> str:
    return f"""SELECT event_type AS symbol, CAST(date_trunc('{granularity}', ts) AS TIMESTAMP_NTZ) AS bucket, min_by(value, ts) AS open, max(value) AS high,
min(value) AS low, max_by(value, ts) AS close, round(sum(value), 4) AS volume, count(*) AS trade_count
FROM market.events GROUP BY event_type, CAST(date_trunc('{granularity}', ts) AS TIMESTAMP_NTZ)"""


def _plain(sql: str, table: str, column: str) -> str:
    """A view's query as DuckDB's one-shot aggregate: the same text over the driver's table, without null times."""
    import re

    text = sql.replace("TIMESTAMP_NTZ", "TIMESTAMP").replace("min_by(", "arg_min(").replace("max_by(", "arg_max(")
    head, tail = re.split(r"FROM market\.\w+(?: AS e)?", text, maxsplit=1)
    source = f"FROM (SELECT * FROM {table} WHERE {column} IS NOT NULL) e"
    return f"{head}{source}{tail}"


_SUMS = """SELECT event_type, CAST(date_trunc('{g}', ts) AS TIMESTAMP_NTZ) AS {g}, round(sum(value), 4) AS volume, count(*) AS trade_count FROM market.events GROUP BY 1, 2"""
_COUNTS = "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS hour, count(*) AS trade_count FROM market.events GROUP BY CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ)"
_HIGH = "SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP_NTZ) AS day, max(value) AS high, max_by(user_id, ts) AS last_user FROM market.events GROUP BY event_type, day"
_LARGE = "SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS hour, count(*) AS trade_count, round(sum(value), 4) AS volume FROM market.events WHERE value > 50 GROUP BY event_type, hour"
_OR = "SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP_NTZ) AS day, count(*) AS n -- a comment\nFROM market.events AS e WHERE value > 90 OR e.event_type = 'click' GROUP BY e.event_type, day"
_MULTI = "SELECT event_type, user_id % 7 AS grp, CAST(date_trunc('day', ts) AS TIMESTAMP_NTZ) AS day, count(*) AS n, round(avg(value), 6) AS mean FROM market.events GROUP BY event_type, user_id % 7, CAST(date_trunc('day', ts) AS TIMESTAMP_NTZ)"
_HAVING = "SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS hour, count(*) AS n FROM market.events GROUP BY 1, 2 HAVING count(*) < 4 ORDER BY n"
_ORDERS = "SELECT o_orderstatus, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM market.orders GROUP BY o_orderstatus, month"
_LINES = "SELECT l_returnflag, l_linestatus, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP_NTZ) AS month, round(sum(l_quantity), 2) AS quantity, count(*) AS n FROM market.lineitem GROUP BY {by}"
_ANY = """SELECT l_returnflag, CAST(date_trunc('year', l_shipdate) AS TIMESTAMP_NTZ) AS year, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_quantity), 6) AS spread,
count(DISTINCT l_partkey) AS parts, count(*) FILTER (WHERE l_discount > 0.05) AS discounted FROM market.lineitem GROUP BY l_returnflag, year"""
_ORDERED = """SELECT l_returnflag, CAST(date_trunc('quarter', l_shipdate) AS TIMESTAMP_NTZ) AS quarter, round(percentile(l_quantity, 0.5), 6) AS median,
array_join(array_sort(collect_set(l_linestatus)), ',') AS statuses, max(struct(l_extendedprice, l_orderkey)).l_orderkey AS dearest, bool_or(l_tax > 0.07) AS taxed
FROM market.lineitem GROUP BY l_returnflag, quarter"""
_ORDERED_SQL = """SELECT l_returnflag, CAST(date_trunc('quarter', l_shipdate) AS TIMESTAMP) AS quarter, round(quantile_cont(l_quantity, 0.5), 6) AS median,
string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS statuses, arg_max(l_orderkey, (l_extendedprice, l_orderkey)) AS dearest, bool_or(l_tax > 0.07) AS taxed
FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2"""
_NULLS = "SELECT nullif(event_type, 'click') AS kind, CAST(date_trunc('week', ts) AS TIMESTAMP_NTZ) AS week, count(*) AS n FROM market.events GROUP BY nullif(event_type, 'click'), CAST(date_trunc('week', ts) AS TIMESTAMP_NTZ)"
_KEYS = "SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP_NTZ) AS day FROM market.events GROUP BY event_type, day"


def _direct(sql: str) -> str:
    """date_trunc as the projection itself, which chunked backfills need: on NTZ columns the bucket then is an instant."""
    import re

    return re.sub(r"CAST\((date_trunc\('\w+', \w+\)) AS TIMESTAMP_NTZ\)", r"\1", sql)


def _bare_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HAVING over date_trunc itself, whose output is an instant."""
    found = _fed(_direct(_HAVING), [0, 1, 2, 3, 4, 5])(spark, sf_dir)
    return found.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def _chunked(chunks: list[tuple[str, int | None]]) -> Query:
    """A backfill of orders by month; (chunk, stop after so many commits) for each attempt."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lab = Lab(spark, _table(spark, sf_dir, "orders").schema)
        lab.source.add_files([f"{sf_dir}/orders.parquet"])
        target = None
        for chunk, stop in chunks:
            target, _ = lab.refresh(_direct(_ORDERS), chunk=chunk, stop_after=stop)
        return target.read().withColumn("month", F.col("month").cast("timestamp_ntz"))

    return run


def _chain(deep: bool) -> Query:
    """Views over views: minutes to hours, and hours to days."""
    one = "SELECT event_type, date_trunc('minute', ts) AS bucket, sum(value) AS volume, count(*) AS trade_count FROM market.events GROUP BY 1, 2"
    up = "SELECT event_type, date_trunc('{g}', bucket) AS {n}, sum(volume) AS volume, sum(trade_count) AS trade_count FROM market.below GROUP BY 1, 2"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = _table(spark, sf_dir, "events")
        lab = Lab(spark, events.schema)
        last = None
        for part in [_slices(events, "ts", [datetime(2024, 1, 9, 7, 30), datetime(2024, 1, 20, 5)])[k] for k in (1, 2, 0)]:
            lab.source.append(part)
            minutes, _ = lab.refresh(one, "minutes")
            last, _ = lab.refresh(up.format(g="hour", n="bucket").replace("'hour', bucket) AS bucket", "'hour', bucket) AS hour_bucket"), "hours", minutes)
            if deep:
                last, _ = lab.refresh(up.format(g="day", n="day").replace("date_trunc('day', bucket)", "date_trunc('day', hour_bucket)"), "days", last)
        name = "day" if deep else "hour_bucket"
        return last.read().select("event_type", F.col(name).cast("timestamp_ntz").alias("bucket"), F.round("volume", 4).alias("volume"), "trade_count")

    return run


def _chain_sql(g: str) -> str:
    return f"SELECT event_type, CAST(date_trunc('{g}', ts) AS TIMESTAMP) AS bucket, round(sum(value), 4) AS volume, count(*) AS trade_count FROM events WHERE ts IS NOT NULL GROUP BY 1, 2"


# --- decision tables ---

_LOW, _HIGH_TS = datetime(2024, 2, 29, 13, 47, 5, 123456), datetime(2024, 12, 31, 23, 59, 59, 999999)


def _ntz(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


def expand_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(g, *(x.isoformat(sep=" ") for x in expand(_LOW, _HIGH_TS, g))) for g in GRANULARITIES]
    return _ntz(spark.createDataFrame(rows, "granularity string, range_start string, range_end string"), "range_start", "range_end")


def walk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, a.isoformat(sep=" "), b.isoformat(sep=" ")) for i, (a, b) in enumerate(walk(datetime(2024, 1, 15), datetime(2024, 6, 10), "month"))]
    return _ntz(spark.createDataFrame(rows, "n int, range_start string, range_end string"), "range_start", "range_end")


def chunk_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(g, c) for g in GRANULARITIES for c in chunks_for(g)], "granularity string, chunk string")


def detect_truth_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each decision of the detector, made on a real log."""
    events = _table(spark, sf_dir, "events")
    lab = Lab(spark, events.schema)
    rows: list[tuple[int, str, str]] = []

    def note(case: str, last: int | None) -> None:
        try:
            outcome = detect_changes(lab.source, "ts", "day", last).action.value
        except Exception as e:
            outcome = type(e).__name__
        rows.append((len(rows) + 1, case, outcome))

    note("no snapshots", None)
    parts = _slices(events, "ts", [datetime(2024, 1, 3), datetime(2024, 1, 5)])
    first = lab.source.append(parts[0]).snapshot_id
    note("no bookmark", None)
    note("bookmark is current", first)
    second = lab.source.append(parts[1]).snapshot_id
    note("appended", first)
    note("bookmark is gone", 999)
    lab.source.compact()
    note("only compacted", second)
    lab.source.commit("append", [])
    note("appended no files", second)
    lab.source.delete_where(F.col("value") < 0)
    note("deleted", second)
    return spark.createDataFrame(rows, "n int, case_name string, outcome string")


_TRUTH = (("no snapshots", "no_change"), ("no bookmark", "full_refresh"), ("bookmark is current", "no_change"), ("appended", "incremental"), ("bookmark is gone", "ExpiredSnapshotError"), ("only compacted", "no_change"), ("appended no files", "no_change"), ("deleted", "UnexpectedOperationError"))


def metadata(which: str) -> Query:
    """A metadata table of a source that was made from the table's own file, without paths and times."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lab = Lab(spark, _table(spark, sf_dir, "events").schema)
        lab.source.add_files([f"{sf_dir}/events.parquet"])
        lab.refresh(_KEYS)
        lab.refresh(_COUNTS, "hours")
        found = lab.source.system_table(which)
        if which == "snapshots":
            return found.select("snapshot_id", "operation")
        bounds = F.col("readable_metrics")["ts"]
        if which == "files":
            found = found.groupBy("content").agg(F.sum("record_count").alias("record_count"), F.min(bounds["lower_bound"]).alias("low"), F.max(bounds["upper_bound"]).alias("high"))
        else:
            found = found.groupBy("snapshot_id", "status").agg(F.sum("record_count").alias("record_count"), F.min(bounds["lower_bound"]).alias("low"), F.max(bounds["upper_bound"]).alias("high"))
        return found

    return run


_BOUNDS = "count(*) AS record_count, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') AS low, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') AS high FROM events"
_METADATA = {
    "metadata_snapshots": "SELECT CAST(1 AS BIGINT) AS snapshot_id, 'append' AS operation",
    "metadata_files": f"SELECT CAST(0 AS INTEGER) AS content, {_BOUNDS}",
    "metadata_all_entries": f"SELECT CAST(1 AS BIGINT) AS snapshot_id, CAST(1 AS INTEGER) AS status, {_BOUNDS}",
}


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else x if x.startswith(("TIMESTAMP", "CAST")) else f"'{x}'" for x in r) + ")" for r in rows) + ")"


def _bucket(g: str) -> str:
    return f"SELECT event_type, CAST(date_trunc('{g}', ts) AS TIMESTAMP_NTZ) AS bucket, count(*) AS n, max(value) AS top FROM market.events GROUP BY event_type, bucket"


_EVENT_VIEWS: dict[str, tuple[str, Query]] = {
    **{f"ohlcv_1{g[0]}": (_ohlcv(g), _whole("events", _ohlcv(g))) for g in ("minute", "hour", "day")},
    "weekly_volume": (_SUMS.format(g="week"), _fed(_SUMS.format(g="week"), [0, 1, 2, 3, 4, 5])),
    "monthly_volume": (_SUMS.format(g="month"), _fed(_SUMS.format(g="month"), [0, 2, 1, 3, 5, 4])),
    "hourly_trade_count": (_COUNTS, _whole("events", _COUNTS)),
    "symbol_daily_high": (_HIGH, _whole("events", _HIGH)),
    "large_trades_hourly": (_LARGE, _whole("events", _LARGE)),
    "where_or_parenthesised": (_OR, _fed(_OR, [0, 1, 2, 3, 4, 5])),
    **{f"bucket_{g}": (_bucket(g), _whole("events", _bucket(g))) for g in GRANULARITIES},
    "incremental_append": (_ohlcv("hour"), _fed(_ohlcv("hour"), [0, 1, 2, 3, 4, 5])),
    "late_arrival": (_ohlcv("day"), _fed(_ohlcv("day"), [5, 3, 4, 0, 2, 1])),
    "multi_key": (_MULTI, _fed(_MULTI, [1, 0, 2, 3, 5, 4])),
    "compaction_interleaved": (_ohlcv("hour"), _fed(_ohlcv("hour"), [0, 1, 2, 3, 4, 5], compact=(2, 4))),
    "having_replaces_range": (_HAVING, _fed(_HAVING, [0, 1, 2, 3, 4, 5])),
    "null_key_upsert": (_NULLS, _fed(_NULLS, [0, 1, 2, 3, 4, 5])),
    "keys_only": (_KEYS, _fed(_KEYS, [1, 0, 2, 3, 4, 5])),
}
_LINE_VIEWS = {
    "positional_group_by": _LINES.format(by="1, 2, 3"),
    "alias_group_by": _LINES.format(by="l_returnflag, l_linestatus, month"),
    "expr_group_by": _LINES.format(by="l_returnflag, l_linestatus, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP_NTZ)"),
    "any_aggregate": _ANY,
}
_CHUNKS = {"chunked_backfill": [("quarter", None)], "chunked_resume": [("quarter", 9), ("quarter", None)], "chunk_resize": [("year", 3), ("month", 14), ("quarter", None)]}


def queries() -> dict[str, Query]:
    out = {k: q for k, (_, q) in _EVENT_VIEWS.items()}
    out |= {k: _whole("lineitem", sql) for k, sql in _LINE_VIEWS.items()}
    out |= {k: _chunked(c) for k, c in _CHUNKS.items()}
    out |= {"chained_1m_to_1h": _chain(False), "chained_3_deep": _chain(True)}
    out |= {"expand_bounds": expand_bounds, "walk_buckets": walk_table, "chunk_matrix": chunk_matrix, "detect_truth_table": detect_truth_table}
    out |= {"having_bare_bucket": _bare_having, "ordered_aggregates": _whole("lineitem", _ORDERED)}
    return out | {f"metadata_{w}": metadata(w) for w in ("snapshots", "all_entries", "files")}


def oracle_sql() -> dict[str, str]:
    out = {k: _plain(sql, "events", "ts") for k, (sql, _) in _EVENT_VIEWS.items()}
    out |= {k: _plain(sql, "lineitem", "l_shipdate") for k, sql in _LINE_VIEWS.items()}
    out |= {k: _plain(_ORDERS, "orders", "o_orderdate") for k in _CHUNKS}
    out |= {"chained_1m_to_1h": _chain_sql("hour"), "chained_3_deep": _chain_sql("day")}
    low, high = (f"TIMESTAMP '{x.isoformat(sep=' ')}'" for x in (_LOW, _HIGH_TS))
    step = lambda g: f"INTERVAL {3 if g == 'quarter' else 1} {'month' if g == 'quarter' else g}"
    out["expand_bounds"] = " UNION ALL ".join(f"SELECT '{g}' AS granularity, CAST(date_trunc('{g}', {low}) AS TIMESTAMP) AS range_start, CAST(date_trunc('{g}', {high}) + {step(g)} AS TIMESTAMP) AS range_end" for g in GRANULARITIES)
    months = [("2024-01-15", "2024-02-01"), ("2024-02-01", "2024-03-01"), ("2024-03-01", "2024-04-01"), ("2024-04-01", "2024-05-01"), ("2024-05-01", "2024-06-01"), ("2024-06-01", "2024-06-10")]
    out["walk_buckets"] = f"SELECT * FROM {_values([(i, f'TIMESTAMP {a!r}', f'TIMESTAMP {b!r}') for i, (a, b) in enumerate(months)])} AS t(n, range_start, range_end)"
    allowed = {g: "minute hour day week month quarter year" for g in ("millisecond", "second", "minute")} | {"hour": "hour day week month quarter year", "day": "day week month quarter year", "week": "week", "month": "month quarter year", "quarter": "quarter year", "year": "year"}
    out["chunk_matrix"] = f"SELECT * FROM {_values([(g, c) for g, cs in allowed.items() for c in cs.split()])} AS t(granularity, chunk)"
    out |= _METADATA | {"having_bare_bucket": _plain(_HAVING, "events", "ts"), "ordered_aggregates": _ORDERED_SQL}
    out["detect_truth_table"] = f"SELECT * FROM {_values([(i, a, b) for i, (a, b) in enumerate(_TRUTH, 1)])} AS t(n, case_name, outcome)"
    return out
