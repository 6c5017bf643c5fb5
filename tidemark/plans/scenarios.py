"""Queries that take a view through what its life holds: the service's ticks and maintenance, streams, expiry, vacated buckets, pinned
snapshots, chunk history and refused forms. Each result has its SQL; where tables are read, over all their rows."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ServerConfig, ViewConfig, data_size, duration, validate
from ..errors import ViewError
from ..functions.buckets import metric_bounds
from ..operators.detect import Action, detect_changes
from ..operators.refresh import output_schema, refresh
from ..service import Catalog, Service
from ..sources.seed import HOURS, OPENS, SYMBOLS, trades
from ..sources.tablelog import SnapshotTable
from ..state import QueryHistory
from ..streaming.driver import batch_refresh, stream_view
from .catalog import Lab, Query, _folder, _slices, _table
from .viewdef import parse_view

HOURLY = """SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS hour, count(*) AS n, round(sum(value), 4) AS volume
FROM market.events GROUP BY event_type, hour"""
_HOURLY_SQL = """SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS n, round(sum(value), 4) AS volume
FROM events WHERE ts IS NOT NULL{more} GROUP BY 1, 2"""
CUTS = [datetime(2024, 1, d, 12, 37, 11) for d in (6, 12, 21)]


def _driver_folder() -> str:
    """For the service's own small files (settings, state), which only the driver reads."""
    path = tempfile.mkdtemp(prefix="tidemark-service-")
    atexit.register(shutil.rmtree, path, True)
    return path


def service_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view kept by the service's ticks while slices arrive in disorder, with all maintenance after each tick and a restart half-way."""
    events = _table(spark, sf_dir, "events")
    here, catalog = _driver_folder(), Catalog(spark, _folder(spark))
    source = SnapshotTable.create(spark, catalog.table("market.events").path, events.schema)
    start = lambda: Service(spark, catalog, ServerConfig(), os.path.join(here, "config.yaml"), os.path.join(here, "views.yaml"))
    service = start()
    view = ViewConfig("hourly", HOURLY, "market.hourly", maintenance_interval_seconds=1, expire_snapshots_retention="0s", remove_orphan_files_retention="0s")
    service.create(view)
    parts, actions = _slices(events, "ts", CUTS), []
    for k in (2, 0, 3, 1):
        source.append(parts[k])
        actions += [service.refresh_view("hourly"), service.refresh_view("hourly")]
        if k == 0:  # bookmark, views and status come from what was written
            service.close()
            service = start()
            service.reload()
    assert actions == ["full", "skip", *["incremental", "skip"] * 3], actions
    out = catalog.table("market.hourly").read()
    service.close()
    return out


def maintained_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and target are compacted, expired and swept between refreshes; the bookmark stays in the log."""
    events = _table(spark, sf_dir, "events")
    lab, target = Lab(spark, events.schema), None
    for part in _slices(events, "ts", CUTS):
        lab.source.append(part)
        target, _ = lab.refresh(HOURLY)
        lab.source.compact()
        _, action = lab.refresh(HOURLY)
        assert action is Action.NO_CHANGE, action
        for table in (lab.source, target):
            table.compact()
            table.expire_snapshots(timedelta(0))
            table.remove_orphan_files(timedelta(0))
        lab.refresh(HOURLY)
    return target.read()


def vacated_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source is overwritten by fewer rows: buckets that are empty now leave the view, as replace_range is on."""
    events = _table(spark, sf_dir, "events")
    lab = Lab(spark, events.schema)
    lab.source.append(events)
    lab.refresh(HOURLY, replace_range=True)
    lab.source.overwrite(events.where("value > 60"))
    return lab.refresh(HOURLY, replace_range=True)[0].read()


def empty_then_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view over a source that has a snapshot but no rows: its first refresh writes nothing and is bookmarked, the next is incremental."""
    events = _table(spark, sf_dir, "events")
    lab = Lab(spark, events.schema)
    lab.source.commit("append", [])
    target, first = lab.refresh(HOURLY)
    assert first is Action.FULL_REFRESH and target.current() is None, first
    lab.source.append(events)
    target, second = lab.refresh(HOURLY)
    assert second is Action.INCREMENTAL, second
    return target.read()


def pinned_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that arrive after detection are not in the refresh that it began."""
    events = _table(spark, sf_dir, "events")
    lab = Lab(spark, events.schema)
    old, new = _slices(events, "ts", CUTS[:1])
    lab.source.append(old)
    parsed = parse_view(spark, HOURLY)
    found = detect_changes(lab.source, "ts", "hour", None)
    lab.source.append(new)
    target = SnapshotTable.create(spark, f"{lab.base}/target", output_schema(spark, parsed, lab.source))
    for _ in refresh(spark, parsed, lab.source, target, found.filter_range, snapshot=found.current_snapshot):
        pass
    return target.read()


def two_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams feed one source and its view, each with its own checkpoint; one of them runs again, and a batch is delivered twice."""
    events = _table(spark, sf_dir, "events")
    lab = Lab(spark, events.schema)
    path, again = f"{lab.base}/target", f"{lab.base}/checkpoint-{uuid.uuid4().hex}"
    read = lambda: spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    for test, checkpoint in (("value > 60", f"{lab.base}/checkpoint"), ("value <= 60 OR value IS NULL", again), ("value <= 60 OR value IS NULL", again)):
        query = stream_view(spark, read().where(test), HOURLY, lab.source, path, checkpoint)
        query.awaitTermination()
    target = SnapshotTable(spark, path)
    batch_refresh(HOURLY, lab.source, target, again)(events.where("value <= 60 OR value IS NULL"), 0)
    return target.read()


def session_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view that calls a function of the session."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tidemark_net(x DOUBLE, rate DOUBLE) RETURNS DOUBLE RETURN x * (1 - rate)")
    lines = _table(spark, sf_dir, "lineitem")
    lab = Lab(spark, lines.schema)
    lab.source.add_files([f"{sf_dir}/lineitem.parquet"])
    return lab.refresh(
        "SELECT L_RETURNFLAG AS flag, CAST(DATE_TRUNC('MONTH', L_ShipDate) AS TIMESTAMP_NTZ) AS Month, round(sum(tidemark_net(l_extendedprice, l_discount)), 2) AS net "
        "FROM market.lineitem GROUP BY flag, MONTH;"
    )[0].read().withColumnRenamed("Month", "month")


def chunk_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the state keeps of a backfill by quarters: the newest five commits with the source rows that each read."""
    lab = Lab(spark, _table(spark, sf_dir, "orders").schema)
    lab.source.add_files([f"{sf_dir}/orders.parquet"])
    parsed = parse_view(spark, "SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n FROM market.orders GROUP BY 1")
    target = SnapshotTable.create(spark, f"{lab.base}/target", output_schema(spark, parsed, lab.source))
    history = QueryHistory(os.path.join(_driver_folder(), "state.db"), keep=5).open()
    for done in refresh(spark, parsed, lab.source, target, chunk="quarter"):
        history.append("orders", done)
    rows = [(i, q.stage, q.processed_rows) for i, q in enumerate(history.recent("orders"), 1)]
    history.close()
    return spark.createDataFrame(rows, "newest int, stage string, processed_rows long")


_TRADES = """SELECT symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS bucket, round(min_by(price, ts), 2) AS open, round(max(price), 2) AS high,
round(min(price), 2) AS low, round(max_by(price, ts), 2) AS close, sum(quantity) AS volume, count(*) AS n FROM market.trades GROUP BY 1, 2"""


def seeded_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars over the demo trades, a third of the month after the other."""
    demo = trades(spark)
    lab, target = Lab(spark, demo.schema), None
    for part in _slices(demo, "ts", [datetime(2026, 1, 11, 15, 20), datetime(2026, 1, 21, 14, 5)]):
        lab.source.append(part)
        target, _ = lab.refresh(_TRADES)
    return target.read()


def bounds_of_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time bounds of events from the files' metrics, as a map and as JSON text."""
    events = _table(spark, sf_dir, "events")
    lab = Lab(spark, events.schema)
    for part in _slices(events, "ts", CUTS):
        lab.source.append(part.coalesce(1))
    files = lab.source.system_table("files")
    forms = {"map": files, "json": files.withColumn("readable_metrics", F.to_json("readable_metrics"))}
    found = [metric_bounds(f, "ts").select(F.lit(k).alias("form"), F.col("low").cast("timestamp_ntz").alias("low"), F.col("high").cast("timestamp_ntz").alias("high"), "files") for k, f in forms.items()]
    return found[0].unionByName(found[1])


# --- decision tables ---

_VIEW = "SELECT symbol, date_trunc('hour', ts) AS hour, sum(x) AS total FROM trades GROUP BY symbol, date_trunc('hour', ts)"


def _with(old: str, new: str) -> str:
    assert old in _VIEW
    return _VIEW.replace(old, new)


#: (form, query, merge keys or a word of the refusal)
FORMS = (
    ("by expressions", _VIEW, "symbol,hour"),
    ("by positions", _with("BY symbol, date_trunc('hour', ts)", "BY 1, 2"), "symbol,hour"),
    ("by aliases of any case", _with("BY symbol, date_trunc('hour', ts)", "BY SYMBOL, Hour"), "symbol,hour"),
    ("trailing semicolon", _VIEW + " ;", "symbol,hour"),
    ("sorted", _VIEW + " ORDER BY total", "symbol,hour"),
    ("empty", " ", "empty"),
    ("two statements", "SELECT 1; SELECT 2", "single"),
    ("join", _with("FROM trades", "FROM trades JOIN q USING (k)"), "joins"),
    ("comma join", _with("FROM trades", "FROM trades, q"), "joins"),
    ("union", _VIEW + " UNION ALL " + _VIEW, "set operations"),
    ("CTE", "WITH c AS (SELECT 1) " + _VIEW, "CTEs"),
    ("subquery in FROM", _with("FROM trades", "FROM (SELECT * FROM trades) t"), "subqueries"),
    ("IN subquery", _with("FROM trades", "FROM trades WHERE x IN (SELECT y FROM z)"), "subqueries"),
    ("EXISTS subquery", _with("FROM trades", "FROM trades WHERE EXISTS (SELECT 1 FROM z)"), "subqueries"),
    ("no GROUP BY", "SELECT symbol FROM trades", "GROUP BY"),
    ("distinct", "SELECT DISTINCT symbol FROM trades", "DISTINCT"),
    ("star", "SELECT * FROM trades GROUP BY date_trunc('hour', ts)", "alias"),
    ("no alias", _with(" AS total", ""), "alias"),
    ("window function", _with("sum(x)", "sum(x) OVER ()"), "window"),
    ("limit", _VIEW + " LIMIT 3", "LIMIT"),
    ("arithmetic on a bucket", _with("'hour', ts) AS", "'hour', ts) + INTERVAL 1 DAY AS"), "arithmetic"),
    ("unknown granularity", _VIEW.replace("'hour'", "'fortnight'"), "granularity"),
    ("two granularities", _with("'hour', ts) AS", "'day', ts) AS"), "multiple distinct granularities"),
    ("two time columns", _with("'hour', ts) AS", "'hour', tz) AS"), "multiple columns"),
    ("bucket of an expression", _VIEW.replace("ts)", "CAST(ts AS DATE))"), "malformed"),
    ("bucket not grouped", "SELECT symbol, max(date_trunc('hour', ts)) AS h FROM trades GROUP BY symbol", "GROUP BY must hold"),
    ("key not in the output", _VIEW + ", other", "does not match"),
    ("grouping sets", _VIEW.replace("GROUP BY symbol, date_trunc('hour', ts)", "GROUP BY ROLLUP (symbol, date_trunc('hour', ts))"), "grouping sets"),
    ("position out of range", _with("BY symbol, date_trunc('hour', ts)", "BY 1, 9"), "out of range"),
    ("placeholder", _with("FROM trades", "FROM trades WHERE {range_filter}"), "range_filter"),
)


def view_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each form of a view's query: its merge keys, or which refusal it meets ('other' where it is not the one that its row expects)."""
    rows = []
    for form, sql, expected in FORMS:
        try:
            rows.append((form, True, ",".join(parse_view(spark, sql).merge_keys)))
        except ViewError as e:
            rows.append((form, False, expected if expected in str(e) else "other"))
    return spark.createDataFrame(rows, "form string, accepted boolean, outcome string")


#: (setting, value, seconds or bytes, or -1 where it is refused)
SETTINGS = (
    ("duration", "90s", 90), ("duration", "5m", 300), ("duration", "2h", 7200), ("duration", "7d", 604800), ("duration", "7w", -1), ("duration", "", -1),
    ("data_size", "512B", 512), ("data_size", "2KB", 2048), ("data_size", "100MB", 104857600), ("data_size", "3GB", 3221225472), ("data_size", "1TB", 1099511627776), ("data_size", "x", -1),
    ("full_refresh_chunk", "day", 1), ("full_refresh_chunk", "minute", -1), ("name", "hourly_2", 1), ("name", "a b", -1), ("query_timeout_seconds", "0", -1), ("query_timeout_seconds", "30", 1),
)


def config_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings and what they come to: seconds, bytes, 1 for one that a view may have; -1 if refused."""

    def checked(kind: str, text: str) -> int:
        value = int(text) if kind == "query_timeout_seconds" else text
        validate(spark, ViewConfig(**({"name": "v", "query": _VIEW, "target_table": "market.v"} | {kind: value})))
        return 1

    read: dict[str, Callable[[str], int]] = {"duration": lambda x: int(duration(x).total_seconds()), "data_size": data_size}
    rows = []
    for kind, text, _ in SETTINGS:
        try:
            rows.append((kind, text, read[kind](text) if kind in read else checked(kind, text)))
        except ViewError:
            rows.append((kind, text, -1))
    return spark.createDataFrame(rows, "setting string, text string, amount long")


def _rows_sql(rows, names: str) -> str:
    put = lambda x: str(x).upper() if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(put, r)) + ')' for r in rows)}) AS t({names})"


def queries() -> dict[str, Query]:
    found = (service_ticks, maintained_target, vacated_buckets, empty_then_filled, pinned_snapshot, two_streams, session_function, chunk_history, seeded_trades, bounds_of_metrics, view_forms, config_values)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    whole = _HOURLY_SQL.format(more="")
    accepted = {"symbol,hour"}
    return {
        **dict.fromkeys(("service_ticks", "maintained_target", "empty_then_filled", "two_streams"), whole),
        "vacated_buckets": _HOURLY_SQL.format(more=" AND value > 60"),
        "pinned_snapshot": _HOURLY_SQL.format(more=f" AND ts < TIMESTAMP '{CUTS[0].isoformat(sep=' ')}'"),
        "session_function": """SELECT l_returnflag AS flag, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS month,
round(sum(l_extendedprice * (1 - l_discount)), 2) AS net FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2""",
        "chunk_history": """SELECT CAST(row_number() OVER (ORDER BY quarter DESC) AS INTEGER) AS newest, 'chunk_merge' AS stage, n AS processed_rows
FROM (SELECT date_trunc('quarter', o_orderdate) AS quarter, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1) ORDER BY quarter DESC LIMIT 5""",
        "seeded_trades": f"""WITH i AS (SELECT range AS i, range // 3 AS tick FROM range({30 * HOURS * 60 * 4 * 3})),
t AS (SELECT TIMESTAMP '2026-01-01' + to_seconds((tick // 4 // {HOURS * 60}) * 86400 + {OPENS * 3600} + (tick // 4 % {HOURS * 60}) * 60 + (tick % 4) * 15) AS ts,
  {list(SYMBOLS)!r}[i % 3 + 1] AS symbol, 100 + 50 * (i % 3) + ((i * 7919 + 104729) % 1999) / 100 AS price, 1 + (i * 31) % 97 AS quantity FROM i)
SELECT symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket, round(arg_min(price, ts), 2) AS open, round(max(price), 2) AS high,
  round(min(price), 2) AS low, round(arg_max(price, ts), 2) AS close, CAST(sum(quantity) AS BIGINT) AS volume, count(*) AS n FROM t GROUP BY 1, 2""",
        "bounds_of_metrics": f"""WITH p AS (SELECT ts, {' + '.join(f"CAST(ts >= TIMESTAMP '{c.isoformat(sep=' ')}' AS INTEGER)" for c in CUTS)} AS part FROM events WHERE ts IS NOT NULL)
SELECT form, min(ts) AS low, max(ts) AS high, count(DISTINCT part) AS files FROM p, (VALUES ('map'), ('json')) AS f(form) GROUP BY form""",
        "view_forms": _rows_sql([(f, e in accepted, e) for f, _, e in FORMS], "form, accepted, outcome"),
        "config_values": _rows_sql(SETTINGS, "setting, text, amount"),
    }
