import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.errors import CommitConflictError, ExpiredSnapshotError, UnexpectedOperationError
from tidemark.operators.detect import Action, detect_changes
from tidemark.plans.catalog import Lab
from tidemark.plans.viewdef import parse_view

SCHEMA = "symbol string, ts timestamp, price double, quantity double"
WEEK = "SELECT symbol, date_trunc('week', ts) AS week, max(price) AS high, min(price) AS low, sum(quantity) AS volume, count(*) AS n FROM m.trades GROUP BY 1, 2"


def trades(spark, *rows):
    return spark.createDataFrame([(s, datetime.fromisoformat(t).replace(tzinfo=UTC), float(p), float(q)) for s, t, p, q in rows], SCHEMA)


@pytest.fixture
def lab(spark):
    return Lab(spark, spark.createDataFrame([], SCHEMA).schema)


def found(table):
    return {(r["symbol"], r["week"].date().isoformat()): (r["volume"], r["n"]) for r in table.read().collect()}


def test_weekly_late_rows_and_compaction(spark, lab):
    lab.source.append(trades(spark, ("A", "2026-04-06", 150, 100), ("A", "2026-04-07", 160, 200)))
    target, action = lab.refresh(WEEK)
    assert action is Action.FULL_REFRESH and found(target) == {("A", "2026-04-06"): (300, 2)}
    lab.source.append(trades(spark, ("A", "2026-04-13", 155, 50)))
    target, action = lab.refresh(WEEK)
    assert action is Action.INCREMENTAL and found(target) == {("A", "2026-04-06"): (300, 2), ("A", "2026-04-13"): (50, 1)}
    before = lab.bookmarks["target"]
    late = lab.source.append(trades(spark, ("A", "2026-04-08", 155, 50)))
    assert detect_changes(lab.source, "ts", "week", before).filter_range == (datetime(2026, 4, 6, tzinfo=UTC), datetime(2026, 4, 13, tzinfo=UTC))
    target, _ = lab.refresh(WEEK)
    assert found(target) == {("A", "2026-04-06"): (350, 3), ("A", "2026-04-13"): (50, 1)}
    was = target.current()
    assert lab.source.compact().operation == "replace"
    assert lab.refresh(WEEK)[1] is Action.NO_CHANGE and target.current() == was and lab.bookmarks["target"] > late.snapshot_id
    with pytest.raises(ExpiredSnapshotError):
        detect_changes(lab.source, "ts", "week", 99)
    lab.source.delete_where(F.col("price") > 155)
    with pytest.raises(UnexpectedOperationError):
        lab.refresh(WEEK)


def test_null_keys_upsert_once_and_overwrite_rebuilds_vacated_buckets(spark, lab):
    lab.source.append(trades(spark, (None, "2026-04-06", 1, 1), (None, "2026-04-14", 1, 5)))
    lab.refresh(WEEK)
    lab.source.append(trades(spark, (None, "2026-04-07", 1, 1)))
    target, _ = lab.refresh(WEEK)
    assert found(target) == {(None, "2026-04-06"): (2, 2), (None, "2026-04-13"): (5, 1)}
    lab.source.overwrite(trades(spark, (None, "2026-04-06", 1, 7)))
    target, _ = lab.refresh(WEEK, replace_range=True)
    assert found(target) == {(None, "2026-04-06"): (7, 1)}


def test_random_slices_match_the_whole(spark, lab):
    rng = random.Random(4)
    rows = [(rng.choice("ABC"), (datetime(2026, 1, 1) + timedelta(minutes=rng.randrange(60 * 24 * 40))).isoformat(), rng.randrange(100), rng.randrange(9)) for _ in range(120)]
    target = None
    for i in range(0, len(rows), 40):
        lab.source.append(trades(spark, *rows[i : i + 40]))
        target, _ = lab.refresh(WEEK)
    whole = trades(spark, *rows).groupBy("symbol", F.date_trunc("week", "ts").alias("week")).agg(F.sum("quantity").alias("volume"), F.count("*").alias("n"))
    assert found(target) == {(r["symbol"], r["week"].date().isoformat()): (r["volume"], r["n"]) for r in whole.collect()}


def test_conflict_expiry_and_orphans(spark, lab):
    lab.source.append(trades(spark, ("A", "2026-04-06", 1, 1)))
    with pytest.raises(CommitConflictError):
        lab.source.commit("append", [], expected=0)
    lab.source.append(trades(spark, ("A", "2026-04-07", 1, 1)))
    assert lab.source.expire_snapshots(timedelta(0)) == 1
    assert lab.source.read().count() == 2
    lab.source._write(trades(spark, ("A", "2026-04-07", 1, 1)))  # a crash before the commit
    assert lab.source.remove_orphan_files(timedelta(seconds=-5)) == 1
    assert lab.source.read().count() == 2


def test_range_reaches_the_scan(spark, lab):
    lab.source.append(trades(spark, ("A", "2026-04-06", 1, 1)))
    df = lab.source.read(None, "ts", datetime(2026, 4, 6, tzinfo=UTC), datetime(2026, 4, 7, tzinfo=UTC))
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    assert parse_view(spark, WEEK).merge_keys == ("symbol", "week")


@pytest.mark.parametrize("bucket", ["date_trunc('hour', ts)", "CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ)"])
def test_groups_that_stop_qualifying_go(spark, lab, bucket):
    sql = f"SELECT symbol, {bucket} AS hour, count(*) AS n FROM m.trades GROUP BY symbol, {bucket} HAVING count(*) < 4"
    lab.source.append(trades(spark, ("A", "2026-04-06T05:10", 1, 1), ("A", "2026-04-06T05:20", 1, 1), ("B", "2026-04-06T07:00", 1, 1)))
    target, _ = lab.refresh(sql)
    assert sorted((r["symbol"], r["n"]) for r in target.read().collect()) == [("A", 2), ("B", 1)]
    lab.source.append(trades(spark, *[("A", f"2026-04-06T05:{m}", 1, 1) for m in (30, 40, 50, 55)]))
    target, action = lab.refresh(sql)
    assert action is Action.INCREMENTAL and [(r["symbol"], r["n"]) for r in target.read().collect()] == [("B", 1)]
    assert lab.refresh(sql)[1] is Action.NO_CHANGE


def test_having_without_a_bucket_is_refused(spark):
    from tidemark.errors import ViewError

    with pytest.raises(ViewError, match="HAVING"):
        parse_view(spark, "SELECT CAST(date_trunc('hour', ts) AS STRING) AS h, count(*) AS n FROM t GROUP BY 1 HAVING count(*) > 1")


@pytest.mark.parametrize("bucket", ["date_trunc('hour', ts)", "CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ)"])
def test_an_increment_rewrites_only_files_that_meet_its_range(spark, lab, bucket):
    sql = f"SELECT symbol, {bucket} AS hour, count(*) AS n FROM m.trades GROUP BY 1, 2"
    days = [(f"S{k}", f"2026-0{m}-{d:02d}T{h:02d}:00", 1, 1) for m in (1, 2, 3) for d in range(1, 29, 3) for h in (1, 13) for k in range(9)]
    lab.source.append(trades(spark, *days))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        target, _ = lab.refresh(sql)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    before = {f.path: f for f in target.live()}
    assert len(before) > 2
    lab.source.append(trades(spark, ("S1", "2026-02-13T13:30", 1, 1)))
    target, _ = lab.refresh(sql)
    gone = [before[p] for p in target.log()[-1].removed]
    low, high = datetime(2026, 2, 13, 13), datetime(2026, 2, 13, 14)
    assert gone and len(gone) < len(before)
    assert all(f.range("hour")[0].replace(tzinfo=None) < high and f.range("hour")[1].replace(tzinfo=None) >= low for f in gone)
    assert sum(r["n"] for r in target.read().collect()) == len(days) + 1


def test_footers_give_what_a_scan_gives(spark, lab):
    lab.source.append(trades(spark, ("A", "2026-04-06T01:02:03.000004", 1, 1), ("B", "1969-12-31T23:59:59.5", 1, 1)))
    paths = [f.path for f in lab.source.live()]
    key = lambda e: e.path.rsplit("/", 1)[1]
    a, b = (sorted(x, key=key) for x in (lab.source.live(), lab.source._scanned(paths)))
    assert [(key(x), x.rows, x.size, x.bounds) for x in a] == [(key(x), x.rows, x.size, x.bounds) for x in b]


def test_a_crash_inside_expiry_loses_nothing(spark, lab, monkeypatch):
    for day in ("06", "07", "08"):
        lab.source.append(trades(spark, ("A", f"2026-04-{day}", 1, 1)))
    real = lab.source.files_.delete
    calls = []

    def crash(path):
        calls.append(path)
        if "_log" in path and path.endswith(".json"):
            raise OSError("gone")
        real(path)

    monkeypatch.setattr(lab.source.files_, "delete", crash)
    with pytest.raises(OSError):
        lab.source.expire_snapshots(timedelta(0))
    monkeypatch.undo()
    from tidemark.sources.tablelog import SnapshotTable

    again = SnapshotTable(spark, lab.source.path)
    assert again.read().count() == 3 and len(again.log()) == 1
    again.append(trades(spark, ("A", "2026-04-09", 1, 1)))
    assert again.expire_snapshots(timedelta(0)) == 1 and SnapshotTable(spark, lab.source.path).read().count() == 4
