from datetime import timedelta

from tidemark.plans.catalog import Lab
from tidemark.streaming.driver import batch_refresh, stream_view
from tidemark.operators.refresh import output_schema
from tidemark.plans.viewdef import parse_view
from tidemark.sources.tablelog import SnapshotTable

SQL = "SELECT date_trunc('day', ts) AS day, count(*) AS n FROM m.events GROUP BY 1"


def test_stream(spark, tmp_path):
    events = spark.range(100).selectExpr("timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 30 as int)) AS ts", "id")
    events.write.parquet(f"{tmp_path}/in")
    lab = Lab(spark, events.schema)
    q = stream_view(spark, spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), SQL, lab.source, f"file://{tmp_path}/t", f"{tmp_path}/c")
    q.awaitTermination(120)
    target = SnapshotTable(spark, f"file://{tmp_path}/t")
    assert sorted(r["n"] for r in target.read().collect()) == [4, 48, 48]
    again = SnapshotTable.create(spark, f"{lab.base}/again", output_schema(spark, parse_view(spark, SQL), lab.source))
    for _ in range(2):  # a batch that runs twice is appended once
        batch_refresh(SQL, lab.source, again, "one")(events, 7)
    assert sum(r["n"] for r in again.read().collect()) == 200


def test_each_stream_numbers_its_own_batches_also_after_expiry(spark, tmp_path):
    events = spark.range(10).selectExpr("timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 30 as int)) AS ts", "id")
    lab = Lab(spark, events.schema)
    target = SnapshotTable.create(spark, f"{lab.base}/t", output_schema(spark, parse_view(spark, SQL), lab.source))
    for stream in ("a", "b"):
        batch_refresh(SQL, lab.source, target, stream)(events, 0)
    assert sum(r["n"] for r in target.read().collect()) == 20
    lab.source.append(events)
    assert lab.source.expire_snapshots(timedelta(0)) == 2
    for stream in ("a", "b"):  # again, as after a crash
        batch_refresh(SQL, lab.source, target, stream)(events, 0)
    assert lab.source.read().count() == 30
