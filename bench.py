"""Headline queries of the view engine: python bench.py prints one JSON line. BENCH_SF_DIR, BENCH_CPUS."""

import json
import os
import sys
import time
from datetime import datetime

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from tidemark.operators.detect import detect_changes
    from tidemark.plans import catalog

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name, f):
        began = time.time()
        out = f()
        took[name] = round(time.time() - began, 4)
        return out

    queries = catalog.queries()
    run = lambda q: queries[q](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("bucket_year")  # start-up is not measured
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cut = F.lit(datetime(2024, 1, 29).isoformat(sep=" ")).cast("timestamp_ntz")
    end = F.lit(datetime(2024, 1, 30).isoformat(sep=" ")).cast("timestamp_ntz")
    sql = catalog._ohlcv("hour")
    lab = catalog.Lab(spark, events.schema)
    lab.source.append(events.where((F.col("ts") < cut) | (F.col("ts") >= end)))
    timed("full_refresh_hourly", lambda: lab.refresh(sql))
    bookmark = lab.bookmarks["target"]
    timed("detect_unchanged", lambda: detect_changes(lab.source, "ts", "hour", bookmark))
    lab.source.append(events.where((F.col("ts") >= cut) & (F.col("ts") < end)))
    timed("detect_one_snapshot", lambda: detect_changes(lab.source, "ts", "hour", bookmark))
    timed("incremental_day_hourly", lambda: lab.refresh(sql))
    for q in ("ohlcv_1m", "ohlcv_1h", "ohlcv_1d", "symbol_daily_high", "any_aggregate", "chunked_backfill"):
        timed(q, lambda q=q: run(q))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
