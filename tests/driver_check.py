"""Compare queries with their DuckDB SQL as the driver does: python tests/driver_check.py SF_DIR [NAME...]."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rows_of(frame):
    def plain(x):
        if x is None or str(x) in ("<NA>", "NaT") or x != x:
            return None
        if isinstance(x, float):
            return round(x, 9) if math.isfinite(x) else str(x)
        return x.item() if hasattr(x, "item") else x

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(str(plain(x)) for x in r) for r in frame.astype(object).values.tolist()))


def main(sf_dir, *names):
    import duckdb
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for t in os.listdir(sf_dir):
        name = t.removesuffix(".parquet")
        duckdb.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{t}'")
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or [n for n in queries]:
        began = time.time()
        try:
            got = rows_of(queries[name](spark, sf_dir).toPandas())
            want = rows_of(duckdb.sql(oracle[name]).df()) if name in oracle else None
            same = want is None or got == want
            print(f"{name}: {'rows only' if want is None else 'equal' if same else 'DIFFERENT'} {len(got[1])} rows, {time.time() - began:.1f} s", flush=True)
            if not same:
                bad += 1
                print("  ", got[0], want[0], len(want[1]), *[x for x in zip(got[1], want[1]) if x[0] != x[1]][:2])
        except Exception as e:
            bad += 1
            print(f"{name}: {type(e).__name__}: {str(e)[:600]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
