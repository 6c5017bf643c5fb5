import os

import pytest

from tidemark.plans import scenarios
from tidemark.plans.catalog import Lab
from tidemark.plans.scenarios import HOURLY
from tidemark.operators.detect import detect_changes
from tidemark.errors import MissingFilterColumnError

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(scenarios.queries()))
def test_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("events", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = scenarios.queries()[name](spark, SF)
    want = con.sql(scenarios.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda rows: sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)
    assert plain(tuple(r[c] for c in columns) for r in got.collect()) == plain(want.select(*columns).fetchall())


def test_column_without_bounds_is_an_error(spark):
    rows = spark.sql("SELECT CAST(NULL AS TIMESTAMP_NTZ) AS ts, 'a' AS event_type, 1D AS value")
    lab = Lab(spark, rows.schema)
    first = lab.source.append(rows).snapshot_id
    lab.source.append(rows)
    with pytest.raises(MissingFilterColumnError):
        detect_changes(lab.source, "ts", "hour", first)
    with pytest.raises(MissingFilterColumnError):
        lab.refresh(HOURLY)


def test_time_columns_match_whatever_their_case(spark):
    rows = spark.sql("SELECT TIMESTAMP_NTZ'2026-01-01 05:30:00' AS Ts, 'a' AS event_type, 1D AS value")
    lab = Lab(spark, rows.schema)
    for n in (1, 2):
        lab.source.append(rows)
        assert [r["n"] for r in lab.refresh(HOURLY)[0].read().collect()] == [n]
