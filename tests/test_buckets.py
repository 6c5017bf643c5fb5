from datetime import UTC, datetime, timedelta

import pytest

from tidemark.functions.buckets import GRANULARITIES, chunks_for, expand, floor, following, walk

TIMES = [
    datetime(2024, 1, 1), datetime(2024, 2, 29, 23, 59, 59, 999999), datetime(2024, 12, 31, 12), datetime(2023, 3, 31, 1, 2, 3, 4005), datetime(2024, 4, 8, 9, 30), datetime(2024, 4, 7, 23, 59),
    datetime(1970, 1, 1), datetime(2000, 6, 15, 6, 6, 6, 6), datetime(2024, 10, 1), datetime(2026, 1, 5, 0, 0, 0, 1), datetime(2024, 7, 1, tzinfo=UTC),
]


@pytest.mark.parametrize("g", GRANULARITIES)
@pytest.mark.parametrize("ts", TIMES)
def test_expand_is_aligned_covering_and_tight(g, ts):
    start, end = expand(ts, ts + timedelta(days=3, microseconds=7), g)
    assert floor(start, g) == start and floor(end, g) == end
    assert start <= ts and ts + timedelta(days=3, microseconds=7) < end
    assert following(start, g) > ts and floor(end - timedelta(microseconds=1), g) <= ts + timedelta(days=3, microseconds=7)


def test_boundary_belongs_to_the_bucket_that_starts_there():
    assert expand(datetime(2024, 4, 8), datetime(2024, 4, 8), "week") == (datetime(2024, 4, 8), datetime(2024, 4, 15))
    assert expand(datetime(2024, 12, 31), datetime(2025, 1, 1), "year") == (datetime(2024, 1, 1), datetime(2026, 1, 1))


def test_walk():
    assert list(walk(datetime(2024, 1, 31), datetime(2024, 3, 1), "month")) == [(datetime(2024, 1, 31), datetime(2024, 2, 1)), (datetime(2024, 2, 1), datetime(2024, 3, 1))]
    assert list(walk(datetime(2024, 1, 1), datetime(2024, 1, 1), "day")) == []
    with pytest.raises(ValueError, match="unsupported granularity"):
        list(walk(datetime(2024, 1, 1), datetime(2024, 1, 2), "fortnight"))


def test_chunks():
    assert chunks_for("week") == ("week",)
    assert chunks_for("millisecond") == ("minute", "hour", "day", "week", "month", "quarter", "year")
    assert chunks_for("month") == ("month", "quarter", "year")


def test_metric_bounds_compare_instants(spark):
    from tidemark.functions.buckets import metric_bounds

    rows = [
        ('{"ts": {"lower_bound": "2026-01-01T09:00:00+09:00", "upper_bound": "2026-01-01T03:00:00+00:00"}}',),
        ('{"ts": {"lower_bound": "2026-01-01T01:00:00+00:00", "upper_bound": "2026-01-01T00:30:00-05:00"}}',),
        ('{"x": {"lower_bound": "1", "upper_bound": "2"}}',),
        (None,),
    ]
    found = metric_bounds(spark.createDataFrame(rows, "readable_metrics string"), "ts").selectExpr("string(low) AS low", "string(high) AS high", "files").first()
    assert tuple(found) == ("2026-01-01 00:00:00", "2026-01-01 05:30:00", 2)
    assert tuple(metric_bounds(spark.createDataFrame([], "readable_metrics string"), "ts").first()) == (None, None, 0)
