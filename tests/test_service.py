import dataclasses
import json
import urllib.request
from datetime import UTC, datetime

import pytest
import threading

from tidemark.config import ServerConfig, ViewConfig, data_size, duration, load_views, validate
from tidemark.errors import ViewError
from tidemark.httpapi import handle, server
from tidemark.service import Catalog, Service
from tidemark.sources.tablelog import SnapshotTable

VIEW = {"name": "hourly", "query": "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM m.trades GROUP BY 1", "target_table": "m.hourly"}


@pytest.fixture
def service(spark, tmp_path):
    s = Service(spark, Catalog(spark, f"file://{tmp_path}/w"), ServerConfig(), str(tmp_path / "config.yaml"), str(tmp_path / "views.yaml"))
    schema = spark.createDataFrame([], "ts timestamp, x double").schema
    SnapshotTable.create(spark, f"file://{tmp_path}/w/m/trades", schema).append(spark.createDataFrame([(datetime(2026, 1, 1, 5, tzinfo=UTC), 1.0)], schema))
    yield s
    s.close()


def test_codes_and_refresh(service, spark):
    assert handle(service, "GET", "/health", None) == (200, {"status": "ok", "views": 0})
    assert handle(service, "POST", "/api/views", VIEW)[0] == 201
    assert handle(service, "POST", "/api/views", VIEW)[0] == 409
    assert handle(service, "POST", "/api/views", VIEW | {"name": "b", "target_table": "m.b", "query": "SELECT 1"})[0] == 422
    assert handle(service, "POST", "/api/views", VIEW | {"name": "b", "target_table": "m.b", "query_timeout_seconds": True})[0] == 422
    assert handle(service, "PUT", "/api/views/none", VIEW)[0] == 404
    assert handle(service, "PUT", "/api/views/hourly", VIEW | {"query": VIEW["query"] + " HAVING count(*) > 1"})[0] == 422
    assert handle(service, "PUT", "/api/views/hourly", VIEW | {"maintenance_interval_seconds": 1})[0] == 200
    assert handle(service, "POST", "/api/views/parse", {"query": VIEW["query"]})[1]["merge_keys"] == ["hour"]
    assert service.refresh_view("hourly") == "full" and service.refresh_view("hourly") == "skip"
    assert service.catalog.table("m.hourly").read().count() == 1
    assert service.status["hourly"].total_refreshes == 1 and set(service.status["hourly"].maintenance) == {"optimize", "expire_snapshots", "remove_orphan_files"}
    assert 'mv_refresh_total{type="full",view="hourly"} 1' in handle(service, "GET", "/metrics", None)[1]
    assert handle(service, "DELETE", "/api/views/hourly", None) == (204, None)
    assert service.history.get_last_source_snapshot("hourly") is None


def test_trigger_over_http(service):
    service.create(ViewConfig(**VIEW, refresh_interval_seconds=3600))
    service.supervise_once()
    http = server(service, 0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{http.server_address[1]}/api/views/hourly/refresh"
    with urllib.request.urlopen(urllib.request.Request(url, method="POST"), timeout=120) as r:
        assert json.load(r)["total_refreshes"] >= 1
    http.shutdown()


def test_files_round_trip_and_bad_files_keep_the_last_good(service, spark):
    service.create(ViewConfig(**VIEW, full_refresh_chunk="day"))
    assert load_views(spark, service.views_path) == list(service.views.values())
    with open(service.views_path, "w") as f:
        f.write("views: [{name: a}]")
    service._mtime = None
    assert not service.reload() and list(service.views) == ["hourly"]


def test_validation(spark):
    assert duration("7d").days == 7 and data_size("2KB") == 2048
    for bad in ({"full_refresh_chunk": "second"}, {"name": "a b"}, {"query_timeout_seconds": 0}, {"expire_snapshots_retention": "7w"}, {"optimize_file_size_threshold": "x"}, {"maintenance_interval_seconds": -1}):
        with pytest.raises(ViewError):
            validate(spark, ViewConfig(**VIEW | bad))


def test_delete_stops_a_backfill_between_commits(service, spark):
    """A view that is deleted while its chunks are rebuilt makes no further commit, and leaves no state behind."""
    import time

    source = service.catalog.table("m.trades")
    days = spark.range(40).selectExpr("timestamp'2026-02-01 00:00:00' + make_dt_interval(cast(id as int)) AS ts", "1.0 AS x")
    source.append(days)
    service.create(ViewConfig(**VIEW, refresh_interval_seconds=3600, full_refresh_chunk="day"))
    service.supervise_once()
    target = service.catalog.table("m.hourly")
    deadline = time.time() + 60
    while time.time() < deadline and len(service.catalog.table("m.hourly").log()) < 2:
        time.sleep(0.05)
    runtime = service.runtime["hourly"]
    service.delete("hourly")
    assert runtime.stopped.is_set() and not runtime.thread.is_alive()
    commits = len(target.log())
    time.sleep(1)
    assert 2 <= commits == len(target.log()) < 41
    assert service.history.get_last_source_snapshot("hourly") is None and "hourly" not in service.status


def test_refresh_of_a_view_without_a_worker_yet(service):
    service.create(ViewConfig(**VIEW, refresh_interval_seconds=3600))
    code, status = handle(service, "POST", "/api/views/hourly/refresh", None)
    assert code == 200 and status["total_refreshes"] >= 1


def test_errors_are_recorded_and_shared_targets_refused(service, spark):
    view = ViewConfig(**VIEW | {"query": VIEW["query"].replace("m.trades", "m.none")})
    service.create(view)
    with pytest.raises(FileNotFoundError):
        service.refresh_view("hourly")
    assert service.status["hourly"].total_errors == 1 and "m.none" in service.status["hourly"].last_error
    assert handle(service, "POST", "/api/views", VIEW | {"name": "other"})[0] == 409
    assert handle(service, "PUT", "/api/views/hourly", dataclasses.asdict(view) | {"target_table": "m.else"})[0] == 422
    names = [f["name"] for f in handle(service, "GET", "/api/views/schema", None)[1]]
    assert {"query", "target_table", "full_refresh_chunk"} <= set(names)
    assert [v["name"] for v in handle(service, "GET", "/api/views", None)[1]] == ["hourly"]


def test_empty_source_is_a_skip(service, spark):
    SnapshotTable.create(spark, service.catalog.table("m.empty").path, spark.createDataFrame([], "ts timestamp").schema)
    service.create(ViewConfig(**VIEW | {"query": VIEW["query"].replace("m.trades", "m.empty")}))
    assert service.refresh_view("hourly") == "skip" and service.status["hourly"].last_error is None
