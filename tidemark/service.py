"""The controller: a worker thread for each view, a supervisor that follows the views file, refreshes, maintenance."""

from __future__ import annotations

import logging
import os
import threading
import time
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from . import config as cfg
from .config import ServerConfig, ViewConfig
from .metrics import Metrics
from .operators.detect import Action, detect_changes
from .operators.refresh import QueryInfo, output_schema, refresh
from .plans.viewdef import parse_view
from .sources.tablelog import SnapshotTable
from .state import QueryHistory

log = logging.getLogger("tidemark")


@dataclass
class ViewStatus:
    last_refresh: str | None = None
    last_duration: float | None = None
    last_action: str = "pending"
    last_range: str | None = None
    last_error: str | None = None
    total_refreshes: int = 0
    total_errors: int = 0
    chunks_done: int | None = None
    chunks_total: int | None = None
    recent_queries: list[QueryInfo] = field(default_factory=list)
    maintenance: dict[str, dict] = field(default_factory=dict)


class Runtime:
    """A view's worker: its thread, wake flag, stop flag, and the number of cycles that have ended."""

    def __init__(self) -> None:
        self.condition = threading.Condition()
        self.wake = self.stop = self.running = False
        #: Set when the worker must end: a refresh stops between commits.
        self.stopped = threading.Event()
        self.done = 0
        self.thread: threading.Thread | None = None


class Catalog:
    """Table names to tables: dotted names are folders below a warehouse path."""

    def __init__(self, spark: SparkSession, warehouse: str) -> None:
        self.spark, self.warehouse = spark, warehouse.rstrip("/")

    def table(self, name: str) -> SnapshotTable:
        return SnapshotTable(self.spark, f"{self.warehouse}/{'/'.join(name.split('.'))}")


def partition_columns(text: str | None, schema) -> tuple[str, ...]:
    """The columns of a partitioning such as ARRAY['symbol', 'day(bucket)']: rows of a commit are dealt to files by them."""
    if not text:
        return ()
    import re

    found = [m[1] or m[0] for m in re.findall(r"'(?:\s*)(\w+)(?:\(\s*(\w+)[^)]*\))?\s*'", text)]
    return tuple(c for c in found if c in schema.fieldNames())


class Service:
    def __init__(self, spark: SparkSession, catalog: Catalog, config: ServerConfig | None = None, config_path: str = "config.yaml", views_path: str = "views.yaml") -> None:
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            raise RuntimeError("the session time zone must be UTC: buckets would shift")
        spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
        self.spark, self.catalog, self.config, self.views_path = spark, catalog, config or ServerConfig(), views_path
        self.metrics = Metrics()
        self.history = QueryHistory(cfg.state_db_path(self.config, config_path, views_path)).open()
        self.views: dict[str, ViewConfig] = {}
        self.status: dict[str, ViewStatus] = {}
        self.runtime: dict[str, Runtime] = {}
        self._tags: dict[str, str] = {}
        self.lock = threading.RLock()
        self._mtime: float | None = None
        self._closing = threading.Event()
        self._supervisor: threading.Thread | None = None

    # --- definitions ---

    def reload(self) -> bool:
        """Read the views file if it changed. A broken file keeps the last good views and is not tried again until it changes."""
        mtime = os.path.getmtime(self.views_path) if os.path.exists(self.views_path) else None
        if mtime == self._mtime:
            return False
        self._mtime = mtime
        try:
            views = cfg.load_views(self.spark, self.views_path)
        except Exception:
            log.exception("the views file can't be used; the last good one stays")
            return False
        with self.lock:
            self.views = {v.name: v for v in views}
            for name in self.views:
                self._hydrate(name)
        self.metrics.add("mv_config_reload_total")
        self.metrics.set("mv_views_configured", len(views))
        return True

    def _hydrate(self, name: str) -> None:
        if name in self.status:
            return
        s = ViewStatus(**{k: v for k, v in (self.history.get_view_status(name) or {}).items() if v is not None})
        s.recent_queries, s.maintenance = self.history.recent(name), self.history.all_maintenance(name)
        self.status[name] = s

    def _save(self) -> None:
        cfg.save_views(list(self.views.values()), self.views_path)
        self._mtime = os.path.getmtime(self.views_path)
        self.metrics.set("mv_views_configured", len(self.views))

    def create(self, view: ViewConfig) -> None:
        cfg.validate(self.spark, view)
        with self.lock:
            if view.name in self.views or any(v.target_table == view.target_table for v in self.views.values()):
                raise KeyError(f"there is a view {view.name} or a view into {view.target_table}")
            self.views[view.name] = view
            self._hydrate(view.name)
            self._save()

    def update(self, name: str, view: ViewConfig) -> None:
        same = lambda text: " ".join(text.split())
        cfg.validate(self.spark, view)
        with self.lock:
            old = self.views[name]
            if view.name != name or same(view.query) != same(old.query):
                raise cfg.ViewError("name and query of a view can't change")
            if view.target_table != old.target_table:
                raise cfg.ViewError("target_table of a view can't change: the new table would lack its history")
            self.views[name] = view
            self._save()

    def delete(self, name: str) -> None:
        """Stops the view's worker first; the target table stays."""
        with self.lock:
            self.views.pop(name)
            self._save()
        self._stop_worker(name)
        self.history.delete_view(name)
        self.metrics.drop(name)
        self.status.pop(name, None)

    # --- refreshing ---

    def _persist(self, name: str) -> None:
        s = self.status[name]
        self.history.upsert_view_status(name, **{k: getattr(s, k) for k in ("last_refresh", "last_duration", "last_action", "last_range", "last_error", "total_refreshes", "total_errors", "chunks_done", "chunks_total")})

    def _record(self, name: str, q: QueryInfo) -> None:
        self.history.append(name, q)
        self.status[name].recent_queries = [q, *self.status[name].recent_queries][: self.history.keep]

    def _cancel(self, tag: str) -> None:
        self.spark.interruptTag(tag)

    def refresh_view(self, name: str, stop: threading.Event | None = None) -> str:
        """Detect, refresh, bookmark, maintain; returns the action. Errors are counted and kept in the status, then raised."""
        view, s, began = self.views[name], self.status[name], time.monotonic()
        tag = self._tags[name] = f"view-{name}-{time.time_ns()}"
        timer, late = None, threading.Event()
        if view.query_timeout_seconds:

            def cancel() -> None:
                late.set()
                self._cancel(tag)

            timer = threading.Timer(view.query_timeout_seconds, cancel)
            timer.start()
        self.spark.addTag(tag)
        try:
            action = self._refresh(name, view, s, stop, late)
            if late.is_set():
                raise TimeoutError
            return action
        except Exception as e:
            if stop is not None and stop.is_set() and not late.is_set():
                return "interrupted"  # its jobs were cancelled
            s.total_errors += 1
            s.last_error = f"refresh exceeded query_timeout_seconds={view.query_timeout_seconds}" if late.is_set() else f"{type(e).__name__}: {e}"
            self.metrics.add("mv_refresh_errors_total", view=name)
            raise
        finally:
            if timer:
                timer.cancel()
            self.spark.removeTag(tag)
            self._tags.pop(name, None)
            s.last_refresh, s.last_duration = datetime.now(UTC).isoformat(), time.monotonic() - began
            self.metrics.observe("mv_refresh_duration_seconds", s.last_duration, view=name)
            if name in self.views:
                self._persist(name)

    def _refresh(self, name: str, view: ViewConfig, s: ViewStatus, stop: threading.Event | None, late: threading.Event) -> str:
        parsed = parse_view(self.spark, view.query)
        source = self.catalog.table(parsed.source_table)
        if not source.exists:
            raise FileNotFoundError(f"no table {parsed.source_table}")
        schema = output_schema(self.spark, parsed, source)
        target = self.catalog.table(view.target_table)
        if not target.exists:
            target = SnapshotTable.create(self.spark, target.path, schema, partition_columns(view.target_partitioning, schema))
        clock = time.monotonic()
        found = detect_changes(source, parsed.filter_column, parsed.granularity, self.history.get_last_source_snapshot(name))
        self.metrics.observe("mv_detection_duration_seconds", time.monotonic() - clock, view=name)
        if found.action is Action.NO_CHANGE:
            s.last_action, s.last_error = "skip", None
            if found.current_snapshot is not None:
                self.history.set_last_source_snapshot(name, found.current_snapshot)
            self.metrics.add("mv_refresh_total", view=name, type="skip")
            self.maintain(name)
            return "skip"
        full = found.action is Action.FULL_REFRESH
        s.last_action = ("chunked_full" if view.full_refresh_chunk else "full") if full else "incremental"
        s.chunks_done = s.chunks_total = None
        for q in refresh(self.spark, parsed, source, target, found.filter_range, view.full_refresh_chunk, view.replace_range, found.current_snapshot):
            self._record(name, q)
            s.last_range = f"{q.range[0].isoformat()} - {q.range[1].isoformat()}" if q.range else None
            s.chunks_done, s.chunks_total = q.chunks_done, q.chunks_total
            self.metrics.add("mv_refresh_rows_processed_total", q.processed_rows, view=name)
            self.metrics.add("mv_refresh_bytes_processed_total", q.processed_bytes, view=name)
            if q.stage == "chunk_merge":
                self.metrics.add("mv_chunks_completed_total", view=name)
                self.metrics.observe("mv_chunk_duration_seconds", q.elapsed_ms / 1000, view=name)
                self.metrics.add("mv_chunk_rows_written_total", q.rows_written, view=name)
                self._persist(name)
            if late.is_set():
                raise TimeoutError
            if stop is not None and stop.is_set() and q.chunks_done is not None and q.chunks_done != q.chunks_total:
                return "interrupted"  # no bookmark: the next cycle resumes from the target
        self.history.set_last_source_snapshot(name, found.current_snapshot)
        s.total_refreshes += 1
        s.last_error = None
        self.metrics.set("mv_source_snapshot_id", found.current_snapshot, view=name)
        self.metrics.set("mv_refresh_last_success_timestamp", time.time(), view=name)
        self.metrics.add("mv_refresh_total", view=name, type="full" if full else "incremental")
        self.maintain(name)
        return s.last_action

    def maintain(self, name: str) -> None:
        """Each operation that is due; one that fails doesn't keep the others from running."""
        view, s = self.views[name], self.status[name]
        if not view.maintenance_interval_seconds:
            return
        target = self.catalog.table(view.target_table)
        size = cfg.data_size(view.optimize_file_size_threshold) if view.optimize_file_size_threshold else 100 << 20
        ops = {
            "optimize": lambda: target.compact(size),
            "expire_snapshots": lambda: target.expire_snapshots(cfg.duration(view.expire_snapshots_retention)),
            "remove_orphan_files": lambda: target.remove_orphan_files(cfg.duration(view.remove_orphan_files_retention)),
        }
        for op, run in ops.items():
            if not getattr(view, op):
                continue
            was = s.maintenance.get(op, {})
            if was.get("last_run") and (datetime.now(UTC) - datetime.fromisoformat(was["last_run"])).total_seconds() < view.maintenance_interval_seconds:
                continue
            began, clock, error = datetime.now(UTC), time.monotonic(), None
            try:
                run()
            except Exception as e:
                log.exception("maintenance %s of %s failed", op, name)
                error = f"{type(e).__name__}: {e}"
            now = {"last_run": began.isoformat(), "last_duration": time.monotonic() - clock, "last_error": error, "total_runs": (was.get("total_runs") or 0) + 1, "total_errors": (was.get("total_errors") or 0) + bool(error)}
            s.maintenance[op] = now
            self.history.upsert_maintenance(name, op, **now)

    # --- threads ---

    def _worker(self, name: str, r: Runtime) -> None:
        while True:
            with r.condition:
                if r.stop or self._closing.is_set():
                    return
                r.wake, r.running = False, True
            try:
                self.refresh_view(name, r.stopped)
            except Exception:
                log.exception("refresh of %s failed", name)
            with r.condition:
                r.running = False
                r.done += 1
                r.condition.notify_all()
                view = self.views.get(name)
                if view is None:
                    return
                # triggers that came meanwhile are one follow-up
                r.condition.wait_for(lambda: r.wake or r.stop or self._closing.is_set(), timeout=view.refresh_interval_seconds)

    def _stop_worker(self, name: str) -> None:
        r = self.runtime.pop(name, None)
        if r is None:
            return
        r.stopped.set()
        with r.condition:
            r.stop = True
            r.condition.notify_all()
        if tag := self._tags.get(name):
            self._cancel(tag)
        if r.thread and r.thread is not threading.current_thread():
            r.thread.join(timeout=60)

    def supervise_once(self) -> None:
        """Follow the views file; start workers that are missing or dead, stop those of views that went."""
        self.reload()
        for name in list(self.runtime):
            if name not in self.views:
                self._stop_worker(name)
        for name in list(self.views):
            r = self.runtime.get(name)
            if r is None or r.thread is None or not r.thread.is_alive():
                r = Runtime()
                r.thread = threading.Thread(target=self._worker, args=(name, r), name=f"view-{name}", daemon=True)
                self.runtime[name] = r
                r.thread.start()

    def start(self) -> None:
        def run() -> None:
            while not self._closing.is_set():
                self.supervise_once()
                self._closing.wait(self.config.config_reload_seconds)

        self._supervisor = threading.Thread(target=run, name="supervisor", daemon=True)
        self._supervisor.start()

    def trigger(self, name: str, timeout: float = 300) -> ViewStatus | None:
        """Wait for a cycle that began after this call; None if the view was deleted meanwhile."""
        if name not in self.runtime:
            self.supervise_once()  # a view whose worker hasn't started yet
        r = self.runtime[name]
        with r.condition:
            goal = r.done + (2 if r.running else 1)
            r.wake = True
            r.condition.notify_all()
            if not r.condition.wait_for(lambda: r.done >= goal or r.stop, timeout=timeout):
                raise TimeoutError(name)
            return None if r.stop and r.done < goal else self.status.get(name)

    def close(self) -> None:
        self._closing.set()
        for name in list(self.runtime):
            self._stop_worker(name)
        if self._supervisor:
            self._supervisor.join(timeout=60)
        self.history.close()
