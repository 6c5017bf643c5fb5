"""Bookmarks, statuses, query history and maintenance runs in SQLite."""

from __future__ import annotations

import sqlite3
import threading
from datetime import datetime

from .operators.refresh import QueryInfo

#: The state tables.
TABLES = """
CREATE TABLE IF NOT EXISTS query_history (view TEXT, query_id TEXT, info_uri TEXT, stage TEXT, started_at TEXT, elapsed_ms INTEGER, processed_rows INTEGER, processed_bytes INTEGER);
CREATE TABLE IF NOT EXISTS maintenance_state (view TEXT, op TEXT, last_run TEXT NOT NULL, last_duration REAL, last_error TEXT, total_runs INTEGER, total_errors INTEGER, PRIMARY KEY (view, op));
CREATE TABLE IF NOT EXISTS view_status (view TEXT PRIMARY KEY, last_refresh TEXT, last_duration REAL, last_action TEXT, last_range TEXT, last_error TEXT, total_refreshes INTEGER, total_errors INTEGER, chunks_done INTEGER, chunks_total INTEGER, last_source_snapshot INTEGER);
"""
STATUS = ("last_refresh", "last_duration", "last_action", "last_range", "last_error", "total_refreshes", "total_errors", "chunks_done", "chunks_total")
MAINTENANCE = ("last_run", "last_duration", "last_error", "total_runs", "total_errors")


class QueryHistory:
    """One connection shared by the worker threads; history keeps the newest queries of each view."""

    def __init__(self, path: str, keep: int = 50) -> None:
        self.path, self.keep, self._lock = path, keep, threading.Lock()
        self._db: sqlite3.Connection | None = None

    def open(self) -> QueryHistory:
        self._db = sqlite3.connect(self.path, check_same_thread=False)
        self._db.executescript(TABLES)
        return self

    def close(self) -> None:
        if self._db is not None:
            self._db.close()
            self._db = None

    def _run(self, sql: str, args: tuple = ()) -> list[tuple]:
        assert self._db is not None, "the state is not open"
        with self._lock, self._db:
            return self._db.execute(sql, args).fetchall()

    def append(self, view: str, q: QueryInfo) -> None:
        self._run("INSERT INTO query_history VALUES (?, ?, ?, ?, ?, ?, ?, ?)", (view, q.query_id, q.info_uri, q.stage, q.started_at.isoformat(), q.elapsed_ms, q.processed_rows, q.processed_bytes))
        self._run("DELETE FROM query_history WHERE view = ? AND rowid NOT IN (SELECT rowid FROM query_history WHERE view = ? ORDER BY rowid DESC LIMIT ?)", (view, view, self.keep))

    def recent(self, view: str, limit: int | None = None) -> list[QueryInfo]:
        """Newest first."""
        rows = self._run("SELECT query_id, info_uri, stage, started_at, elapsed_ms, processed_rows, processed_bytes FROM query_history WHERE view = ? ORDER BY rowid DESC LIMIT ?", (view, limit or self.keep))
        return [QueryInfo(a, b, c, datetime.fromisoformat(d), *rest) for a, b, c, d, *rest in rows]

    def delete_view(self, view: str) -> None:
        for t in ("query_history", "maintenance_state", "view_status"):
            self._run(f"DELETE FROM {t} WHERE view = ?", (view,))

    def _upsert(self, table: str, keys: dict, values: dict) -> None:
        names = [*keys, *values]
        sets = ", ".join(f"{k} = excluded.{k}" for k in values)
        self._run(f"INSERT INTO {table} ({', '.join(names)}) VALUES ({', '.join('?' * len(names))}) ON CONFLICT ({', '.join(keys)}) DO UPDATE SET {sets}", (*keys.values(), *values.values()))

    def upsert_view_status(self, view: str, **status) -> None:
        """The bookmark is not among the columns, so a status can't clobber it."""
        if bad := set(status) - set(STATUS):
            raise ValueError(f"unknown status columns: {sorted(bad)}")
        self._upsert("view_status", {"view": view}, status)

    def get_view_status(self, view: str) -> dict | None:
        rows = self._run(f"SELECT {', '.join(STATUS)} FROM view_status WHERE view = ?", (view,))
        return dict(zip(STATUS, rows[0], strict=True)) if rows else None

    def get_last_source_snapshot(self, view: str) -> int | None:
        rows = self._run("SELECT last_source_snapshot FROM view_status WHERE view = ?", (view,))
        return rows[0][0] if rows else None

    def set_last_source_snapshot(self, view: str, snapshot: int | None) -> None:
        self._upsert("view_status", {"view": view}, {"last_source_snapshot": snapshot})

    def upsert_maintenance(self, view: str, op: str, **values) -> None:
        self._upsert("maintenance_state", {"view": view, "op": op}, values)

    def all_maintenance(self, view: str) -> dict[str, dict]:
        rows = self._run(f"SELECT op, {', '.join(MAINTENANCE)} FROM maintenance_state WHERE view = ?", (view,))
        return {r[0]: dict(zip(MAINTENANCE, r[1:], strict=True)) for r in rows}
