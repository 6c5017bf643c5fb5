"""Counters, gauges and summaries in the Prometheus text form."""

from __future__ import annotations

import threading

#: Metric -> (type, help).
METRICS = {
    "mv_refresh_total": ("counter", "Refreshes by view and type"),
    "mv_refresh_duration_seconds": ("summary", "Duration of refreshes"),
    "mv_refresh_last_success_timestamp": ("gauge", "Time of the last success"),
    "mv_refresh_errors_total": ("counter", "Failed refreshes"),
    "mv_config_reload_total": ("counter", "Reloads of the views file"),
    "mv_views_configured": ("gauge", "Views"),
    "mv_refresh_bytes_processed_total": ("counter", "Bytes processed"),
    "mv_refresh_rows_processed_total": ("counter", "Rows processed"),
    "mv_detection_duration_seconds": ("summary", "Duration of change detection"),
    "mv_source_snapshot_id": ("gauge", "Bookmarked snapshot"),
    "mv_chunks_completed_total": ("counter", "Backfill chunks"),
    "mv_chunk_duration_seconds": ("summary", "Duration of chunks"),
    "mv_chunk_rows_written_total": ("counter", "Rows written by chunks"),
}


class Metrics:
    def __init__(self) -> None:
        self._lock, self._values = threading.Lock(), {}

    def add(self, name: str, amount: float = 1, **labels: str) -> None:
        with self._lock:
            k = (name, tuple(sorted(labels.items())))
            self._values[k] = self._values.get(k, 0) + amount

    def set(self, name: str, value: float, **labels: str) -> None:
        with self._lock:
            self._values[name, tuple(sorted(labels.items()))] = value

    def observe(self, name: str, seconds: float, **labels: str) -> None:
        self.add(f"{name}_sum", seconds, **labels)
        self.add(f"{name}_count", 1, **labels)

    def get(self, name: str, **labels: str) -> float:
        with self._lock:
            return self._values.get((name, tuple(sorted(labels.items()))), 0)

    def drop(self, view: str) -> None:
        with self._lock:
            self._values = {k: v for k, v in self._values.items() if ("view", view) not in k[1]}

    def text(self) -> str:
        escape = lambda v: str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
        with self._lock:
            values = sorted(self._values.items())
        lines = []
        for name, (kind, about) in METRICS.items():
            lines += [f"# HELP {name} {about}", f"# TYPE {name} {kind}"]
            for (full, labels), v in values:
                if full == name or kind == "summary" and full in (f"{name}_sum", f"{name}_count"):
                    inner = ",".join(f'{k}="{escape(x)}"' for k, x in labels)
                    lines.append(f"{full}{{{inner}}} {v:g}" if inner else f"{full} {v:g}")
        return "\n".join(lines) + "\n"
