"""View definitions and service settings as YAML, with one validator for every way in."""

from __future__ import annotations

import dataclasses
import os
import re
from dataclasses import dataclass
from datetime import timedelta

import yaml
from pyspark.sql import SparkSession

from .errors import ViewError
from .functions.buckets import GRANULARITIES, chunks_for
from .plans.viewdef import ParsedView, parse_view

#: Forms of names, durations and data sizes.
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
QUALIFIED = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*")
DURATION = re.compile(r"\d+[smhd]")
DATA_SIZE = re.compile(r"\d+(B|KB|MB|GB|TB)")


@dataclass(frozen=True)
class ViewConfig:
    name: str
    query: str
    target_table: str
    target_partitioning: str | None = None
    refresh_interval_seconds: int = 60
    query_timeout_seconds: int | None = None
    full_refresh_chunk: str | None = None
    maintenance_interval_seconds: int = 0
    optimize: bool = True
    expire_snapshots: bool = True
    remove_orphan_files: bool = True
    optimize_file_size_threshold: str | None = None
    expire_snapshots_retention: str = "7d"
    remove_orphan_files_retention: str = "7d"
    replace_range: bool = False


@dataclass(frozen=True)
class ServerConfig:
    port: int = 8000
    config_reload_seconds: int = 30
    state_db_path: str = "state.db"


def validate_identifier(name: str) -> str:
    if not IDENTIFIER.fullmatch(name or ""):
        raise ViewError(f"invalid identifier: {name!r}")
    return name


def validate_qualified_name(name: str) -> str:
    if not QUALIFIED.fullmatch(name or ""):
        raise ViewError(f"invalid qualified name: {name!r}")
    return name


def duration(text: str) -> timedelta:
    if not DURATION.fullmatch(text):
        raise ViewError(f"invalid duration: {text!r}")
    return timedelta(seconds=int(text[:-1]) * {"s": 1, "m": 60, "h": 3600, "d": 86_400}[text[-1]])


def data_size(text: str) -> int:
    if not DATA_SIZE.fullmatch(text):
        raise ViewError(f"invalid data size: {text!r}")
    number, unit = re.fullmatch(r"(\d+)(\w+)", text).groups()
    return int(number) << {"B": 0, "KB": 10, "MB": 20, "GB": 30, "TB": 40}[unit]


def validate_chunk(view: ParsedView, chunk: str | None) -> None:
    if not chunk:
        return
    if chunk not in GRANULARITIES or chunk in GRANULARITIES[:2]:
        raise ViewError(f"{chunk!r} is not a valid chunk granularity")
    if chunk not in chunks_for(view.granularity):
        raise ViewError(f"full_refresh_chunk {chunk!r} is not compatible with a view by {view.granularity}")
    if view.bucket_alias is None:
        raise ViewError("full_refresh_chunk needs a projection date_trunc(...) AS alias")


def validate(spark: SparkSession, view: ViewConfig) -> ParsedView:
    """Everything that YAML, POST and PUT check."""
    validate_qualified_name(view.name)
    validate_qualified_name(view.target_table)
    parsed = parse_view(spark, view.query)
    validate_chunk(parsed, view.full_refresh_chunk)
    t = view.query_timeout_seconds
    if t is not None and (isinstance(t, bool) or not isinstance(t, int) or t <= 0):
        raise ViewError("query_timeout_seconds must be a positive integer")
    if view.maintenance_interval_seconds < 0:
        raise ViewError("maintenance_interval_seconds must not be negative")
    duration(view.expire_snapshots_retention)
    duration(view.remove_orphan_files_retention)
    if view.optimize_file_size_threshold is not None:
        data_size(view.optimize_file_size_threshold)
    return parsed


def view_from(d: dict) -> ViewConfig:
    known = {f.name for f in dataclasses.fields(ViewConfig)}
    missing = [k for k in ("query", "target_table") if not d.get(k)]
    if missing:
        raise ViewError(f"a view needs {' and '.join(missing)}")
    if unknown := set(d) - known:
        raise ViewError(f"unknown fields: {', '.join(sorted(unknown))}")
    return ViewConfig(**{"name": d["target_table"]} | {k: v for k, v in d.items() if v is not None})


def check_unique(views: list[ViewConfig]) -> None:
    for what in ("name", "target_table"):
        seen: set[str] = set()
        for v in views:
            if (x := getattr(v, what)) in seen:
                raise ViewError(f"duplicate {what}: {x}")
            seen.add(x)


def load_views(spark: SparkSession, path: str) -> list[ViewConfig]:
    """A list of views, or {views: [...]}; a missing or empty file has none."""
    if not os.path.exists(path):
        return []
    with open(path) as f:
        loaded = yaml.safe_load(f)
    rows = (loaded.get("views") if isinstance(loaded, dict) else loaded) or []
    for d in rows:
        if not d.get("name"):
            raise ViewError("a view in a file needs a name")
    views = [view_from(d) for d in rows]
    check_unique(views)
    for v in views:
        validate(spark, v)
    return views


def save_views(views: list[ViewConfig], path: str) -> None:
    """Fields with their default are left out, but for the four that identify a view."""
    always = ("name", "query", "target_table", "refresh_interval_seconds")
    rows = [{f.name: getattr(v, f.name) for f in dataclasses.fields(v) if f.name in always or getattr(v, f.name) != f.default} for v in views]
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.part", "w") as f:
        yaml.safe_dump({"views": rows}, f, sort_keys=False)
    os.replace(f"{path}.part", path)


def load_config(path: str) -> ServerConfig:
    loaded = {}
    if os.path.exists(path):
        with open(path) as f:
            loaded = yaml.safe_load(f) or {}
    server = loaded.get("server", loaded)
    return ServerConfig(**{k: v for k, v in server.items() if k in {f.name for f in dataclasses.fields(ServerConfig)}})


def state_db_path(config: ServerConfig, config_path: str, views_path: str) -> str:
    """A relative path is anchored at the views file's folder if that is there and writable, else at the configuration's."""
    if os.path.isabs(config.state_db_path):
        return config.state_db_path
    folder = os.path.dirname(os.path.abspath(views_path))
    if not (os.path.isdir(folder) and os.access(folder, os.W_OK)):
        folder = os.path.dirname(os.path.abspath(config_path))
    return os.path.join(folder, config.state_db_path)
