"""Change detection from the snapshot log alone: no data is read."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from enum import Enum

from ..errors import MissingFilterColumnError, UnexpectedOperationError
from ..functions.buckets import as_datetime, expand
from ..sources.tablelog import Snapshot, SnapshotTable

CHANGES = {"append", "overwrite"}
NO_OPS = {"replace"}


class Action(Enum):
    NO_CHANGE = "no_change"
    FULL_REFRESH = "full_refresh"
    INCREMENTAL = "incremental"


@dataclass(frozen=True)
class ChangeResult:
    action: Action
    current_snapshot: int | None
    filter_range: tuple[datetime, datetime] | None = None


def is_change(snapshot: Snapshot) -> bool:
    if snapshot.operation in CHANGES:
        return True
    if snapshot.operation in NO_OPS:
        return False
    raise UnexpectedOperationError(f"snapshot {snapshot.snapshot_id} is a {snapshot.operation}: rows may be lost without replacement")


def _hull(ranges: list[tuple[datetime, datetime]]) -> tuple[datetime, datetime] | None:
    return (min(a for a, _ in ranges), max(b for _, b in ranges)) if ranges else None


def changed_range(table: SnapshotTable, snapshots: list[Snapshot], column: str) -> tuple[datetime, datetime] | None:
    """The least and greatest value of column that these snapshots touched; None if they touched no file.

    Rows that an upsert only carried over don't count. An overwrite without carried rows is measured over the files it removed as well,
    so buckets that it vacated are rebuilt.
    """
    column = table.column(column)
    bounds: dict | None = None
    files, ranges = [], []
    for s in snapshots:
        files += [f for f in s.added if not f.carried]
        if s.operation == "overwrite" and s.removed and not any(f.carried for f in s.added) and not s.changed:
            if bounds is None:  # only these need the files of earlier snapshots
                bounds = {f.path: f for s in table.log() for f in (*(s.base or ()), *s.added)}
            files += [bounds[p] for p in s.removed if p in bounds]
        if column in s.changed:
            ranges.append((as_datetime(s.changed[column][0]), as_datetime(s.changed[column][1])))
    own = [r for f in files if (r := f.range(column)) is not None]
    if files and not own and not ranges:
        raise MissingFilterColumnError(f"no added file of {table.path} has bounds of column {column!r}")
    return _hull([*own, *ranges])


def source_range(table: SnapshotTable, column: str) -> tuple[datetime, datetime] | None:
    """The bounds of column over all live files; None for an empty table."""
    files, column = table.live(), table.column(column)
    own = [r for f in files if (r := f.range(column)) is not None]
    if files and not own:
        raise MissingFilterColumnError(f"no file of {table.path} has bounds of column {column!r}")
    return _hull(own)


def target_bucket_max(table: SnapshotTable, bucket: str) -> datetime | None:
    """Where a backfill got to; None if nothing is known."""
    own = [r[1] for f in table.live() if (r := f.range(bucket)) is not None]
    return max(own) if own else None


def detect_changes(table: SnapshotTable, column: str, granularity: str, last: int | None) -> ChangeResult:
    """What a refresh must do, from the snapshots after last; the range is widened to whole buckets."""
    current = table.current()
    if current is None:
        return ChangeResult(Action.NO_CHANGE, None)
    if current == last:
        return ChangeResult(Action.NO_CHANGE, current)
    if last is None:
        return ChangeResult(Action.FULL_REFRESH, current)
    after = [s for s in table.since(last) if s.snapshot_id <= current]
    changes = [s for s in after if is_change(s)]
    found = changed_range(table, changes, column) if changes else None
    if found is None:
        return ChangeResult(Action.NO_CHANGE, current)
    return ChangeResult(Action.INCREMENTAL, current, expand(*found, granularity))
