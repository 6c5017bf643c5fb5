"""Errors that callers tell apart."""


class ViewError(ValueError):
    """A view definition that can't be maintained."""


class ExpiredSnapshotError(RuntimeError):
    """The bookmarked snapshot is no longer in the log."""


class MissingFilterColumnError(RuntimeError):
    """Files were added, but none has bounds of the filter column."""


class UnexpectedOperationError(RuntimeError):
    """A snapshot's operation may have lost rows without replacing them."""


class CommitConflictError(RuntimeError):
    """Another writer committed first."""
