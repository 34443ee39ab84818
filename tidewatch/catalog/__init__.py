"""Named queries over the test tables, each with its SQL counterpart where one exists."""

from tidewatch.catalog.base import ORACLES, QUERIES
from tidewatch.catalog import logs, results, models, text, streams  # noqa: F401  (registration)

__all__ = ["QUERIES", "ORACLES"]
