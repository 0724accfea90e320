"""All registered queries."""

from . import books, detection, full_reports, intake, matching, recurrence, reports  # noqa: F401  (they register themselves)
from .registry import CATALOG

__all__ = ["CATALOG"]
