"""All named queries."""

from finquill.plans import catalogue, extraction, paging, reporting, scans, statements, validation  # noqa: F401
from finquill.plans.named import SQL, Q

__all__ = ["SQL", "Q"]
