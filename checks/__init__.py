"""Queries over the test tables, each with the SQL that must give the same rows."""

from checks import (  # noqa: F401
    catalog_checks,
    job_checks,
    line_checks,
    message_checks,
    snapshot_checks,
    source_checks,
    state_checks,
)
from checks.registry import ORACLES as ALL_ORACLES
from checks.registry import QUERIES as ALL_QUERIES

__all__ = ["ALL_ORACLES", "ALL_QUERIES"]
