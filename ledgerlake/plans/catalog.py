"""Imports every plan module, so that all queries are registered."""

from ledgerlake.plans import (calculation, dashboards, extraction, insight,  # noqa: F401
                              ledger_writes, normalise, streams)  # noqa: F401
from ledgerlake.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
