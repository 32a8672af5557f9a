"""The registered queries: each operator over whole driver tables, with SQL for the same result."""

from __future__ import annotations

from curalith.queries import cells, governance, joins, ledger, projections, quality, runs
from curalith.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cells", "governance", "joins", "ledger", "projections", "quality", "runs"]
