"""The library's queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from folioscan.plans import edits, encodings, pages
from folioscan.plans.oracles import ORACLES as _ORACLES
from folioscan.plans.queries import QUERIES as _QUERIES

QUERIES = {**_QUERIES, **pages.QUERIES, **edits.QUERIES, **encodings.QUERIES}
ORACLES = {**_ORACLES, **pages.ORACLES, **edits.ORACLES, **encodings.ORACLES}

FLAGSHIP = "anchor_exact"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
