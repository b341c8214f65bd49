"""All named queries of the engine and their DuckDB equivalents."""

from __future__ import annotations

from . import explore, identity, ingestion, mapping, mining, olap, quality, relational, reports, scalar  # noqa: F401
from .core import QUERIES, SQL  # noqa: F401
