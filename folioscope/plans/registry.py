"""All layout queries and their SQL."""

from __future__ import annotations

from .fixtures import sized
from .layout_queries import QUERIES as _LAYOUT
from .layout_sql import ORACLE_SQL
from .more_queries import QUERIES as _MORE

QUERIES = {name: sized(query) for name, query in (_LAYOUT | _MORE).items()}

__all__ = ["ORACLE_SQL", "QUERIES"]
