"""Named queries over the star-schema tables and the SQL they are checked against."""

from . import panel_queries, space_queries, table_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
