"""Every operator as a named query over the standard tables."""

from . import business_queries, model_queries, profile_queries, table_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
