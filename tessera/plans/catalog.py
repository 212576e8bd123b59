"""All queries of the block engine: importing this module registers them."""

from . import q_blocks, q_more, q_ranking, q_search, q_text, q_training  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
