"""Registered queries. Importing this package fills QUERIES and SQL."""

from . import analytics, assist, audits, corpus, files, labels, learning, rules, streams  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
