"""The registered queries, each with the SQL that must give the same rows."""

from .registry import QUERIES, oracle_texts, runners

# Importing the modules registers their queries.
from . import (  # noqa: F401, E402  isort: skip
    q_scalars,
    q_tables,
    q_stats,
    q_text,
    q_extract,
    q_sources,
    q_jobs,
)

__all__ = ["QUERIES", "oracle_texts", "runners"]
