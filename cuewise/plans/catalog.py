"""All registered queries; importing the query modules fills the registry."""

from cuewise.plans import (  # noqa: F401
    queries_history, queries_ingest, queries_ranking, queries_reports, queries_stream, queries_text, queries_time,
)
from cuewise.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
