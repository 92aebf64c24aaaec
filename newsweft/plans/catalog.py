"""All registered queries."""

from newsweft.plans import (  # noqa: F401
    q_bundle,
    q_evidence,
    q_ingest,
    q_scoring,
    q_selection,
    q_similarity,
    q_sources,
    q_streaming,
    q_time,
)
from newsweft.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
