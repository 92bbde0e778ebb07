"""Importing this module registers every query."""

from ledgerscope.plans import (  # noqa: F401
    economics_queries, frame_queries, gate_queries, lever_queries, model_queries, primitive_queries, score_queries, warning_queries,
)
from ledgerscope.plans.registry import ORACLES, QUERIES  # noqa: F401
