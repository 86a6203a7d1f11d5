"""Registered queries. Importing the modules fills the registry."""

from . import align_queries, grid_queries, model_queries, report_queries, stage_queries, survey_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
