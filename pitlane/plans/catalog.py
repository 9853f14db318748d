"""All registered queries (importing the modules fills the registry)."""

from __future__ import annotations

from pitlane.plans import q_files, q_laps, q_metrics, q_models, q_prep, q_sequences, q_sources, q_streaming  # noqa: F401
from pitlane.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
