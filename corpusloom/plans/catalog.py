"""Loads every module that registers queries."""

from __future__ import annotations

from corpusloom.plans import aggregate_queries, descriptive, divergence_queries, flag_queries, inference_queries, kernel_queries, methods, pair_queries, resolve_queries, source_queries, text_queries, window_queries  # noqa: F401
from corpusloom.plans.registry import ORACLES, QUERIES  # noqa: F401
