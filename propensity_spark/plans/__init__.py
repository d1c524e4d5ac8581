"""Registered queries over the driver tables."""

from __future__ import annotations

import importlib

MODULES = ["customer_queries", "rule_queries", "metric_queries", "governance_queries", "model_queries"]


def load_queries() -> dict:
    for module in MODULES:
        importlib.import_module(f"propensity_spark.plans.{module}")
    from propensity_spark.plans.registry import QUERIES

    return QUERIES
