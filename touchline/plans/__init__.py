"""Registered queries: each one pairs a DataFrame job with an independent SQL text."""

from __future__ import annotations

import importlib

FAMILIES = ("geometry_queries", "stats_queries", "tactics_queries", "motion_queries", "events_queries", "text_queries", "evidence_queries", "evaluation_queries", "streaming_queries", "source_queries", "sql_queries")


def all_queries():
    from touchline.plans.registry import ORACLE, QUERIES

    for family in FAMILIES:
        importlib.import_module(f"touchline.plans.{family}")
    return QUERIES, ORACLE


def flagship(spark, sf_dir):
    return all_queries()[0]["team_shape_summary"](spark, sf_dir)
