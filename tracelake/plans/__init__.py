"""Registered queries: each binds an operator to the driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

from . import q_decode, q_detect, q_graph, q_headers, q_index, q_pipeline, q_quality, q_ranges, q_records, q_recovery, q_scan, q_sources, q_timeline  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401


def flagship(spark, sf_dir):
    return QUERIES["a04_session_rollup"](spark, sf_dir)
