"""Aggregates that must not hold a whole group in one row."""

from __future__ import annotations

from tallyforge.plans.registry import QUERIES


def test_list_confidence_collects_no_lists(spark, sf):
    plan = QUERIES["list_confidence"](spark, sf)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "partial_min" in plan
