"""Registered queries: one Spark plan per operator, and SQL that states the same result."""

from rowscribe.plans.registry import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
