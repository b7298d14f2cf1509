"""Registered queries with their check SQL."""

from __future__ import annotations

from plumbline.registry import drift, lifecycle, metrics, prepare, scoring, semantic, streams

PARTS = (prepare, scoring, drift, semantic, metrics, lifecycle, streams)


def all_queries():
    """Name to callable ``(spark, sf_dir) -> DataFrame``."""
    return {name: fn for part in PARTS for name, (fn, _) in part.ENTRIES.items()}


def all_sql():
    """Name to check SQL, for every query that plain SQL can express."""
    return {name: sql for part in PARTS for name, (_, sql) in part.ENTRIES.items() if sql}
