"""Registered queries: each pairs a Spark plan with the SQL that checks it."""

from __future__ import annotations

REGISTRY: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn

    return add


def load_all() -> dict[str, tuple]:
    from . import accuracy, changes, counting, sketches, snapshot, streams, trees, written  # noqa: F401

    return REGISTRY
