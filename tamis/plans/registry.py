"""All queries of the engine with their SQL counterparts."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}
MODULES = ("sieve", "learning", "recollection", "insight", "domains", "serving", "streams", "collected", "routing", "governance", "ladders")


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir); sql: what DuckDB runs for the same rows."""

    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


for _module in MODULES:
    importlib.import_module(f"tamis.plans.{_module}")
