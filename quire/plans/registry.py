"""All named queries of the library and their SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("text", "search", "relations", "content", "lexicon", "structure", "keys", "originals", "checks", "models", "files", "passages")


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        for key, value in getattr(import_module(f"quire.plans.{name}"), what).items():
            if key in out:
                raise ValueError(f"two queries are named {key}")
            out[key] = value
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("SQL")
