"""All queries and their SQL, by module."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["training_core", "audit", "extras", "records", "ledger"]


def _modules() -> list:
    return [importlib.import_module(f"tidemark.queries.{m}") for m in MODULES if importlib.util.find_spec(f"tidemark.queries.{m}")]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in _modules():
        out.update(m.queries())
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in _modules():
        out.update(m.oracle_sql())
    return out
