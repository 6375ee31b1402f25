"""Every registered query and its DuckDB SQL, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Modules that register queries when they are imported.
MODULES = ("stats", "text", "classify", "patterns", "windows", "monitor", "vectors", "distributions", "similarity", "integrity", "dictionary", "codec", "schedules")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"stratalyte.operators.{m}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
