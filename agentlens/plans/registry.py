"""All queries of the library outside the training-text operators, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlens.plans.bindings import oracle, view

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, views: str, sql: str | None, digits: int = 6) -> Callable:
    """Registers a function of the named views (as DataFrames) under ``name``; ``sql`` is its DuckDB form over the same
    views. Doubles of the result are rounded to ``digits`` places, as the SQL's are."""

    def wrap(f: Callable[..., DataFrame]) -> Callable:
        def run(spark, sf_dir: str) -> DataFrame:
            out = f(*[view(spark, sf_dir, v) if v.startswith("v_") else spark.read.parquet(f"{sf_dir}/{v}.parquet") for v in views.split()])
            return out.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

        QUERIES[name] = run
        if sql is not None:
            names = [v for v in views.split() if v.startswith("v_")]
            ORACLES[name] = oracle(sql, *names) if names else sql
        return f

    return wrap


for _module in ("audit", "decisions", "text", "joins", "reports", "learning", "streams"):
    importlib.import_module(f"agentlens.plans.{_module}_queries")
