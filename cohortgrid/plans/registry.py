"""Registry of named queries and their independent SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import apply_runtime_conf
from ..sources.bindings import VIEWS, Bound, duck_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(bound) -> DataFrame`` under ``name``. Floats are rounded to
    six places on the way out, as in the oracle texts."""

    def register(fn: Callable[[Bound], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_runtime_conf(spark)
            return rounded(fn(Bound(spark, sf_dir)))

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    return df.selectExpr(*[f"round(`{c}`, {digits}) AS `{c}`" if c in doubles else f"`{c}`" for c in df.columns])


def sql(body: str, views: list[str], parts: dict[str, str] | None = None) -> str:
    """``WITH <views>, <parts> <body>`` in DuckDB SQL."""
    ctes = [f"{v} AS ({duck_text(v)})" for v in views if v in VIEWS]
    ctes += [f"{k} AS ({v})" for k, v in (parts or {}).items()]
    return "WITH " + ",\n".join(ctes) + "\n" + body
