"""Registry of the runnable queries and their reference SQL.

Each query names its output columns and kinds once: i = bigint, d = double
(6 decimals), s = string, b = boolean. Both sides are cast to that list.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracle_base import BASE


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}

_SPARK = {"i": "bigint", "s": "string", "b": "boolean"}
_DUCK = {"i": "bigint", "s": "varchar", "b": "boolean"}


def query(name: str, columns: str, sql: str | None = None):
    """Register a query: ``columns`` is "name:kind name:kind ..."."""
    spec = tuple(tuple(c.split(":")) for c in columns.split())

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.select(*[_spark_col(c, k) for c, k in spec])
        assert name not in QUERIES, name
        QUERIES[name] = Query(name, spec, run, None if sql is None else _finish(sql, spec))
        return fn
    return add


def _spark_col(c: str, kind: str):
    if kind == "d":
        return (F.round(F.col(c).cast("double"), 6) + F.lit(0.0)).alias(c)
    return F.col(c).cast(_SPARK[kind]).alias(c)


def _finish(sql: str, spec) -> str:
    cols = ", ".join(
        f"round(cast({c} as double), 6) + 0.0 as {c}" if k == "d"
        else f"cast({c} as {_DUCK[k]}) as {c}" for c, k in spec)
    return f"{BASE},\nq__ as (\n{sql.strip()}\n)\nselect {cols} from q__"
