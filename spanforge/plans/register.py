"""The register of queries: a name, a function of (spark, sf_dir), and perhaps its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as long, others as double with six digits, start and end as s and e."""
    names = {"start": "s", "end": "e"}
    out = []
    for c, t in df.dtypes:
        col = F.col(f"`{c}`")
        if t in ("int", "smallint", "tinyint", "bigint"):
            col = col.cast("long")
        elif t in ("float", "double"):
            col = F.round(col.cast("double"), 6)
        out.append(col.alias(names.get(c, c)))
    return df.select(*out)


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = lambda spark, d: tidy(f(spark, d))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


R = lambda x, n: f"round({x}, 6) AS {n}"
