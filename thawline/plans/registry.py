"""Named queries: a Spark callable and, where SQL can say it, the same result in SQL.

Both sides are brought to one neutral form: doubles rounded, dates and stamps as
text, so that a comparison does not depend on either engine's display types.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def neutral(df: DataFrame, digits: int) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, digits)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def neutral_sql(sql: str, doubles: str, dates: str, stamps: str, digits: int) -> str:
    items = [f'round("{c}"::double, {digits}) + 0.0 as "{c}"' for c in doubles.split()]
    items += [f"strftime(\"{c}\", '%Y-%m-%d') as \"{c}\"" for c in dates.split()]
    items += [f"strftime(\"{c}\", '%Y-%m-%d %H:%M:%S') as \"{c}\"" for c in stamps.split()]
    if not items:
        return sql
    return f"select * replace ({', '.join(items)}) from (\n{sql}\n)"


def query(name: str, sql: str | None = None, doubles: str = "", dates: str = "", stamps: str = "",
          digits: int = DIGITS):
    """Register a query; `doubles`, `dates`, `stamps` name the columns to neutralise in the SQL."""
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: neutral(fn(spark, sf_dir), digits)
        if sql is not None:
            ORACLES[name] = neutral_sql(sql.strip(), doubles, dates, stamps, digits)
        return fn
    return add
