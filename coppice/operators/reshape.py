"""Stacking, unpivoting, reordering and ranking of result tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stack_tagged(tables: Mapping[object, DataFrame], tag: str) -> DataFrame:
    """Rows of same-schema tables under one another, each tagged with its key."""
    tagged = [df.withColumn(tag, F.lit(key)) for key, df in tables.items()]
    return reduce(DataFrame.unionByName, tagged)


def stack_filling(*tables: DataFrame) -> DataFrame:
    """Rows of tables under one another; a column missing in one is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def to_long(
    df: DataFrame,
    value_columns: list[str],
    ids: list[str] | None = None,
    names_to: str = "variable",
    values_to: str = "value",
) -> DataFrame:
    """Wide to long; the value columns are cast to double as they need one type."""
    ids = ids or []
    typed = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in value_columns])
    return typed.unpivot(ids, value_columns, names_to, values_to)


def move_after(df: DataFrame, col: str, after: str) -> DataFrame:
    """Move a column to the place behind another."""
    order = [c for c in df.columns if c != col]
    order.insert(order.index(after) + 1, col)
    return df.select(*order)


def top_k(df: DataFrame, order_by: str, tie_break: str, k: int = 10) -> DataFrame:
    """The k rows with the largest value; planned as a per-task top-k and a merge."""
    return df.orderBy(F.col(order_by).desc_nulls_last(), F.col(tie_break).asc()).limit(k)
