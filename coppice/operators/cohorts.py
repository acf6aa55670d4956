"""Which rows enter a model table: thresholds, exclusions, complete cases, first events."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from coppice.operators.joins import BROADCAST_ROWS, lookup_join


def at_least(df: DataFrame, col: str, bound: float, strict: bool = False) -> DataFrame:
    """Rows with ``col >= bound`` (``> bound`` when strict); null and NaN never qualify."""
    kept = F.col(col) > bound if strict else F.col(col) >= bound
    return df.where(kept & ~_is_nan(df, col))


def _is_nan(df: DataFrame, col: str) -> Column:
    """Whether a value is NaN; only floating columns can hold it, and Spark orders it above all numbers."""
    return F.isnan(col) if isinstance(df.schema[col].dataType, (DoubleType, FloatType)) else F.lit(False)


def in_set(df: DataFrame, col: str, values: Iterable) -> DataFrame:
    """Rows whose ``col`` is one of ``values``."""
    return df.where(F.col(col).isin(list(values)))


def exclude(df: DataFrame, unwanted: Mapping[str, object]) -> DataFrame:
    """Rows that differ from ``unwanted`` in every named column; null rows go as well."""
    for col, value in unwanted.items():
        df = df.where(F.col(col) != F.lit(value))
    return df


def complete_cases(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Keep ``columns`` and the rows where none of them is null or NaN."""
    if columns is not None:
        df = df.select(*columns)
    return df.dropna(how="any")


def unexposed(
    df: DataFrame, exposed: DataFrame, key: str, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Rows whose key never occurs in the already filtered ``exposed`` table."""
    ids = exposed.select(key).distinct()
    return lookup_join(df, ids, [key], "left_anti", True, max_rows, derived=True)


def first_per_group(
    df: DataFrame,
    key: str,
    order_by: str,
    tie_break: list[str],
    descending: bool = False,
) -> DataFrame:
    """One row per key: the smallest (or largest) ``order_by``, nulls and NaN last.

    The rank filter becomes a window group limit that already runs before the shuffle, so
    each task sends at most one row per key, however large a group is.
    """
    known = F.when(~_is_nan(df, order_by), F.col(order_by))
    lead = known.desc_nulls_last() if descending else known.asc_nulls_last()
    ties: list[Column] = [F.col(c).asc_nulls_last() for c in tie_break]
    window = Window.partitionBy(key).orderBy(lead, *ties)
    return (
        df.withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank")
    )
