"""Group statistics put back on the rows they were computed from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions import safe_ratio, strict_mean
from coppice.operators.joins import BROADCAST_ROWS, lookup_join


def group_mean(
    df: DataFrame, key: str, value: str, out: str = "group_mean", null_policy: str = "propagate"
) -> DataFrame:
    """One row per key with the mean of ``value``.

    ``"propagate"`` gives null to a group with any null member, ``"skip"`` averages the rest.
    """
    if null_policy not in {"propagate", "skip"}:
        raise ValueError(f"unknown null policy {null_policy!r}")
    mean = strict_mean(value) if null_policy == "propagate" else F.avg(value)
    return df.groupBy(key).agg(mean.alias(out))


def ratio_to_group_mean(
    df: DataFrame,
    means: DataFrame,
    key: str,
    value: str,
    mean_col: str = "group_mean",
    out: str = "relative",
    max_rows: int = BROADCAST_ROWS,
    derived: bool = True,
) -> DataFrame:
    """Add ``value / mean of its group``, the means coming from another (unfiltered) table.

    Pass ``derived=False`` for means that are already stored.
    """
    joined = lookup_join(df, means, [key], "left", True, max_rows, derived)
    return joined.withColumn(out, safe_ratio(value, mean_col))


def ratio_within_group(
    df: DataFrame,
    key: str,
    value: str,
    out: str = "relative",
    null_policy: str = "propagate",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Ratio to the mean of the same table.

    Same result as a mean over a window partitioned by ``key``, but a window would pull all
    rows of a group into one task; aggregating first shuffles one row per key and task.
    """
    means = group_mean(df, key, value, "__mean", null_policy)
    return ratio_to_group_mean(df, means, key, value, "__mean", out, max_rows).drop("__mean")


def minmax_rescale(
    df: DataFrame,
    key: str,
    value: str,
    out: str = "x_rescaled",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Rescale ``value`` to [0, 1] inside each group; null for a group without spread."""
    bounds = df.groupBy(key).agg(F.min(value).alias("__min"), F.max(value).alias("__max"))
    joined = lookup_join(df, bounds, [key], "left", True, max_rows, derived=True)
    scaled = safe_ratio(F.col(value) - F.col("__min"), F.col("__max") - F.col("__min"))
    return joined.withColumn(out, scaled).drop("__min", "__max")
