"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DateType,
    NumericType,
    TimestampNTZType,
    TimestampType,
)

from coppice.session import stage

# Largest table handed to a broadcast: measured, never assumed.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 128 * 2**20
# A key is hot when it holds more than 1/HOT_KEYS of the rows, so there are fewer than
# HOT_KEYS hot keys whatever the data: a proven bound for broadcasting them.
HOT_KEYS = 256


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """True when ``df`` is measured to stay within both bounds.

    At most ``max_rows + 1`` rows are read; values of variable length are measured as text.
    """
    fixed = (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType)
    loose = [f.name for f in df.schema.fields if not isinstance(f.dataType, fixed)]
    width = F.lit(8 * len(df.columns))
    for name in loose:
        width = width + F.coalesce(F.octet_length(F.col(f"`{name}`").cast("string")), F.lit(0))
    row = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).first()
    return row["n"] <= max_rows and (row["b"] or 0) <= max_bytes


def heavy_keys(df: DataFrame, keys: list[str], max_keys: int = HOT_KEYS) -> DataFrame:
    """Keys holding more than ``1/max_keys`` of the rows (fewer than ``max_keys`` of them).

    The counts combine on the map side, so a hot key costs one row per task here. The keys
    found pass through the driver, which their bound allows: the plans using them then do
    not count again.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    hot = counts.where(F.col("__n") * max_keys > total).select(*keys)
    return df.sparkSession.createDataFrame(hot.collect(), hot.schema)


def _keep(df: DataFrame, marker: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Semi or anti join with a bounded, broadcast table of keys (null matches null)."""
    named = marker.select(*[F.col(k).alias(f"__hot_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(named[f"__hot_{k}"]) for k in keys])
    return df.join(F.broadcast(named), same, how)


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "left",
    unique_right: bool = False,
) -> DataFrame:
    """Shuffle join whose crowded partitions adaptive execution can split.

    It splits the left side of a left, semi or anti join, and either side of an inner join. Keys
    that are hot on the right of a left join are therefore joined apart, as an inner join: each has
    partners, so that is the same rows. Rows are never grouped, so values stay as they are.
    """
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError(f"unsupported join type {how!r}")
    if how in {"left_semi", "left_anti"}:
        return left.join(right.select(*keys).distinct(), keys, how)
    if how == "inner" or unique_right:
        return left.join(right, keys, how)
    hot = heavy_keys(right.dropna(subset=keys), keys)
    if hot.isEmpty():
        return left.join(right, keys, how)
    crowded = _keep(left, hot, keys, "left_semi").join(_keep(right, hot, keys, "left_semi"), keys, "inner")
    rest = _keep(left, hot, keys, "left_anti").join(_keep(right, hot, keys, "left_anti"), keys, how)
    return rest.unionByName(crowded)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "left",
    unique_right: bool = False,
    max_rows: int = BROADCAST_ROWS,
    derived: bool = False,
) -> DataFrame:
    """Join with a side that is usually small: broadcast if counted small, else shuffled.

    ``derived`` says that the right side is the result of a shuffle over a large table. It
    is then written once, as counting, checking and joining would each compute it again.
    """
    if derived:
        right = stage(right, "join-side")
    if fits_broadcast(right, max_rows):
        return left.join(F.broadcast(right), keys, how)
    return spread_join(left, right, keys, how, unique_right)


def join_on_pairs(
    left: DataFrame,
    right: DataFrame,
    pairs: dict[str, str],
    how: str = "left",
    unique_right: bool = False,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join on differently named columns (left name -> right name), dropping the right keys."""
    renamed = right.withColumnsRenamed({r: l for l, r in pairs.items()})
    return lookup_join(left, renamed, list(pairs), how, unique_right, max_rows)


def left_join_expecting(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    expect: str = "m:n",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left join with a declared cardinality: ``"m:n"``, or ``"n:1"`` which is verified."""
    if expect not in {"m:n", "n:1"}:
        raise ValueError(f"unknown cardinality {expect!r}")
    if expect == "n:1":
        repeated = right.dropna(subset=keys).groupBy(*keys).count().where("count > 1")
        if not repeated.isEmpty():
            raise ValueError(f"right side has several rows for one value of {keys}")
    return lookup_join(left, right, keys, "left", expect == "n:1", max_rows)
