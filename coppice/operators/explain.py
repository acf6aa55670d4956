"""Model-agnostic explanations: permutation importance and partial dependence.

A scorer is any function that adds a ``prediction`` column to a DataFrame: a SQL
expression, a fitted forest, or something of the caller's own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.functions import safe_ratio, stable_hash

Scorer = Callable[[DataFrame], DataFrame]

ROWS_PER_BLOCK = 10_000
# Grid points expanded per row in one pass; larger grids are worked off in several passes.
GRID_POINTS_PER_PASS = 4_096
DEFAULT_RESOLUTION = 51
BASELINE = "(none)"


def expr_scorer(expression: str) -> Scorer:
    """Scorer made of a SQL expression over the columns."""
    return lambda df: df.withColumn("prediction", F.expr(expression).cast("double"))


# ---------------------------------------------------------------- permutation importance


def require_row_ids(df: DataFrame, ids: list[str]) -> int:
    """Number of rows; raises if the ids are shared by many rows.

    Hashes of the ids decide where a row goes, so an id held by a large share of the rows
    would put them all in one block and one bag. One pass with a mergeable estimate, no
    shuffle of the ids.
    """
    estimate = F.approx_count_distinct(F.xxhash64(*ids), 0.02)
    row = df.agg(F.count(F.lit(1)).alias("n"), estimate.alias("ids")).first()
    if row["ids"] < 0.8 * row["n"]:
        raise ValueError(
            f"{ids} do not identify rows: about {row['ids']} values for {row['n']} rows; "
            "name more id columns, or none to have the rows numbered by prepare()"
        )
    return row["n"]


def block_count(df: DataFrame, ids: list[str], rows_per_block: int = ROWS_PER_BLOCK) -> int:
    """Number of permutation blocks that keeps a block at about ``rows_per_block`` rows."""
    return max(2, math.ceil(require_row_ids(df, ids) / rows_per_block))


def with_permuted(
    df: DataFrame,
    ids: list[str],
    features: list[str],
    blocks: int,
    seed: int = 0,
    prefix: str = "__perm_",
) -> DataFrame:
    """Add ``__block`` and, for every feature, its value on the next row of the block.

    Rows are dealt to blocks by a hash of their id and ordered by a second hash; shifting by
    one and wrapping round is a permutation inside the block. One shuffle serves all
    features, and no global order is needed.
    """
    keyed = df.withColumn(
        "__block", F.pmod(stable_hash(ids, f"block:{seed}"), F.lit(blocks))
    ).withColumn("__order", stable_hash(ids, f"order:{seed}"))
    ring = Window.partitionBy("__block").orderBy("__order", *ids)
    shifted = {
        f"{prefix}{f}": F.coalesce(F.lead(f).over(ring), F.first(f).over(ring)) for f in features
    }
    return keyed.withColumns(shifted).drop("__order")


def permuted_variants(df: DataFrame, features: list[str], prefix: str = "__perm_") -> DataFrame:
    """One row per original row and variant: untouched, and each feature permuted."""
    names = F.array(*[F.lit(n) for n in [BASELINE, *features]])
    exploded = df.withColumn("variable", F.explode(names))
    swapped = {
        f: F.when(F.col("variable") == F.lit(f), F.col(f"{prefix}{f}")).otherwise(F.col(f))
        for f in features
    }
    return exploded.withColumns(swapped).drop(*[f"{prefix}{f}" for f in features])


def _importance(errors: DataFrame, repeat: str) -> DataFrame:
    """Scaled importance from the errors (``repeat``, ``variable``, ``mse``) of all variants."""
    # one row per repeat and variable: the window only ever holds the variants of one repeat
    whole = Window.partitionBy(repeat)
    untouched = F.max(F.when(F.col("variable") == BASELINE, F.col("mse"))).over(whole)
    deltas = errors.withColumn("__delta", F.col("mse") - untouched).where(
        F.col("variable") != BASELINE
    )
    n = F.count("__delta")
    return deltas.groupBy("variable").agg(
        F.avg("__delta").alias("importance"),
        safe_ratio(F.avg("__delta"), F.stddev_samp("__delta") / F.sqrt(n)).alias("importance_z"),
        n.alias("repeats"),
    )


def permutation_importance(
    df: DataFrame,
    scorer: Scorer,
    features: list[str],
    label: str,
    ids: list[str],
    blocks: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """Rise of the squared error when a feature is permuted, scaled by its standard error.

    The blocks are the repeats. The table is partitioned by block once; variants, scores and
    the errors per block all stay inside that partitioning.
    """
    blocks = blocks or block_count(df, ids)
    needed = list(dict.fromkeys([*ids, *features, label]))
    variants = permuted_variants(
        with_permuted(df.select(*needed), ids, features, blocks, seed), features
    )
    errors = (
        scorer(variants)
        .groupBy("__block", "variable")
        .agg(F.avg(F.pow(F.col("prediction") - F.col(label), F.lit(2))).alias("mse"))
    )
    return _importance(errors, "__block")


# ---------------------------------------------------------------- partial dependence


def grid_values(
    df: DataFrame, variables: Sequence[str], resolution: int | None = None
) -> dict[str, list[float]]:
    """Equally spaced values of each numeric variable.

    Without a resolution a variable gets as many points as it has distinct values, at most
    51. Distinct values are estimated first and counted exactly only where the estimate is
    small enough to matter, so the exact count never shuffles a high-cardinality column.
    """
    if resolution is not None and resolution < 2:
        raise ValueError("a grid needs at least two points")
    stats = [F.min(v).cast("double").alias(f"min_{i}") for i, v in enumerate(variables)]
    stats += [F.max(v).cast("double").alias(f"max_{i}") for i, v in enumerate(variables)]
    if resolution is None:
        stats += [F.approx_count_distinct(v).alias(f"n_{i}") for i, v in enumerate(variables)]
    row = df.agg(*stats).first()
    points = {v: resolution or DEFAULT_RESOLUTION for v in variables}
    if resolution is None:
        few = [v for i, v in enumerate(variables) if row[f"n_{i}"] <= 4 * DEFAULT_RESOLUTION]
        if few:
            exact = df.agg(*[F.count_distinct(v).alias(f"n_{i}") for i, v in enumerate(few)]).first()
            points |= {v: min(exact[f"n_{i}"], DEFAULT_RESOLUTION) for i, v in enumerate(few)}
    grid = {}
    for i, v in enumerate(variables):
        low, high, n = row[f"min_{i}"], row[f"max_{i}"], points[v]
        if low is None:
            grid[v] = []
        else:
            grid[v] = [low + k * (high - low) / (n - 1) for k in range(n)] if n > 1 else [low]
    return grid


def code_grid(levels: int) -> list[float]:
    """Grid of an ordinally encoded category: every level code."""
    return [float(k) for k in range(levels)]


def _slices(grid: Mapping[str, Sequence[float]], per_pass: int):
    """Cut the grid into passes of at most ``per_pass`` points: (variable, offset, values)."""
    current, room = [], per_pass
    for variable, values in grid.items():
        start = 0
        while start < len(values):
            take = min(room, len(values) - start)
            current.append((variable, start, [float(x) for x in values[start : start + take]]))
            start, room = start + take, room - take
            if room == 0:
                yield current
                current, room = [], per_pass
    if current:
        yield current


def _expanded(df: DataFrame, pieces: list[tuple[str, int, list[float]]], inputs: list[str]) -> DataFrame:
    entries = F.array(
        *[
            F.struct(F.lit(v).alias("variable"), F.lit(o).alias("start"), F.lit(xs).alias("points"))
            for v, o, xs in pieces
        ]
    )
    wide = (
        df.withColumn("__piece", F.explode(entries))
        .select(
            *inputs,
            F.col("__piece.variable").alias("variable"),
            F.col("__piece.start").alias("__start"),
            F.posexplode("__piece.points").alias("__at", "value"),
        )
        .withColumn("grid_index", F.col("__start") + F.col("__at"))
        .drop("__start", "__at")
    )
    varied = {v for v, _, _ in pieces}

    def substituted(c: str) -> Column:
        return F.when(F.col("variable") == F.lit(c), F.col("value")).otherwise(F.col(c))

    return wide.withColumns({c: substituted(c) for c in inputs if c in varied})


def partial_dependence(
    df: DataFrame,
    scorer: Scorer,
    grid: Mapping[str, Sequence[float]],
    inputs: list[str],
    per_pass: int = GRID_POINTS_PER_PASS,
) -> DataFrame:
    """Mean prediction with one variable set to each grid value in turn.

    ``inputs`` are the columns the scorer reads; nothing else is carried. The grid is a
    literal inside the plan, so expanding rows is a map-side step and only one partial mean
    per grid point and task is shuffled.
    """
    base = df.select(*inputs)
    curves = [
        scorer(_expanded(base, pieces, inputs))
        .groupBy("variable", "grid_index", "value")
        .agg(F.avg("prediction").alias("yhat"))
        for pieces in _slices(grid, per_pass)
    ]
    return reduce(DataFrame.unionByName, curves)


def average_curves(curves: DataFrame) -> DataFrame:
    """Mean curve of each variable over replicates."""
    return curves.groupBy("variable", "grid_index", "value").agg(F.avg("yhat").alias("mean_yhat"))
