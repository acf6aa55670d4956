"""Deterministic hold-out splits, folds and bootstrap bags keyed by row id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions import bag_weight, stable_hash, uniform01


def holdout_split(
    df: DataFrame, ids: list[str], train_fraction: float = 0.75, seed: int = 0, out: str = "is_train"
) -> DataFrame:
    """Flag the training rows. A row's side depends on its id and the seed only."""
    return df.withColumn(out, uniform01(ids, f"split:{seed}") < F.lit(train_fraction))


def kfold_assign(
    df: DataFrame, ids: list[str], folds: int = 5, seed: int = 0, out: str = "fold"
) -> DataFrame:
    """Add a fold number from 0 to ``folds - 1``."""
    return df.withColumn(out, F.pmod(stable_hash(ids, f"fold:{seed}"), F.lit(folds)).cast("int"))


def bag_weights(
    df: DataFrame, ids: list[str], bags: int, seed: int = 0, prefix: str = "__w"
) -> DataFrame:
    """Add one bootstrap multiplicity column per bag."""
    return df.withColumns({f"{prefix}{b}": bag_weight(ids, b, seed) for b in range(bags)})
