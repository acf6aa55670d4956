"""Candidate settings, cross-validated search and the final fit."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coppice.functions import r2_explained, rmse, stable_hash, uniform01
from coppice.operators.evaluate import cv_metric_summary
from coppice.operators.explain import Scorer
from coppice.operators.forest import ForestSpec, ModelTable, fit_replicates, run_all, with_spec, workflow
from coppice.operators.reshape import to_long
from coppice.operators.sampling import holdout_split, kfold_assign
from coppice.session import stage

Ranges = Mapping[str, tuple[float, float]]
PARAMETERS = ("mtry", "min_n", "trees")


def _levels(low: float, high: float, levels: int, integer: bool) -> list[float]:
    step = (high - low) / (levels - 1) if levels > 1 else 0.0
    values = [low + i * step for i in range(levels)]
    return sorted({math.floor(v) for v in values}) if integer else values


def regular_grid(
    spark: SparkSession, ranges: Ranges, levels: int = 5, integer: bool = True
) -> DataFrame:
    """Every combination of equally spaced levels (floored and de-duplicated if integer)."""
    grid = spark.range(1).drop("id")
    for name, (low, high) in ranges.items():
        values = F.array(*[F.lit(v) for v in _levels(low, high, levels, integer)])
        grid = grid.select("*", F.explode(values).alias(name))
    return grid


def latin_hypercube(
    spark: SparkSession, ranges: Ranges, n: int = 20, seed: int = 0, integer: bool = True
) -> DataFrame:
    """``n`` space-filling candidates: each parameter visits each of n strata exactly once.

    The strata are permuted by ranking a hash of the candidate number, and the position
    inside a stratum is another hash. The windows hold the n candidates.
    """
    design = spark.range(n).withColumnRenamed("id", "candidate")
    for name, (low, high) in ranges.items():
        order = Window.orderBy(stable_hash(["candidate"], f"{seed}:{name}"), "candidate")
        at = (F.row_number().over(order) - 1 + uniform01(["candidate"], f"{seed}:{name}:in")) / n
        if integer:
            value = F.floor(F.lit(low) + at * F.lit(high - low + 1)).cast("int")
        else:
            value = F.lit(low) + at * F.lit(high - low)
        design = design.withColumn(name, value)
    return design


def with_config_id(candidates: DataFrame) -> DataFrame:
    """Add a readable, unique id per candidate."""
    parts = [F.concat(F.lit(p[:2] + "="), F.col(p).cast("string")) for p in PARAMETERS]
    return candidates.withColumn("config", F.concat_ws(" ", *parts))


def _candidate_rows(candidates: DataFrame) -> list[tuple[str, dict[str, int]]]:
    """Candidates on the driver: their number is chosen by the caller, not by the data."""
    rows = with_config_id(candidates).select("config", *PARAMETERS).distinct().orderBy("config")
    return [(r.config, {p: int(r[p]) for p in PARAMETERS}) for r in rows.collect()]


def _spec_for(base: ForestSpec, point: Mapping[str, int]) -> ForestSpec:
    return with_spec(base, trees=point["trees"], mtry=point["mtry"], min_node=point["min_n"])


def _fitted(table: ModelTable, spec: ForestSpec, hashed_bags: bool) -> Scorer:
    """A forest of the rows of ``table``, as a scorer."""
    if hashed_bags:
        return fit_replicates(table, spec, [1], 1)[0].scorer()
    return workflow(table, spec).fit(table.df).transform


def grid_search(
    table: ModelTable,
    candidates: DataFrame,
    base: ForestSpec = ForestSpec(),
    folds: int = 5,
    seed: int = 0,
    parallelism: int = 4,
    hashed_bags: bool = False,
) -> DataFrame:
    """Fit every candidate on every fold; long metrics (config, parameters, fold, metric).

    Folds are a column of one staged table. Each fit and its assessment is a job of its
    own, submitted from a bounded pool; only two numbers per job return to the driver. With ``hashed_bags``
    candidates are bagged as final models are, each bag by a hash of the row ids; else by MLlib, in one fit.
    """
    spark = table.df.sparkSession
    folded = stage(kfold_assign(table.df, table.ids, folds, seed, "__fold"), "folds", spread=True)
    points = _candidate_rows(candidates)

    def job(config: str, point: dict[str, int], fold: int):
        def assess():
            training = replace(table, df=folded.where(F.col("__fold") != fold))
            score = _fitted(training, _spec_for(base, point), hashed_bags)
            scored = score(folded.where(F.col("__fold") == fold))
            row = scored.agg(
                rmse("prediction", table.label).alias("rmse"),
                r2_explained("prediction", table.label).alias("rsq"),
            ).first()
            head = (config, *[point[p] for p in PARAMETERS], fold)
            return [(*head, "rmse", row.rmse), (*head, "rsq", row.rsq)]

        return assess

    jobs = [job(c, p, f) for c, p in points for f in range(folds)]
    found = [row for rows in run_all(spark, jobs, parallelism) for row in rows]
    schema = "config string, mtry int, min_n int, trees int, fold int, metric string, estimate double"
    return spark.createDataFrame(found, schema)


def collect_metrics(search: DataFrame) -> DataFrame:
    """Mean, fold count and standard error per candidate and metric."""
    return cv_metric_summary(search, ["config", *PARAMETERS, "metric"])


def tuning_long(summary: DataFrame, metric: str = "rmse") -> DataFrame:
    """Mean metric against each parameter value, one row per candidate and parameter."""
    rows = summary.where(F.col("metric") == metric)
    return to_long(rows, list(PARAMETERS), ["config", "mean"], "parameter", "value")


def select_best(
    summary: DataFrame, metric: str = "rmse", config: str = "config", maximize: bool = False
) -> DataFrame:
    """The candidate with the best mean, ties broken by its id."""
    rows = summary.where((F.col("metric") == metric) & F.col("mean").isNotNull())
    lead = F.col("mean").desc() if maximize else F.col("mean").asc()
    return rows.orderBy(lead, F.col(config)).limit(1)


def last_fit(
    table: ModelTable,
    best: Mapping[str, int],
    base: ForestSpec = ForestSpec(),
    train_fraction: float = 0.75,
    seed: int = 0,
    hashed_bags: bool = False,
) -> DataFrame:
    """Refit the chosen candidate on the training rows and report on the held-out ones; see ``grid_search`` for the bags."""
    split = holdout_split(table.df, table.ids, train_fraction, seed, "__train")
    score = _fitted(replace(table, df=split.where("__train")), _spec_for(base, best), hashed_bags)
    scored = score(split.where("not __train"))
    wide = scored.agg(
        rmse("prediction", table.label).alias("rmse"),
        r2_explained("prediction", table.label).alias("rsq"),
    )
    return to_long(wide, ["rmse", "rsq"], [], "metric", "estimate")


def training_part(
    table: ModelTable, train_fraction: float = 0.75, seed: int = 0
) -> ModelTable:
    """The training rows of the split that ``last_fit`` holds out from."""
    split = holdout_split(table.df, table.ids, train_fraction, seed, "__train")
    kept = split.where("__train").drop("__train")
    return ModelTable(kept, table.label, table.features, table.ids, table.encoder, table.carried)
