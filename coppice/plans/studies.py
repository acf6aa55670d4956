"""Complete studies: fit replicates, score them, explain them, carry them to new data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.operators import tuning
from coppice.operators.charts import dependence_lines, dependence_strip, top_variables
from coppice.operators.evaluate import transfer_metrics
from coppice.operators.explain import average_curves, grid_values
from coppice.operators.forest import (
    BaggedForest,
    ForestSpec,
    ModelTable,
    fit_per_group,
    fit_replicates,
    forest_importance,
    oob_predictions,
    replicate_metrics,
    run_all,
)
from coppice.operators.trees import flatten, tree_curves, tree_scores
from coppice.session import stage


@dataclass(frozen=True)
class Study:
    """Fitted replicates and the result tables derived from them."""

    table: ModelTable
    forests: list[BaggedForest]
    predictions: DataFrame
    metrics: DataFrame
    importance: DataFrame
    top: DataFrame
    groups: Mapping[object, tuple[ModelTable, BaggedForest]] = field(default_factory=dict)


def run_study(
    table: ModelTable,
    spec: ForestSpec,
    replicates: Sequence[int] = range(1, 51),
    top: int = 10,
    parallelism: int = 4,
    carried: Sequence[str] = (),
) -> Study:
    """Fit the replicates and derive out-of-bag predictions, metrics and importances."""
    forests = fit_replicates(table, spec, replicates, parallelism)
    predictions = stage(oob_predictions(forests, table, carried), "oob")
    importance = stage(forest_importance(forests, table), "importance")
    return Study(
        table,
        forests,
        predictions,
        replicate_metrics(predictions),
        importance,
        top_variables(importance, top, "importance_z"),
    )


def dependence_grid(
    table: ModelTable, variables: Sequence[str], resolution: int | None = None
) -> DataFrame:
    """``variable, grid_index, value``: equally spaced points for numbers, every level code for categories."""
    spark = table.df.sparkSession
    numeric = [v for v in variables if v not in table.levels]
    points = grid_values(table.df, numeric, resolution) if numeric else {}
    rows = [(v, i, x) for v, xs in points.items() for i, x in enumerate(xs)]
    grid = spark.createDataFrame(rows, "variable string, grid_index int, value double")
    for v in variables:
        if v in table.levels:
            codes = spark.range(table.levels[v]).select(
                F.lit(v).alias("variable"), F.col("id").cast("int").alias("grid_index"), F.col("id").cast("double").alias("value")
            )
            grid = grid.unionByName(codes)
    return grid


def replicate_curves(
    table: ModelTable,
    forests: Sequence[BaggedForest],
    variables: Sequence[str],
    resolution: int | None = 20,
) -> DataFrame:
    """Dependence curve of each variable in each already fitted replicate."""
    return tree_curves(flatten(forests), table.df, dependence_grid(table, variables, resolution))


def dependence_tables(
    table: ModelTable,
    forests: Sequence[BaggedForest],
    variables: Sequence[str],
    resolution: int | None = 20,
) -> dict[str, DataFrame]:
    """Strip of the first replicate, averages over all, and the combined line table."""
    curves = stage(replicate_curves(table, forests, variables, resolution), "curves")
    averages = average_curves(curves)
    first = curves.where(F.col("model_run") == F.lit(forests[0].replicate))
    return {
        "strip": dependence_strip(first.drop("model_run")),
        "average": averages,
        "lines": dependence_lines(curves, averages),
    }


def run_transfer(
    study_table: ModelTable,
    forests: Sequence[BaggedForest],
    new_rows: DataFrame,
    carried: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Score stored replicates on another cohort: (long predictions, metrics per model)."""
    kept = {c: f"__keep_{c}" for c in carried}
    rows = new_rows.withColumns({n: F.col(c) for c, n in kept.items()})
    if study_table.encoder:
        rows = study_table.encoder.transform(rows)
    rows = rows.withColumns({f: F.col(f).cast("double") for f in study_table.features})
    long = tree_scores(flatten(forests), rows, study_table.label, list(kept.values()), iteration="model")
    long = long.select("model", "observed", "predicted", *kept.values())
    predictions = long.withColumnsRenamed({n: c for c, n in kept.items()})
    return predictions, transfer_metrics(predictions, ["model"])


def run_difference_study(
    rows: DataFrame,
    features: Sequence[str],
    ids: Sequence[str],
    spec: ForestSpec,
    model: str = "model",
    label: str = "difference",
    categorical: Sequence[str] = (),
    parallelism: int = 4,
) -> Study:
    """Model the prediction error separately for every transferred model.

    ``groups`` of the result holds the table and the forest of each model by its key; ``table`` holds the rows of all.
    A forest's replicate number, which the result tables carry, is the key if that is a number.
    """
    fits = fit_per_group(
        rows, model, label, features, ids, spec, categorical, parallelism=parallelism
    )
    forests = [forest for _, forest in fits.values()]
    predictions = [oob_predictions([forest], part) for part, forest in fits.values()]
    importance = run_all(
        rows.sparkSession,
        [lambda p=p, f=f: forest_importance([f], p) for p, f in fits.values()],
        parallelism,
    )
    parts = [part for part, _ in fits.values()]
    table = replace(parts[0], df=reduce(DataFrame.unionByName, [p.df for p in parts]))
    oob = stage(reduce(DataFrame.unionByName, predictions), "difference-oob")
    weights = stage(reduce(DataFrame.unionByName, importance), "difference-importance")
    return Study(
        table, forests, oob, replicate_metrics(oob), weights,
        top_variables(weights, 10, "importance_z"), fits,
    )


def difference_curves(
    study: Study, variables: Sequence[str], resolution: int | None = 20
) -> DataFrame:
    """Dependence curves of each difference model on its own rows; ``model_run`` names the model."""
    curves = [
        replicate_curves(table, [forest], variables, resolution) for table, forest in study.groups.values()
    ]
    return reduce(DataFrame.unionByName, curves)


@dataclass(frozen=True)
class Tuning:
    """Summaries of the space-filling and the regular search, the winner and its test fit."""

    first: DataFrame
    second: DataFrame
    best: DataFrame
    final: DataFrame


def run_tuning(
    table: ModelTable,
    first_ranges: tuning.Ranges,
    second_ranges: tuning.Ranges,
    base: ForestSpec = ForestSpec(),
    candidates: int = 20,
    levels: int = 5,
    folds: int = 5,
    seed: int = 0,
    parallelism: int = 4,
    hashed_bags: bool = False,
) -> Tuning:
    """Space-filling search, regular search, best candidate by RMSE, hold-out fit.

    ``hashed_bags`` bags candidates as final models are, at a job for each bag; else each is one MLlib fit.
    """
    spark = table.df.sparkSession
    train = tuning.training_part(table, seed=seed)
    wide = tuning.latin_hypercube(spark, first_ranges, candidates, seed)
    narrow = tuning.regular_grid(spark, second_ranges, levels)
    first = tuning.collect_metrics(
        tuning.grid_search(train, wide, base, folds, seed, parallelism, hashed_bags)
    )
    second = tuning.collect_metrics(
        tuning.grid_search(train, narrow, base, folds, seed, parallelism, hashed_bags)
    )
    best = tuning.select_best(second)
    row = best.first()
    point = {p: row[p] for p in tuning.PARAMETERS}
    return Tuning(first, second, best, tuning.last_fit(table, point, base, seed=seed, hashed_bags=hashed_bags))
