"""Explanations of scorers whose answers are known in closed form."""

import math

import pytest
from pyspark.sql import functions as F

from coppice.operators.explain import (
    _slices,
    average_curves,
    block_count,
    code_grid,
    expr_scorer,
    grid_values,
    partial_dependence,
    permutation_importance,
    with_permuted,
)
from coppice.operators.forest import score_models


def test_grid_has_as_many_points_as_values_up_to_51(spark):
    df = spark.range(1000).select(
        (F.col("id") % 4).cast("double").alias("few"),
        (F.col("id") % 51).cast("double").alias("edge"),
        F.col("id").cast("double").alias("many"),
        F.lit(5.0).alias("flat"),
        F.lit(None).cast("double").alias("none"),
    )
    grid = grid_values(df, ["few", "edge", "many", "flat", "none"])
    assert grid["few"] == [0.0, 1.0, 2.0, 3.0]
    assert len(grid["edge"]) == 51 and len(grid["many"]) == 51
    assert grid["many"][0] == 0.0 and math.isclose(grid["many"][-1], 999.0)
    assert grid["flat"] == [5.0] and grid["none"] == []
    assert len(grid_values(df, ["few"], 20)["few"]) == 20
    with pytest.raises(ValueError):
        grid_values(df, ["few"], 1)


def test_slices_cover_the_grid_once():
    grid = {"a": [1.0, 2.0, 3.0], "b": code_grid(7), "c": []}
    for size in (1, 2, 4, 100):
        seen = [(v, o + i, x) for piece in _slices(grid, size) for v, o, xs in piece for i, x in enumerate(xs)]
        assert seen == [(v, i, x) for v, xs in grid.items() for i, x in enumerate(xs)]
        assert all(sum(len(xs) for _, _, xs in piece) <= size for piece in _slices(grid, size))


@pytest.mark.parametrize("per_pass", [3, 4096])
def test_dependence_of_an_additive_scorer_is_its_component(spark, planted, per_pass):
    score = expr_scorer("3 * a + b * b")
    grid = {"a": [0.0, 1.0, 2.0], "b": [0.0, 2.0]}
    got = {
        (r.variable, r.grid_index): r.yhat
        for r in partial_dependence(planted, score, grid, ["a", "b"], per_pass).collect()
    }
    means = planted.agg(F.avg(3 * F.col("a")).alias("a"), F.avg(F.col("b") ** 2).alias("b")).first()
    assert len(got) == 5
    for i, a in enumerate(grid["a"]):
        assert math.isclose(got[("a", i)], 3 * a + means.b)
    for i, b in enumerate(grid["b"]):
        assert math.isclose(got[("b", i)], means.a + b * b)


def test_average_of_curves(spark):
    df = spark.createDataFrame(
        [("a", 0, 1.0, 2.0), ("a", 0, 1.0, 4.0)], "variable string, grid_index int, value double, yhat double"
    )
    assert average_curves(df).first().mean_yhat == 3.0


def test_permuting_keeps_each_block_a_permutation(spark, planted):
    out = with_permuted(planted, ["id"], ["a", "b"], 7, seed=2)
    sums = out.groupBy("__block").agg(
        F.sort_array(F.collect_list("a")).alias("x"), F.sort_array(F.collect_list("__perm_a")).alias("y")
    )
    assert sums.count() == 7 and sums.where("x != y").count() == 0
    assert out.where("a = __perm_a").count() == 0


def test_importance_ranks_the_planted_signal(spark, planted):
    score = expr_scorer("3 * a + b")
    got = {
        r.variable: r
        for r in permutation_importance(planted, score, ["a", "b", "c"], "y", ["id"], blocks=6).collect()
    }
    assert got["a"].importance > 5 * got["b"].importance > 0
    assert got["c"].importance == 0 and got["c"].importance_z is None
    assert got["a"].repeats == 6
    # E[(3(a' - a))^2] = 2 * 9 * var(U(0, 10)) = 150
    assert abs(got["a"].importance - 150) < 12


def test_importance_shuffles_the_table_once(spark, planted):
    score = expr_scorer("3 * a + b")
    df = permutation_importance(planted, score, ["a", "b"], "y", ["id"], blocks=6)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # by block, then one row per variable


def test_block_count_grows_with_the_rows(spark):
    assert block_count(spark.range(95), ["id"], 10) == 10
    assert block_count(spark.range(5), ["id"], 10) == 2


def test_shared_ids_are_refused(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("id"))
    with pytest.raises(ValueError, match="do not identify rows"):
        block_count(df, ["id"])


def test_score_models_is_one_pass(spark, planted):
    scorers = {1: expr_scorer("a"), 2: expr_scorer("b")}
    out = score_models(scorers, planted, "y", ["id"])
    assert out.columns == ["model", "observed", "predicted", "id"]
    assert out.count() == 6000
    many = {m: expr_scorer(f"a + {m}") for m in range(23)}
    wide = score_models(many, planted, "y").groupBy("model").agg(F.count("predicted").alias("n"))
    assert sorted((r.model, r.n) for r in wide.collect()) == [(m, 3000) for m in range(23)]
    assert out.where("model = 2").join(planted, "id").where("predicted <> b").count() == 0
