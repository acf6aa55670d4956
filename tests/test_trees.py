"""The node table against MLlib's own scores, and the number of passes over the rows."""

from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions import out_of_bag
from coppice.operators import trees as T
from coppice.operators.explain import grid_values, partial_dependence, permuted_variants, with_permuted
from coppice.operators.forest import ForestSpec, fit_replicates, forest_importance, oob_predictions, prepare
from coppice.plans.studies import dependence_grid, replicate_curves, run_transfer

SPEC = ForestSpec(trees=7, mtry=2, min_node=4, bags=3, max_depth=6, max_bins=32)


@pytest.fixture(scope="module")
def table(planted):
    return prepare(planted, "y", ["a", "b", "c", "d"], ["id"], ["d"])


@pytest.fixture(scope="module")
def forests(table):
    return fit_replicates(table, SPEC, [1, 2, 5], parallelism=4)


@pytest.fixture(params=[1 << 30, 1])
def passes(request, monkeypatch):
    """All replicates in one pass, or each in its own."""
    monkeypatch.setattr(T, "PASS_BYTES", request.param)
    return 1 if request.param > 1 else 3


def _scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def test_nodes_say_what_the_models_say(table, forests):
    flat = T.flatten(forests)
    rows = table.df.limit(200).toPandas()
    x = rows[table.features].to_numpy(float)
    x[3, 0], x[4, 1] = np.nan, np.inf
    models = [t for f in forests for m in f.bags for t in m.trees]
    walked = flat.walk(np.arange(len(models)), x)
    from pyspark.ml.linalg import Vectors

    for k in range(0, len(models), 5):
        assert walked[k].tolist() == [models[k].predict(Vectors.dense(v)) for v in x[:40]] + walked[k][40:].tolist()
    assert [sum(s) for s in flat.sizes] == [7, 7, 7] and flat.sizes[0] == [3, 2, 2]


def test_a_single_leaf_is_a_tree(spark):
    rows = spark.createDataFrame([(i, 1.0, 5.0) for i in range(20)], "id long, a double, y double")
    table = prepare(rows, "y", ["a"], ["id"])
    fitted = fit_replicates(table, ForestSpec(trees=2, bags=2, max_depth=3), [1], 1)
    found = oob_predictions(fitted, table).collect()
    assert len(found) == 20 and {r.predicted for r in found} <= {5.0, None}
    assert {r.importance for r in forest_importance(fitted, table, blocks=2).collect()} == {0.0}
    grid = dependence_grid(table, ["a"], 3)
    assert {r.yhat for r in T.tree_curves(T.flatten(fitted), table.df, grid).collect()} == {5.0}


def test_out_of_bag_scores_equal_those_of_the_models(table, forests, passes):
    found = oob_predictions(forests, table, ["c"])
    assert _scans(found) == passes
    got = {(r.iteration, r.id): (r.observed, r.predicted, r.c) for r in found.collect()}
    for forest in forests:
        scored = forest.raw_scores(table.df).select("id", "y", forest.combined_out_of_bag(table.ids).alias("p"), "c")
        for r in scored.collect():
            observed, predicted, c = got.pop((forest.replicate, r.id))
            assert (observed, c) == (r.y, r.c) and predicted == (pytest.approx(r.p, rel=1e-9) if r.p is not None else None)
    assert not got


def test_bags_are_recomputed_from_null_and_text_ids(spark):
    rows = spark.createDataFrame([("é", 1), (None, 2), ("a:b", None), (None, None)], "k string, n long")
    wanted = rows.select(*[out_of_bag(["k", "n"], b, 77) for b in range(9)]).collect()
    prefixes = [r[0] for r in rows.select(T.hash_prefix(["k", "n"])).collect()]
    assert T.unseen_rows(prefixes, 77, 9).T.tolist() == [list(r) for r in wanted]


def test_importance_equals_scoring_every_variant(table, forests, passes):
    found = {(r.iteration, r.variable): (r.importance, r.importance_z) for r in forest_importance(forests, table, 3, 1).collect()}
    permuted = with_permuted(table.df, table.ids, table.features, 3, 1)
    for forest in forests:
        rises = {f: [] for f in table.features}
        for b in range(len(forest.bags)):
            scored = forest.raw_scores(permuted_variants(permuted.where(forest.unseen(table.ids, b)), table.features))
            error = F.avg(F.pow(F.col(f"__bag{b}") - F.col("y"), 2))
            mse = {r.variable: r.e for r in scored.groupBy("variable").agg(error.alias("e")).collect()}
            for f in table.features:
                rises[f].append(mse[f] - mse["(none)"])
        for f, rise in rises.items():
            mean, error = np.mean(rise), np.std(rise, ddof=1) / np.sqrt(len(rise))
            got = found.pop((forest.replicate, f))
            assert got[0] == pytest.approx(mean, abs=1e-9) and got[1] == (pytest.approx(mean / error, rel=1e-6) if error else None)
    assert not found


def test_curves_equal_scoring_every_grid_point(table, forests, passes):
    found = replicate_curves(table, forests, table.features, 9)
    got = {(r.model_run, r.variable, r.grid_index): (r["value"], r.yhat) for r in found.collect()}
    grid = grid_values(table.df, ["a", "b", "c"], 9) | {"d": [0.0, 1.0, 2.0]}
    for forest in forests:
        for r in partial_dependence(table.df, forest.scorer(), grid, table.features).collect():
            value, yhat = got.pop((forest.replicate, r.variable, r.grid_index))
            assert value == r["value"] and yhat == pytest.approx(r.yhat, rel=1e-9)
    assert not got


def test_two_hundred_levels_are_evaluated_by_interval(spark):
    rows = spark.range(2000).select(
        "id", F.format_string("level%03d", F.col("id") % 200).alias("k"), (F.col("id") % 7).cast("double").alias("a"),
        ((F.col("id") % 200) * 0.5 + F.col("id") % 7).alias("y"),
    )
    table = prepare(rows, "y", ["k", "a"], ["id"], ["k"])
    fitted = fit_replicates(table, ForestSpec(trees=3, bags=3, mtry=2, max_depth=4, max_bins=16, min_node=2), [1], 2)
    got = {r.grid_index: r.yhat for r in replicate_curves(table, fitted, ["k"]).collect()}
    wanted = partial_dependence(table.df, fitted[0].scorer(), {"k": [float(i) for i in range(200)]}, table.features).collect()
    assert len(got) == 200 and all(got[r.grid_index] == pytest.approx(r.yhat, rel=1e-9) for r in wanted)
    assert len(set(got.values())) <= len(T.flatten(fitted).thresholds(0)) + 1 < 60


def test_transfer_scores_all_replicates_in_one_pass(table, forests, planted):
    long, metrics = run_transfer(table, forests, planted.withColumn("d", F.lit("new level")), ["id", "d"])
    assert long.columns == ["model", "observed", "predicted", "id", "d"] and metrics.count() == 3
    assert {r.d for r in long.select("d").distinct().collect()} == {"new level"}
    rows = table.encoder.transform(planted.withColumn("d", F.lit("new level")))
    wanted = reduce(DataFrame.unionByName, [f.scorer()(rows).select(F.lit(f.replicate).alias("m"), "id", "prediction") for f in forests])
    got = {(r.model, r.id): r.predicted for r in long.collect()}
    for r in wanted.collect():
        assert got.pop((r.m, r.id)) == pytest.approx(r.prediction, rel=1e-9)
    assert not got


def test_node_table_survives_a_round_trip(spark, table, forests):
    flat = T.flatten(forests)
    again = T.Trees.from_arrow(flat.to_arrow(), dict(zip(flat.replicates, flat.seeds, strict=True)), flat.features)
    x = np.random.default_rng(1).uniform(0, 10, (50, 4))
    every = np.arange(len(flat.root))
    assert (flat.walk(every, x) == again.walk(every, x)).all() and again.sizes == flat.sizes
    assert (flat.of == again.of).all() and (flat.bag == again.bag).all()
    shuffled = flat.to_arrow().take(np.random.default_rng(2).permutation(len(flat.feature)))
    mixed = T.Trees.from_arrow(shuffled, dict(zip(flat.replicates, flat.seeds, strict=True)), flat.features)
    assert (flat.walk(every, x) == mixed.walk(every, x)).all()


def test_published_strength_is_one_pass(spark, table, forests):
    """Fifty replicates of five hundred trees, made of the fitted ones, are scored in one scan of the table."""
    flat = T.flatten([f for k in range(17) for f in forests][:50])
    grown = T.Trees(
        flat.feature, flat.threshold, flat.left, flat.right, flat.value, flat.root, flat.bag, flat.of, list(range(50)), flat.seeds, flat.sizes,
        flat.features,
    )
    assert len(list(T.passes(grown))) == 1
    scored = T.tree_scores(grown, table.df, "y", ["id"], ["id"])
    assert _scans(scored) == 1 and scored.groupBy("iteration").count().count() == 50
