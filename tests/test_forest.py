"""Fitted forests: bags, out-of-bag scoring, importance, storage, transfer, tuning."""

import math

import pytest
from pyspark.sql import functions as F

from coppice.operators import tuning
from coppice.operators.explain import partial_dependence
from coppice.operators.forest import (
    ForestSpec,
    fit_per_group,
    fit_replicates,
    forest_importance,
    linear_fit_per_group,
    oob_predictions,
    prepare,
    replicate_metrics,
    workflow,
)
from coppice.plans.studies import (
    dependence_tables,
    run_difference_study,
    run_study,
    run_transfer,
    run_tuning,
)
from coppice.sources import load_forests, save_forests

SPEC = ForestSpec(trees=15, mtry=3, min_node=5, bags=5, max_depth=7, max_bins=32, seed=4)


@pytest.fixture(scope="module")
def table(planted):
    return prepare(planted, "y", ["a", "b", "c", "d"], ["id"], ["d"])


@pytest.fixture(scope="module")
def forests(table):
    return fit_replicates(table, SPEC, [1, 2], parallelism=8)


def test_spec_maps_to_the_estimator(spark):
    assert ForestSpec(trees=7, bags=3).bag_sizes() == [3, 2, 2]
    assert ForestSpec(trees=2, bags=20).bag_sizes() == [1, 1]
    one = ForestSpec(mtry=1, min_node=6).estimator(9, 4, 0)
    assert one.getFeatureSubsetStrategy() == "1"  # "1.0" would mean all features
    assert one.getMinInstancesPerNode() == 3
    assert ForestSpec(mtry=112).estimator(33, 1, 0).getFeatureSubsetStrategy() == "33"
    assert ForestSpec().estimator(26, 1, 0).getFeatureSubsetStrategy() == "5"
    with pytest.raises(ValueError, match="30 deep"):
        ForestSpec(max_depth=99).estimator(2, 1, 0)


def test_prepare_keeps_ids_that_are_also_features(planted):
    t = prepare(planted, "y", ["a", "d"], ["id", "d"], ["d"], carried=["b"])
    assert t.ids == ["id", "__id_d"] and t.carried == ["b"]
    types = dict(t.df.dtypes)
    assert types["d"] == "double" and types["__id_d"] == "string"
    with pytest.raises(ValueError, match="not in the table"):
        prepare(planted, "y", ["nope"], ["id"])


def test_rows_without_ids_are_numbered_once(planted):
    copies = planted.select("y", "a", "b").unionByName(planted.select("y", "a", "b"))
    t = prepare(copies, "y", ["a", "b"])
    assert t.ids == ["__row"] and t.df.select("__row").distinct().count() == 6000
    one = oob_predictions(fit_replicates(t, SPEC, [1], 8), t)
    assert one.count() == 6000


def test_ids_shared_by_many_rows_are_refused(planted):
    with pytest.raises(ValueError, match="do not identify rows"):
        prepare(planted, "y", ["a"], ["d"])


def test_workflow_is_a_pipeline(table):
    model = workflow(table, SPEC).fit(table.df)
    assert len(model.stages) == 2 and model.stages[1].getNumTrees == 15
    assert model.transform(table.df).where("prediction is null").count() == 0


def test_bags_are_fitted_without_their_out_of_bag_rows(table, forests):
    weights = table.df.select(*[forests[0].weight(["id"], b).alias(f"w{b}") for b in range(5)])
    never = weights.where(" and ".join(f"w{b} > 0" for b in range(5))).count()
    oob = oob_predictions(forests[:1], table)
    assert oob.where("predicted is null").count() == never > 0
    assert oob.count() == table.df.count()


def test_out_of_bag_scores_equal_brute_force(table, forests):
    forest = forests[0]
    cols = [forest.weight(["id"], b).alias(f"w{b}") for b in range(5)]
    local = forest.raw_scores(table.df).select("id", *cols, *[f"__bag{b}" for b in range(5)]).toPandas()
    got = oob_predictions([forest], table).toPandas().set_index("id").predicted
    sizes = [m.getNumTrees for m in forest.bags]
    for row in local.head(300).itertuples(index=False):
        out = [b for b in range(5) if row[1 + b] == 0]
        expected = sum(row[6 + b] * sizes[b] for b in out) / sum(sizes[b] for b in out) if out else math.nan
        assert (math.isnan(expected) and math.isnan(got[row[0]])) or math.isclose(got[row[0]], expected)


def test_forest_dependence_equals_brute_force(table, forests):
    score = forests[0].scorer()
    grid = {"a": [1.0, 5.0, 9.0], "d": [0.0, 2.0]}
    for r in partial_dependence(table.df, score, grid, table.features).collect():
        fixed = table.df.withColumn(r.variable, F.lit(r.value))
        assert math.isclose(r.yhat, score(fixed).agg(F.avg("prediction")).first()[0], rel_tol=1e-9)


def test_replicates_differ(table, forests):
    first = table.df.select(forests[0].weight(["id"], 0).alias("a"), forests[1].weight(["id"], 0).alias("b"))
    assert first.where("a <> b").count() > 1000


def test_out_of_bag_quality_is_honest(table, forests):
    rows = replicate_metrics(oob_predictions(forests, table)).collect()
    assert len(rows) == 2
    for r in rows:
        assert 0.85 < r.r2_oob < 0.99
        assert math.isclose(r.rmse, math.sqrt(r.mse))
    inside = forests[0].scorer()(table.df).agg(F.avg(F.pow(F.col("prediction") - F.col("y"), 2))).first()[0]
    assert inside < rows[0].mse


def test_refit_repeats_exactly(table, forests):
    again = fit_replicates(table, SPEC, [1], parallelism=3)[0]
    total = F.sum(F.round("prediction", 6))
    assert (
        again.scorer()(table.df).agg(total).first()[0] == forests[0].scorer()(table.df).agg(total).first()[0]
    )


def test_importance_finds_the_planted_order(table, forests):
    rows = forest_importance(forests, table).collect()
    assert len(rows) == 8
    for i in (1, 2):
        z = {r.variable: r.importance for r in rows if r.iteration == i}
        assert z["a"] > 5 * z["b"] > 5 * abs(z["c"])


def test_saved_forests_score_the_same(spark, table, forests, tmp_path):
    save_forests(spark, forests, str(tmp_path / "m"))
    loaded = load_forests(spark, str(tmp_path / "m"))
    assert [f.replicate for f in loaded] == [1, 2]
    both = loaded[0].scorer()(forests[0].scorer()(table.df).withColumnRenamed("prediction", "before"))
    assert both.where("abs(before - prediction) > 1e-9").count() == 0
    old = oob_predictions(forests[1:], table).agg(F.sum("predicted")).first()[0]
    new = oob_predictions(loaded[1:], table).agg(F.sum("predicted")).first()[0]
    assert math.isclose(old, new)


def test_scoring_names_missing_columns(table, forests):
    with pytest.raises(ValueError, match=r"\['c'\]"):
        forests[0].scorer()(table.df.drop("c"))


def test_transfer_to_new_rows_with_an_unseen_level(table, forests, planted):
    new = planted.where("id < 300").withColumn("d", F.when(F.col("id") < 3, "other").otherwise(F.col("d")))
    predictions, metrics = run_transfer(table, forests, new, ["id", "d"])
    assert predictions.count() == 600 and predictions.where("predicted is null").count() == 0
    assert {r.d for r in predictions.select("d").distinct().collect()} == {"level0", "level1", "level2", "other"}
    assert all(r.r2_pct > 85 for r in metrics.collect())


def test_one_forest_per_group(planted):
    rows = planted.withColumn("model", (F.col("id") % 2 + 1).cast("int"))
    fits = fit_per_group(rows, "model", "y", ["a", "b"], ["id"], SPEC, parallelism=4)
    assert list(fits) == [1, 2]
    assert all(t.df.count() == 1500 for t, _ in fits.values())
    study = run_difference_study(
        rows.withColumnRenamed("y", "difference"), ["a", "b", "d"], ["id"], SPEC, categorical=["d"]
    )
    assert study.metrics.count() == 2 and study.importance.count() == 6
    strongest = study.importance.groupBy("variable").agg(F.avg("importance").alias("m"))
    assert strongest.orderBy(F.desc("m")).first().variable == "a"


def test_linear_fit(planted):
    row = linear_fit_per_group(planted.withColumn("g", F.lit(1)), "g", "a", "y").first()
    assert abs(row.slope - 3) < 0.1 and row.n == 3000


def test_study_end_to_end(table):
    study = run_study(table, SPEC, [1, 2], top=2, parallelism=8)
    # few bags make the scaling noisy, so only the set of the two strongest is certain
    assert {r.variable for r in study.top.collect()} == {"a", "b"}
    curves = dependence_tables(table, study.forests, ["a", "d"], 5)
    assert curves["strip"].count() == 5 + 3
    assert curves["average"].count() == 8
    assert curves["lines"].groupBy("line_type").count().count() == 2
    a = [r.mean_yhat for r in curves["average"].where("variable = 'a'").orderBy("value").collect()]
    assert a == sorted(a) and a[-1] - a[0] > 15


def test_regular_grid_floors_integer_levels(spark):
    grid = tuning.regular_grid(spark, {"mtry": (5, 12), "min_n": (2, 8), "trees": (500, 1000)})
    assert sorted({r.min_n for r in grid.collect()}) == [2, 3, 5, 6, 8]
    assert grid.count() == 125
    assert tuning.regular_grid(spark, {"mtry": (1, 2)}).count() == 2


def test_hypercube_visits_every_stratum(spark):
    n = 20
    rows = tuning.latin_hypercube(spark, {"x": (0.0, 1.0), "y": (10.0, 30.0)}, n, 7, integer=False).collect()
    assert sorted(int(r.x * n) for r in rows) == list(range(n))
    assert sorted(int((r.y - 10) / 20 * n) for r in rows) == list(range(n))
    ints = {r.m for r in tuning.latin_hypercube(spark, {"m": (1, 4)}, n, 7).collect()}
    assert ints == {1, 2, 3, 4}


def test_best_candidate_breaks_ties_by_id(spark):
    rows = [("b", "rmse", 1.0), ("a", "rmse", 1.0), ("c", "rsq", 0.1), ("d", "rmse", None)]
    df = spark.createDataFrame(rows, "config string, metric string, mean double")
    assert tuning.select_best(df).first().config == "a"
    assert tuning.select_best(df, "rsq", maximize=True).first().config == "c"


def test_tuning_end_to_end(table):
    base = ForestSpec(max_depth=4, max_bins=16)
    ranges = {"mtry": (1, 4), "min_n": (2, 4), "trees": (2, 3)}
    out = run_tuning(table, ranges, ranges, base, candidates=2, levels=2, folds=2, parallelism=8)
    summary = out.second.collect()
    assert len(summary) == 16 and all(r.n == 2 for r in summary)
    best = out.best.first()
    assert best.mean == min(r["mean"] for r in summary if r.metric == "rmse")
    assert {r.metric for r in out.final.collect()} == {"rmse", "rsq"}
    assert tuning.tuning_long(out.second).count() == 24
