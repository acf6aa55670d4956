"""Semantics on tiny frames: missing values, ties, thresholds, categories."""

import math

import pytest
from pyspark.sql import functions as F

from coppice.functions import (
    composite_key,
    log2_or_null,
    mse,
    r2_explained,
    r2_out_of_bag,
    residual,
    rmse,
    to_number,
)
from coppice.operators import cohorts
from coppice.operators.charts import dependence_lines, dependence_strip, importance_ranked, top_variables
from coppice.operators.cohorts import (
    at_least,
    complete_cases,
    exclude,
    first_per_group,
    in_set,
    unexposed,
)
from coppice.operators.encode import (
    CategoryEncoder,
    label_values,
    level_codes,
    map_categories,
    mapping_frame,
    ordinal_encode,
)
from coppice.operators.evaluate import fit_metrics, transfer_metrics
from coppice.operators.features import group_mean, minmax_rescale, ratio_within_group
from coppice.operators.reshape import move_after, stack_filling, stack_tagged, to_long


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame([("s1", 1.0), ("s1", None), ("s2", 2.0)], "site string, v double")


def test_mean_propagates_or_skips_missing(sites):
    strict = {r.site: r.m for r in group_mean(sites, "site", "v", "m").collect()}
    skipping = {r.site: r.m for r in group_mean(sites, "site", "v", "m", "skip").collect()}
    assert strict == {"s1": None, "s2": 2.0}
    assert skipping == {"s1": 1.0, "s2": 2.0}
    with pytest.raises(ValueError):
        group_mean(sites, "site", "v", "m", "drop")


@pytest.mark.parametrize("max_rows", [0, 1000])
def test_ratio_within_group(spark, max_rows):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 3.0), ("b", 0.0), ("c", None)], "site string, v double"
    )
    got = {(r.site, r.v): r.relative for r in ratio_within_group(df, "site", "v", max_rows=max_rows).collect()}
    assert got == {("a", 1.0): 0.5, ("a", 3.0): 1.5, ("b", 0.0): None, ("c", None): None}


def test_first_per_group_puts_missing_last_and_breaks_ties(spark):
    burns = spark.createDataFrame(
        [("a", None, 1), ("a", 2.0, 3), ("a", 2.0, 2), ("b", 5.0, 4), ("c", None, 5)],
        "id string, area double, row int",
    )
    up = {r.id: r.row for r in first_per_group(burns, "id", "area", ["row"]).collect()}
    down = {r.id: r.row for r in first_per_group(burns, "id", "area", ["row"], True).collect()}
    assert up == {"a": 2, "b": 4, "c": 5}
    assert down == {"a": 2, "b": 4, "c": 5}


def test_first_per_group_limits_before_the_shuffle(spark, planted):
    plan = first_per_group(planted, "d", "a", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_log2_and_number_parsing(spark):
    df = spark.createDataFrame([("0",), ("-1",), ("8",), ("x",), (None,)], "t string")
    got = [r.p for r in df.select(log2_or_null(to_number("t")).alias("p")).collect()]
    assert got == [None, None, 3.0, None, None]


def test_residual_sign(spark):
    df = spark.createDataFrame([(3.0, 1.0)], "p double, o double")
    assert df.select(residual("p", "o")).first()[0] == 2.0
    assert df.select(residual("p", "o", "observed-predicted")).first()[0] == -2.0
    with pytest.raises(ValueError):
        residual("p", "o", "squared")


def test_composite_key_shows_missing_parts(spark):
    df = spark.createDataFrame([("Average", None)], "t string, r int")
    assert df.select(composite_key("t", "r")).first()[0] == "Average.NA"


def test_rescale_of_a_flat_group_is_missing(spark):
    df = spark.createDataFrame([("f", 1.0), ("f", 1.0), ("g", 1.0), ("g", 3.0)], "variable string, v double")
    got = sorted(
        (r.variable, r.x_rescaled) for r in minmax_rescale(df, "variable", "v").where("variable='g'").collect()
    )
    assert got == [("g", 0.0), ("g", 1.0)]
    flat = minmax_rescale(df, "variable", "v", max_rows=0).where("variable='f'").collect()
    assert [r.x_rescaled for r in flat] == [None, None]


def test_metrics_of_constant_predictions(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 4.0)], "m int, predicted double, observed double")
    row = transfer_metrics(df, ["m"]).first()
    assert row.r2_pct is None and math.isclose(row.rmse, math.sqrt(5))
    one = fit_metrics(df.limit(1), ["m"]).first()
    assert one.r2_oob is None and one.mse == 1.0


def test_metrics_against_hand_computation(spark):
    data = [(1.0, 2.0), (2.0, 1.0), (4.0, 5.0), (None, 100.0)]
    df = spark.createDataFrame(data, "p double, o double")
    row = df.agg(
        mse("p", "o").alias("mse"), rmse("p", "o").alias("rmse"),
        r2_explained("p", "o").alias("r2"), r2_out_of_bag("p", "o").alias("oob"),
    ).first()
    var = sum((o - 8 / 3) ** 2 for o in (2, 1, 5)) / 2
    assert math.isclose(row.mse, 1.0) and math.isclose(row.rmse, 1.0)
    assert math.isclose(row.oob, 1 - 1 / var)
    cov = sum((p - 7 / 3) * (o - 8 / 3) for p, o in ((1, 2), (2, 1), (4, 5)))
    vp = sum((p - 7 / 3) ** 2 for p in (1, 2, 4))
    assert math.isclose(row.r2, cov**2 / (vp * 2 * var))


def test_categories_and_labels(spark):
    df = spark.createDataFrame([("known",), ("unknown",), (None,)], "variable string")
    mapping = mapping_frame(spark, {"known": "Climate"}, "variable", "category")
    plain = [r.category for r in map_categories(df, mapping, "variable").collect()]
    other = [r.category for r in map_categories(df, mapping, "variable", default="Other").collect()]
    assert plain == ["Climate", None, None]
    assert other == ["Climate", "Other", "Other"]
    labels = mapping.withColumnRenamed("category", "label")
    assert [r.label for r in label_values(df, labels, "variable").collect()] == ["Climate", "unknown", None]


@pytest.mark.parametrize("max_rows", [0, 10_000])
def test_level_codes_follow_the_order(spark, max_rows):
    df = spark.range(500).select(F.concat(F.lit("L"), (F.col("id") % 97).cast("string")).alias("c"))
    codes = {r.c: r.code for r in level_codes(df, "c", max_rows).collect()}
    assert codes == {c: i for i, c in enumerate(sorted(f"L{i}" for i in range(97)))}
    coded = ordinal_encode(df, "c", max_rows=max_rows)
    assert coded.count() == 500 and coded.where("code is null").count() == 0


@pytest.mark.parametrize("max_rows", [0, 10_000])
def test_encoder_codes_columns_separately(spark, max_rows):
    train = spark.createDataFrame([("b", "x", 1), ("a", "y", 2), ("b", "z", 3)], "q string, p string, n int")
    encoder = CategoryEncoder.fit(train, ["q", "p"], max_rows)
    new = spark.createDataFrame([("a", "z", 1), ("new", None, 2)], "q string, p string, n int")
    got = sorted((r.n, r.q, r.p) for r in encoder.transform(new, max_rows).where("n = 1").collect())
    assert got == [(1, 0.0, 2.0)]
    unseen = encoder.transform(new, max_rows).where("n = 2").first()
    assert unseen.q == 2.0 and unseen.p is None
    assert encoder.counts == {"q": 2, "p": 3}


def test_filters(spark):
    df = spark.createDataFrame(
        [(1.0, "N", "s1"), (0.9, "N", "s2"), (None, "N", "s3"), (2.0, None, "s4"), (float("nan"), "N", "s5")],
        "share double, conf string, site string",
    )
    assert {r.site for r in at_least(df.where("site != 's5'"), "share", 1.0).collect()} == {"s1", "s4"}
    assert {r.site for r in at_least(df.where("site != 's5'"), "share", 1.0, True).collect()} == {"s4"}
    assert {r.site for r in exclude(df, {"conf": "None", "site": "s1"}).collect()} == {"s2", "s3", "s5"}
    assert {r.site for r in complete_cases(df).collect()} == {"s1", "s2"}
    assert {r.site for r in in_set(df, "site", ["s1", "s9"]).collect()} == {"s1"}


def test_survey_with_only_filtered_events_stays_unexposed(spark):
    surveys = spark.createDataFrame([("low",), ("flagged",), ("burned",), (None,)], "survey string")
    events = spark.createDataFrame(
        [("low", 0.5, "N"), ("flagged", 50.0, "Y"), ("burned", 50.0, "N")], "survey string, share double, qc string"
    )
    exposed = at_least(events, "share", 1.0).where("qc = 'N'")
    for bound in (0, 100):
        got = {r.survey for r in unexposed(surveys, exposed, "survey", bound).collect()}
        assert got == {"low", "flagged", None}


def test_stacking_and_reordering(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3,)], "x int")
    assert [tuple(r) for r in stack_filling(a, b).orderBy("x").collect()] == [(1, 2), (3, None)]
    tagged = stack_tagged({1: a, 2: a}, "iteration")
    assert sorted(r.iteration for r in tagged.collect()) == [1, 2]
    assert move_after(a.withColumn("z", F.lit(0)), "z", "x").columns == ["x", "z", "y"]
    long = to_long(a, ["x", "y"])
    assert sorted((r.variable, r.value) for r in long.collect()) == [("x", 1.0), ("y", 2.0)]


def test_importance_tables(spark):
    imp = spark.createDataFrame(
        [("a", 1, 5.0), ("a", 2, 7.0), ("b", 1, -1.0), ("b", 2, 2.0), ("c", 1, 0.5), ("c", 2, 0.5)],
        "variable string, iteration int, importance double",
    )
    top = [(r.variable, r.rank) for r in top_variables(imp, 2).orderBy("rank").collect()]
    assert top == [("a", 1), ("b", 2)]
    ranked = importance_ranked(imp, drop_negative=True)
    assert ranked.count() == 5
    assert ranked.where("variable = 'b'").first().mean_importance == 0.5


def test_curves_without_run_are_filled(spark):
    curves = spark.createDataFrame([("a", 1.0, 2.0, 1), ("a", 2.0, None, 1)], "variable string, value double, yhat double, model_run int")
    means = spark.createDataFrame([("a", 1.0, 2.0)], "variable string, value double, mean_yhat double")
    lines = {(r.line_type, r.line) for r in dependence_lines(curves, means).collect()}
    assert lines == {("Individual", "Individual.1"), ("Average", "Average.NA")}
    assert [r.x_rescaled for r in dependence_strip(curves).collect()] == [0.0]


def test_nan_is_no_large_number(spark):
    df = spark.sql("select * from values (1, double('nan')), (1, 2.0D), (2, 0.5D), (2, null) as t(k, v)")
    assert [r.v for r in cohorts.at_least(df, "v", 1.0).collect()] == [2.0]
    assert sorted(r.v for r in cohorts.first_per_group(df, "k", "v", ["v"], descending=True).collect()) == [0.5, 2.0]
