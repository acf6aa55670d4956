"""Splits, folds and bags depend on ids only."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from coppice.functions import bag_weight, out_of_bag, poisson1
from coppice.operators.sampling import bag_weights, holdout_split, kfold_assign


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(parts=st.integers(1, 7), folds=st.integers(2, 9), seed=st.integers(0, 10**6))
def test_folds_are_a_partition_whatever_the_layout(spark, parts, folds, seed):
    df = spark.range(400)
    one = {r.id: r.fold for r in kfold_assign(df, ["id"], folds, seed).collect()}
    two = {r.id: r.fold for r in kfold_assign(df.repartition(parts), ["id"], folds, seed).collect()}
    assert one == two and set(one.values()) <= set(range(folds)) and len(one) == 400


def test_split_has_the_asked_share(spark):
    flags = [r.is_train for r in holdout_split(spark.range(20_000), ["id"], 0.75, 3).collect()]
    assert abs(sum(flags) / len(flags) - 0.75) < 0.01


def test_weights_look_like_poisson_and_differ_between_bags(spark):
    n = 40_000
    cols = bag_weights(spark.range(n), ["id"], 6, seed=1)
    row = cols.agg(
        *[F.avg(f"__w{b}").alias(f"m{b}") for b in range(6)],
        *[F.avg((F.col(f"__w{b}") == 0).cast("int")).alias(f"z{b}") for b in range(6)],
        *[F.corr("__w0", f"__w{b}").alias(f"c{b}") for b in range(1, 6)],
    ).first()
    for b in range(6):
        assert abs(row[f"m{b}"] - 1) < 0.03
        assert abs(row[f"z{b}"] - math.exp(-1)) < 0.01
    assert all(abs(row[f"c{b}"]) < 0.03 for b in range(1, 6))


@pytest.mark.parametrize("u,k", [(0.0, 0), (0.3678, 0), (0.3679, 1), (0.98, 3), (1 - 2.0**-32, 12)])
def test_poisson_quantiles(spark, u, k):
    assert spark.range(1).select(poisson1(F.lit(u))).first()[0] == k


def test_out_of_bag_means_weight_zero(spark):
    df = spark.range(5000)
    for b in (0, 3, 7):
        assert df.where((bag_weight(["id"], b, 2) == 0) != out_of_bag(["id"], b, 2)).count() == 0


def test_ids_may_span_columns(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("a"), F.floor(F.col("id") / 10).alias("b"))
    assert df.select(bag_weight(["a", "b"], 0)).distinct().count() > 1
