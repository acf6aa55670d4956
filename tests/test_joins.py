from collections import Counter

import pytest
from pyspark.sql import functions as F

from coppice.operators.joins import (
    fits_broadcast,
    heavy_keys,
    join_on_pairs,
    left_join_expecting,
    lookup_join,
    spread_join,
)


def rows(df):
    return Counter(tuple(r) for r in df.select(*sorted(df.columns)).collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share key 1, another large part has no key."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 1)
        .when(F.col("id") % 7 == 0, F.lit(None))
        .otherwise(F.col("id") % 700 + 10)
        .cast("bigint")
        .alias("k"),
        (F.col("id") % 5).alias("x"),
    )


@pytest.fixture(scope="module")
def many(spark):
    """Several rows per key; key 12 is crowded here only, key 1 on both sides."""
    return spark.range(400).select(
        F.when(F.col("id") % 4 == 0, 1)
        .when(F.col("id") % 4 == 1, 12)
        .otherwise(F.col("id") % 300)
        .cast("bigint")
        .alias("k"),
        F.col("id").alias("z"),
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("unique", [True, False])
def test_spread_join_equals_plain_join(skewed, many, how, unique):
    right = many.groupBy("k").agg(F.max("z").alias("z")) if unique else many
    plain = skewed.join(right, ["k"], how)
    assert rows(spread_join(skewed, right, ["k"], how, unique)) == rows(plain)


def test_spread_join_on_two_keys(skewed, many):
    left = skewed.withColumn("g", F.col("x") % 2)
    right = many.withColumn("g", F.col("z") % 2)
    assert rows(spread_join(left, right, ["k", "g"])) == rows(left.join(right, ["k", "g"], "left"))


def test_spread_join_with_empty_sides(skewed, many):
    assert rows(spread_join(skewed.where("false"), many, ["k"])) == Counter()
    none = many.where("false")
    assert rows(spread_join(skewed, none, ["k"])) == rows(skewed.join(none, ["k"], "left"))


def test_heavy_keys_are_few_and_contain_the_hot_one(skewed):
    found = {r.k for r in heavy_keys(skewed, ["k"], 16).collect()}
    assert found == {1, None}


def test_values_do_not_depend_on_the_way(spark):
    left = spark.sql("select 1 as k, -0.0D as x, map('a', 1) as m from range(300) union all select null, double('nan'), null")
    right = spark.range(2).select(F.lit(1).alias("k"), F.col("id").alias("z"))
    wide = spark.range(400).select(F.lit(1).alias("k"), F.col("id").alias("z"))
    for side in (right, wide):
        small = Counter(map(repr, lookup_join(left, side, ["k"]).collect()))
        assert Counter(map(repr, lookup_join(left, side, ["k"], max_rows=0).collect())) == small
        assert any("-0.0" in r for r in small)


def test_lookup_join_takes_both_ways(skewed, many):
    plain = rows(skewed.join(many, ["k"], "left"))
    assert rows(lookup_join(skewed, many, ["k"])) == plain
    assert rows(lookup_join(skewed, many, ["k"], max_rows=5)) == plain
    assert rows(lookup_join(skewed, many, ["k"], max_rows=5, derived=True)) == plain


def test_broadcast_bound_counts_rows_and_bytes(spark, many):
    assert fits_broadcast(many, 400) and not fits_broadcast(many, 399)
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("t"), F.array("id").alias("a"))
    assert fits_broadcast(wide, 10, 11_000) and not fits_broadcast(wide, 10, 10_000)
    assert fits_broadcast(many.where("false"), 1)


def test_join_on_pairs_drops_the_right_keys(spark):
    left = spark.createDataFrame([(1, 2000, "p")], "site bigint, year int, v string")
    right = spark.createDataFrame([(1, 2000, "s")], "sid bigint, survey_year int, survey string")
    out = join_on_pairs(left, right, {"site": "sid", "year": "survey_year"})
    assert out.columns == ["site", "year", "v", "survey"]
    assert out.first().survey == "s"


def test_declared_cardinality_is_checked(skewed, many):
    with pytest.raises(ValueError, match="several rows"):
        left_join_expecting(skewed, many, ["k"], "n:1")
    with pytest.raises(ValueError, match="cardinality"):
        left_join_expecting(skewed, many, ["k"], "1:1")
    unique = many.groupBy("k").agg(F.max("z").alias("z"))
    assert left_join_expecting(skewed, unique, ["k"], "n:1").count() == 3000
