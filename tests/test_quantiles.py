import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.operators.evaluate import boxplot_stats, exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.fixture(scope="module")
def values(spark):
    """One large skewed group a third of which is copies, one flat, one tiny, one with gaps."""
    big = spark.range(60_000, numPartitions=6).select(
        F.lit("big").alias("g"),
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.exp(F.randn(5) * 3)).alias("v"),
    )
    flat = spark.range(30_000).select(F.lit("flat").alias("g"), F.lit(2.5).alias("v"))
    tiny = spark.range(4).select(F.lit("tiny").alias("g"), F.col("id").cast("double").alias("v"))
    gaps = spark.range(5).select(
        F.lit("gaps").alias("g"), F.when(F.col("id") > 1, F.col("id").cast("double")).alias("v")
    )
    df = big.unionByName(flat).unionByName(tiny).unionByName(gaps)
    path = spark.conf.get("spark.checkpoint.dir", "/tmp") + "/quantile-test"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("whole,max_rows", [(100_000, 1000), (20_000, 1000), (20_000, 0)])
def test_quantiles_equal_brute_force(values, whole, max_rows):
    got = {
        (r.g, r.prob): (r.n, r.quantile)
        for r in exact_quantiles(values, "g", "v", PROBS, max_rows, whole).collect()
    }
    local = values.dropna().toPandas()
    assert len(got) == 4 * len(PROBS)
    for g, part in local.groupby("g"):
        for p in PROBS:
            n, q = got[(g, p)]
            assert n == len(part)
            assert np.isclose(q, np.quantile(part.v, p), rtol=1e-12)


def test_boxplot_equals_brute_force(values):
    local = values.dropna().toPandas()
    for r in boxplot_stats(values, "g", "v").collect():
        v = local.v[local.g == r.g].to_numpy()
        q1, med, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert np.allclose([r.q1, r.median, r.q3], [q1, med, q3])
        assert (r.whisker_low, r.whisker_high) == (inside.min(), inside.max())
        assert r.outliers == len(v) - len(inside) and r.n == len(v)
