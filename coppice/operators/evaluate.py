"""Quality metrics, resampling summaries and box-chart statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.functions import mse, r2_explained, r2_out_of_bag, rmse
from coppice.operators.joins import BROADCAST_ROWS, lookup_join
from coppice.session import stage

# percentile_approx keeps a deterministic rank error of at most n / _SKETCH; the bracket
# taken around a rank is four times as wide.
_SKETCH = 10_000
_MARGIN = 4.0 / _SKETCH
# Groups up to this size keep all their values in one aggregation state.
WHOLE_GROUP = 100_000
# Bins a bracket is cut into to locate a rank before anything is sorted.
_BINS = 1_024


def transfer_metrics(
    predictions: DataFrame,
    by: list[str],
    predicted: str = "predicted",
    observed: str = "observed",
) -> DataFrame:
    """Variance explained (percent) and RMSE per model on a new cohort."""
    return predictions.groupBy(*by).agg(
        (F.lit(100.0) * r2_explained(predicted, observed)).alias("r2_pct"),
        rmse(predicted, observed).alias("rmse"),
    )


def fit_metrics(
    predictions: DataFrame,
    by: list[str],
    predicted: str = "predicted",
    observed: str = "observed",
) -> DataFrame:
    """The three notions of R2 next to one another, with MSE and RMSE."""
    explained = r2_explained(predicted, observed)
    return predictions.groupBy(*by).agg(
        (F.lit(100.0) * explained).alias("r2_pct"),
        r2_out_of_bag(predicted, observed).alias("r2_oob"),
        explained.alias("rsq"),
        mse(predicted, observed).alias("mse"),
        rmse(predicted, observed).alias("rmse"),
    )


def cv_metric_summary(
    metrics: DataFrame, by: list[str], value: str = "estimate"
) -> DataFrame:
    """Mean, count and standard error of a metric over the folds."""
    n = F.count(value)
    return metrics.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        n.alias("n"),
        F.try_divide(F.stddev_samp(value), F.sqrt(n)).alias("std_err"),
    )


def exact_quantiles(
    df: DataFrame,
    by: str,
    value: str,
    probabilities: list[float],
    max_rows: int = BROADCAST_ROWS,
    whole: int = WHOLE_GROUP,
) -> DataFrame:
    """Interpolated (type 7) quantiles per group: columns ``by, prob, n, quantile``.

    ``percentile`` keeps every distinct value of a group in one aggregation state, so it
    only serves groups of at most ``whole`` rows. For larger groups a mergeable sketch
    brackets each wanted rank first, see ``_large_group_quantiles``.
    """
    known = df.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("__v"))
    sizes = stage(known.groupBy(by).agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    large = sizes.where(F.col("n") > whole).select(by)
    if large.isEmpty():
        return _small_group_quantiles(known, by, probabilities)
    small_rows = lookup_join(known, large, [by], "left_anti", True, max_rows)
    large_rows = lookup_join(known, large, [by], "left_semi", True, max_rows)
    return _small_group_quantiles(small_rows, by, probabilities).unionByName(
        _large_group_quantiles(large_rows, by, probabilities, max_rows)
    )


def _small_group_quantiles(known: DataFrame, by: str, probabilities: list[float]) -> DataFrame:
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    found = known.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.percentile("__v", wanted).alias("__q")
    )
    pairs = F.arrays_zip(wanted.alias("prob"), F.col("__q").alias("quantile"))
    return found.select(by, "n", F.explode(pairs).alias("__p")).select(
        by, "__p.prob", "n", "__p.quantile"
    )


def _large_group_quantiles(
    known: DataFrame, by: str, probabilities: list[float], max_rows: int
) -> DataFrame:
    """Exact quantiles of groups too large for one task.

    The sketch bounds the values between which a rank lies. One pass counts the values below
    each bracket, another keeps the values inside with their multiplicities (copies collapse
    before the shuffle). The bracket, about n / 1,250 rows wide, is cut into bins whose
    totals locate the rank, and only the bins holding it are put in order.
    """
    wanted: list[float] = []
    for p in probabilities:
        wanted += [max(p - _MARGIN, 0.0), min(p + _MARGIN, 1.0)]
    sketch = known.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("__v").alias("__lo"),
        F.max("__v").alias("__hi"),
        F.percentile_approx("__v", wanted, _SKETCH).alias("__q"),
    )
    entries = []
    for i, p in enumerate(probabilities):
        at = (F.col("n") - 1) * F.lit(float(p))
        low = F.col("__lo") if p <= _MARGIN else F.col("__q")[2 * i]
        high = F.col("__hi") if p >= 1 - _MARGIN else F.col("__q")[2 * i + 1]
        entries.append(
            F.struct(
                F.lit(float(p)).alias("prob"),
                low.alias("low"),
                high.alias("high"),
                F.floor(at).alias("rank"),
                (at - F.floor(at)).alias("part"),
            )
        )
    brackets = sketch.select(by, "n", F.array(*entries).alias("__brackets"))
    marked = lookup_join(known, brackets, [by], "inner", True, max_rows, derived=True)
    v, b, every = F.col("__v"), F.col("__b"), range(len(probabilities))

    def bracket(i: int) -> Column:
        return F.col("__brackets")[i]

    below = marked.groupBy(by).agg(
        *[F.count_if(v < bracket(i)["low"]).alias(f"__below{i}") for i in every]
    )
    entries = [
        F.struct(F.lit(float(p)).alias("prob"), F.col(f"__below{i}").alias("__below"))
        for i, p in enumerate(probabilities)
    ]
    below = below.select(by, F.explode(F.array(*entries)).alias("__e")).select(by, "__e.*")

    hit = reduce(
        lambda x, y: x | y, [(v >= bracket(i)["low"]) & (v <= bracket(i)["high"]) for i in every]
    )
    around = F.filter("__brackets", lambda x: (v >= x["low"]) & (v <= x["high"]))
    place = F.floor(F.try_divide(v - b["low"], b["high"] - b["low"]) * _BINS)
    counted = stage(
        marked.where(hit)
        .select(by, "n", "__v", F.explode(around).alias("__b"))
        .select(
            by,
            "n",
            "__v",
            b["prob"].alias("prob"),
            b["rank"].alias("rank"),
            b["part"].alias("part"),
            F.coalesce(place, F.lit(0)).alias("bin"),
        )
        .groupBy(by, "n", "prob", "rank", "part", "bin", "__v")
        .agg(F.count(F.lit(1)).alias("__m")),
        "brackets",
    )
    upper_rank = F.least(F.col("rank") + 1, F.col("n") - 1)
    along = Window.partitionBy(by, "prob").orderBy("bin")
    sizes = counted.groupBy(by, "n", "prob", "rank", "bin").agg(F.sum("__m").alias("__size"))
    bins = (
        lookup_join(sizes, below, [by, "prob"], "inner", True, max_rows, derived=True)
        .withColumn("__base", F.col("__below") + F.sum("__size").over(along) - F.col("__size"))
        .where((F.col("__base") <= upper_rank) & (F.col("rank") < F.col("__base") + F.col("__size")))
        .select(by, "prob", "bin", "__base")
    )
    kept = lookup_join(counted, bins, [by, "prob", "bin"], "inner", True, max_rows, derived=True)
    order = Window.partitionBy(by, "prob", "bin").orderBy("__v")
    placed = kept.withColumn("__end", F.col("__base") + F.sum("__m").over(order))
    begin = F.col("__end") - F.col("__m")

    def at_rank(rank):
        return F.max(F.when((begin <= rank) & (rank < F.col("__end")), F.col("__v")))

    found = placed.groupBy(by, "n", "prob", "part").agg(
        at_rank(F.col("rank")).alias("__a"), at_rank(upper_rank).alias("__b")
    )
    missed = F.raise_error(F.lit("a quantile fell outside its sketch bracket")).cast("double")
    value_at = F.when(F.col("__a").isNull() | F.col("__b").isNull(), missed).otherwise(
        F.col("__a") + F.col("part") * (F.col("__b") - F.col("__a"))
    )
    return found.select(by, "prob", "n", value_at.alias("quantile"))


def boxplot_stats(
    df: DataFrame, by: str, value: str, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Quartiles, whiskers inside 1.5 IQR and number of outliers per group."""
    quantiles = exact_quantiles(df, by, value, [0.25, 0.5, 0.75], max_rows)

    def pick(p: float):
        return F.max(F.when(F.col("prob") == F.lit(p), F.col("quantile")))

    hinges = quantiles.groupBy(by).agg(
        pick(0.25).alias("q1"), pick(0.5).alias("median"), pick(0.75).alias("q3")
    )
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    joined = lookup_join(df.select(by, value), hinges, [by], "inner", True, max_rows, derived=True)
    return joined.groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count(F.when(~inside, v)).alias("outliers"),
        F.count(v).alias("n"),
    )
