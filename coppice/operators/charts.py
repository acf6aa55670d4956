"""Tables behind the importance and dependence charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coppice.operators.encode import map_categories
from coppice.operators.evaluate import boxplot_stats
from coppice.operators.features import minmax_rescale
from coppice.operators.joins import lookup_join
from coppice.operators.reshape import stack_filling, top_k
from coppice.session import stage


def mean_importance(importance: DataFrame, value: str = "importance") -> DataFrame:
    """Mean over replicates per variable."""
    return importance.groupBy("variable").agg(F.avg(value).alias("mean_importance"))


def top_variables(importance: DataFrame, k: int = 10, value: str = "importance") -> DataFrame:
    """The k most important variables with their rank (1 = most important)."""
    best = top_k(mean_importance(importance, value), "mean_importance", "variable", k)
    # k rows by now, so a window without partitions is bounded
    order = Window.orderBy(F.col("mean_importance").desc_nulls_last(), "variable")
    return best.withColumn("rank", F.row_number().over(order).cast("bigint"))


def importance_ranked(
    importance: DataFrame, value: str = "importance", drop_negative: bool = False
) -> DataFrame:
    """Replicate rows with the mean of their variable, for ordering a chart.

    The mean covers all replicates; ``drop_negative`` only removes rows from the chart.
    """
    means = mean_importance(importance, value)
    rows = importance.where(F.col(value) >= 0) if drop_negative else importance
    return lookup_join(rows, means, ["variable"], "left", True, derived=True)


def keep_top(rows: DataFrame, top: DataFrame, key: str = "variable") -> DataFrame:
    """Rows whose key is in the (small) top table."""
    return lookup_join(rows, top.select(key), [key], "left_semi", True, derived=True)


def max_importance(rows: DataFrame, value: str = "importance") -> DataFrame:
    """Bar length: largest importance per variable and category."""
    return rows.dropna(subset=["variable", "category"]).groupBy("variable", "category").agg(
        F.max(value).alias("max_importance")
    )


def importance_chart(
    importance: DataFrame,
    categories: DataFrame,
    k: int = 10,
    value: str = "importance",
    default_category: str | None = None,
    drop_negative: bool = False,
) -> DataFrame:
    """Bars and boxes of the top variables: one row per variable."""
    top = stage(top_variables(importance, k, value), "top")
    rows = keep_top(importance, top)
    if drop_negative:
        rows = rows.where(F.col(value) >= 0)
    bars = map_categories(top, categories, "variable", default=default_category)
    longest = rows.groupBy("variable").agg(F.max(value).alias("max_importance"))
    boxes = boxplot_stats(rows, "variable", value)
    # all three tables have at most k rows
    return bars.join(F.broadcast(longest), "variable", "left").join(
        F.broadcast(boxes), "variable", "left"
    )


def dependence_strip(curves: DataFrame) -> DataFrame:
    """Curves with their x axis rescaled to [0, 1] per variable; points without y dropped."""
    return minmax_rescale(curves, "variable", "value").dropna(subset=["yhat"])


def dependence_lines(curves: DataFrame, averages: DataFrame, run: str = "model_run") -> DataFrame:
    """Individual and average curves in one table; the average has no run."""
    single = curves.withColumnRenamed("yhat", "y").withColumn("line_type", F.lit("Individual"))
    mean = averages.withColumnRenamed("mean_yhat", "y").withColumn("line_type", F.lit("Average"))
    both = stack_filling(single, mean)
    line = F.concat_ws(".", "line_type", F.coalesce(F.col(run).cast("string"), F.lit("NA")))
    return both.withColumn("line", line)
