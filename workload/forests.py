"""Forest fitting and everything that needs fitted forests, on one row per order."""

from __future__ import annotations

from pyspark.sql import functions as F

from coppice.operators import tuning
from coppice.operators.forest import (
    ForestSpec,
    fit_replicates,
    forest_importance,
    oob_predictions,
    prepare,
    workflow,
)
from coppice.operators.joins import lookup_join
from coppice.plans.studies import replicate_curves, run_difference_study, run_transfer
from workload.registry import query, table

FEATURES = [
    "items", "quantity", "mean_discount", "mean_tax", "account", "month", "priority", "segment",
]
SPEC = ForestSpec(trees=6, mtry=3, min_node=10, bags=3, max_depth=5, max_bins=32)


def baskets(spark, d):
    """One row per order that has line items; the response is what its basket is worth."""
    items = (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.sum("l_quantity").alias("quantity"),
            F.avg("l_discount").alias("mean_discount"),
            F.avg("l_tax").alias("mean_tax"),
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("worth"),
        )
    )
    orders = table(spark, d, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("c_custkey"),
        F.month("o_orderdate").alias("month"),
        F.year("o_orderdate").alias("year"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )
    customers = table(spark, d, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("account"), F.col("c_mktsegment").alias("segment")
    )
    joined = lookup_join(orders, customers, ["c_custkey"], "left", True)
    return items.join(joined, "o_orderkey").dropna()


def basket_table(spark, d, carried=()):
    return prepare(
        baskets(spark, d), "worth", FEATURES, ["o_orderkey"], ["priority", "segment"], carried
    )


@query("forest_fit_predict")
def forest_fit_predict(spark, d):
    data = basket_table(spark, d)
    model = workflow(data, SPEC).fit(data.df)
    return model.transform(data.df).select("o_orderkey", "worth", "prediction")


@query("oob_predictions")
def oob(spark, d):
    data = basket_table(spark, d, ["year"])
    return oob_predictions(fit_replicates(data, SPEC, [1, 2]), data, ["year"])


@query("permutation_importance_forest")
def importance(spark, d):
    data = basket_table(spark, d)
    return forest_importance(fit_replicates(data, SPEC, [1, 2]), data)


@query("pdp_forest")
def dependence(spark, d):
    """Curves of every feature in every replicate."""
    data = basket_table(spark, d)
    return replicate_curves(data, fit_replicates(data, SPEC, [1, 2]), FEATURES, 20)


@query("transfer_forest")
def transfer(spark, d):
    """Replicates fitted on finished orders, scored on the others."""
    rows = baskets(spark, d)
    done = rows.where("status = 'F'")
    data = prepare(done, "worth", FEATURES, ["o_orderkey"], ["priority", "segment"])
    forests = fit_replicates(data, SPEC, [1, 2])
    return run_transfer(data, forests, rows.where("status <> 'F'"), ["o_orderkey", "year"])[1]


@query("per_group_forest")
def per_group(spark, d):
    """One error model per transferred replicate."""
    rows = baskets(spark, d)
    data = prepare(rows, "worth", FEATURES, ["o_orderkey"], ["priority", "segment"])
    forests = fit_replicates(data, SPEC, [1, 2])
    predicted = run_transfer(data, forests, rows, ["o_orderkey", *FEATURES])[0]
    errors = predicted.withColumn("difference", F.col("predicted") - F.col("observed"))
    study = run_difference_study(
        errors, FEATURES, ["o_orderkey"], SPEC, categorical=["priority", "segment"]
    )
    return study.metrics


def _search(spark, data):
    ranges = {"mtry": (2, len(FEATURES)), "min_n": (2, 20), "trees": (3, 6)}
    candidates = tuning.regular_grid(spark, ranges, 2)
    return tuning.grid_search(tuning.training_part(data), candidates, SPEC, folds=3, parallelism=8)


@query("grid_search_small")
def grid_search(spark, d):
    return tuning.collect_metrics(_search(spark, basket_table(spark, d)))


@query("last_fit_metrics")
def last_fit(spark, d):
    data = basket_table(spark, d)
    return tuning.last_fit(data, {"mtry": 3, "min_n": 10, "trees": 6}, SPEC)
