"""Metrics, resampling assignments, tuning tables and chart data."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from coppice.operators import tuning
from coppice.operators.charts import (
    dependence_lines,
    importance_chart,
    importance_ranked,
    keep_top,
    max_importance,
    top_variables,
)
from coppice.operators.encode import map_categories
from coppice.operators.evaluate import (
    boxplot_stats,
    cv_metric_summary,
    exact_quantiles,
    fit_metrics,
    transfer_metrics,
)
from coppice.operators.forest import linear_fit_per_group, replicate_metrics
from coppice.operators.joins import lookup_join
from coppice.operators.sampling import bag_weights, holdout_split, kfold_assign
from workload.registry import query, sql_hash, table


def rounded(df, digits=6, *keep):
    """Round every double column, to compare sums taken in different orders."""
    return df.select(
        *[
            F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c)
            for c, t in df.dtypes
        ]
    )


# ------------------------------------------------------------------ importances


def importances(spark, d):
    """Importance-like rows: one per line item, named by supplier, replicate = line number."""
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("v"), F.col("l_suppkey").cast("string")).alias("variable"),
        F.col("l_linenumber").alias("iteration"),
        (F.col("l_extendedprice") * (F.col("l_discount") - 0.03)).alias("importance"),
    )


def categories(spark, d):
    """Category of each variable: the region of the supplier."""
    regions = table(spark, d, "region").select(
        F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("category")
    )
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    named = lookup_join(nations, regions, ["n_regionkey"], "inner", True)
    suppliers = table(spark, d, "supplier").select(
        F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("variable"), "s_nationkey"
    )
    return lookup_join(suppliers, named, ["s_nationkey"], "inner", True).select("variable", "category")


_IMP = """imp as (select 'v' || l_suppkey as variable, l_linenumber as iteration,
                         l_extendedprice * (l_discount - 0.03) as importance from lineitem),
          cat as (select 'v' || s_suppkey as variable, r_name as category from supplier
                  join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
          mean as (select variable, avg(importance) as mean_importance from imp group by variable),
          top as (select variable, mean_importance,
                         row_number() over (order by mean_importance desc, variable) as rank
                  from mean order by mean_importance desc, variable limit 10)"""


@query(
    "importance_ranked",
    f"""with {_IMP}
        select variable, iteration, round(importance, 6) as importance,
               round(mean_importance, 6) as mean_importance
        from imp join mean using (variable) where importance >= 0""",
)
def ranked(spark, d):
    return rounded(importance_ranked(importances(spark, d), drop_negative=True))


@query(
    "topk_variables",
    f"with {_IMP} select variable, round(mean_importance, 6) as mean_importance, rank from top",
)
def topk_variables(spark, d):
    return rounded(top_variables(importances(spark, d)))


@query(
    "topk_semi_join",
    f"""with {_IMP} select variable, iteration, round(importance, 6) as importance from imp
        where variable in (select variable from top)""",
)
def topk_semi_join(spark, d):
    rows = importances(spark, d)
    return rounded(keep_top(rows, top_variables(rows)))


@query(
    "max_by_two_keys",
    f"""with {_IMP} select variable, category, round(max(importance), 6) as max_importance
        from imp join cat using (variable) group by variable, category""",
)
def max_by_two_keys(spark, d):
    rows = map_categories(importances(spark, d), categories(spark, d), "variable")
    return rounded(max_importance(rows))


@query(
    "importance_chart_data",
    f"""with {_IMP}, q as (
          select variable, quantile_cont(importance, 0.25) as q1,
                 quantile_cont(importance, 0.5) as median, quantile_cont(importance, 0.75) as q3,
                 max(importance) as max_importance, count(*) as n
          from imp where variable in (select variable from top) group by variable),
        w as (select variable,
                 min(case when importance >= q1 - 1.5 * (q3 - q1) and importance <= q3 + 1.5 * (q3 - q1)
                          then importance end) as whisker_low,
                 max(case when importance >= q1 - 1.5 * (q3 - q1) and importance <= q3 + 1.5 * (q3 - q1)
                          then importance end) as whisker_high,
                 count(case when not (importance >= q1 - 1.5 * (q3 - q1)
                                      and importance <= q3 + 1.5 * (q3 - q1)) then 1 end) as outliers
              from imp join q using (variable) group by variable)
        select variable, rank, category, round(mean_importance, 6) as mean_importance,
               round(max_importance, 6) as max_importance, round(q1, 6) as q1,
               round(median, 6) as median, round(q3, 6) as q3, round(whisker_low, 6) as whisker_low,
               round(whisker_high, 6) as whisker_high, outliers, n
        from top join q using (variable) join w using (variable) left join cat using (variable)""",
)
def importance_chart_data(spark, d):
    return rounded(importance_chart(importances(spark, d), categories(spark, d)))


# ------------------------------------------------------------------ metrics


def predictions(spark, d):
    """Prediction-like rows: one per line item, replicate = line number."""
    return table(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("iteration"),
        F.col("l_returnflag").alias("model"),
        (F.col("l_quantity") * 1500).alias("predicted"),
        F.col("l_extendedprice").alias("observed"),
    )


_ERR = "avg(power(l_extendedprice - 1500 * l_quantity, 2))"
_PCT = "round(100 * power(corr(l_extendedprice, 1500 * l_quantity), 2), 6)"


@query(
    "transfer_metrics",
    f"""select l_returnflag as model, {_PCT} as r2_pct, round(sqrt({_ERR}), 4) as rmse
        from lineitem group by l_returnflag""",
)
def transfer(spark, d):
    out = transfer_metrics(predictions(spark, d), ["model"])
    return out.select("model", F.round("r2_pct", 6).alias("r2_pct"), F.round("rmse", 4).alias("rmse"))


@query(
    "r2_three_ways",
    f"""select l_returnflag as model, {_PCT} as r2_pct,
               round(1 - {_ERR} / var_samp(l_extendedprice), 6) as r2_oob,
               round(power(corr(l_extendedprice, 1500 * l_quantity), 2), 8) as rsq
        from lineitem group by l_returnflag""",
)
def r2_three_ways(spark, d):
    out = fit_metrics(predictions(spark, d), ["model"])
    return out.select(
        "model",
        F.round("r2_pct", 6).alias("r2_pct"),
        F.round("r2_oob", 6).alias("r2_oob"),
        F.round("rsq", 8).alias("rsq"),
    )


@query(
    "replicate_metrics",
    f"""select l_linenumber as iteration, round(1 - {_ERR} / var_samp(l_extendedprice), 6) as r2_oob,
               round({_ERR}, 1) as mse, round(sqrt({_ERR}), 4) as rmse
        from lineitem group by l_linenumber""",
)
def per_replicate(spark, d):
    out = replicate_metrics(predictions(spark, d))
    return out.select(
        "iteration",
        F.round("r2_oob", 6).alias("r2_oob"),
        F.round("mse", 1).alias("mse"),
        F.round("rmse", 4).alias("rmse"),
    )


@query(
    "per_group_fit",
    """select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope,
              round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept,
              round(regr_r2(l_extendedprice, l_quantity), 6) as r2, count(*) as n
       from lineitem group by l_returnflag""",
)
def per_group_fit(spark, d):
    out = linear_fit_per_group(
        table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice"
    )
    return out.select(
        "l_returnflag",
        F.round("slope", 4).alias("slope"),
        F.round("intercept", 3).alias("intercept"),
        F.round("r2", 6).alias("r2"),
        "n",
    )


@query(
    "exact_quantiles",
    """select l_returnflag, prob, round(quantile, 6) as quantile, n from (
         select l_returnflag, count(*) as n,
                unnest([0.0, 0.1, 0.5, 0.9, 1.0]::DOUBLE[]) as prob,
                unnest(quantile_cont(l_extendedprice, [0.0, 0.1, 0.5, 0.9, 1.0])) as quantile
         from lineitem group by l_returnflag)""",
)
def quantiles(spark, d):
    probabilities = [0.0, 0.1, 0.5, 0.9, 1.0]
    return rounded(
        exact_quantiles(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", probabilities)
    )


@query(
    "boxplot_stats",
    """with q as (select l_suppkey, quantile_cont(l_extendedprice, 0.25) as q1,
                         quantile_cont(l_extendedprice, 0.5) as median,
                         quantile_cont(l_extendedprice, 0.75) as q3
                  from lineitem group by l_suppkey)
       select l_suppkey, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
              round(min(case when inside then v end), 6) as whisker_low,
              round(max(case when inside then v end), 6) as whisker_high,
              count(case when not inside then 1 end) as outliers, count(*) as n
       from (select l_suppkey, q1, median, q3, l_extendedprice as v,
                    l_extendedprice >= q1 - 1.5 * (q3 - q1)
                      and l_extendedprice <= q3 + 1.5 * (q3 - q1) as inside
             from lineitem join q using (l_suppkey))
       group by l_suppkey, q1, median, q3""",
)
def boxes(spark, d):
    return rounded(boxplot_stats(table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice"))


# ------------------------------------------------------------------ resampling


@query(
    "holdout_split",
    f"""select o_orderkey, {sql_hash('o_orderkey', 'split:0')} / 4294967296.0 < 0.75 as is_train
        from orders""",
)
def split(spark, d):
    return holdout_split(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


@query(
    "kfold_assign",
    f"select o_orderkey, ({sql_hash('o_orderkey', 'fold:0')} % 5)::INTEGER as fold from orders",
)
def folds(spark, d):
    return kfold_assign(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


def _poisson_sql(u: str) -> str:
    """Inverse Poisson(1) distribution function as SQL, exact at 32 bits."""
    total, k, steps = 0.0, 0, []
    while 1.0 - total > 2.0**-32:
        total += math.exp(-1.0) / math.factorial(k)
        steps.append(f"when {u} < {total!r}::DOUBLE then {k}")
        k += 1
    return f"(case {' '.join(steps)} else {k} end)::INTEGER"


@query(
    "bag_weights",
    "select o_orderkey, "
    + ", ".join(
        f"{_poisson_sql(sql_hash('o_orderkey', f'0:{b // 4}', b % 4) + ' / 4294967296.0')} as w{b}"
        for b in range(6)
    )
    + " from orders",
)
def weights(spark, d):
    return bag_weights(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 6, prefix="w")


# ------------------------------------------------------------------ tuning tables


def cv_metrics(spark, d):
    """Metric-like rows: settings from line number and flags, folds from the shipping year."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("mtry"),
        F.ascii("l_returnflag").alias("min_n"),
        (F.floor(F.col("l_quantity") / 10) * 100).cast("int").alias("trees"),
        F.year("l_shipdate").alias("fold"),
        F.when(F.col("l_linestatus") == "O", "rmse").otherwise("rsq").alias("metric"),
        "l_extendedprice",
    )
    means = rows.groupBy("mtry", "min_n", "trees", "fold", "metric").agg(
        F.avg("l_extendedprice").alias("estimate")
    )
    return tuning.with_config_id(means)


_CV = """cv as (select l_linenumber as mtry, ascii(l_returnflag) as min_n,
                       (floor(l_quantity / 10) * 100)::INTEGER as trees, year(l_shipdate) as fold,
                       case when l_linestatus = 'O' then 'rmse' else 'rsq' end as metric,
                       avg(l_extendedprice) as estimate from lineitem group by 1, 2, 3, 4, 5),
         summary as (select concat_ws(' ', 'mt=' || mtry, 'mi=' || min_n, 'tr=' || trees) as config,
                            mtry, min_n, trees, metric, avg(estimate) as mean, count(*) as n,
                            stddev_samp(estimate) / sqrt(count(*)) as std_err
                     from cv group by 1, 2, 3, 4, 5)"""


@query(
    "cv_metric_summary",
    f"""with {_CV} select config, mtry, min_n, trees, metric, round(mean, 5) as mean, n,
                          round(std_err, 5) as std_err from summary""",
)
def cv_summary(spark, d):
    by = ["config", *tuning.PARAMETERS, "metric"]
    return rounded(cv_metric_summary(cv_metrics(spark, d), by), 5)


@query(
    "tuning_long",
    f"""with {_CV} select config, round(mean, 5) as mean, parameter, value from
          (select config, mean, mtry::DOUBLE as mtry, min_n::DOUBLE as min_n,
                  trees::DOUBLE as trees from summary where metric = 'rmse')
        unpivot (value for parameter in (mtry, min_n, trees))""",
)
def long_metrics(spark, d):
    return rounded(tuning.tuning_long(tuning.collect_metrics(cv_metrics(spark, d))), 5)


@query(
    "select_best",
    f"""with {_CV} select config, mtry, min_n, trees, metric, round(mean, 5) as mean, n,
                          round(std_err, 5) as std_err
        from summary where metric = 'rmse' order by mean, config limit 1""",
)
def best(spark, d):
    return rounded(tuning.select_best(tuning.collect_metrics(cv_metrics(spark, d))), 5)


def _observed_ranges(spark, d):
    """Ranges of three columns over the whole table."""
    row = (
        table(spark, d, "lineitem")
        .agg(
            *[f(c).alias(f"{n}_{p}")
              for p, c in [("mtry", "l_linenumber"), ("min_n", "l_quantity"), ("trees", "l_extendedprice")]
              for n, f in [("lo", F.min), ("hi", F.max)]]
        )
        .first()
    )
    return {p: (float(row[f"lo_{p}"]), float(row[f"hi_{p}"])) for p in tuning.PARAMETERS}


_RANGES = """r as (select min(l_linenumber)::DOUBLE as a0, max(l_linenumber)::DOUBLE as a1,
                          min(l_quantity) as b0, max(l_quantity) as b1,
                          min(l_extendedprice) as c0, max(l_extendedprice) as c1 from lineitem)"""


@query(
    "regular_grid",
    f"""with {_RANGES}, i as (select unnest(range(5)) as i)
        select distinct floor(a0 + a.i * ((a1 - a0) / 4))::INTEGER as mtry,
               floor(b0 + b.i * ((b1 - b0) / 4))::INTEGER as min_n,
               floor(c0 + c.i * ((c1 - c0) / 4))::INTEGER as trees
        from r, i a, i b, i c""",
)
def grid(spark, d):
    return tuning.regular_grid(spark, _observed_ranges(spark, d))


def _stratum(name: str) -> str:
    order = sql_hash("i", f"0:{name}")
    inside = sql_hash("i", f"0:{name}:in")
    return f"(row_number() over (order by {order}, i) - 1 + {inside} / 4294967296.0) / 20"


@query(
    "latin_hypercube",
    f"""with {_RANGES}, i as (select unnest(range(20)) as i)
        select i as candidate, round(a0 + {_stratum('mtry')} * (a1 - a0), 6) as mtry,
               round(b0 + {_stratum('min_n')} * (b1 - b0), 6) as min_n,
               round(c0 + {_stratum('trees')} * (c1 - c0), 6) as trees
        from r, i""",
)
def hypercube(spark, d):
    return rounded(tuning.latin_hypercube(spark, _observed_ranges(spark, d), 20, integer=False))


# ------------------------------------------------------------------ chart lines


@query(
    "dependence_lines",
    """with c as (select l_returnflag as variable, floor(l_quantity) as value, l_linenumber as model_run,
                         avg(l_extendedprice) as yhat from lineitem group by 1, 2, 3)
       select variable, value, model_run, round(yhat, 5) as y, 'Individual' as line_type,
              'Individual.' || model_run as line from c
       union all
       select variable, value, null, round(avg(yhat), 5), 'Average', 'Average.NA'
       from c group by variable, value""",
)
def lines(spark, d):
    curves = (
        table(spark, d, "lineitem")
        .groupBy(
            F.col("l_returnflag").alias("variable"),
            F.floor("l_quantity").cast("double").alias("value"),
            F.col("l_linenumber").alias("model_run"),
        )
        .agg(F.avg("l_extendedprice").alias("yhat"))
    )
    means = curves.groupBy("variable", "value").agg(F.avg("yhat").alias("mean_yhat"))
    return rounded(dependence_lines(curves, means), 5, "value")
