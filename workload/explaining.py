"""Partial dependence, permutation importance and scoring with closed-form scorers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.operators.charts import dependence_strip
from coppice.operators.explain import (
    block_count,
    average_curves,
    expr_scorer,
    grid_values,
    partial_dependence,
    permutation_importance,
)
from coppice.operators.forest import score_models
from coppice.session import spread_scan
from workload.registry import query, sql_hash, table
from workload.results import rounded

_INPUTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_VARIED = ["l_quantity", "l_discount", "l_tax"]
# Means are compared at seven digits: at fewer, a mean of these two-digit values can sit
# exactly on a rounding tie, which the order of summation would then decide.


def _line_items(spark, d) -> DataFrame:
    """The scorer's inputs, on all cores: a row is expanded to as many rows as grid points."""
    return spread_scan(table(spark, d, "lineitem").select(*_INPUTS))


def _formula(q="l_quantity", p="l_extendedprice", d="l_discount", t="l_tax", scale="2.0D"):
    return f"{scale} * {q} + 0.001D * {p} * {d} + {q} * {t}"


def _formula_sql(q="l_quantity", p="l_extendedprice", d="l_discount", t="l_tax", scale="2.0"):
    return f"{scale}::DOUBLE * {q} + 0.001::DOUBLE * {p} * {d} + {q} * {t}"


def _grid_sql(points: str) -> str:
    """Grid of the three varied columns; ``points`` is the number of points of column c."""
    return " union all ".join(
        f"""select '{c}' as variable, i::INTEGER as grid_index,
                   mn + i * (mx - mn) / (n - 1)::DOUBLE as value
            from (select min({c}) as mn, max({c}) as mx, {points.format(c=c)} as n from lineitem),
                 range(51) t(i) where i < n"""
        for c in _VARIED
    )


_DEFAULT_POINTS = "least(count(distinct {c}), 51)"


@query(
    "pdp_grid",
    f"""with g as ({_grid_sql(_DEFAULT_POINTS)})
        select variable, grid_index, round(value, 6) as value from g""",
)
def pdp_grid(spark, d):
    grid = grid_values(table(spark, d, "lineitem"), _VARIED)
    rows = [(v, i, float(x)) for v, xs in grid.items() for i, x in enumerate(xs)]
    return rounded(spark.createDataFrame(rows, "variable string, grid_index int, value double"))


def _pdp_sql(points: str, scale: str = "2.0") -> str:
    cases = " ".join(
        f"when '{c}' then {_formula_sql(**{k: 'value'}, scale=scale)}"
        for c, k in [("l_quantity", "q"), ("l_discount", "d"), ("l_tax", "t")]
    )
    return f"""select variable, grid_index, value, avg(case variable {cases} end) as yhat
               from lineitem, ({_grid_sql(points)}) g group by variable, grid_index, value"""


@query(
    "partial_dependence_expr",
    f"""with c as ({_pdp_sql(_DEFAULT_POINTS)})
        select variable, grid_index, round(value, 6) as value, round(yhat, 7) as yhat from c""",
)
def dependence(spark, d):
    rows = _line_items(spark, d)
    curves = partial_dependence(rows, expr_scorer(_formula()), grid_values(rows, _VARIED), _INPUTS)
    return curves.select(
        "variable", "grid_index", F.round("value", 6).alias("value"), F.round("yhat", 7).alias("yhat")
    )


def _three_models(spark, d) -> DataFrame:
    rows = _line_items(spark, d)
    grid = grid_values(rows, _VARIED, 20)
    return reduce(
        DataFrame.unionByName,
        [
            partial_dependence(rows, expr_scorer(_formula(scale=f"{m}.0D")), grid, _INPUTS)
            for m in (1, 2, 3)
        ],
    )


_THREE_SQL = " union all ".join(_pdp_sql("20", f"{m}.0") for m in (1, 2, 3))


@query(
    "pdp_average",
    f"""with c as ({_THREE_SQL})
        select variable, grid_index, round(value, 6) as value, round(avg(yhat), 7) as mean_yhat
        from c group by variable, grid_index, value""",
)
def averaged(spark, d):
    return average_curves(_three_models(spark, d)).select(
        "variable",
        "grid_index",
        F.round("value", 6).alias("value"),
        F.round("mean_yhat", 7).alias("mean_yhat"),
    )


@query(
    "pdp_strip",
    f"""with c as ({_pdp_sql("20")})
        select variable, grid_index, round(yhat, 7) as yhat,
               round((value - min(value) over v) / (max(value) over v - min(value) over v), 6) as x_rescaled
        from c window v as (partition by variable)""",
)
def strip(spark, d):
    rows = _line_items(spark, d)
    grid = grid_values(rows, _VARIED, 20)
    curves = partial_dependence(rows, expr_scorer(_formula()), grid, _INPUTS)
    return dependence_strip(curves).select(
        "variable", "grid_index", F.round("yhat", 7).alias("yhat"), F.round("x_rescaled", 6).alias("x_rescaled")
    )


@query(
    "permutation_importance_expr",
    f"""with b as (
          select o_orderkey as id, {sql_hash('o_orderkey', 'block:0')} % greatest(2, (select ceil(count(*) / 10000.0) from orders))::BIGINT as blk,
                 {sql_hash('o_orderkey', 'order:0')} as h, o_custkey::DOUBLE as x1,
                 month(o_orderdate)::DOUBLE as x2, o_totalprice as y from orders),
        p as (select *, coalesce(lead(x1) over w, first_value(x1) over w) as p1,
                     coalesce(lead(x2) over w, first_value(x2) over w) as p2
              from b window w as (partition by blk order by h, id)),
        e as (select blk, avg(power(3 * x1 + x2 - y, 2)) as e0,
                     avg(power(3 * p1 + x2 - y, 2)) as e1, avg(power(3 * x1 + p2 - y, 2)) as e2
              from p group by blk),
        l as (select 'x1' as variable, e1 - e0 as delta from e
              union all select 'x2', e2 - e0 from e)
        select variable, round(avg(delta), 0) as importance,
               round(avg(delta) / (stddev_samp(delta) / sqrt(count(*))), 4) as importance_z,
               count(*) as repeats
        from l group by variable""",
)
def importance(spark, d):
    rows = table(spark, d, "orders").select(
        "o_orderkey",
        F.col("o_custkey").cast("double").alias("x1"),
        F.month("o_orderdate").cast("double").alias("x2"),
        F.col("o_totalprice").alias("y"),
    )
    out = permutation_importance(
        rows, expr_scorer("3 * x1 + x2"), ["x1", "x2"], "y", ["o_orderkey"], block_count(rows, ["o_orderkey"])
    )
    return out.select(
        "variable",
        F.round("importance", 0).alias("importance"),
        F.round("importance_z", 4).alias("importance_z"),
        "repeats",
    )


@query(
    "score_models_expr",
    f"""select m::INTEGER as model, l_orderkey, l_linenumber, l_extendedprice as observed,
               case m when 1 then {_formula_sql(scale='1.0')}
                      when 2 then {_formula_sql(scale='2.0')}
                      else {_formula_sql(scale='3.0')} end as predicted
        from lineitem, range(1, 4) t(m)""",
)
def scored(spark, d):
    scorers = {m: expr_scorer(_formula(scale=f"{m}.0D")) for m in (1, 2, 3)}
    return score_models(
        scorers, table(spark, d, "lineitem"), "l_extendedprice", ["l_orderkey", "l_linenumber"]
    )
