"""Forests that SQL can follow: trees deep enough to give each cell of two features a leaf of its own.

With all features tried at every split, any node size and enough depth a tree predicts the weighted mean of the row's cell, the weights
being those of its bag, which SQL has by the same hash. So bagging, out-of-bag scores, importance, curves, transfer, groups and
tuning are all compared row by row. The response is irrational, so that no mean sits on a rounding tie.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from coppice.operators import tuning
from coppice.operators.forest import (
    ForestSpec,
    fit_per_group,
    fit_replicates,
    forest_importance,
    group_names,
    oob_predictions,
    prepare,
)
from coppice.plans.studies import difference_curves, replicate_curves, run_difference_study
from coppice.session import new_path
from coppice.sources import load_bundle, save_bundle
from workload.registry import query, sql_hash, table
from workload.results import _poisson_sql

SPEC = ForestSpec(trees=3, mtry=2, min_node=1, bags=3, max_depth=8, max_bins=32)
FEATURES = ["priority", "part"]
REPLICATES = [1, 2]
_DIGITS = 6


def orders(spark, d):
    """All orders: priority, a third by customer, and the square root of the price."""
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.col("o_orderpriority").alias("priority"),
        (F.col("o_custkey") % 3).cast("double").alias("part"),
        F.sqrt("o_totalprice").alias("y"),
        F.when(F.col("o_orderkey") % 2 == 0, "even").otherwise("odd").alias("half"),
        (F.col("o_orderkey") % 2 + 1).cast("int").alias("model"),
    )


def order_table(spark, d):
    return prepare(orders(spark, d), "y", FEATURES, ["o_orderkey"], ["priority"])


_ORDERS = """o as (
  select o_orderkey, o_orderpriority as priority, (o_custkey % 3)::DOUBLE as part, sqrt(o_totalprice) as y,
         case when o_orderkey % 2 = 0 then 'even' else 'odd' end as half, (o_orderkey % 2 + 1)::INTEGER as model,
         dense_rank() over (order by o_orderpriority) - 1 as code
  from orders)"""


def _weights(replicates=REPLICATES, bags=3, rows="o", ids="o_orderkey") -> str:
    """Weight ``w`` of every row in every bag."""
    parts = [
        f"select {r} as r, {b} as b, x.*, {_poisson_sql(sql_hash(ids, f'{r}:{b // 4}', b % 4) + ' / 4294967296.0')} as w from {rows} x"
        for r in replicates
        for b in range(bags)
    ]
    return " union all ".join(parts)


_CELLS = "select r, b, code, part, sum(w * y) / sum(w) as p from w where w > 0 group by all"
_BAGS = f"with {_ORDERS}, w as ({_weights()}), c as ({_CELLS})"


@query(
    "saturated_fit_predict",
    f"""{_BAGS}
        select o.o_orderkey, round(avg(c.p), {_DIGITS}) as prediction
        from o join c on c.r = 1 and c.code = o.code and c.part = o.part group by o.o_orderkey""",
)
def fit_predict(spark, d):
    data = order_table(spark, d)
    forest = fit_replicates(data, SPEC, [1])[0]
    return forest.scorer()(data.df).select("o_orderkey", F.round("prediction", _DIGITS).alias("prediction"))


@query(
    "saturated_oob",
    f"""{_BAGS}
        select w.r::INTEGER as iteration, w.o_orderkey, round(avg(case when w.w = 0 then c.p end), {_DIGITS}) as predicted
        from w join c on c.r = w.r and c.b = w.b and c.code = w.code and c.part = w.part group by w.r, w.o_orderkey""",
)
def oob(spark, d):
    data = order_table(spark, d)
    found = oob_predictions(fit_replicates(data, SPEC, REPLICATES), data)
    return found.select("iteration", "o_orderkey", F.round("predicted", _DIGITS).alias("predicted"))


@query(
    "saturated_importance",
    f"""with {_ORDERS}, k as (
          select *, {sql_hash('o_orderkey', 'block:0')} % 4 as blk, {sql_hash('o_orderkey', 'order:0')} as h from o),
        p as (select *, coalesce(lead(code) over x, first_value(code) over x) as code_p,
                     coalesce(lead(part) over x, first_value(part) over x) as part_p
              from k window x as (partition by blk order by h, o_orderkey)),
        w as ({_weights(rows='p')}), c as ({_CELLS}),
        e as (select w.r, w.b, avg(power(c0.p - w.y, 2)) as e0, avg(power(c1.p - w.y, 2)) as e1, avg(power(c2.p - w.y, 2)) as e2
              from w join c c0 on c0.r = w.r and c0.b = w.b and c0.code = w.code and c0.part = w.part
                     join c c1 on c1.r = w.r and c1.b = w.b and c1.code = w.code_p and c1.part = w.part
                     join c c2 on c2.r = w.r and c2.b = w.b and c2.code = w.code and c2.part = w.part_p
              where w.w = 0 group by w.r, w.b),
        l as (select r, 'priority' as variable, e1 - e0 as delta from e union all select r, 'part', e2 - e0 from e)
        select r::INTEGER as iteration, variable, round(avg(delta), 5) as importance,
               round(avg(delta) / (stddev_samp(delta) / sqrt(count(*))), 4) as importance_z
        from l group by r, variable""",
)
def importance(spark, d):
    data = order_table(spark, d)
    found = forest_importance(fit_replicates(data, SPEC, REPLICATES), data, blocks=4)
    return found.select(
        "iteration", "variable", F.round("importance", 5).alias("importance"), F.round("importance_z", 4).alias("importance_z")
    )


def _curves_sql(by: str) -> str:
    """Curves over both variables of each ``by``; the level of one is set, the other is the row's."""
    return f"""
        select 'priority' as variable, g.code::INTEGER as grid_index, g.code::DOUBLE as value, round(avg(c.p), {_DIGITS}) as yhat,
               c.r::INTEGER as model_run
        from o, (select distinct code from o) g, c where c.code = g.code and c.part = o.part and {by} group by g.code, c.r
        union all
        select 'part', g.part::INTEGER, g.part, round(avg(c.p), {_DIGITS}), c.r::INTEGER
        from o, (select distinct part from o) g, c where c.part = g.part and c.code = o.code and {by} group by g.part, c.r"""


def _rounded(curves):
    return curves.select("variable", "grid_index", "value", F.round("yhat", _DIGITS).alias("yhat"), "model_run")


@query("pdp_category", f"{_BAGS} {_curves_sql('true')}")
def curves(spark, d):
    """Curves of a category's levels and of a number, in two replicates."""
    data = order_table(spark, d)
    return _rounded(replicate_curves(data, fit_replicates(data, SPEC, REPLICATES), FEATURES, 3))


@query(
    "stored_ensemble_transfer",
    f"""with {_ORDERS}, t as (select * from o where half = 'even'), w as ({_weights(rows='t')}), c as ({_CELLS})
        select c.r::INTEGER as model, o.o_orderkey, o.priority, round(avg(c.p), {_DIGITS}) as predicted
        from o join c on c.code = o.code and c.part = o.part where o.half = 'odd' group by all""",
)
def transfer(spark, d):
    """Fitted on one half, stored with encoder and roles, loaded, and applied to the raw rows of the other half."""
    rows = orders(spark, d)
    data = prepare(rows.where("half = 'even'"), "y", FEATURES, ["o_orderkey"], ["priority"])
    path = new_path(spark, "ensemble")
    save_bundle(data, fit_replicates(data, SPEC, REPLICATES), path)
    scored = load_bundle(spark, path).score(rows.where("half = 'odd'"), ["o_orderkey", "priority"])
    return scored.select("model", "o_orderkey", "priority", F.round("predicted", _DIGITS).alias("predicted"))


def _grouped(key: str, text_key: str) -> str:
    """Bags and cells of a forest for each value of ``key`` (1 and 2), whose row ids are the group and the order."""
    weights = " union all ".join(
        f"select * from ({_weights([r], rows='o', ids=f'''{text_key} || ':' || o_orderkey''')}) where {key} = {value}"
        for r, value in ((1, "1" if key == "model" else "'even'"), (2, "2" if key == "model" else "'odd'"))
    )
    return f"with {_ORDERS}, w as ({weights}), c as ({_CELLS})"


@query(
    "text_group_forests",
    f"""{_grouped('half', 'half')}
        select w.half, w.o_orderkey, round(avg(case when w.w = 0 then c.p end), {_DIGITS}) as predicted
        from w join c on c.r = w.r and c.b = w.b and c.code = w.code and c.part = w.part group by w.half, w.o_orderkey""",
)
def groups(spark, d):
    """A forest for each value of a text key, which the out-of-bag predictions carry."""
    fits = fit_per_group(orders(spark, d), "half", "y", FEATURES, ["o_orderkey"], SPEC, ["priority"])
    parts = [oob_predictions([forest], part) for part, forest in fits.values()]
    names = group_names(fits, "half").withColumnRenamed("half", "name")
    found = parts[0].unionByName(parts[1]).join(F.broadcast(names), "iteration")
    return found.select(F.col("name").alias("half"), "o_orderkey", F.round("predicted", _DIGITS).alias("predicted"))


@query("difference_curves", f"{_grouped('model', 'model')} {_curves_sql('o.model = c.r')}")
def differences(spark, d):
    """Dependence curves of a model for each transferred model, on its own rows."""
    study = run_difference_study(
        orders(spark, d), FEATURES, ["o_orderkey"], SPEC, label="y", categorical=["priority"]
    )
    return _rounded(difference_curves(study, FEATURES, 3))


def _scored_sql(bags: int, training: str, rest: str) -> str:
    """Rows of ``rest`` with the prediction of ``bags`` bags of the rows of ``training``."""
    return f"""select o.*, p from (select * from o where {rest}) o join (
          select code, part, avg(p) as p from (
            select r, b, code, part, sum(w * y) / sum(w) as p
            from ({_weights([1], bags, '(select * from o where ' + training + ')')}) where w > 0 group by all)
          group by all) m using (code, part)"""


_RMSE, _RSQ = "sqrt(avg(power(p - y, 2)))", "power(covar_pop(p, y), 2) / (var_pop(p) * var_pop(y))"
_FOLD = f"{sql_hash('o_orderkey', 'fold:0')} % 3"
_TRAIN = f"{sql_hash('o_orderkey', 'split:0')} / 4294967296.0 < 0.75"


@query(
    "saturated_search",
    f"with {_ORDERS} "
    + " union all ".join(
        f"""select 'mt=2 mi=1 tr={trees}' as config, {fold}::INTEGER as fold, '{metric}' as metric, round({value}, 6) as estimate
            from ({_scored_sql(trees, f'{_FOLD} <> {fold}', f'{_FOLD} = {fold}')})"""
        for trees in (2, 3)
        for fold in range(3)
        for metric, value in (("rmse", _RMSE), ("rsq", _RSQ))
    ),
)
def search(spark, d):
    """Two candidates on three folds, bagged by hashes as final models are."""
    candidates = tuning.regular_grid(spark, {"mtry": (2, 2), "min_n": (1, 1), "trees": (2, 3)}, 2)
    found = tuning.grid_search(order_table(spark, d), candidates, SPEC, folds=3, hashed_bags=True)
    return found.select("config", "fold", "metric", F.round("estimate", 6).alias("estimate"))


@query(
    "saturated_last_fit",
    f"with {_ORDERS}, s as ({_scored_sql(3, _TRAIN, f'not ({_TRAIN})')}) "
    f"select 'rmse' as metric, round({_RMSE}, 6) as estimate from s union all select 'rsq', round({_RSQ}, 6) from s",
)
def last(spark, d):
    found = tuning.last_fit(
        order_table(spark, d), {"mtry": 2, "min_n": 1, "trees": 3}, replace(SPEC), hashed_bags=True
    )
    return found.select("metric", F.round("estimate", 6).alias("estimate"))
