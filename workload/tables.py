"""Model tables end to end: the survey, event and difference tables of a study."""

from __future__ import annotations

from pyspark.sql import functions as F

from coppice.operators.joins import lookup_join
from coppice.plans.tables import (
    SurveyColumns,
    difference_rows,
    exposed_surveys,
    model_rows,
    one_event_per_survey,
    site_means,
    unexposed_surveys,
)
from workload.registry import query, table

COLS = SurveyColumns(
    site="site",
    survey="survey",
    width="width",
    relative_width="relative_width",
    quality="quality",
    region="area",
    share="share",
    size="size",
    event_year="event_year",
)


def surveys(spark, d):
    """Survey-like rows: line items with their supplier's region, some values missing."""
    regions = table(spark, d, "region").select(
        F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("area")
    )
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    named = lookup_join(nations, regions, ["n_regionkey"], "inner", True)
    suppliers = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"
    )
    places = lookup_join(suppliers, named, ["s_nationkey"], "inner", True)
    rows = table(spark, d, "lineitem").select(
        "l_suppkey",
        F.col("l_partkey").alias("site"),
        F.col("l_orderkey").alias("survey"),
        F.col("l_linenumber").alias("visit"),
        F.nullif("l_quantity", F.lit(50.0)).alias("width"),
        F.col("l_returnflag").alias("quality"),
        (F.col("l_discount") * 100).alias("share"),
        F.col("l_extendedprice").alias("size"),
        F.year("l_shipdate").alias("event_year"),
        F.nullif("l_tax", F.lit(0.0)).alias("tax"),
        F.col("l_linestatus").alias("shape"),
    )
    return lookup_join(rows, places.select("l_suppkey", "area"), ["l_suppkey"], "inner", True)


_SURVEYS = """s as (
    select l_partkey as site, l_orderkey as survey, l_linenumber as visit,
           nullif(l_quantity, 50) as width, l_returnflag as quality, l_discount * 100 as share,
           l_extendedprice as size, year(l_shipdate) as event_year, nullif(l_tax, 0) as tax,
           l_linestatus as shape, r_name as area
    from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
                  join region on n_regionkey = r_regionkey),
  m as (select site, case when count(width) = count(*) then avg(width) end as site_mean
        from s group by site),
  r as (select s.*, width / site_mean as relative_width from s left join m using (site)
        where quality = 'N'),
  x as (select * from r where share >= 5),
  f as (select * from (select *, row_number() over (partition by survey
          order by size nulls last, visit, site, share, tax nulls last) as rk from x) where rk = 1)"""

_TIES = ["visit", "site", "share", "tax"]
_AREAS = ["ASIA", "EUROPE", "AFRICA"]
_COLUMNS = ["survey", "site", "visit", "relative_width", "tax", "event_year", "shape"]
_COLUMNS_SQL = """survey, site, visit, round(relative_width, 6) as relative_width, tax,
                  event_year::INTEGER as event_year, shape"""
_COMPLETE_SQL = """relative_width is not null and tax is not null
                   and area in ('ASIA', 'EUROPE', 'AFRICA') and site <> 15 and shape <> 'F'"""
_UNWANTED = {"site": 15, "shape": "F"}


def _short(df):
    return df.withColumn("relative_width", F.round("relative_width", 6))


def unexposed_rows(spark, d):
    base = surveys(spark, d)
    means = site_means(base, COLS)
    exposed = exposed_surveys(base, means, 5.0, cols=COLS)
    return model_rows(unexposed_surveys(base, exposed, means, COLS), _COLUMNS, _AREAS, _UNWANTED, COLS)


@query(
    "unexposed_model_table",
    f"""with {_SURVEYS} select {_COLUMNS_SQL} from r
        where survey not in (select survey from x) and {_COMPLETE_SQL}""",
)
def unexposed_model_table(spark, d):
    return _short(unexposed_rows(spark, d))


def exposed_rows(spark, d):
    base = surveys(spark, d)
    exposed = exposed_surveys(base, site_means(base, COLS), 5.0, cols=COLS)
    return one_event_per_survey(exposed, _TIES, cols=COLS)


@query(
    "exposed_model_table",
    f"with {_SURVEYS} select {_COLUMNS_SQL} from f where {_COMPLETE_SQL}",
)
def exposed_model_table(spark, d):
    return _short(model_rows(exposed_rows(spark, d), _COLUMNS, _AREAS, _UNWANTED, COLS))


@query(
    "difference_model_table",
    f"""with {_SURVEYS},
        p as (select l_linenumber as model, l_orderkey as site_key, year(l_shipdate) as year,
                     l_quantity * 1500 as predicted, l_extendedprice as observed from lineitem),
        j as (select p.*, o_custkey as survey from p left join orders
                on site_key = o_orderkey and year = year(o_orderdate))
        select model, round(predicted - observed, 4) as difference, survey, size, tax, event_year::INTEGER as event_year
        from j join f using (survey) where tax is not null""",
)
def difference_model_table(spark, d):
    predictions = table(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("model"),
        F.col("l_orderkey").alias("site_key"),
        F.year("l_shipdate").alias("year"),
        (F.col("l_quantity") * 1500).alias("predicted"),
        F.col("l_extendedprice").alias("observed"),
    )
    linkage = table(spark, d, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("order_year"), F.col("o_custkey").alias("survey"), "o_orderstatus"
    )
    out = difference_rows(
        predictions,
        linkage,
        exposed_rows(spark, d).select("survey", "size", "tax", "event_year"),
        ["model", "difference", "survey", "size", "tax", "event_year"],
        {"site_key": "o_orderkey", "year": "order_year"},
        survey="survey",
        drop=["o_orderstatus"],
    )
    return out.withColumn("difference", F.round("difference", 4))
