"""Projections, filters, joins, group features and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from coppice.functions import composite_key, log2_or_null, residual, to_number
from coppice.operators.cohorts import (
    at_least,
    complete_cases,
    exclude,
    first_per_group,
    in_set,
    unexposed,
)
from coppice.operators.encode import label_values, map_categories, mapping_frame, ordinal_encode
from coppice.operators.features import (
    group_mean,
    minmax_rescale,
    ratio_to_group_mean,
    ratio_within_group,
)
from coppice.operators.joins import join_on_pairs, left_join_expecting, lookup_join
from coppice.operators.reshape import move_after, stack_filling, stack_tagged, to_long
from coppice.session import new_path
from coppice.sources.tables import read_delimited, write_curves, write_predictions
from workload.registry import query, table


@query(
    "csv_roundtrip_scan",
    """select o_orderkey, o_custkey, o_orderpriority,
              case when o_orderstatus <> 'P' then o_totalprice end as o_totalprice,
              'a "' || o_orderstatus || '", b\\' || o_orderpriority as note
       from orders""",
)
def csv_roundtrip_scan(spark, d):
    path = new_path(spark, "csv")
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("o.custkey"), "o_orderpriority", price.alias("o.totalprice"),
        F.concat(F.lit('a "'), "o_orderstatus", F.lit('", b\\'), "o_orderpriority").alias("note"),
    )
    write_predictions(rows, path, "csv", None)
    schema = "o_orderkey bigint, `o.custkey` bigint, o_orderpriority string, `o.totalprice` double, note string"
    return read_delimited(spark, path, schema)


@query(
    "predictions_roundtrip",
    """select l_linenumber::INTEGER as model, l_orderkey, l_partkey, l_extendedprice as observed,
              1500 * l_quantity as predicted from lineitem""",
)
def predictions_roundtrip(spark, d):
    path = new_path(spark, "predictions")
    rows = table(spark, d, "lineitem").select(
        F.col("l_linenumber").cast("int").alias("model"), "l_orderkey", "l_partkey",
        F.col("l_extendedprice").alias("observed"), (F.col("l_quantity") * 1500).alias("predicted"),
    )
    write_predictions(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


@query(
    "curves_roundtrip",
    """select variable, l_orderkey, l_linenumber, value as x
       from (select l_orderkey, l_linenumber, l_quantity, l_extendedprice from lineitem)
       unpivot (value for variable in (l_quantity, l_extendedprice))""",
)
def curves_roundtrip(spark, d):
    path = new_path(spark, "curves")
    rows = to_long(
        table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_orderkey", "l_linenumber"], values_to="x"
    )
    write_curves(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


@query(
    "text_to_number",
    """select o_orderkey,
              try_cast(case when o_orderstatus = 'F' then o_custkey::varchar else o_orderpriority end as double) as number
       from orders""",
)
def text_to_number(spark, d):
    text = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey").cast("string")).otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", to_number(text).alias("number"))


@query(
    "reorder_columns",
    "select p_partkey, p_type, p_brand from part",
)
def reorder_columns(spark, d):
    return move_after(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), "p_brand", "p_type")


@query(
    "label_only_rows",
    "select o_orderkey, o_custkey, o_orderpriority from orders where o_orderpriority = '4-NOT SPECIFIED'",
)
def label_only_rows(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return in_set(rows, "o_orderpriority", ["4-NOT SPECIFIED"])


@query(
    "complete_case_select",
    """select l_orderkey, l_partkey, l_quantity, nullif(l_tax, 0) as tax
       from lineitem where nullif(l_tax, 0) is not null""",
)
def complete_case_select(spark, d):
    rows = table(spark, d, "lineitem").withColumn("tax", F.nullif("l_tax", F.lit(0.0)))
    return complete_cases(rows, ["l_orderkey", "l_partkey", "l_quantity", "tax"])


@query(
    "group_mean_strict",
    """select l_partkey,
              case when count(nullif(l_quantity, 50)) = count(*)
                   then round(avg(nullif(l_quantity, 50)), 6) end as mean_quantity
       from lineitem group by l_partkey""",
)
def group_mean_strict(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_partkey", F.nullif("l_quantity", F.lit(50.0)).alias("q")
    )
    means = group_mean(rows, "l_partkey", "q", "mean_quantity")
    return means.withColumn("mean_quantity", F.round("mean_quantity", 6))


@query(
    "group_mean_skip",
    """select l_partkey, round(avg(nullif(l_quantity, 50)), 6) as mean_quantity
       from lineitem group by l_partkey""",
)
def group_mean_skip(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_partkey", F.nullif("l_quantity", F.lit(50.0)).alias("q")
    )
    means = group_mean(rows, "l_partkey", "q", "mean_quantity", "skip")
    return means.withColumn("mean_quantity", F.round("mean_quantity", 6))


@query(
    "group_mean_ratio",
    """with m as (select l_partkey, avg(l_quantity) as mq from lineitem group by l_partkey)
       select l_orderkey, l.l_partkey, l_linenumber, round(l_quantity / mq, 6) as relative
       from lineitem l left join m on l.l_partkey = m.l_partkey
       where l_discount >= 0.01 and l_returnflag = 'N'""",
)
def group_mean_ratio(spark, d):
    rows = table(spark, d, "lineitem")
    means = group_mean(rows, "l_partkey", "l_quantity")
    kept = at_least(rows, "l_discount", 0.01).where("l_returnflag = 'N'")
    kept = kept.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    out = ratio_to_group_mean(kept, means, "l_partkey", "l_quantity")
    return out.select("l_orderkey", "l_partkey", "l_linenumber", F.round("relative", 6).alias("relative"))


@query(
    "group_mean_ratio_window",
    """with b as (select l_orderkey, l_partkey, l_linenumber, nullif(l_quantity, 50) as q
                  from lineitem)
       select l_orderkey, l_partkey, l_linenumber,
              round(q / case when count(q) over p = count(*) over p then avg(q) over p end, 6)
                as relative
       from b window p as (partition by l_partkey)""",
)
def group_mean_ratio_window(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", F.nullif("l_quantity", F.lit(50.0)).alias("q")
    )
    out = ratio_within_group(rows, "l_partkey", "q")
    return out.select("l_orderkey", "l_partkey", "l_linenumber", F.round("relative", 6).alias("relative"))


@query(
    "log2_transform",
    """select o_orderkey,
              round(case when o_totalprice - 50000 > 0
                         then log2(case when o_totalprice - 50000 > 0
                                        then o_totalprice - 50000 end) end, 6) as phi
       from orders""",
)
def log2_transform(spark, d):
    phi = F.round(log2_or_null(F.col("o_totalprice") - 50000), 6)
    return table(spark, d, "orders").select("o_orderkey", phi.alias("phi"))


@query(
    "residual_table",
    """select l_orderkey, l_linenumber, l_partkey,
              round(1500 * l_quantity - l_extendedprice, 4) as difference, o_custkey
       from lineitem left join orders
         on l_orderkey = o_orderkey and year(l_shipdate) = year(o_orderdate)""",
)
def residual_table(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.round(residual(F.col("l_quantity") * 1500, "l_extendedprice"), 4).alias("difference"),
        F.year("l_shipdate").alias("year"),
    )
    linkage = table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("order_year")
    )
    pairs = {"l_orderkey": "o_orderkey", "year": "order_year"}
    return join_on_pairs(rows, linkage, pairs).drop("year")


@query(
    "threshold_filter",
    """select 'at least' as rule, l_orderkey, l_linenumber, l_partkey, l_discount + 0.0 as share
       from lineitem where l_discount >= 0.05
       union all
       select 'above', l_orderkey, l_linenumber, l_partkey, l_discount + 0.0
       from lineitem where l_discount > 0.05""",
)
def threshold_filter(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_discount"
    )
    both = stack_tagged(
        {"at least": at_least(rows, "l_discount", 0.05), "above": at_least(rows, "l_discount", 0.05, strict=True)},
        "rule",
    )
    return both.withColumn("share", F.col("l_discount") + 0.0).drop("l_discount")


@query(
    "region_in_set",
    """select c_custkey, c_mktsegment, r_name
       from customer join nation on c_nationkey = n_nationkey
                     join region on n_regionkey = r_regionkey
       where r_name in ('ASIA', 'EUROPE', 'AFRICA')""",
)
def region_in_set(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    named = lookup_join(nations, regions, ["n_regionkey"], "inner", True)
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    placed = lookup_join(rows, named, ["c_nationkey"], "inner", True)
    return in_set(placed, "r_name", ["ASIA", "EUROPE", "AFRICA"]).select(
        "c_custkey", "c_mktsegment", "r_name"
    )


@query(
    "exclude_outliers",
    """select p_partkey, p_type, p_brand from part
       where p_brand <> 'Brand#2' and nullif(p_type, 'SMALL') <> 'ECONOMY'""",
)
def exclude_outliers(spark, d):
    rows = table(spark, d, "part").select(
        "p_partkey", F.nullif("p_type", F.lit("SMALL")).alias("p_type"), "p_brand"
    )
    return exclude(rows, {"p_brand": "Brand#2", "p_type": "ECONOMY"})


@query(
    "anti_join_unexposed",
    """select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem l
       where not exists (select 1 from lineitem b where b.l_orderkey = l.l_orderkey
                           and b.l_discount >= 0.01 and b.l_returnflag = 'N')""",
)
def anti_join_unexposed(spark, d):
    rows = table(spark, d, "lineitem")
    exposed = at_least(rows, "l_discount", 0.01).where("l_returnflag = 'N'")
    kept = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return unexposed(kept, exposed, "l_orderkey")


@query(
    "many_to_many_left",
    """select l.l_orderkey, l.l_linenumber, r.l_partkey as exposed_part, r.l_discount + 0.0 as share
       from lineitem l left join (select * from lineitem
                                  where l_returnflag = 'R' and l_discount > 0.05) r
         on l.l_orderkey = r.l_orderkey""",
)
def many_to_many_left(spark, d):
    rows = table(spark, d, "lineitem")
    exposures = at_least(rows, "l_discount", 0.05, strict=True).where("l_returnflag = 'R'").select(
        "l_orderkey", F.col("l_partkey").alias("exposed_part"), (F.col("l_discount") + 0.0).alias("share")
    )
    return left_join_expecting(rows.select("l_orderkey", "l_linenumber"), exposures, ["l_orderkey"])


_TOP1 = """select l_orderkey, l_linenumber, l_partkey, l_extendedprice from (
             select *, row_number() over (partition by l_orderkey order by {order},
                       l_linenumber, l_partkey, l_extendedprice) as rk from lineitem) where rk = 1"""


def _top1(spark, d, order_by, descending=False):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", order_by.alias("__o")
    )
    ties = ["l_linenumber", "l_partkey", "l_extendedprice"]
    return first_per_group(rows, "l_orderkey", "__o", ties, descending).drop("__o")


@query("top1_smallest_per_group", _TOP1.format(order="nullif(l_tax, 0) asc nulls last"))
def top1_smallest_per_group(spark, d):
    return _top1(spark, d, F.nullif("l_tax", F.lit(0.0)))


@query("top1_largest_per_group", _TOP1.format(order="nullif(l_tax, 0) desc nulls last"))
def top1_largest_per_group(spark, d):
    return _top1(spark, d, F.nullif("l_tax", F.lit(0.0)), descending=True)


@query("first_event_per_group", _TOP1.format(order="year(l_shipdate) asc nulls last"))
def first_event_per_group(spark, d):
    return _top1(spark, d, F.year("l_shipdate"))


@query(
    "minmax_rescale",
    """select l_partkey, l_orderkey, l_linenumber, round((l_quantity - mn) / nullif(mx - mn, 0), 6) as x_rescaled
       from (select *, min(l_quantity) over (partition by l_partkey) as mn,
                       max(l_quantity) over (partition by l_partkey) as mx from lineitem)""",
)
def rescale(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    out = minmax_rescale(rows, "l_partkey", "l_quantity")
    return out.select(
        "l_partkey", "l_orderkey", "l_linenumber", F.round("x_rescaled", 6).alias("x_rescaled")
    )


_KINDS = {"1-URGENT": "fast", "2-HIGH": "fast", "3-MEDIUM": "slow"}
_KINDS_SQL = "(values ('1-URGENT', 'fast'), ('2-HIGH', 'fast'), ('3-MEDIUM', 'slow')) k(p, c)"


@query(
    "category_map",
    f"select o_orderkey, c as category from orders left join {_KINDS_SQL} on o_orderpriority = p",
)
def category_map(spark, d):
    kinds = mapping_frame(spark, _KINDS, "o_orderpriority", "category")
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return map_categories(rows, kinds, "o_orderpriority").select("o_orderkey", "category")


@query(
    "category_map_default",
    f"""select o_orderkey, coalesce(c, 'Other') as category
        from orders left join {_KINDS_SQL} on o_orderpriority = p""",
)
def category_map_default(spark, d):
    kinds = mapping_frame(spark, _KINDS, "o_orderpriority", "category")
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    mapped = map_categories(rows, kinds, "o_orderpriority", default="Other")
    return mapped.select("o_orderkey", "category")


@query(
    "label_lookup",
    f"""select o_orderkey, o_orderpriority, coalesce(c, o_orderpriority) as label
        from orders left join {_KINDS_SQL} on o_orderpriority = p""",
)
def label_lookup(spark, d):
    labels = mapping_frame(spark, _KINDS, "o_orderpriority", "label")
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return label_values(rows, labels, "o_orderpriority").select(
        "o_orderkey", "o_orderpriority", "label"
    )


@query(
    "ordinal_encode",
    "select p_partkey, p_brand, (dense_rank() over (order by p_brand) - 1)::BIGINT as code from part",
)
def encode(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_brand")
    return ordinal_encode(rows, "p_brand").select("p_partkey", "p_brand", "code")


@query(
    "composite_key",
    """select l_orderkey, l_partkey, concat_ws('.', l_returnflag, l_linestatus,
                coalesce(nullif(l_linenumber, 7)::varchar, 'NA')) as line
       from lineitem""",
)
def line_key(spark, d):
    key = composite_key("l_returnflag", "l_linestatus", F.nullif("l_linenumber", F.lit(7)))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", key.alias("line"))


@query(
    "union_tagged",
    """select c_custkey as account, c_acctbal as balance, 'customer' as kind from customer
       union all select s_suppkey, s_acctbal, 'supplier' from supplier""",
)
def union_tagged(spark, d):
    parts = {
        kind: table(spark, d, kind).select(
            F.col(f"{kind[0]}_{kind[:4]}key").alias("account"), F.col(f"{kind[0]}_acctbal").alias("balance")
        )
        for kind in ("customer", "supplier")
    }
    return stack_tagged(parts, "kind")


@query(
    "union_missing_cols",
    """select l_partkey, 'Individual' as line_type, l_linenumber as run, l_quantity as y from lineitem
       union all
       select l_partkey, 'Average', null, round(avg(l_quantity), 6) from lineitem group by l_partkey""",
)
def union_missing_cols(spark, d):
    rows = table(spark, d, "lineitem")
    single = rows.select(
        "l_partkey",
        F.lit("Individual").alias("line_type"),
        F.col("l_linenumber").alias("run"),
        F.col("l_quantity").alias("y"),
    )
    mean = rows.groupBy("l_partkey").agg(F.round(F.avg("l_quantity"), 6).alias("y"))
    return stack_filling(single, mean.withColumn("line_type", F.lit("Average")))


@query(
    "unpivot_long",
    """select l_orderkey, l_linenumber, variable, value from
         (select l_orderkey, l_linenumber, l_quantity, l_extendedprice,
                 l_partkey::DOUBLE as l_partkey from lineitem)
       unpivot (value for variable in (l_quantity, l_extendedprice, l_partkey))""",
)
def unpivot_long(spark, d):
    return to_long(
        table(spark, d, "lineitem"),
        ["l_quantity", "l_extendedprice", "l_partkey"],
        ["l_orderkey", "l_linenumber"],
    )
