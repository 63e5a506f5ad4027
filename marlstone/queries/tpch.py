"""Star-schema reports over the order tables. Money is summed as decimals, so no order of addition shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.joins import small
from ..plans import ir
from ..plans.compile import to_dataframe, to_sql
from ..session import table
from . import query


def _money(c):
    return c.cast("decimal(18,4)")


PRICE = "cast(l_extendedprice as decimal(18,4)) * (1 - cast(l_discount as decimal(6,4)))"
REVENUE = f"cast(round(sum({PRICE}), 2) as double)"


def _revenue():
    return F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,4)") * (1 - F.col("l_discount").cast("decimal(6,4)"))), 2).cast("double")


ORDERS = ir.Scan("files", "orders", (("o_orderkey", "Integer"), ("o_orderdate", "DateTime"), ("o_orderpriority", "String")))
LINES = ir.Scan("files", "lineitem", (("l_orderkey", "Integer"), ("l_quantity", "Decimal<12,2>"), ("l_shipdate", "DateTime"), ("l_returnflag", "String")))
FLAGSHIP = ir.Aggregate(
    ir.Join(ir.Filter(LINES, ir.Compare("=", ir.Col("l_returnflag"), ir.Lit.of("R"))), ORDERS, (("l_orderkey", "o_orderkey"),)),
    ("o_orderpriority",),
    (("lines", "count", None), ("quantity", "sum", "l_quantity"), ("average", "avg", "l_quantity"), ("first_ship", "min", "l_shipdate")),
)


@query("flagship_priority_returns", to_sql(FLAGSHIP, "duckdb"))
def flagship(spark, d):
    return to_dataframe(FLAGSHIP, lambda scan: table(spark, d, scan.relation))


@query(
    "tpch_q1_pricing_summary",
    f"""select l_returnflag, l_linestatus, cast(round(sum(cast(l_quantity as decimal(18,2))), 2) as double) as sum_qty, {REVENUE} as sum_disc_price,
    round(avg(l_quantity), 4) as avg_qty, round(avg(l_discount), 6) as avg_disc, count(*) as count_order
    from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""",
)
def q1(spark, d):
    return (
        table(spark, d, "lineitem").filter("l_shipdate <= timestamp_ntz '1998-09-02'").groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"), _revenue().alias("sum_disc_price"),
            F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("count_order"),
        )
    )


@query(
    "tpch_q3_shipping_priority",
    f"""select l_orderkey, {REVENUE} as revenue, o_orderdate from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
    where c_mktsegment = 'BUILDING' and o_orderdate < timestamp '1998-03-15' group by l_orderkey, o_orderdate order by revenue desc, l_orderkey limit 10""",
)
def q3(spark, d):
    c = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, d, "orders").filter("o_orderdate < timestamp_ntz '1998-03-15'").select("o_orderkey", "o_custkey", "o_orderdate")
    l = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    joined = l.join(o.join(c, o.o_custkey == c.c_custkey, "left_semi"), l.l_orderkey == o.o_orderkey)
    return joined.groupBy("l_orderkey", "o_orderdate").agg(_revenue().alias("revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10).select("l_orderkey", "revenue", "o_orderdate")


@query("tpch_q4_order_priority", "select o_orderpriority, count(*) as order_count from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45) group by 1")
def q4(spark, d):
    l = table(spark, d, "lineitem").filter("l_quantity > 45").select("l_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return o.join(l, o.o_orderkey == l.l_orderkey, "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("order_count"))


@query(
    "tpch_q5_local_supplier_volume",
    f"""select n_name, {REVENUE} as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
    join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    where r_name = 'ASIA' group by n_name""",
)
def q5(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    s = table(spark, d, "supplier").join(small(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    l = table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return l.join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).groupBy("n_name").agg(_revenue().alias("revenue"))


@query(
    "tpch_q6_forecast_revenue",
    """select cast(round(sum(cast(l_extendedprice as decimal(18,4)) * cast(l_discount as decimal(6,4))), 2) as double) as revenue from lineitem
    where l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1997-01-01' and l_discount between 0.04 and 0.07 and l_quantity < 24""",
)
def q6(spark, d):
    l = table(spark, d, "lineitem").filter("l_shipdate >= timestamp_ntz '1996-01-01' and l_shipdate < timestamp_ntz '1997-01-01' and l_discount between 0.04D and 0.07D and l_quantity < 24")
    return l.agg(F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,4)") * F.col("l_discount").cast("decimal(6,4)")), 2).cast("double").alias("revenue"))


@query(
    "tpch_q10_returned_items",
    f"""select c_custkey, c_name, {REVENUE} as revenue, n_name from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
    join nation on c_nationkey = n_nationkey where l_returnflag = 'R' group by c_custkey, c_name, n_name order by revenue desc, c_custkey limit 20""",
)
def q10(spark, d):
    l = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_extendedprice", "l_discount")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    # group by the key before the names join, so that names don't travel with every line
    per = l.join(o, l.l_orderkey == o.o_orderkey).groupBy("o_custkey").agg(_revenue().alias("revenue"))
    c = table(spark, d, "customer").join(small(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return per.join(c, F.col("o_custkey") == F.col("c_custkey")).orderBy(F.desc("revenue"), "c_custkey").limit(20).select("c_custkey", "c_name", "revenue", "n_name")


@query("tpch_q13_customer_distribution", "select c_count, count(*) as custdist from (select c_custkey, count(o_orderkey) as c_count from customer left join orders on c_custkey = o_custkey group by c_custkey) t group by c_count")
def q13(spark, d):
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, d, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.groupBy(F.coalesce("n", F.lit(0)).alias("c_count")).agg(F.count(F.lit(1)).alias("custdist"))


@query(
    "tpch_q14_promotion_effect",
    f"""select round(100.0 * cast(sum(case when p_type like 'PROMO%' then {PRICE} else 0 end) as double) / cast(sum({PRICE}) as double), 6) as promo_revenue
    from lineitem join part on l_partkey = p_partkey where l_shipdate >= timestamp '1996-01-01'""",
)
def q14(spark, d):
    l = table(spark, d, "lineitem").filter("l_shipdate >= timestamp_ntz '1996-01-01'").select("l_partkey", "l_extendedprice", "l_discount")
    j = l.join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    price = F.col("l_extendedprice").cast("decimal(18,4)") * (1 - F.col("l_discount").cast("decimal(6,4)"))
    return j.agg(F.round(100.0 * F.sum(F.when(F.col("p_type").startswith("PROMO"), price).otherwise(0)).cast("double") / F.sum(price).cast("double"), 6).alias("promo_revenue"))


@query(
    "tpch_q17_small_quantity",
    """select count(*) as n, cast(round(sum(cast(l_extendedprice as decimal(18,2))), 2) as double) as total from lineitem join part on p_partkey = l_partkey
    where p_brand = (select min(p_brand) from part) and l_quantity < (select 0.5 * avg(l2.l_quantity) from lineitem l2 where l2.l_partkey = p_partkey)""",
)
def q17(spark, d):
    part = table(spark, d, "part")
    brand = part.agg(F.min("p_brand").alias("b"))
    l = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice")
    mine = l.join(part.join(small(brand), F.col("p_brand") == F.col("b"), "left_semi").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    half = mine.groupBy("l_partkey").agg((0.5 * F.avg("l_quantity")).alias("half"))
    return mine.join(half, "l_partkey").filter("l_quantity < half").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query(
    "tpch_q18_large_orders",
    """select o_orderkey, o_custkey, cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity from orders join lineitem on l_orderkey = o_orderkey
    group by o_orderkey, o_custkey having sum(l_quantity) > 200 order by quantity desc, o_orderkey limit 100""",
)
def q18(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q")).filter("q > 200")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.join(per, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", F.col("q").cast("double").alias("quantity")).orderBy(F.desc("quantity"), "o_orderkey").limit(100)


@query(
    "tpch_q22_rich_without_orders",
    """select c_mktsegment, count(*) as n, cast(round(sum(cast(c_acctbal as decimal(18,2))), 2) as double) as balance from customer
    where c_acctbal > (select avg(c_acctbal) from customer where c_acctbal > 0) and not exists (select 1 from orders where o_custkey = c_custkey) group by 1""",
)
def q22(spark, d):
    c = table(spark, d, "customer")
    mean = c.filter("c_acctbal > 0").agg(F.avg("c_acctbal").alias("mean"))
    rich = c.join(small(mean), F.col("c_acctbal") > F.col("mean"))
    o = table(spark, d, "orders").select("o_custkey")
    left = rich.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return left.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"))
