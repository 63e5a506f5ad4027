"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.joins import qualify
from ..session import table
from . import query



def _by():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")



@query("window_ranking", "select p_partkey, row_number() over w as rn, rank() over v as rk, dense_rank() over v as dr, ntile(4) over w as nt from part window w as (partition by p_brand order by p_size, p_partkey), v as (partition by p_brand order by p_size)")
def ranking(spark, d):
    w, v = Window.partitionBy("p_brand").orderBy("p_size", "p_partkey"), Window.partitionBy("p_brand").orderBy("p_size")
    return table(spark, d, "part").select("p_partkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(v).cast("long").alias("rk"), F.dense_rank().over(v).cast("long").alias("dr"), F.ntile(4).over(w).cast("long").alias("nt"))


@query("window_distribution", "select p_partkey, round(percent_rank() over v, 9) as pr, round(cume_dist() over v, 9) as cd from part window v as (partition by p_brand order by p_size)")
def distribution(spark, d):
    v = Window.partitionBy("p_brand").orderBy("p_size")
    return table(spark, d, "part").select("p_partkey", F.round(F.percent_rank().over(v), 9).alias("pr"), F.round(F.cume_dist().over(v), 9).alias("cd"))


@query("window_lag_lead", "select o_orderkey, lag(o_orderkey) over w as prev, lead(o_orderkey, 2, -1) over w as next2 from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
def lag_lead(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(_by()).alias("prev"), F.lead("o_orderkey", 2, -1).over(_by()).alias("next2"))


@query("window_rows_frame", "select o_orderkey, round(cast(sum(cast(o_totalprice as decimal(18,2))) over w as double) / count(*) over w, 4) as m from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between 6 preceding and current row)")
def rows_frame(spark, d):
    w = _by().rowsBetween(-6, 0)
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(w).cast("double")
    return table(spark, d, "orders").select("o_orderkey", F.round(total / F.count(F.lit(1)).over(w), 4).alias("m"))


@query("window_range_frame", "select p_partkey, count(*) over (partition by p_brand order by p_size range between 3 preceding and 3 following) as n from part")
def range_frame(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-3, 3)
    return table(spark, d, "part").select("p_partkey", F.count(F.lit(1)).over(w).alias("n"))


@query("window_values", "select o_orderkey, first_value(o_orderkey) over w as f, last_value(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as l, nth_value(o_orderkey, 2) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as n2 from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
def values(spark, d):
    whole = _by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "orders").select("o_orderkey", F.first("o_orderkey").over(_by()).alias("f"), F.last("o_orderkey").over(whole).alias("l"), F.nth_value("o_orderkey", 2).over(whole).alias("n2"))


@query("window_running_sum", "select l_orderkey, l_linenumber, cast(sum(cast(l_quantity as decimal(12,2))) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows unbounded preceding) as double) as run from lineitem")
def running(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.sum(F.col("l_quantity").cast("decimal(12,2)")).over(w).cast("double").alias("run"))


@query("window_share", "select c_custkey, round(c_acctbal / sum(c_acctbal) over (partition by c_nationkey), 6) as share from customer where c_acctbal > 0")
def share(spark, d):
    return table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey", F.round(F.col("c_acctbal") / F.sum("c_acctbal").over(Window.partitionBy("c_nationkey")), 6).alias("share"))


@query("qualify", "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 2")
def qualify_top(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return qualify(table(spark, d, "orders"), F.row_number().over(w) <= 2).select("o_custkey", "o_orderkey")
