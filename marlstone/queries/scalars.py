"""Scalar functions by family, each where its meaning could differ between engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dialect as D
from ..session import table
from . import query


@query("scalar_conditional", "select o_orderkey, case when o_totalprice > 200000 then 'big' when o_totalprice > 100000 then 'mid' else 'small' end as size, coalesce(nullif(o_orderstatus, 'F'), '-') as s, ifnull(nullif(o_orderkey % 4, 0), -1) as r from orders")
def conditional(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 200000, "big").when(F.col("o_totalprice") > 100000, "mid").otherwise("small").alias("size"), F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("F")), F.lit("-")).alias("s"), F.ifnull(F.nullif(F.col("o_orderkey") % 4, F.lit(0)), F.lit(-1)).alias("r"))


@query("scalar_greatest_least", "select p_partkey, greatest(p_size, 20, nullif(p_size, 1)) as g, least(p_size, 20, nullif(p_size, 50)) as l from part")
def greatest(spark, d):
    p = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.greatest(p, F.lit(20), F.nullif(p, F.lit(1))).alias("g"), F.least(p, F.lit(20), F.nullif(p, F.lit(50))).alias("l"))


@query("scalar_strings", "select c_custkey, upper(c_name) as u, lower(c_mktsegment) as l, c_name || '/' || c_mktsegment as cat, c_mktsegment[1:3] as cut, length(c_name) as n, replace(c_name, '0', '') as r, lpad(cast(c_nationkey as varchar), 4, '0') as p, trim('  ' || c_mktsegment || ' ') as t, reverse(c_mktsegment) as rev, strpos(c_name, '#') as pos, starts_with(c_name, 'Cust') as sw from customer")
def strings(spark, d):
    n, m = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, d, "customer").select(
        "c_custkey", F.upper(n).alias("u"), F.lower(m).alias("l"), F.concat(n, F.lit("/"), m).alias("cat"), D.slice_text(m, 1, 3).alias("cut"), F.length(n).cast("long").alias("n"),
        F.replace(n, F.lit("0"), F.lit("")).alias("r"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0").alias("p"), F.trim(F.concat(F.lit("  "), m, F.lit(" "))).alias("t"),
        F.reverse(m).alias("rev"), F.instr(n, "#").cast("long").alias("pos"), n.startswith("Cust").alias("sw"),
    )


@query("scalar_regex", "select p_partkey, regexp_matches(p_type, '^[A-Z]+ ') as m, regexp_extract(p_brand, '([0-9]+)', 1) as num, string_split(p_type, ' ')[1] as head, regexp_replace(p_type, '[AEIOU]', '*', 'g') as masked, p_type ilike '%brass' as il from part")
def regex(spark, d):
    t = F.col("p_type")
    return table(spark, d, "part").select("p_partkey", t.rlike("^[A-Z]+ ").alias("m"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("num"), D.part(t, " ", 1).alias("head"), F.regexp_replace(t, "[AEIOU]", "*").alias("masked"), t.ilike("%brass").alias("il"))


@query("scalar_digests", "select s_suppkey, md5(s_name) as m, sha256(s_name) as s from supplier")
def digests(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.md5("s_name").alias("m"), F.sha2("s_name", 256).alias("s"))


@query("scalar_dates", "select o_orderkey, cast(date_trunc('month', o_orderdate) as timestamp) as mon, strftime(o_orderdate, '%Y-%m-%d') as txt, extract(year from o_orderdate) as y, extract(quarter from o_orderdate) as q, dayofyear(o_orderdate) as doy, o_orderdate + interval 3 day as plus, date_diff('day', timestamp '1992-01-01', o_orderdate) as days, epoch_ms(o_orderdate) as ms, last_day(o_orderdate) as eom from orders")
def dates(spark, d):
    o = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", F.date_trunc("month", o).cast("timestamp_ntz").alias("mon"), F.date_format(o, "yyyy-MM-dd").alias("txt"), F.year(o).cast("long").alias("y"), F.quarter(o).cast("long").alias("q"),
        F.dayofyear(o).cast("long").alias("doy"), (o + F.expr("interval 3 days")).alias("plus"), F.date_diff(o.cast("date"), F.to_date(F.lit("1992-01-01"))).cast("long").alias("days"), D.epoch_ms(o).alias("ms"), F.last_day(o).alias("eom"),
    )


@query("scalar_math", "select p_partkey, round(p_retailprice, 1) as r, abs(-p_size) as a, floor(p_retailprice) as f, ceil(p_retailprice) as c, cast(sign(p_size - 25) as integer) as s, p_size // 7 as q, p_size % 7 as m, cast(p_retailprice / 10 as integer) as i, round(sqrt(p_size), 9) as sq, round(ln(p_size), 9) as ln, power(p_size, 2) as pw from part")
def maths(spark, d):
    p, n = F.col("p_retailprice"), F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", F.round(p, 1).alias("r"), F.abs(-n).alias("a"), F.floor(p).cast("double").alias("f"), F.ceil(p).cast("double").alias("c"), F.signum(n - 25).cast("int").alias("s"), D.int_divide(n, F.lit(7)).cast("int").alias("q"),
        (n % 7).alias("m"), F.rint(p / 10).cast("int").alias("i"), F.round(F.sqrt(n), 9).alias("sq"), F.round(F.ln(n), 9).alias("ln"), F.pow(n, F.lit(2)).alias("pw"),
    )


@query("scalar_lists", "select o_custkey, list_transform(ks, lambda k: k * 2) as doubled, list_filter(ks, lambda k: k % 2 = 0) as even, len(ks) as n, list_contains(ks, 7) as has, ks[1] as head, list_sum(ks)::bigint as total from (select o_custkey, list(o_orderkey order by o_orderkey) as ks from orders group by 1) t")
def lists(spark, d):
    t = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("ks"))
    return t.select("o_custkey", F.transform("ks", lambda k: k * 2).alias("doubled"), F.filter("ks", lambda k: k % 2 == 0).alias("even"), F.size("ks").cast("long").alias("n"), F.array_contains("ks", 7).alias("has"), F.get("ks", F.lit(0)).alias("head"), F.aggregate("ks", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("scalar_structs", "select n_nationkey, struct_pack(k := n_nationkey, name := n_name).name as name, struct_pack(k := n_nationkey).k + 1 as k1 from nation")
def structs(spark, d):
    s = F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return table(spark, d, "nation").select("n_nationkey", s["name"].alias("name"), (s["k"] + 1).alias("k1"))


@query("scalar_maps", "select n_regionkey, map_extract(m, 'a')[1] as a, cast(cardinality(m) as bigint) as n from (select n_regionkey, map {'a': min(n_nationkey), 'b': max(n_nationkey)} as m from nation group by 1) t")
def maps(spark, d):
    t = table(spark, d, "nation").groupBy("n_regionkey").agg(F.create_map(F.lit("a"), F.min("n_nationkey"), F.lit("b"), F.max("n_nationkey")).alias("m"))
    return t.select("n_regionkey", F.element_at("m", "a").alias("a"), F.size("m").cast("long").alias("n"))


@query("scalar_json", "select event_id, json_extract_string(props, '$.k') as k, props ->> '$.v' as v from events")
def json_path(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.v").alias("v"))


@query("scalar_casts", "select p_partkey, try_cast(p_brand as integer) as bad, cast(p_size as varchar) as t, cast(p_retailprice as decimal(12,1))::varchar as dec from part")
def casts(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_brand").try_cast("int").alias("bad"), F.col("p_size").cast("string").alias("t"), F.col("p_retailprice").cast("decimal(12,1)").cast("string").alias("dec"))
