"""Requests to sources, typed files, promises, freshness, admission and derived tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import types as ty
from ..operators.delta import own_folder
from ..operators.derive import derive_items
from ..quality import operations as ops
from ..quality import promises as pr
from ..session import table
from ..sources import files
from ..sources import request as rq
from ..types import Field
from . import query


@query("request_filters", "select o_orderkey as k, o_totalprice as price from orders where o_orderstatus in ('F', 'O') and o_totalprice >= 1000 and o_totalprice < 150000 and o_orderpriority like '%-%' and o_orderkey <> 7 and o_custkey is not null order by o_totalprice desc, o_orderkey limit 50")
def request_filters(spark, d):
    w = rq.Where
    r = rq.Request("orders", (("k", "o_orderkey"), ("price", "o_totalprice")), (w("o_orderstatus", "in", ["F", "O"]), w("o_totalprice", "ge", 1000), w("o_totalprice", "lt", 150000), w("o_orderpriority", "like", "%-%"), w("o_orderkey", "neq", 7), w("o_custkey", "isNotNull")), order_by=(("o_totalprice", "desc"), ("o_orderkey", "asc")), limit=50)
    return rq.run(r, table(spark, d, "orders"))


@query("request_keys_and_span", "select event_id, value from events where event_id > 100 and event_id <= 200 and (user_id = 3 or user_id = 5 or user_id = 9)")
def request_span(spark, d):
    r = rq.Request("events", (("event_id", "event_id"), ("value", "value")), keys=({"user_id": 3}, {"user_id": 5}, {"user_id": 9}), span=rq.Span("event_id", 100, 200))
    return rq.run(r, table(spark, d, "events"))


@query(
    "request_sql_text",
    """select * from (values ('postgres','SELECT "a" AS "x" FROM "s"."t" WHERE "a" IN ($1, $2) AND ("k", "l") IN (($3, $4)) ORDER BY "a" ASC NULLS LAST LIMIT 5'),
    ('mysql','SELECT `a` AS `x` FROM `s`.`t` WHERE `a` IN (?, ?) AND (`k`, `l`) IN ((?, ?)) ORDER BY `a` IS NULL, `a` ASC LIMIT 5'),
    ('oracle','SELECT "a" AS "x" FROM "s"."t" WHERE "a" IN (:1, :2) AND ("k", "l") IN ((:3, :4)) ORDER BY "a" ASC NULLS LAST FETCH FIRST 5 ROWS ONLY'),
    ('bigquery','SELECT `a` AS `x` FROM `s`.`t` WHERE `a` IN (@p1, @p2) AND ((`k` = @p3 AND `l` = @p4)) ORDER BY `a` ASC NULLS LAST LIMIT 5')) t(dialect, text)""",
)
def request_sql(spark, d):
    r = rq.Request("s.t", (("x", "a"),), (rq.Where("a", "in", [1, 2]),), keys=({"k": 1, "l": 2},), order_by=(("a", "asc"),), limit=5)
    return spark.createDataFrame([(x, rq.to_sql(r, x)[0]) for x in ("postgres", "mysql", "oracle", "bigquery")], "dialect string, text string")


def _folder(spark):
    return f"{own_folder(spark)}/files-{uuid.uuid4().hex}"


@query("source_csv_rescue", "select cast(n_nationkey as bigint) as k, case when n_nationkey % 5 = 0 then null else cast(n_nationkey as bigint) end as v, case when n_nationkey % 5 = 0 then '{\"v\":\"bad' || n_nationkey || '\"}' end as _rescued_data from nation")
def csv_rescue(spark, d):
    path = _folder(spark)
    n = table(spark, d, "nation")
    n.select("n_nationkey", F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("bad"), "n_nationkey")).otherwise(F.col("n_nationkey").cast("string")).alias("v")).write.option("header", True).csv(path)
    return files.read_csv(spark, path, [Field("k", ty.parse("Integer")), Field("v", ty.parse("Integer")), Field(files.RESCUED, ty.parse("String"))])


@query("source_csv_nulls", "select cast(k as bigint) as k, a, b from (values (1, null, ''), (2, 'x', 'y')) t(k, a, b)")
def csv_nulls(spark, d):
    path = _folder(spark)
    spark.createDataFrame([('1,,""',), ("2,x,y",)], "line string").coalesce(1).write.text(path)
    return files.read_csv(spark, path, [Field("k", ty.parse("Integer")), Field("a", ty.parse("String")), Field("b", ty.parse("String"))], header=False)


@query("source_jsonl_typed", "select s_suppkey as k, cast(s_acctbal as decimal(12,2))::varchar as bal from supplier")
def jsonl(spark, d):
    path = _folder(spark)
    table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").cast("decimal(12,2)").cast("string").alias("bal")).write.json(path)
    got = files.read_jsonl(spark, path, [Field("k", ty.parse("Integer")), Field("bal", ty.parse("Decimal<12,2>"))])
    return got.select("k", F.col("bal").cast("string").alias("bal"))


@query("source_parquet_partitions", "select n_nationkey, n_regionkey from nation where n_regionkey = 2")
def partitions(spark, d):
    path = _folder(spark)
    table(spark, d, "nation").write.partitionBy("n_regionkey").parquet(path)
    return files.read_parquet(spark, path).filter("n_regionkey = 2").select("n_nationkey", "n_regionkey")


@query("source_infer_text", "select * from (values ('a','Integer'), ('b','String'), ('c','Date'), ('e','Decimal<38,18>')) t(col, kind)")
def infer(spark, d):
    t = spark.createDataFrame([("1", "1", "2024-01-02", "1.5"), ("22", "x", "2024-02-29", "2"), (None, None, None, None)], "a string, b string, c string, e string")
    return spark.createDataFrame([(f.name, str(f.type)) for f in files.infer_text_columns(t)], "col string, kind string")


@query("sink_upsert", "select c_custkey, case when exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F') then 'filled' else c_mktsegment end as c_mktsegment from customer")
def upsert(spark, d):
    """Customers with a filled order replace themselves in a table of all customers."""
    path = _folder(spark)
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    files.write_dataset(c, path)
    filled = c.join(table(spark, d, "orders").filter("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return files.write_dataset(filled.withColumn("c_mktsegment", F.lit("filled")), path, "upsert", ["c_custkey"])


PROMISES = [
    pr.Promise("rowCount", "mustBeGreaterThan", (10,)),
    pr.Promise("nullValues", "mustBe", (0,), ("o_custkey",)),
    pr.Promise("duplicateValues", "mustBe", (0,), ("o_orderkey",)),
    pr.Promise("duplicateValues", "mustBeLessThan", (10,), ("o_custkey",), severity="warning"),
    pr.Promise("invalidValues", "mustBe", (0,), ("o_orderstatus",), values=("F", "O", "P")),
    pr.Promise("invalidValues", "mustBeBetween", (0, 5), ("o_totalprice",), unit="percent", between=(0, 400000), severity="warning"),
    pr.Promise("missingValues", "mustNotBe", (0,), ("o_orderpriority",), values=("5-LOW",)),
    pr.Promise("rowCountChange", "mustBeGreaterOrEqualTo", (0,)),
]


@query(
    "promise_metrics",
    """select 0 as i, 'rowCount' as metric, cast(count(*) as double) as value from orders union all select 1, 'nullValues', count(*) filter (where o_custkey is null) from orders
    union all select 2, 'duplicateValues', count(o_orderkey) - count(distinct o_orderkey) from orders union all select 3, 'duplicateValues', count(o_custkey) - count(distinct o_custkey) from orders
    union all select 4, 'invalidValues', count(*) filter (where o_orderstatus not in ('F', 'O', 'P')) from orders
    union all select 5, 'invalidValues', round(100.0 * count(*) filter (where not (o_totalprice between 0 and 400000)) / count(*), 6) from orders
    union all select 6, 'missingValues', count(*) filter (where o_orderpriority is null or o_orderpriority = '5-LOW') from orders union all select 7, 'rowCountChange', count(*) - 100 from orders""",
)
def promise_metrics(spark, d):
    got = pr.measure(table(spark, d, "orders"), PROMISES, {"rowCount": 100})
    return spark.createDataFrame([(i, p.metric, round(float(got[p]), 6)) for i, p in enumerate(PROMISES)], "i int, metric string, value double")


@query(
    "promise_verdicts",
    """with m as (select count(*) as n, count(*) filter (where o_custkey is null) as nulls, count(o_orderkey) - count(distinct o_orderkey) as k, count(o_custkey) - count(distinct o_custkey) as c,
      count(*) filter (where o_orderstatus not in ('F', 'O', 'P')) as bad, 100.0 * count(*) filter (where not (o_totalprice between 0 and 400000)) / count(*) as pct,
      count(*) filter (where o_orderpriority is null or o_orderpriority = '5-LOW') as missing from orders),
    v as (select unnest([n > 10, nulls = 0, k = 0, c < 10, bad = 0, pct between 0 and 5, missing <> 0, n - 100 >= 0]) as ok, unnest([0, 1, 2, 3, 4, 5, 6, 7]) as i, unnest([true, true, true, false, true, false, true, true]) as strict from m)
    select i, case when ok then 'pass' else 'fail' end as outcome from v union all select 100, case when bool_and(ok or not strict) then 'publish' else 'blocked' end from v""",
)
def promise_verdicts(spark, d):
    verdicts, publish = pr.judge(table(spark, d, "orders"), PROMISES, {"rowCount": 100})
    rows = [(i, v.outcome) for i, v in enumerate(verdicts[: len(PROMISES)])]
    return spark.createDataFrame([*rows, (100, "publish" if publish else "blocked")], "i int, outcome string")


@query("freshness_due", "select * from (values ('never',true), ('young',false), ('old',true), ('running',false), ('waiting',false), ('waited',true)) t(view, due)")
def freshness(spark, d):
    f = ops.Freshness
    cases = {"never": f(100, None), "young": f(100, 1000 - 79), "old": f(100, 1000 - 80), "running": f(100, 0, running_since_s=900), "waiting": f(100, 0, failures=3, failed_at_s=800), "waited": f(100, 0, failures=3, failed_at_s=700)}
    return spark.createDataFrame([(n, ops.due(x, 1000)[0]) for n, x in cases.items()], "view string, due boolean")


@query("cache_verdicts", "select * from (values ('absent'), ('other_rule'), ('other_topology'), ('incomplete'), ('stale'), ('hit')) t(verdict)")
def cache(spark, d):
    c = ops.Cached
    cases = [None, c("x", "t", True, 9), c("r", "x", True, 9), c("r", "t", False, 9), c("r", "t", True, 3), c("r", "t", True, 9)]
    return spark.createDataFrame([(ops.cache_verdict(x, "r", "t", 5),) for x in cases], "verdict string")


@query("admission_class", "select * from (values ('scan','L'), ('enormous','E')) t(query, klass)")
def admission(spark, d):
    rows = [("scan", ops.admit(table(spark, d, "orders")).klass), ("enormous", ops.admit(spark.range(10**13)).klass)]
    return spark.createDataFrame(rows, "query string, klass string")


@query("derive_incremental", "select n_nationkey as item, 'ok' as status, cast(length(n_name) as integer) as n, case when n_nationkey < 5 then 'again' else 'kept' end as how from nation where n_nationkey <> 24 and n_nationkey <> 23 union all select 23, 'error: boom', null, 'kept'")
def derive(spark, d):
    """Items derived once; then five change, one goes, and only the five are computed again."""
    items = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("path"), F.md5("n_name").alias("digest"), F.col("n_name").alias("body"))

    def measure(mark):
        def f(item):
            if item["path"] == "23":
                raise ValueError("boom")
            return [{"n": len(item["body"]), "how": mark}]

        return f

    run = lambda rows, kept, mark: derive_items(rows, kept, measure(mark), "measure", "1", {}, "n int, how string")
    first = _kept(spark, run(items, None, "kept"))
    changed = items.filter("path <> '24'").withColumn("digest", F.when(F.col("path").cast("int") < 5, F.concat("digest", F.lit("x"))).otherwise(F.col("digest")))
    out = run(changed, first, "again")
    return out.select(F.col("_item").cast("int").alias("item"), F.col("_status").alias("status"), "n", F.when(F.col("_status") == "ok", F.col("how")).otherwise(F.lit("kept")).alias("how"))


def _kept(spark, df):
    path = _folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@query("gateway_read", "select n_nationkey, n_name from nation where n_regionkey = 1")
def gateway_read(spark, d):
    """A small interactive read within its bounds; one that is over them is an error, never cut short."""
    from ..sources.gateway import Bounds, Gateway, OverBudget

    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    g = Gateway(spark, tight=Bounds(rows=3))
    try:
        g.read("tight", lambda: n)
    except OverBudget:
        pass
    else:
        raise AssertionError("a read over its bound was answered")
    return spark.createDataFrame(g.read("wide", lambda: n.filter("n_regionkey = 1").select("n_nationkey", "n_name")))


@query("witness_reads", "select o_orderkey, case when o_orderkey <= (select max(o_orderkey) from orders where o_orderstatus = 'F') then 1 else 2 end as part from orders where o_orderstatus = 'F' or o_orderkey > (select max(o_orderkey) from orders where o_orderstatus = 'F')")
def witness_reads(spark, d):
    """The filled orders come first; what the second read finds is past the first one's witness."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    first, at = rq.read_since(o.filter("o_orderstatus = 'F'"), "o_orderkey")
    second, end = rq.read_since(o, "o_orderkey", at)
    if not end.reached(at):
        raise AssertionError("the second witness is behind the first")
    return first.select("o_orderkey", F.lit(1).alias("part")).unionAll(second.select("o_orderkey", F.lit(2)))
