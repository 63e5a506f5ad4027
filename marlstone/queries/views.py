"""The view engine: algebra operators, rewriting onto materializations, deltas, and the pure analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.delta import WEIGHT, Circuit, as_delta, consolidate, from_upserts, rows_of
from ..operators.state_store import StateStore
from ..plans import ir, matching, pushdown, refresh, views
from ..plans.compile import to_dataframe, to_sql
from ..session import table
from . import query

C, L = ir.Col, ir.Lit.of
ORDERS = ir.Scan("files", "orders", (("o_orderkey", "Integer"), ("o_custkey", "Integer"), ("o_orderstatus", "String"), ("o_totalprice", "Decimal<12,2>"), ("o_orderpriority", "String")))
CUSTOMER = ir.Scan("files", "customer", (("c_custkey", "Integer"), ("c_nationkey", "Integer"), ("c_mktsegment", "String")))
SUPPLIER = ir.Scan("files", "supplier", (("s_suppkey", "Integer"), ("s_nationkey", "Integer")))
JOINED = ir.Join(ORDERS, CUSTOMER, (("o_custkey", "c_custkey"),))

PLANS = {
    "alg_scan": CUSTOMER,
    "alg_project": ir.Project(ORDERS, (("k", C("o_orderkey")), ("big", ir.Compare(">", C("o_totalprice"), L(150000))), ("one", L(1)))),
    "alg_filter": ir.Filter(ORDERS, ir.And((ir.Or((ir.In(C("o_orderstatus"), (L("F"), L("P"))), ir.Compare("<", C("o_orderkey"), L(100)))), ir.Not(ir.IsNull(C("o_custkey")))))),
    "alg_empty_sets": ir.Project(CUSTOMER, (("k", C("c_custkey")), ("t", ir.And()), ("f", ir.Or()), ("i", ir.In(C("c_custkey"), ())))),
    "alg_join_inner": JOINED,
    "alg_join_left": ir.Join(CUSTOMER, ir.Filter(ORDERS, ir.Compare("=", C("o_orderstatus"), L("P"))), (("c_custkey", "o_custkey"),), "left"),
    "alg_join_right": ir.Join(ir.Filter(ORDERS, ir.Compare("=", C("o_orderstatus"), L("P"))), CUSTOMER, (("o_custkey", "c_custkey"),), "right"),
    "alg_join_full": ir.Join(SUPPLIER, CUSTOMER, (("s_suppkey", "c_nationkey"),), "full"),
    "alg_group": ir.Aggregate(JOINED, ("c_mktsegment",), (("n", "count", None), ("total", "sum", "o_totalprice"), ("lo", "min", "o_totalprice"), ("hi", "max", "o_totalprice"), ("mean", "avg", "o_totalprice"))),
    "alg_group_global": ir.Aggregate(ORDERS, (), (("n", "count", None), ("hi", "max", "o_orderkey"))),
    "alg_group_global_no_rows": ir.Aggregate(ir.Filter(ORDERS, ir.Compare("<", C("o_orderkey"), L(-1))), (), (("n", "count", None),)),
    "alg_union": ir.Union((ir.Project(ORDERS, (("k", C("o_custkey")), ("m", C("o_totalprice")))), ir.Project(CUSTOMER, (("m", ir.Lit("Decimal", "1.5")), ("k", C("c_custkey")))))),
    "alg_distinct": ir.Distinct(ir.Project(ORDERS, (("p", C("o_orderpriority")), ("s", C("o_orderstatus"))))),
    "alg_limit": ir.Limit(ir.Project(ORDERS, (("s", C("o_orderstatus")), ("k", C("o_orderkey")))), 25),
}


def _read(spark, d):
    return lambda scan: table(spark, d, scan.relation)


def _algebra(plan):
    return lambda spark, d: to_dataframe(plan, _read(spark, d))


for _name, _plan in PLANS.items():
    query(_name, to_sql(_plan, "duckdb"))(_algebra(_plan))


@query("alg_spark_sql_text", to_sql(PLANS["alg_group"], "duckdb"))
def as_sql_text(spark, d):
    """The plan as Spark SQL text, run over views."""
    for name in ("orders", "customer"):
        table(spark, d, name).createOrReplaceTempView(name)
    return spark.sql(to_sql(PLANS["alg_group"], "spark"))


VIEWS = {"big": ir.Filter(ORDERS, ir.Compare(">", C("o_totalprice"), L(100000))), "big_by_customer": ir.Aggregate(ir.Ref("big"), ("o_custkey",), (("n", "count", None),))}


@query("view_expansion", "select o_custkey, count(*) as n from orders where cast(o_totalprice as decimal(12,2)) > 100000 group by 1")
def expansion(spark, d):
    return to_dataframe(views.expand(ir.Ref("big_by_customer"), VIEWS), _read(spark, d))


# -- rewriting ------------------------------------------------------------------------------------

STORED = ir.Aggregate(ir.Filter(JOINED, ir.Compare(">", C("o_totalprice"), L(50000))), ("c_mktsegment", "o_orderstatus"), (("n", "count", None), ("total", "sum", "o_totalprice"), ("hi", "max", "o_totalprice")))
COARSE = ir.Aggregate(ir.Filter(JOINED, ir.And((ir.Compare(">", C("o_totalprice"), L(50000)), ir.Compare("=", C("o_orderstatus"), L("F"))))), ("c_mktsegment",), (("orders", "count", None), ("top", "max", "o_totalprice"), ("spent", "sum", "o_totalprice")))
STORED_SCAN = ir.Scan("lake", "mv_orders", (("c_mktsegment", "String"), ("o_orderstatus", "String"), ("n", "Integer"), ("total", "Decimal<38,2>"), ("hi", "Decimal<12,2>")))


@query("view_rewrite_rollup", to_sql(COARSE, "duckdb"))
def rewrite_rollup(spark, d):
    """A coarser, narrower query answered from the stored rows of a finer view."""
    tree = matching.FilterTree()
    tree.register("mv_orders", STORED, STORED_SCAN)
    name, plan = tree.rewrite(COARSE)
    assert name == "mv_orders"
    stored = to_dataframe(STORED, _read(spark, d))
    return to_dataframe(plan, lambda scan: stored if scan.relation == "mv_orders" else table(spark, d, scan.relation))


WIDE = ir.Project(ir.Filter(ORDERS, ir.Compare(">=", C("o_totalprice"), L(20000))), (("k", C("o_orderkey")), ("price", C("o_totalprice")), ("status", C("o_orderstatus"))))
NARROW = ir.Project(ir.Filter(ORDERS, ir.And((ir.Compare(">", C("o_totalprice"), L(90000)), ir.In(C("o_orderstatus"), (L("F"), L("O")))))), (("o_orderkey", C("o_orderkey")), ("o_totalprice", C("o_totalprice"))))


@query("view_rewrite_compensation", to_sql(NARROW, "duckdb"))
def rewrite_compensation(spark, d):
    scan = ir.Scan("lake", "wide", (("k", "Integer"), ("price", "Decimal<12,2>"), ("status", "String")))
    plan = matching.match(NARROW, WIDE, scan)
    stored = to_dataframe(WIDE, _read(spark, d))
    return to_dataframe(plan, lambda s: stored)


SLIM = ir.Project(ir.Filter(ORDERS, ir.Compare(">", C("o_totalprice"), L(20000))), (("k", C("o_orderkey")), ("c", C("o_custkey"))))
FULL = ir.Aggregate(ir.Filter(JOINED, ir.Compare(">", C("o_totalprice"), L(60000))), ("c_mktsegment", "o_orderpriority"), (("n", "count", None), ("top", "max", "o_totalprice")))


@query("view_rewrite_join_back", to_sql(FULL, "duckdb"))
def rewrite_join_back(spark, d):
    """Hidden columns come back over the unique order key, and the missing relation over its join."""
    scan = ir.Scan("lake", "slim", (("k", "Integer"), ("c", "Integer")))
    tree = matching.FilterTree()
    tree.register("slim", SLIM, scan, seal="s1")
    assert tree.rewrite(FULL, keys={"orders": "o_orderkey"}, seal="s2") is None
    name, plan = tree.rewrite(FULL, keys={"orders": "o_orderkey"}, seal="s1")
    stored = to_dataframe(SLIM, _read(spark, d))
    return to_dataframe(plan, lambda s: stored if s.relation == "slim" else table(spark, d, s.relation))


@query("view_matching_verdicts", "select * from (values ('coarse','mv_orders',''), ('narrow','','no candidate'), ('unfiltered','','the view lacks rows of the query')) t(query, answered_by, reason)")
def matching_verdicts(spark, d):
    tree = matching.FilterTree()
    tree.register("mv_orders", STORED, STORED_SCAN)
    rows = []
    unfiltered = ir.Aggregate(JOINED, ("c_mktsegment",), (("n", "count", None),))
    for name, q in (("coarse", COARSE), ("narrow", ir.Project(SUPPLIER, (("s_suppkey", C("s_suppkey")),))), ("unfiltered", unfiltered)):
        got, why = tree.rewrite(q), ""
        if got is None:
            names = tree.candidates(q)
            why = "no candidate"
            for n in names:
                try:
                    matching.match(q, *tree.views[n])
                except matching.NotMatched as e:
                    why = str(e)
        rows.append((name, got[0] if got else "", why))
    return spark.createDataFrame(rows, "query string, answered_by string, reason string")


SEGMENTED = ir.Project(ir.Filter(JOINED, ir.Compare(">", C("o_totalprice"), L(1000))), (("k", C("o_orderkey")), ("price", C("o_totalprice")), ("segment", C("c_mktsegment"))))
DEAR = ir.Project(ir.Filter(ORDERS, ir.Compare(">", C("o_totalprice"), L(50000))), (("k", C("o_orderkey")), ("price", C("o_totalprice"))))


@query("view_rewrite_extra_join", to_sql(DEAR, "duckdb"))
def rewrite_extra_join(spark, d):
    """A view that joins one relation more answers the query, since each order has one customer."""
    scan = ir.Scan("lake", "mv_segmented", (("k", "Integer"), ("price", "Decimal<12,2>"), ("segment", "String")))
    plan = matching.match(DEAR, SEGMENTED, scan, frozenset({matching.Guarantee("orders.o_custkey", "customer.c_custkey")}))
    stored = to_dataframe(SEGMENTED, _read(spark, d))
    return to_dataframe(plan, lambda s: stored)


_GROUPED = ir.Aggregate(ir.Filter(JOINED, ir.And((ir.Compare(">", C("o_totalprice"), L(1000)), ir.In(C("o_orderstatus"), (L("F"), L("O")))))), ("c_mktsegment", "o_orderstatus"), (("n", "count", None), ("hi", "max", "o_totalprice")))


@query("plan_read_back", to_sql(_GROUPED, "duckdb"))
def read_back(spark, d):
    """A plan written as JSON, read again and run; another spelling of it has the same digest."""
    import json

    plan = ir.from_json(json.loads(json.dumps(ir.to_json(_GROUPED))))
    other = ir.Aggregate(ir.Filter(JOINED, ir.And((ir.In(C("o_orderstatus"), (L("O"), L("F"))), ir.Compare("<", L(1000), C("o_totalprice"))))), ("o_orderstatus", "c_mktsegment"), (("hi", "max", "o_totalprice"), ("n", "count", None)))
    if plan != _GROUPED or ir.digest(plan) != ir.digest(other):
        raise AssertionError("the plan did not come back")
    return to_dataframe(plan, _read(spark, d))


@query("schema_resolved", "select column_name as col, case when column_type like 'DECIMAL%' then 'decimal' when column_type = 'BIGINT' then 'bigint' else 'string' end as kind from (describe " + to_sql(_GROUPED, "duckdb") + ")")
def schema_resolved(spark, d):
    """The types that the resolver gives a plan are those of its rows."""
    from .. import types as ty
    from ..plans.schema import schema_of

    told = {n: ty.to_spark(f.type).typeName() for n, f in schema_of(_GROUPED).items()}
    rows = {f.name: f.dataType.typeName() for f in to_dataframe(_GROUPED, _read(spark, d)).schema.fields}
    if told != rows:
        raise AssertionError(f"{told} is not {rows}")
    return spark.createDataFrame([(n, {"long": "bigint"}.get(t, t)) for n, t in told.items()], "col string, kind string")


# -- analyses -------------------------------------------------------------------------------------


@query(
    "lineage_edges",
    """select * from (values
    ('c_mktsegment','files','customer','c_custkey','INDIRECT','JOIN'), ('c_mktsegment','files','customer','c_mktsegment','DIRECT','IDENTITY'), ('c_mktsegment','files','customer','c_mktsegment','INDIRECT','GROUP_BY'),
    ('c_mktsegment','files','orders','o_custkey','INDIRECT','JOIN'), ('c_mktsegment','files','customer','c_custkey','INDIRECT','GROUP_BY'), ('c_mktsegment','files','orders','o_custkey','INDIRECT','GROUP_BY'),
    ('total','files','customer','c_mktsegment','INDIRECT','GROUP_BY'), ('total','files','customer','c_custkey','INDIRECT','GROUP_BY'), ('total','files','customer','c_custkey','INDIRECT','JOIN'),
    ('total','files','orders','o_custkey','INDIRECT','GROUP_BY'), ('total','files','orders','o_custkey','INDIRECT','JOIN'), ('total','files','orders','o_totalprice','DIRECT','AGGREGATION')
    ) t(output, datasource, relation, root_column, family, subtype)""",
)
def lineage(spark, d):
    plan = ir.Aggregate(JOINED, ("c_mktsegment",), (("total", "sum", "o_totalprice"),))
    return spark.createDataFrame(views.lineage_rows(plan), "output string, datasource string, relation string, root_column string, family string, subtype string")


@query("label_flow_leaks", "select * from (values ('n','confidentiality','secret','public','files.customer.c_mktsegment','GROUP_BY')) t(output, dimension, found, allowed, root, influence)")
def flow(spark, d):
    lattice = views.Lattice(("public", "internal", "secret"), ("raw", "checked"))
    plan = ir.Aggregate(CUSTOMER, ("c_mktsegment",), (("n", "count", None),))
    roots = {views.Root("files", "customer", c): views.Labels("secret" if c == "c_mktsegment" else "public", "checked") for c, _ in CUSTOMER.columns}
    _, leaks = views.check_flow(plan, roots, {"n": views.Labels("public", "raw")}, lattice)
    rows = [(x.column, x.dimension, x.found, x.allowed, f"{x.root.datasource}.{x.root.relation}.{x.root.column}", x.influence) for x in leaks]
    return spark.createDataFrame(rows, "output string, dimension string, found string, allowed string, root string, influence string")


@query("pushdown_report", "select * from (values ('files.orders','(`o_totalprice` > 1000)',''), ('files.customer','','no null test')) t(relation, pushed, refusals)")
def pushdown_report(spark, d):
    caps = pushdown.Capabilities(comparators=frozenset({"=", ">"}))
    plan = ir.Filter(JOINED, ir.And((ir.Compare(">", C("o_totalprice"), L(1000)), ir.IsNull(C("c_mktsegment")))))
    rows = [(r, p, w) for r, _, p, w in pushdown.report(plan, {"files": caps})]
    return spark.createDataFrame(rows, "relation string, pushed string, refusals string")


@query("pushdown_residual", to_sql(ir.Filter(JOINED, ir.Compare(">", C("o_totalprice"), L(150000))), "duckdb"))
def residual(spark, d):
    """Requests evaluated at the sources and the residual above them give the plan's rows."""
    plan = ir.Filter(JOINED, ir.Compare(">", C("o_totalprice"), L(150000)))
    split = pushdown.split(plan, {"files": pushdown.Capabilities(comparators=frozenset({">"}))})
    from ..plans.compile import column

    wanted = {r.relation: r.predicate for r in split.requests}

    def read(scan):
        df = table(spark, d, scan.relation).select(*[F.col(n).cast("decimal(12,2)").alias(n) if t.startswith("Dec") else F.col(n) for n, t in scan.columns])
        return df.filter(column(wanted[scan.relation])) if wanted[scan.relation] else df

    return to_dataframe(split.residual, read)


@query("refresh_modes", "select * from (values ('alg_group',false,'avg mean is not maintained'), ('alg_join_inner',true,'join left,join right'), ('alg_join_left',false,'no delta rule for a left join'), ('alg_limit',false,'a limit depends on all rows'), ('alg_distinct',true,'distinct'), ('alg_union',true,'')) t(plan, incremental, detail)")
def refresh_modes(spark, d):
    rows = []
    for name in ("alg_group", "alg_join_inner", "alg_join_left", "alg_limit", "alg_distinct", "alg_union"):
        m = refresh.analyze(PLANS[name])
        rows.append((name, m.incremental, ",".join(m.state) if m.incremental else "; ".join(m.reasons)))
    return spark.createDataFrame(rows, "plan string, incremental boolean, detail string")


@query("refresh_decisions", "select * from (values ('threshold 40 of 1000',true), ('threshold 50 of 1000',false), ('coefficients 300',true), ('coefficients 400',false), ('work 1000',true), ('work 4000',false), ('empty base',true)) t(policy, incremental)")
def refresh_decisions(spark, d):
    p, m = PLANS["alg_join_inner"], refresh.Measure
    cases = [
        ("threshold 40 of 1000", m(1000, 40), refresh.Threshold()), ("threshold 50 of 1000", m(1000, 50), refresh.Threshold()), ("coefficients 300", m(1000, 300), refresh.Coefficients()),
        ("coefficients 400", m(1000, 400), refresh.Coefficients()), ("work 1000", m(1000, 1, 1000), refresh.CountedWork(3)), ("work 4000", m(1000, 1, 4000), refresh.CountedWork(3)), ("empty base", m(0, 9), refresh.Threshold()),
    ]
    return spark.createDataFrame([(n, refresh.decide(p, x, policy).incremental) for n, x, policy in cases], "policy string, incremental boolean")


# -- deltas ---------------------------------------------------------------------------------------

KEPT = ir.Aggregate(JOINED, ("c_mktsegment",), (("n", "count", None), ("total", "sum", "o_totalprice"), ("hi", "max", "o_totalprice")))


def _loaded(spark, d, plan=KEPT):
    """A circuit that has seen all orders with odd keys, then the rest, then the loss of status P."""
    circuit = Circuit(spark, plan)
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    leaf_o, leaf_c = ("files", "orders"), ("files", "customer")
    out = circuit.step({leaf_o: as_delta(o.filter("o_orderkey % 2 = 1")), leaf_c: as_delta(c)})
    for delta in (as_delta(o.filter("o_orderkey % 2 = 0")), as_delta(o.filter("o_orderstatus = 'P'"), -1)):
        out = consolidate(out.unionByName(circuit.step({leaf_o: delta})))
    return out


@query("delta_equals_recompute", "select c_mktsegment, count(*) as n, cast(sum(cast(o_totalprice as decimal(12,2))) as decimal(38,2)) as total, max(cast(o_totalprice as decimal(12,2))) as hi from orders join customer on o_custkey = c_custkey where o_orderstatus <> 'P' group by 1")
def delta_aggregate(spark, d):
    return rows_of(_loaded(spark, d))


@query("delta_distinct", "select distinct o_orderpriority, cast(c_nationkey as bigint) as c_nationkey from orders join customer on o_custkey = c_custkey where o_orderstatus <> 'P'")
def delta_distinct(spark, d):
    plan = ir.Distinct(ir.Project(JOINED, (("o_orderpriority", C("o_orderpriority")), ("c_nationkey", C("c_nationkey")))))
    return rows_of(_loaded(spark, d, plan))


@query("delta_weights", "select o_orderstatus, -count(*) as weight from orders where o_orderstatus = 'P' group by 1 union all select o_orderstatus, count(*) from orders where o_orderstatus = 'F' group by 1")
def delta_weights(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus")
    delta = as_delta(o).unionByName(as_delta(o.filter("o_orderstatus = 'O'"), -1)).unionByName(as_delta(o.filter("o_orderstatus = 'P'"), -2))
    return consolidate(delta).withColumnRenamed(WEIGHT, "weight")


@query(
    "delta_from_upserts",
    """select 'old' as side, c_custkey, c_mktsegment, -1 as w from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')
    union all select 'new', c_custkey, c_mktsegment || '!', 1 from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F') and c_acctbal >= 0""",
)
def upserts(spark, d):
    """A change log of the customers with a filled order; those in debt are deleted in it."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    logged = table(spark, d, "customer").join(table(spark, d, "orders").filter("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    changes = logged.select("c_custkey", F.concat("c_mktsegment", F.lit("!")).alias("c_mktsegment"), F.lit(2).alias("seq"), (F.col("c_acctbal") < 0).alias("gone"))
    older = logged.select("c_custkey", F.lit("stale").alias("c_mktsegment"), F.lit(1).alias("seq"), F.lit(False).alias("gone"))
    delta = from_upserts(changes.unionByName(older), c, ["c_custkey"], "seq", "gone")
    return delta.select(F.when(F.col(WEIGHT) < 0, "old").otherwise("new").alias("side"), "c_custkey", "c_mktsegment", F.col(WEIGHT).cast("int").alias("w"))


@query("state_store_protocol", "select * from (values (1,'miss'), (2,'filling'), (3,'buffered'), (4,'filled'), (5,'hit 3'), (6,'stale'), (7,'applied'), (8,'absent'), (9,'refused')) t(step, outcome)")
def state_protocol(spark, d):
    s = StateStore("r1", 2)
    seen = [s.read(("a",))[0], s.read(("a",))[0], s.delta(("a",), {("x",): 1}, 6)]
    s.fill(("a",), {("x",): 2}, 5, "r1")
    seen += ["filled", f"hit {s.read(('a',))[1][('x',)]}", s.delta(("a",), {("x",): 1}, 6), s.delta(("a",), {("x",): -3}, 7), s.delta(("b",), {("y",): 1}, 9)]
    try:
        s.fill(("c",), {}, 1, "r1")
        seen.append("filled")
    except ValueError:
        seen.append("refused")
    return spark.createDataFrame(list(enumerate(seen, 1)), "step int, outcome string")


# -- SQL texts ------------------------------------------------------------------------------------

_TEXT = "select c_mktsegment, sum(o_totalprice) as spent from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F' group by c_mktsegment"


@query(
    "sql_lineage",
    """select * from (values ('c_mktsegment','customer','c_mktsegment','direct'), ('spent','orders','o_totalprice','derived'), ('c_mktsegment','orders','o_custkey','indirect'), ('spent','orders','o_custkey','indirect'),
    ('c_mktsegment','customer','c_custkey','indirect'), ('spent','customer','c_custkey','indirect'), ('c_mktsegment','orders','o_orderstatus','indirect'), ('spent','orders','o_orderstatus','indirect'),
    ('spent','customer','c_mktsegment','indirect'), ('c_mktsegment','customer','c_mktsegment','indirect')) t(output, relation, root_column, kind)""",
)
def sql_lineage(spark, d):
    from ..plans.sqlscan import analyze

    a = analyze(spark, _TEXT, {n: table(spark, d, n).schema for n in ("orders", "customer")})
    return spark.createDataFrame([(o.name, r.relation, r.column, r.kind) for o in a.outputs for r in o.references], "output string, relation string, root_column string, kind string")


@query("sql_federation_split", "select * from (values ('customer','c_custkey,c_mktsegment',''), ('orders','o_custkey,o_orderstatus,o_totalprice','EqualTo(o_orderstatus,F)')) t(relation, columns, filters)")
def sql_federation(spark, d):
    from ..plans.sqlscan import federate

    parts = federate(spark, _TEXT, {n: table(spark, d, n).schema for n in ("orders", "customer")})
    own = lambda fs: ",".join(f for f in fs if not f.startswith("IsNotNull"))
    return spark.createDataFrame([(p.relation, ",".join(p.columns), own(p.filters)) for p in parts], "relation string, columns string, filters string")


@query("delta_counted_work", "select * from (values ('linear',0), ('group',20)) t(plan, work)")
def counted_work(spark, d):
    """Rows that a one-row step looks at: nothing kept for a filter; the row and its group for a count."""
    a = ir.Scan("s", "a", (("k", "Integer"), ("v", "Integer")))
    out = []
    for name, plan in (("linear", ir.Filter(a, ir.Compare(">", C("v"), L(1)))), ("group", ir.Aggregate(a, ("k",), (("n", "count", None),)))):
        c = Circuit(spark, plan, count_work=True)
        c.step({("s", "a"): as_delta(spark.range(450).selectExpr("id % 50 as k", "id as v"))})
        before = c.work
        c.step({("s", "a"): as_delta(spark.createDataFrame([(7, -1)], "k long, v long"))})
        out.append((name, c.work - before))
    return spark.createDataFrame(out, "plan string, work int")
