"""The SQL surface over snapshot datasets: each query runs a short script in a lake of its own and
returns what it leaves."""

from __future__ import annotations

import uuid

from ..catalog.engine import Engine
from ..operators.delta import own_folder
from ..session import table
from . import query


def _lake(spark, d, *tables) -> Engine:
    """A fresh lake with the named tables as datasets of database sales."""
    e = Engine(spark, f"{own_folder(spark)}/lake-{uuid.uuid4().hex}", "sales")
    for name in tables:
        table(spark, d, name).createOrReplaceTempView(f"src_{name}")
        e.execute(f"create dataset {name} as select * from src_{name}")
    return e


@query("sql_create_insert", "select n_nationkey as id, n_name as name from nation union all values (100, 'X'), (101, null)")
def create_insert(spark, d):
    e = _lake(spark, d, "nation")
    e.execute("create dataset t (id int not null, name string)")
    e.execute("insert into t select n_nationkey, n_name from nation")
    e.execute("insert into t values (100, 'X')")
    e.execute("insert into t (id) values (101)")
    return e.query("select id, name from t")


@query("sql_insert_overwrite_truncate", "select n_nationkey as id from nation where n_nationkey > 20")
def overwrite(spark, d):
    e = _lake(spark, d, "nation")
    e.execute("create dataset t as select n_nationkey as id from nation")
    e.execute("truncate t")
    e.execute("insert into t values (1), (2)")
    e.execute("insert overwrite t select n_nationkey from nation where n_nationkey > 20")
    return e.query("select id from t")


@query("sql_delete", "select o_orderkey from orders where not coalesce(o_totalprice > 100000 and o_orderstatus <> 'F', false)")
def delete(spark, d):
    e = _lake(spark, d, "orders")
    e.execute("delete from orders where o_totalprice > 100000 and o_orderstatus <> 'F'")
    return e.query("select o_orderkey from orders")


@query("sql_update", "select s_suppkey, case when s_acctbal < 0 then 0.0 else s_acctbal end as s_acctbal from supplier")
def update(spark, d):
    e = _lake(spark, d, "supplier")
    e.execute("update supplier set s_acctbal = 0, s_name = s_name where s_acctbal < 0")
    return e.query("select s_suppkey, s_acctbal from supplier")


@query(
    "sql_merge",
    """select c_custkey, case when c_custkey % 10 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal from customer where c_custkey % 10 <> 5
    union all select c_custkey + 1000000, c_acctbal from customer where c_custkey % 100 = 7""",
)
def merge(spark, d):
    e = _lake(spark, d, "customer")
    e.execute("create dataset changes as select c_custkey, c_acctbal + 1 as c_acctbal, 'u' as op from customer where c_custkey % 10 = 0 union all select c_custkey, c_acctbal, 'd' from customer where c_custkey % 10 = 5 union all select c_custkey + 1000000, c_acctbal, 'i' from customer where c_custkey % 100 = 7")
    e.execute(
        """merge into customer t using changes s on t.c_custkey = s.c_custkey
        when matched and s.op = 'd' then delete
        when matched then update set c_acctbal = s.c_acctbal
        when not matched and s.op = 'i' then insert (c_custkey, c_acctbal) values (s.c_custkey, s.c_acctbal)"""
    )
    return e.query("select c_custkey, c_acctbal from customer")


@query("sql_merge_by_source", "select n_nationkey, case when n_nationkey < 5 then 'kept' else n_name end as n_name from nation where n_nationkey < 5 or n_nationkey >= 20")
def merge_by_source(spark, d):
    e = _lake(spark, d, "nation")
    e.execute("create dataset s as select n_nationkey from nation where n_nationkey < 5")
    e.execute("merge into nation t using s on t.n_nationkey = s.n_nationkey when matched then update set n_name = 'kept' when not matched by source and t.n_nationkey < 20 then delete")
    return e.query("select n_nationkey, n_name from nation")


@query("sql_time_travel", "select 'first' as at, count(*) as n from region union all select 'now', count(*) - 2 from region union all select 'branch', count(*) from region")
def time_travel(spark, d):
    e = _lake(spark, d, "region")
    e.dataset("region").make_branch("audit")
    e.execute("delete from region where r_regionkey < 2")
    return e.query("select 'first' as at, count(*) as n from at('sales.default.region', snapshot => 1) union all select 'now', count(*) from region union all select 'branch', count(*) from at('sales.default.region', rama => 'audit')")


@query("sql_views", "select n_regionkey as region, count(*) as n from nation where n_nationkey > 3 group by 1")
def views(spark, d):
    e = _lake(spark, d, "nation")
    e.execute("create view some as select * from nation where n_nationkey > 3")
    e.execute("create or replace view counted (region, n) comment 'by region' as select n_regionkey, count(*) from some group by 1")
    return e.query("select region, n from counted")


@query("sql_idempotent_key", "select count(*) * 2 as n from region")
def idempotent(spark, d):
    e = _lake(spark, d, "region")
    for _ in range(3):
        e.execute("insert into region select * from src_region", key="load-1")
    return e.query("select count(*) as n from region")


@query("sql_information_schema", "select * from (values ('sales','default','nation','DATASET'), ('sales','default','v','VIEW'), ('sales','eu','photos','MEDIA COLLECTION')) t(table_catalog, table_schema, table_name, table_type)")
def information(spark, d):
    e = _lake(spark, d, "nation")
    e.execute("create view v as select n_name from nation")
    e.execute("create schema eu")
    e.execute("create media collection eu.photos media image formats ('jpeg', 'png')")
    return e.query("select * from information_schema.tables")


@query("sql_refusals", "select * from (values ('two statements'), ('settings'), ('copy'), ('read by function'), ('write a view'), ('drop kind'), ('null in not null'), ('double match')) t(refused)")
def refusals(spark, d):
    e = _lake(spark, d, "region")
    e.execute("create view v as select * from region")
    e.execute("create dataset strict (id int not null)")
    e.execute("create dataset twice as select 1 as r_regionkey union all select 1")
    cases = {
        "two statements": "select 1; select 2", "settings": "set x = 1", "copy": "copy region to 'x'", "read by function": "select * from read_csv('x')", "write a view": "insert into v select * from region",
        "drop kind": "drop dataset v", "null in not null": "insert into strict values (null)", "double match": "merge into region t using twice s on t.r_regionkey = s.r_regionkey when matched then delete",
    }
    refused = []
    for name, sql in cases.items():
        try:
            e.execute(sql)
        except Exception:
            refused.append((name,))
    return spark.createDataFrame(refused, "refused string")


@query("sql_scalar_function", "select n_nationkey, cast(n_nationkey * 2 as bigint) as twice from nation")
def scalar_function(spark, d):
    from .. import types as ty
    from ..functions.contract import Parameter, scalar

    e = _lake(spark, d, "nation")
    e.register("twice", scalar(lambda x: 2 * x, [Parameter("x", ty.parse("Integer"))], ty.parse("Integer"), True))
    return e.query("select n_nationkey, functions.twice(n_nationkey) as twice from nation")


@query("sql_table_function", "select n_nationkey, unnest(range(n_regionkey)) as value from nation")
def table_function(spark, d):
    from .. import types as ty
    from ..functions.contract import Parameter, register_table

    register_table(spark, "upto", lambda n: list(range(n)), [Parameter("n", ty.parse("Integer"))], ty.parse("list<Integer>"))
    table(spark, d, "nation").createOrReplaceTempView("nation_tf")
    return spark.sql("select n_nationkey, u.value from nation_tf, lateral upto(cast(n_regionkey as bigint)) u")


@query("sql_materialized_view", "select 'stale' as at, count(*) as n from nation where n_nationkey < 20 union all select 'fresh', count(*) from nation where n_nationkey < 10")
def materialized_view(spark, d):
    """Stored rows stay as they are until the view is refreshed."""
    e = _lake(spark, d, "nation")
    e.execute("create materialized view some as select n_nationkey from nation where n_nationkey < 20")
    e.execute("delete from nation where n_nationkey >= 10")
    stale = e.query("select 'stale' as at, count(*) as n from some")
    e.execute("refresh materialized view some")
    return stale.unionAll(e.query("select 'fresh' as at, count(*) as n from some"))


@query("sql_null_order", "select k, row_number() over () as place from (select n_nationkey as k, case when n_regionkey = 2 then null else n_regionkey end as r from nation order by r desc nulls first, k) t")
def null_order(spark, d):
    e = _lake(spark, d, "nation")
    return e.query("select k, cast(row_number() over (order by r desc, k) as bigint) as place from (select n_nationkey as k, case when n_regionkey = 2 then null else n_regionkey end as r from nation) t")


@query("sql_changes_feed", "select n_nationkey, -1 as weight from nation where n_nationkey < 3 union all select 100, 1")
def changes_feed(spark, d):
    """What came and went between two snapshots."""
    e = _lake(spark, d, "nation")
    since = e.dataset("nation").head().id
    e.execute("delete from nation where n_nationkey < 3")
    e.execute("insert into nation (n_nationkey) values (100)")
    got = e.dataset("nation").changes(since)
    return got.selectExpr("n_nationkey", "cast(__weight as int) as weight")


@query("sql_databases_and_drops", "select n_nationkey as id, n_name as name, r_name from nation join region on n_regionkey = r_regionkey")
def databases_and_drops(spark, d):
    """Names of three parts over two databases; what was dropped can be made anew."""
    e = _lake(spark, d, "nation", "region")
    for text in (
        "create database geo", "create schema geo.world", "create dataset geo.world.lands as select 1 as x", "drop dataset geo.world.lands",
        "create dataset geo.world.lands as select n_nationkey as id, n_name as name, n_regionkey as region from nation", "drop dataset if exists none", "drop dataset nation",
    ):
        e.execute(text)
    return e.query("select l.id, l.name, r.r_name from geo.world.lands l join sales.default.region r on l.region = r.r_regionkey")


@query("sql_time_types", "select o_orderkey, cast(o_orderdate as timestamp) as at, cast(o_orderdate as date) as day, cast(extract(year from o_orderdate) as integer) as y, cast(o_orderdate as date) + interval 3 month as later from orders")
def time_types(spark, d):
    e = _lake(spark, d, "orders")
    e.execute("create dataset t (k bigint not null, at timestamp, day date)")
    e.execute("insert into t select o_orderkey, cast(o_orderdate as timestamp_ntz), cast(o_orderdate as date) from orders")
    return e.query("select k as o_orderkey, at, day, extract(year from at) as y, cast(day + interval 3 month as timestamp_ntz) as later from t")


@query("sql_now_is_fixed", "select count(*) as n, true as same from orders")
def now_is_fixed(spark, d):
    """All rows of a statement see one instant."""
    e = _lake(spark, d, "orders")
    return e.query("select count(*) as n, min(t) = max(t) as same from (select now() as t from orders) q")


@query("sql_whole_division", "select o_orderkey, o_orderkey // 7 as q, o_orderkey % 7 as r, o_orderkey / 2 as half from orders")
def whole_division(spark, d):
    """Division by zero is an error; between whole numbers div is whole and / is not."""
    e = _lake(spark, d, "orders")
    try:
        e.query("select 1 div (o_orderkey - o_orderkey) as x from orders").collect()
    except Exception as problem:
        if "DIVIDE_BY_ZERO" not in str(problem):
            raise
    else:
        raise AssertionError("division by zero gave a value")
    return e.query("select o_orderkey, o_orderkey div 7 as q, o_orderkey % 7 as r, o_orderkey / 2 as half from orders")
