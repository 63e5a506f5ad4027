"""Executed operators on small frames: deltas, joins, geometry, contracts, files, promises, streams."""

import datetime as dt
import math
import random
import time
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone import types as ty
from marlstone.functions import contract, geo
from marlstone.operators import delta as dl
from marlstone.operators import joins
from marlstone.operators.derive import Undeclared, transform
from marlstone.plans import ir
from marlstone.plans.compile import to_dataframe, to_sql
from marlstone.quality import promises as pr
from marlstone.sources import files
from marlstone.sources import request as rq
from marlstone.types import Field

C, L = ir.Col, ir.Lit.of
A = ir.Scan("s", "a", (("k", "Integer"), ("v", "Integer")))
B = ir.Scan("s", "b", (("j", "Integer"), ("w", "String")))
AB = ir.Join(A, B, (("k", "j"),))
PLANS = [
    ir.Filter(A, ir.Compare(">", C("v"), L(3))),
    AB,
    ir.Aggregate(AB, ("w",), (("n", "count", None), ("s", "sum", "v"), ("lo", "min", "v"), ("hi", "max", "v"))),
    ir.Aggregate(A, (), (("n", "count", None),)),
    ir.Distinct(ir.Project(AB, (("w", C("w")),))),
    ir.Union((ir.Project(A, (("x", C("v")),)), ir.Project(B, (("x", C("j")),)))),
]


@pytest.mark.parametrize("plan", PLANS, ids=range(len(PLANS)))
def test_deltas_add_up_to_a_recomputation(spark, plan):
    rng = random.Random(7)
    circuit, rows, out = dl.Circuit(spark, plan), {"a": [], "b": []}, None
    for _ in range(3):
        deltas = {}
        for name, schema in (("a", "k long, v long"), ("b", "j long, w string")):
            gone = rng.sample(rows[name], min(2, len(rows[name])))
            new = [(rng.choice([1, 2, 3, None]), rng.randrange(6) if name == "a" else rng.choice(["x", "y", None])) for _ in range(4)]
            for g in gone:
                rows[name].remove(g)
            rows[name] += new
            deltas[("s", name)] = dl.as_delta(spark.createDataFrame(new, schema)).unionByName(dl.as_delta(spark.createDataFrame(gone, schema), -1))
        step = circuit.step(deltas)
        out = step if out is None else dl.consolidate(out.unionByName(step))
    frames = {"a": spark.createDataFrame(rows["a"], "k long, v long"), "b": spark.createDataFrame(rows["b"], "j long, w string")}
    want = to_dataframe(plan, lambda s: frames[s.relation])
    got = dl.rows_of(out).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    for n, f in frames.items():
        f.createOrReplaceTempView(n)
    assert sorted(map(str, spark.sql(to_sql(plan)).collect())) == sorted(map(str, want.collect()))


def test_circuit_refuses_what_it_cannot_keep(spark):
    with pytest.raises(ValueError, match="limit"):
        dl.Circuit(spark, ir.Limit(A, 3))


def test_null_semantics(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (3, 4)], "k long, v long")
    run = lambda e: [tuple(r) for r in to_dataframe(ir.Project(A, (("r", e),)), lambda s: df).collect()]
    assert run(ir.In(C("k"), (L(1), L(2)))) == [(True,), (None,), (False,)]
    assert run(ir.Or((ir.IsNull(C("v")), ir.Compare("=", C("k"), L(3))))) == [(True,), (None,), (True,)]
    assert run(ir.In(C("k"), ())) == [(False,)] * 3
    agg = ir.Aggregate(A, ("k",), (("n", "count", "v"), ("s", "sum", "v"), ("m", "avg", "v")))
    got = {r["k"]: (r["n"], r["s"], r["m"]) for r in to_dataframe(agg, lambda s: df).collect()}
    assert got[1] == (1, None, None) and got[3] == (1, 4, Decimal("4.000000000"))


def test_asof_ties_nulls_and_bounds(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), (None, 9), ("b", 3)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 10), ("a", 5, 20), ("a", 5, 30), (None, 1, 40), ("b", 4, 50)], "k string, u int, x int")
    got = {(r["k"], r["t"]): r["x"] for r in joins.asof_join(left, right, ["k"], "t", "u", ["x"], "x").collect()}
    assert got == {("a", 5): 30, ("a", 1): 10, (None, 9): None, ("b", 3): None}
    strict = {(r["k"], r["t"]): r["x"] for r in joins.asof_join(left, right, ["k"], "t", "u", ["x"], "x", inclusive=False).collect()}
    assert strict[("a", 5)] == 10 and strict[("a", 1)] is None


def test_asof_in_buckets_is_the_same(spark):
    rng = random.Random(4)
    left = spark.createDataFrame([(rng.choice("aab"), rng.randrange(100), i) for i in range(200)], "k string, t int, i int")
    right = spark.createDataFrame([(rng.choice("aac"), rng.randrange(100), i) for i in range(80)], "k string, u int, x int")
    for inclusive in (True, False):
        one, many = (sorted(map(str, joins.asof_join(left, right, ["k"], "t", "u", ["x"], "x", inclusive, n).collect())) for n in (1, 7))
        assert one == many
    none = joins.asof_join(left, right.limit(0), ["k"], "t", "u", ["x"], "x", buckets=5)
    assert none.count() == 200 and none.filter("x is not null").isEmpty()


def test_range_join_meets_each_pair_once(spark):
    rng = random.Random(1)
    points = [(i, rng.uniform(0, 20)) for i in range(60)]
    spans = [(i, a := rng.uniform(0, 20), a + rng.uniform(-1, 6)) for i in range(30)]
    got = joins.range_join(spark.createDataFrame(points, "i int, p double"), spark.createDataFrame(spans, "s int, lo double, hi double"), "p", "lo", "hi", 2.0)
    assert sorted((r["i"], r["s"]) for r in got.collect()) == sorted((i, s) for i, p in points for s, lo, hi in spans if lo <= p < hi)


def test_range_counts_make_no_pairs(spark):
    rng = random.Random(2)
    points = [(i, rng.choice([0.5 * rng.randrange(40), rng.uniform(0, 20)])) for i in range(80)] + [(80, None), (81, float("nan")), (82, -0.0)]
    spans = [(a := 0.5 * rng.randrange(40), a + rng.choice([-1, 0, 0.5, 6])) for _ in range(90)] + [(None, 3.0), (3.0, None), (0.0, 1.0)]
    left, right = spark.createDataFrame(points, "i int, p double"), spark.createDataFrame(spans, "lo double, hi double")
    got = joins.range_counts(left, right, "p", "lo", "hi", "n")
    assert {r["i"]: r["n"] for r in got.collect()} == {i: sum(p is not None and None not in (lo, hi) and lo <= p < hi for lo, hi in spans) for i, p in points}
    alike = spark.range(200_000).select("id", F.lit(1.0).alias("p"))  # 4 * 10^10 pairs
    many = joins.range_counts(alike, alike.select(F.col("p").alias("lo"), (F.col("p") + 1).alias("hi")), "p", "lo", "hi", "n")
    assert many.agg(F.min("n"), F.max("n"), F.count("*")).first()[:] == (200_000, 200_000, 200_000)


def test_running_sum_over_several_slices(spark):
    rows = [(g, k, k * 7 % 5) for g in ("a", "b", None) for k in range(100)]
    got = joins.running_sum(spark.createDataFrame(rows, "g string, k long, n long"), ["g"], [F.col("k").asc()], "n", "upto", slice_rows=30)
    assert {(r["g"], r["k"]): r["upto"] for r in got.collect()} == {(g, k): sum(m for h, j, m in rows if h == g and j <= k) for g, k, _ in rows}


def test_small_is_proved(spark):
    assert "broadcast" in joins.small(spark.range(10))._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in joins.small(spark.range(100), rows=10)._jdf.queryExecution().analyzed().toString().lower()


# -- geometry -------------------------------------------------------------------------------------


@pytest.mark.parametrize("wkt", ["POINT (1 2)", "POINT Z (1 2 3)", "LINESTRING (0 0, 1 1.5)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))", "MULTIPOINT ((1 2), (3 4))", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))", "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))", "POINT EMPTY"])
def test_wkt_and_wkb_round_trip(wkt):
    g = geo.from_wkt(wkt)
    assert geo.to_wkt(geo.decode(geo.encode(g))) == wkt


def test_wkb_of_other_forms():
    import struct

    ewkb = struct.pack("<BIIdd", 1, 1 | 0x20000000, 4326, 1.0, 2.0)
    big = struct.pack(">BIdd", 0, 1, 1.0, 2.0)
    assert geo.normalize(ewkb) == geo.normalize(big) == struct.pack("<BIdd", 1, 1, 1.0, 2.0)
    for bad in (b"", b"\x02", ewkb[:-1], ewkb + b"x", struct.pack("<BI", 1, 99)):
        with pytest.raises(geo.GeoProblem):
            geo.decode(bad)


def test_measures_and_predicates():
    g = geo.from_wkt
    ring = g("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))")
    assert geo.area(ring) == 15.0
    assert geo.contains(ring, g("POINT (3 3)")) and not geo.contains(ring, g("POINT (1.5 1.5)")) and not geo.contains(ring, g("POINT (0 2)"))
    assert geo.intersects(ring, g("POINT (0 2)")) and not geo.intersects(ring, g("POINT (1.5 1.5)"))
    assert geo.distance(ring, g("POINT (7 8)")) == 5.0 and geo.distance(ring, g("POINT (1.5 1.5)")) == 0.5
    assert geo.intersects(g("LINESTRING (-1 2, 5 2)"), ring) and geo.distance(g("LINESTRING (0 9, 9 9)"), ring) == 5.0
    assert geo.intersection_area(ring, g("POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))")) == 4.0
    assert geo.intersection_area(ring, g("POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))")) == 3.0
    assert geo.contains(ring, g("POLYGON ((2.5 2.5, 3 2.5, 3 3, 2.5 2.5))"))


def test_hilbert_is_a_curve():
    n = 32
    x, y = np.meshgrid(np.arange(n), np.arange(n))
    d = geo.hilbert(x.ravel(), y.ravel(), 5)
    order = np.argsort(d)
    steps = np.abs(np.diff(x.ravel()[order])) + np.abs(np.diff(y.ravel()[order]))
    assert sorted(d) == list(range(n * n)) and (steps == 1).all()


def test_geojson(spark, tmp_path):
    (tmp_path / "f.geojson").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "id": 1, "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"a": 1}}, {"type": "Feature", "geometry": null, "properties": null}]}')
    got = files.read_geojson(spark, str(tmp_path / "f.geojson")).collect()
    assert geo.to_wkt(geo.decode(got[0]["geometry"])) == "POINT (1 2)" and got[1]["geometry"] is None and got[0]["properties"] == '{"a": 1}'


# -- contracts, files, requests -------------------------------------------------------------------


def test_checked_values():
    ok = lambda v, t: contract.checked(v, ty.parse(t), False, "x")
    assert ok(Decimal("12.30"), "Decimal<4,2>") == Decimal("12.30")
    assert ok({"a": 1}, "Struct<a: Integer>") == {"a": 1}
    for v, t in ((True, "Integer"), (1, "Float"), ("1", "Integer"), (Decimal("1.234"), "Decimal<4,2>"), (Decimal("123"), "Decimal<4,2>"), (2**63, "Integer"), ([1.0], "Vector<2>"), ({"b": 1}, "Struct<a: Integer>"), (None, "String")):
        with pytest.raises(contract.ContractProblem):
            ok(v, t)


def test_scalar_and_table_functions(spark):
    p = contract.Parameter
    f = contract.scalar(lambda a, b: f"{a}{b or ''}", [p("a", ty.parse("Integer")), p("b", ty.parse("String"), True)], ty.parse("String"))
    df = spark.createDataFrame([(1, "x"), (None, "y"), (3, None)], "a long, b string")
    assert [r[0] for r in df.select(f("a", "b")).collect()] == ["1x", None, "3"]
    bad = contract.scalar(lambda a: "no", [p("a", ty.parse("Integer"))], ty.parse("Integer"))
    with pytest.raises(Exception, match="no Integer"):
        df.select(bad("a")).collect()
    contract.register_table(spark, "parts", lambda s: [{"i": i, "c": c} for i, c in enumerate(s)], [p("s", ty.parse("String"))], ty.parse("list<Struct<i: Integer, c: String>>"))
    df.createOrReplaceTempView("tf_in")
    assert sorted(tuple(r) for r in spark.sql("select a, u.i, u.c from tf_in, lateral parts(concat(b, 'z')) u where a = 1").collect()) == [(1, 0, "x"), (1, 1, "z")]


def test_bad_value_stops_a_read_without_rescue(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2024-01-01\nz,2024-02-30\n")
    fields = [Field("a", ty.parse("Integer")), Field("b", ty.parse("Date"))]
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "x.csv"), fields).collect()
    got = files.read_csv(spark, str(tmp_path / "x.csv"), [*fields, Field(files.RESCUED, ty.parse("String"))]).collect()
    assert got[0] == (1, dt.date(2024, 1, 1), None) and got[1]["a"] is None and got[1][files.RESCUED] == '{"a":"z","b":"2024-02-30"}'


def test_filters_reach_the_files(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 as b", "cast(id as string) as c").write.parquet(f"{tmp_path}/t")
    r = rq.Request("t", (("x", "b"),), (rq.Where("id", "ge", 90), rq.Where("c", "isNotNull")))
    df = rq.run(r, spark.read.parquet(f"{tmp_path}/t"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,90)" in plan and df.count() == 10


@pytest.mark.parametrize("r", [rq.Request("t", (("x", "a"),), (rq.Where("a", "near", 1),)), rq.Request("t", ()), rq.Request("t", (("x", "a"),), (rq.Where("a", "in", 3),)), rq.Request("t", (("x", "a"),), (rq.Where("a", "eq"),)), rq.Request("t", (("x", "a"),), order_by=(("a", "asc"),))])
def test_requests_are_rejected_whole(r):
    with pytest.raises(rq.RequestProblem):
        rq.check(r, rq.Capabilities())


def test_request_text_edge_cases():
    r = rq.Request('a"b', (("x", 'c"d'),), (rq.Where("e", "in", []), rq.Where("f", "isNull")))
    assert rq.to_sql(r, "postgres") == ('SELECT "c""d" AS "x" FROM "a""b" WHERE FALSE AND "f" IS NULL', [])
    assert "1 = 0" in rq.to_sql(r, "oracle")[0]


def test_budget(spark):
    with pytest.raises(rq.RequestProblem):
        rq.within_budget(spark.range(11), rq.Budget(rows=10))
    assert rq.within_budget(spark.range(10), rq.Budget(rows=10)).count() == 10


def test_promises_on_edges(spark):
    df = spark.createDataFrame([(1, "1.0"), (2, "1"), (2, None), (None, "x")], "k long, v string")
    P = pr.Promise
    ps = [P("duplicateValues", "mustBe", (1,), ("k",)), P("invalidValues", "mustBe", (1,), ("v",), values=(1,)), P("nullValues", "mustBe", (25,), ("k",), unit="percent"), P("rowCountChange", "mustBeLessThan", (0,)), P("invalidValues", "mustBe", (0,), ("v",), pattern=r"[\d.x]+")]
    verdicts, publish = pr.judge(df, ps)
    assert [v.outcome for v in verdicts] == ["pass", "pass", "pass", "unknown", "pass", "pass"] and publish
    verdicts, publish = pr.judge(df.limit(0), [], {"rowCount": 5})
    assert verdicts[-1].outcome == "fail" and not publish
    for bad in (("nope", "mustBe", (1,)), ("rowCount", "mustBeBetween", (1,)), ("rowCount", "near", (1,))):
        with pytest.raises(ValueError):
            P(*bad)


def test_transform_declares_what_it_touches(spark):
    store = {"a": spark.range(3), "b": spark.range(2)}

    @transform(["a"], "out")
    def double(over):
        return over("a").select((F.col("id") * 2).alias("id"))

    @transform(["a"], "out")
    def sneaky(over):
        return over("b")

    done = double(store.__getitem__, store.__setitem__)
    assert done == {"function": "double", "read": ["a"], "written": ["out"]} and store["out"].count() == 3
    with pytest.raises(Undeclared):
        sneaky(store.__getitem__, store.__setitem__)


def test_writer_refuses(spark, tmp_path):
    for df in (spark.sql("select null as x"), spark.sql("select array(array(1)) as x")):
        with pytest.raises(ValueError):
            files.write_dataset(df, f"{tmp_path}/w")
    two = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    files.write_dataset(two.limit(1), f"{tmp_path}/w")
    with pytest.raises(ValueError, match="twice"):
        files.write_dataset(two, f"{tmp_path}/w", "upsert", ["k"])


# -- tiles, graphs, logs --------------------------------------------------------------------------


def _read_tile(data):
    """A small reader of tiles: name, extent, and (id, type, points or rings) of each feature."""

    def fields(b):
        at = 0

        def varint():
            nonlocal at
            n = shift = 0
            while True:
                n |= (b[at] & 0x7F) << shift
                shift += 7
                at += 1
                if not b[at - 1] & 0x80:
                    return n

        while at < len(b):
            tag = varint()
            if tag & 7 == 0:
                yield tag >> 3, varint()
            else:
                size = varint()
                yield tag >> 3, b[at : at + size]
                at += size

    (_, body), *_ = fields(data)
    out, name = [], None
    for k, v in fields(body):
        if k == 1:
            name = v.decode()
        if k == 2:
            f = dict(fields(v))
            values, at = [], 0
            raw = f[4]
            while at < len(raw):
                n = shift = 0
                while True:
                    n |= (raw[at] & 0x7F) << shift
                    shift += 7
                    at += 1
                    if not raw[at - 1] & 0x80:
                        break
                values.append(n)
            x = y = i = 0
            pts = []
            while i < len(values):
                command, count = values[i] & 7, values[i] >> 3
                i += 1
                if command == 7:
                    continue
                for _ in range(count):
                    dx, dy = ((v >> 1) ^ -(v & 1) for v in values[i : i + 2])
                    x, y, i = x + dx, y + dy, i + 2
                    pts.append((x, y))
            out.append((f[1], f[3], pts))
    return name, out


def test_tile_holds_what_is_inside(spark):
    from marlstone.operators import tiles

    rows = [(1, "POINT (0.0001 -0.0001)"), (2, "POINT (-90 40)"), (3, "LINESTRING (-10 -10, 10 -10)"), (4, "POLYGON ((1 -1, 20 -1, 20 -20, 1 -20, 1 -1))"), (5, "POINT EMPTY"), (6, None)]
    df = spark.createDataFrame(rows, "id long, w string").withColumn("g", geo.st_geomfromtext("w"))
    name, got = _read_tile(tiles.tile_bytes(df, "g", "id", "things", 1, 1, 1))
    by_id = {i: (k, pts) for i, k, pts in got}
    assert name == "things" and set(by_id) == {1, 3, 4}
    assert by_id[1] == (1, [(0, 0)]) and by_id[3][0] == 2 and by_id[3][1][0][0] == -64 and by_id[4][0] == 3 and len(by_id[4][1]) == 4
    assert tiles.tile_bytes(df.filter("id = 2"), "g", "id", "things", 1, 1, 1) == b""
    assert tiles.tile_bytes(df, "g", "id", "things", 1, 1, 1) == tiles.tile_bytes(df.repartition(3), "g", "id", "things", 1, 1, 1)


def test_tile_in_parts_is_the_whole_tile(spark, monkeypatch):
    from marlstone.operators import tiles

    points = spark.range(700).select("id", geo.st_point((F.col("id") % 90).cast("double"), (F.col("id") % 7).cast("double")).alias("g"))
    whole = tiles.tile_bytes(points, "g", "id", "things", 1, 1, 0)
    monkeypatch.setattr(tiles, "MOST_FEATURES", 100)  # the driver's bound isn't the parts'
    with pytest.raises(ValueError):
        tiles.tile_bytes(points, "g", "id", "things", 1, 1, 0)
    for df in (points, points.repartition(5)):
        parts = tiles.tile_parts(df, "g", "id", "things", 1, 1, 0, part_features=64).orderBy("part").collect()
        assert len(parts) == 13 and b"".join(bytes(r["bytes"]) for r in parts) == whole
    assert tiles.tile_parts(points.limit(0), "g", "id", "things", 1, 1, 0).isEmpty()


def test_tile_index_and_contract(spark):
    from marlstone.operators import tiles

    df = spark.range(500).select("id", geo.st_point((F.col("id") % 25) * 3.0 - 30, F.floor(F.col("id") / 25) * 2.0 - 20).alias("g"))
    ordered, cuts, total = tiles.tile_index(df, "g", "id", 4)
    assert total == sum(range(500)) and len(cuts) == 3
    for part in ordered.select("hilbert").rdd.glom().collect():
        assert [r[0] for r in part] == sorted(r[0] for r in part)
    assert tiles.geo_contract(df, "g") == ("Point", None)
    mixed = df.select("g").unionAll(spark.createDataFrame([("LINESTRING (0 0, 1 1)",)], "w string").select(geo.st_geomfromtext("w")))
    assert tiles.geo_contract(mixed, "g")[0] == "Any"
    with pytest.raises(ValueError):
        tiles.geo_contract(df, "g", (F.col("id") % 2).cast("int"))


def test_spatial_left_join_keeps_all(spark):
    from marlstone.operators import tiles

    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 9.0, 9.0), (3, 1.5, 0.5)], "id long, x double, y double").withColumn("g", geo.st_point("x", "y")).drop("x", "y")
    zones = spark.createDataFrame([("a", "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"), ("b", "POLYGON ((0 0, 2 0, 2 1, 0 1, 0 0))")], "zone string, w string").select("zone", geo.st_geomfromtext("w").alias("z"))
    got = tiles.spatial_left_join(pts, "id", "g", zones, "z", "within", 1.0).select("id", "right.zone").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "a"), (1, "b"), (2, None), (3, "b")]


def test_edges_and_reach(spark):
    from marlstone.operators import graph

    rows = spark.createDataFrame([(1, 2, 9), (2, 3, 9), (3, 1, 9), (4, None, 9), (5, 1, 9)], "id long, boss long, x long")
    e = graph.Entity("person", ("id",), (graph.Link("boss", ("boss",)), graph.Link("pair", ("boss", "x"))))
    got = graph.edges(e, rows)
    assert set(got) == {"boss"} and got["boss"].count() == 4
    assert graph.edges(graph.Entity("p", ("id", "x"), e.links), rows) == {}
    reached = graph.reach(spark.createDataFrame([(5,)], "node long"), got["boss"], 3)
    assert sorted(map(tuple, reached.collect())) == [(1, 1), (2, 2), (3, 3), (5, 0)]


def test_execution_log(spark, tmp_path):
    from marlstone.catalog.execlog import ExecutionLog

    log = ExecutionLog(spark, f"file://{tmp_path}/log")
    with log.record("ok", "ana") as e:
        e |= {"reads": ["a"], "rows": 3}
    with pytest.raises(ZeroDivisionError):
        with log.record("bad", "ana"):
            1 / 0
    got = {r["name"]: r for r in log.rows().collect()}
    assert got["ok"]["status"] == "ok" and got["ok"]["reads"] == ["a"] and got["bad"]["error"] == "division by zero"


def test_work_of_a_step_follows_the_delta(spark):
    base = spark.range(400).selectExpr("id % 50 as k", "id as v")
    c = dl.Circuit(spark, ir.Aggregate(A, ("k",), (("n", "count", None),)), count_work=True)
    c.step({("s", "a"): dl.as_delta(base)})
    loaded = c.work
    c.step({("s", "a"): dl.as_delta(spark.createDataFrame([(7, 1)], "k long, v long"))})
    assert c.work - loaded == 1 + 8 + 9


def test_upquery_fills_a_key(spark):
    from marlstone.operators.state_store import upquery

    df = spark.createDataFrame([(1, 5), (None, 6)], "k long, v long")
    run = lambda key: [r["v"] for r in to_dataframe(upquery(A, ("k",), key), lambda s: df).collect()]
    assert run((1,)) == [5] and run((None,)) == [6]


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    plan = ir.Aggregate(A, ("k",), (("n", "count", None), ("s", "sum", "v")))
    delta = lambda *rows: {("s", "a"): dl.as_delta(spark.createDataFrame(rows, "k long, v long"))}
    got = lambda df: sorted(tuple(r) for r in df.collect())
    c = dl.Circuit(spark, plan, folder=f"file://{tmp_path}/c")
    c.step(delta((1, 5), (2, 6)), batch=0)
    first = got(c.step(delta((1, 7)), batch=1))
    assert first == [(1, 1, 5, -1), (1, 2, 12, 1)]
    assert got(c.step(delta((1, 7)), batch=1)) == first  # the sink failed, and it comes again
    again = dl.Circuit(spark, plan, folder=f"file://{tmp_path}/c")  # a restart
    assert got(again.step(delta((1, 7)), batch=1)) == first
    assert got(again.step(delta((1, 1)), batch=2)) == [(1, 2, 12, -1), (1, 3, 13, 1)]
    with pytest.raises(ValueError, match="came after"):
        again.step(delta((1, 7)), batch=0)
    with pytest.raises(ValueError, match="another plan"):
        dl.Circuit(spark, ir.Distinct(A), folder=f"file://{tmp_path}/c")


def test_a_step_reads_only_touched_buckets_and_appends(spark, tmp_path):
    plan = ir.Aggregate(A, ("k",), (("n", "count", None),))
    c = dl.Circuit(spark, plan, folder=f"file://{tmp_path}/c")
    c.step({("s", "a"): dl.as_delta(spark.range(4000).selectExpr("id % 400 as k", "id as v"))})
    (loaded,) = c.state["0"]
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "c" / loaded).rglob("*.parquet")}
    one = {("s", "a"): dl.as_delta(spark.createDataFrame([(7, 1)], "k long, v long"))}
    c.step(one)
    assert c.state["0"][0] == loaded and len(c.state["0"]) == 2
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "c" / loaded).rglob("*.parquet")} == files
    assert len(list((tmp_path / "c" / c.state["0"][1]).rglob("*.parquet"))) == 1
    read = c._tables(c.state["0"], c._schema(A), [int(n.split("=")[1]) for n in c.store.names(c.state["0"][1]) if "=" in n])
    assert read.count() < 4000 / 8


def test_deltas_are_put_together_now_and_then(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dl, "COMPACT", 2)
    c = dl.Circuit(spark, ir.Aggregate(A, ("k",), (("n", "count", None),)), folder=f"file://{tmp_path}/c")
    total = None
    for i in range(6):
        out = c.step({("s", "a"): dl.as_delta(spark.createDataFrame([(1, i), (i, 0)], "k long, v long"))})
        total = out if total is None else dl.consolidate(total.unionByName(out))
        assert len(c.state["0"]) <= 2
    assert sorted(tuple(r) for r in dl.rows_of(total).collect()) == [(0, 1), (1, 7), (2, 1), (3, 1), (4, 1), (5, 1)]


def test_a_negative_weight_is_no_row(spark):
    df = spark.createDataFrame([(1, 2), (2, 0)], "k long, __weight long")
    assert [r["k"] for r in dl.rows_of(df).collect()] == [1, 1]
    with pytest.raises(Exception, match="weight -1"):
        dl.rows_of(spark.createDataFrame([(1, -1)], "k long, __weight long")).collect()


def test_a_stream_whose_sink_fails_is_applied_once(spark, tmp_path):
    from marlstone.streaming import streams

    spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "k string, v long").coalesce(1).write.parquet(f"{tmp_path}/in")
    scan = ir.Scan("s", "a", (("k", "String"), ("v", "Integer")))
    plan = ir.Aggregate(scan, ("k",), (("n", "count", None),))
    seen, fail = [], [True]

    def sink(delta, number):
        if fail.pop() if fail else False:
            raise RuntimeError("sink")
        seen.append((number, sorted(tuple(r) for r in delta.collect())))

    for _ in range(2):
        stream = spark.readStream.schema("k string, v long").parquet(f"{tmp_path}/in")
        q = streams.maintain(stream, dl.Circuit(spark, plan, folder=f"file://{tmp_path}/state"), ("s", "a"), sink, f"{tmp_path}/ck")
        try:
            q.awaitTermination()
        except Exception as e:
            assert "sink" in str(e)
    assert seen == [(0, [("x", 2, 1), ("y", 1, 1)])]


def test_overlap_of_concave_polygons_equals_counted_cells():
    """Polygons of unit cells, whose shared cells can be counted, and the same ones turned."""
    rng = random.Random(9)

    def comb(n):  # a bar with teeth of random heights, as a ring and as its cells
        tops = [rng.randrange(1, 6) for _ in range(n)]
        x0, y0 = rng.randrange(4), rng.randrange(3)
        ring = [(x0, y0), (x0 + n, y0)]
        for i in reversed(range(n)):
            ring += [(x0 + i + 1, y0 + tops[i]), (x0 + i, y0 + tops[i])]
        return [*ring, ring[0]], {(x0 + i, y0 + j) for i in range(n) for j in range(tops[i])}

    for _ in range(60):
        (a, ca), (b, cb) = comb(rng.randrange(1, 7)), comb(rng.randrange(1, 7))
        for turn in (0.0, 0.3):
            c, s = math.cos(turn), math.sin(turn)
            pa, pb = (np.array([(x * c - y * s, x * s + y * c) for x, y in r]) for r in (a, b))
            assert geo._overlap([pa], [pb]) == pytest.approx(len(ca & cb), abs=1e-6)
            assert geo.intersection_area(("Polygon", "", [pa.tolist()]), ("Polygon", "", [pb[::-1].tolist()])) == pytest.approx(len(ca & cb), abs=1e-6)


def test_overlap_with_holes():
    box = lambda x, y, n: np.array([(x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y)], dtype=float)
    frame = [box(0, 0, 10), box(2, 2, 6)]
    assert geo._overlap(frame, [box(0, 0, 10), box(3, 3, 4)]) == pytest.approx(64.0)
    assert geo._overlap(frame, frame) == pytest.approx(64.0)
    assert geo._overlap(frame, [box(3, 3, 2)]) == 0.0 and geo._overlap(frame, [box(20, 0, 3)]) == 0.0


def test_batches_of_points_equal_one_by_one(spark):
    rng = random.Random(1)
    areas = ["POLYGON ((0 0, 10 0, 10 10, 5 4, 0 10, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))", "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0)), ((6 6, 9 6, 9 9, 6 9, 6 6)))", "LINESTRING (0 0, 10 10)"]
    rows = [(rng.choice(areas), float(rng.randrange(11)), float(rng.randrange(11))) for _ in range(300)] + [(None, 1.0, 1.0), (areas[0], None, 1.0)]
    df = spark.createDataFrame(rows, "t string, x double, y double").select(geo.st_geomfromtext("t").alias("a"), geo.st_point("x", "y").alias("p"))
    got = df.select("a", "p", geo.st_contains("a", "p"), geo.st_contains("p", "a"), geo.st_intersects("p", "a"), geo.st_intersects("a", "p"), geo.st_distance("p", "a"), geo.st_bbox("p")).collect()
    for a, p, *values, box in got:
        if a is None or p is None:
            assert values == [None] * 5
            continue
        a, p = geo.decode(a), geo.decode(p)
        want = [geo.contains(a, p), geo.contains(p, a), geo.intersects(p, a), geo.intersects(a, p)]
        assert values[:4] == want and values[4] == pytest.approx(geo.distance(p, a)) and tuple(box) == geo.bounds(p)


def test_what_an_application_keeps_goes_when_it_ends(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
from marlstone.session import build_session
from marlstone.operators.delta import stored
spark = build_session(1, **{{"spark__checkpoint__dir": "file://{tmp_path}/shared"}})
assert stored(spark.range(3)).count() == 3
import os
assert any(n.endswith("-states") for n in os.listdir("{tmp_path}/shared"))
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[1], capture_output=True)
    left = lambda: [p for p in (tmp_path / "shared").iterdir() if p.name.endswith("-states")]
    deadline = time.monotonic() + 20
    while left() and time.monotonic() < deadline:
        time.sleep(0.2)
    assert not left()


def test_a_request_runs_in_a_database(spark):
    pytest.importorskip("pyspark")
    url = "jdbc:derby:memory:requests;create=true"
    rows = [(i, f"it's {i}\\", i * 0.5, dt.date(2024, 1, 1 + i), None if i == 3 else "x") for i in range(9)]
    spark.createDataFrame(rows, "k int, name string, v double, d date, n string").write.format("jdbc").option("url", url).option("driver", "org.apache.derby.jdbc.EmbeddedDriver").option("dbtable", "T").option("createTableColumnTypes", "name VARCHAR(64)").mode("overwrite").save()
    ask = lambda *where, **more: [r[0] for r in files.read_jdbc(spark, url, rq.Request("T", (("k", "k"),), tuple(rq.Where(*w) for w in where), **more), "derby", driver="org.apache.derby.jdbc.EmbeddedDriver").collect()]
    assert sorted(ask(("k", "ge", 6))) == [6, 7, 8] and sorted(ask(("v", "lt", 1.0), ("k", "neq", 0))) == [1]
    assert ask(("name", "eq", "it's 4\\")) == [4] and ask(("n", "isNull")) == [3] and ask(("k", "in", [])) == []
    assert sorted(ask(("d", "le", dt.date(2024, 1, 2)))) == [0, 1]
    assert ask(order_by=(("k", "desc"),), limit=2) == [8, 7]
    assert sorted(ask(keys=({"k": 1, "name": "it's 1\\"}, {"k": 2, "name": "no"}))) == [1]


@pytest.mark.parametrize(
    "dialect, value, text",
    [
        ("postgres", "a'b\\", "'a''b\\'"), ("mysql", "a'b\\", "'a''b\\\\'"), ("bigquery", "a'b", "'a\\'b'"), ("oracle", True, "1"), ("spark", None, "NULL"), ("clickhouse", dt.date(2024, 1, 2), "toDate('2024-01-02')"),
        ("postgres", dt.datetime(2024, 1, 2, 3, 4, 5), "TIMESTAMP '2024-01-02 03:04:05'"), ("phoenix", Decimal("1.50"), "1.50"),
    ],
)
def test_literals(dialect, value, text):
    assert rq.literal(value, dialect) == text
    with pytest.raises(rq.RequestProblem):
        rq.literal(float("nan"), dialect)


def test_witnesses_have_an_order_and_lose_no_row(spark):
    none, five, nine = rq.Witness("none"), rq.Witness("field", 5), rq.Witness("field", 9)
    assert nine.reached(five) and not five.reached(nine) and five.reached(none) and not none.reached(five) and five.reached(five)
    for bad in (lambda: rq.Witness("place", 1), lambda: rq.Witness("none", 1), lambda: rq.Witness("log"), lambda: five.reached(rq.Witness("log", 1))):
        with pytest.raises(rq.RequestProblem):
            bad()
    one = spark.createDataFrame([(1,), (4,), (None,)], "t int")
    two = spark.createDataFrame([(1,), (4,), (None,), (6,), (9,)], "t int")
    ids = lambda df: sorted((r[0] is not None, r[0]) for r in df.collect())
    rows, at = rq.read_since(one, "t")
    assert ids(rows) == [(False, None), (True, 1), (True, 4)] and at == rq.Witness("field", 4)
    rows, end = rq.read_since(two, "t", at)
    assert ids(rows) == [(True, 6), (True, 9)] and end == nine
    rows, same = rq.read_since(two, "t", end)
    assert ids(rows) == [] and same == end
    assert rq.read_since(one.limit(0), "t")[1] == none
    with pytest.raises(rq.RequestProblem):
        rq.read_since(one, "t", rq.Witness("snapshot", 1))


# -- aggregates -----------------------------------------------------------------------------------


def test_decimal_average_counts_every_row_and_writes_the_shortest_number(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [("a", 0.04), ("a", 0.04), ("b", 0.25), ("b", None), ("c", 1.0), ("d", 0.0)] + [("e", 0.01)] + [("e", 0.0)] * 799
    spark.createDataFrame(rows, "l_returnflag string, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = entry.queries()["agg_exact_decimal_avg"](spark, str(tmp_path)).collect()
    assert {r[0]: r[1] for r in got} == {"a": "0.04", "b": "0.125", "c": "1.0", "d": "0.0", "e": "1.3e-05"}


def test_approximate_count_holds_no_sketch_for_each_key(spark, tmp_path):
    import __spark_entry__ as entry

    spark.range(5000).select((F.col("id") % 1300).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    df = entry.queries()["agg_approx_count_distinct"](spark, str(tmp_path))
    assert df.first()[0] is True
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "approx_count_distinct" in plan and "distinct " not in plan


def test_quantiles_are_of_counted_values(spark, tmp_path):
    import __spark_entry__ as entry
    from marlstone.operators.quantiles import quantiles

    rng = random.Random(3)
    rows = [(g, float(rng.randrange(40))) for g in "abbccc" for _ in range(33)] + [(None, 1.0), (None, 4.0), ("n", None), ("b", None), ("one", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"q0": 0.0, "q25": 0.25, "q5": 0.5, "q9": 0.9, "q1": 1.0}
    got = {r["g"]: r for r in quantiles(df, ["g"], "v", shares).collect()}
    disc = {r["g"]: r for r in quantiles(df, ["g"], "v", shares, discrete=True).collect()}
    for g in {r[0] for r in rows}:
        values = sorted(v for h, v in rows if h == g and v is not None)
        for name, q in shares.items():
            if not values:
                assert got[g][name] is None and disc[g][name] is None
                continue
            assert got[g][name] == pytest.approx(float(np.quantile(values, q)), abs=1e-12)
            assert disc[g][name] == values[max(math.ceil(q * len(values)), 1) - 1]
    items = df.select(F.col("g").alias("l_returnflag"), F.col("v").alias("l_extendedprice"), F.col("v").alias("l_quantity"))
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = entry.queries()["agg_median_quantiles"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "median" not in plan


def test_salted_join_repeats_only_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(joins, "LIGHT_ROWS", 20)
    left = spark.createDataFrame([(k, i) for k, n in ((1, 300), (2, 5), (3, 2), (None, 4)) for i in range(n)], "k long, i long")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (9, "d"), (None, "e")], "k long, x string")
    for how in ("inner", "left"):
        got = joins.salted_join(left, right, ["k"], 8, how)
        assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", how).select(*got.columns).collect()))
    l, r = joins.salted_sides(left, right, ["k"], 8)
    assert l.count() == 311 and l.filter("k = 1").select("__salt").distinct().count() == 8
    assert {r[0]: r[1] for r in r.groupBy("x").count().collect()} == {"a": 8, "b": 8, "c": 1, "d": 1, "e": 1}


def test_nearest_vectors_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(joins, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(4)
    v = {i: [float(x) for x in rng.normal(size=6)] for i in range(120)}
    v |= {120 + i: [x * (i + 1) * 0.3 for x in v[5]] for i in range(9)} | {130: [1.0, 2.0]}  # as near as each other but for rounding; another size
    df = spark.createDataFrame([*v.items(), (131, None)], "id long, e array<double>")
    got: dict = {}
    for r in sorted(joins.nearest_vectors(df, df, 4, "id", "id", "e", decimals=9, block_rows=11).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["item_id"])
    cosine = lambda a, b: round(float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))), 9)
    assert got == {q: sorted((i for i in v if len(v[i]) == len(v[q])), key=lambda i: (-cosine(v[q], v[i]), i))[:4] for q in v}
    assert "NestedLoop" not in joins.nearest_vectors(df, df, 4, "id", "id", "e")._jdf.queryExecution().executedPlan().toString()


def test_merge_joins_once(spark, tmp_path):
    from marlstone.catalog.engine import Engine

    seen = spark.sparkContext.accumulator(0)

    def tick(x):
        seen.add(1)
        return x

    e = Engine(spark, f"file://{tmp_path}/lake", "sales")
    e.register("tick", F.udf(tick, "long"))
    e.execute("create dataset t as select id, id as v from range(50)")
    e.execute("create dataset s as select id, id + 1 as v from range(10, 70)")
    n = e.execute("merge into t using (select id, functions.tick(v) as v from s) x on t.id = x.id when matched and x.v % 2 = 0 then delete when matched then update set v = x.v when not matched and x.v > 60 then insert *")
    assert n == 50 and seen.value <= 120
    want = [(i, i) for i in range(10)] + [(i, i + 1) for i in range(10, 50) if i % 2 == 0] + [(i, i + 1) for i in range(60, 70)]
    assert sorted(tuple(r) for r in e.query("select id, v from t").collect()) == want
