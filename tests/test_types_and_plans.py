"""Pure parts: types, plans, schemas, analyses. No session is needed."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from marlstone import types as ty
from marlstone.operators.state_store import Refused, StateStore
from marlstone.plans import ir, matching, pushdown, refresh, views
from marlstone.plans.compile import to_sql
from marlstone.plans.schema import SchemaProblem, schema_of
from marlstone.quality import operations as ops

C, L = ir.Col, ir.Lit.of
ORDERS = ir.Scan("lake", "orders", (("id", "Integer"), ("total", "Decimal<12,2>"), ("country", "String"), ("cust", "Integer")))
CUSTOMERS = ir.Scan("lake", "customers", (("cid", "Integer"), ("segment", "String")))
JOIN = ir.Join(ORDERS, CUSTOMERS, (("cust", "cid"),))


@pytest.mark.parametrize("text", ["Integer", "Decimal<12,2>", "list<String>", "Struct<a: Integer, b: list<Date>>", "Vector<3>", "Geometry<Point,OGC:CRS84>", "Geography<PolygonZ>", "Media<m>", "Money<EUR,2>"])
def test_types_print_and_parse(text):
    assert str(ty.parse(text)) == text
    ty.to_spark(ty.parse(text))


@pytest.mark.parametrize("text", ["Int", "Decimal<39,2>", "Decimal<2,3>", "list<list<Integer>>", "list<Vector<2>>", "Vector<0>", "Vector<16001>", "Struct<A: Integer>", "Struct<a: Integer, a: Date>", "Geometry<Circle>", "Date<3>"])
def test_types_refused(text):
    with pytest.raises(ty.TypeProblem):
        ty.parse(text)


def test_widening_and_decimals():
    p = ty.parse
    assert ty.widens(p("Integer"), p("Decimal<21,2>")) and not ty.widens(p("Integer"), p("Decimal<20,2>"))
    assert ty.widens(p("Decimal<5,2>"), p("Decimal<7,3>")) and not ty.widens(p("Decimal<5,2>"), p("Decimal<5,3>"))
    assert ty.widens(p("Opaque"), p("Binary")) and not ty.widens(p("String"), p("Integer"))
    assert str(ty.common_decimal(p("Decimal<10,2>"), p("Decimal<8,4>"))) == "Decimal<12,4>"
    with pytest.raises(ty.TypeProblem):
        ty.common_decimal(p("Decimal<38,10>"), p("Decimal<38,2>"))
    assert str(ty.sum_type(p("Decimal<12,2>"))) == "Decimal<38,2>" and str(ty.avg_type(p("Decimal<12,2>"))) == "Decimal<38,9>"


@given(st.integers(1, 38), st.integers(0, 38), st.integers(1, 38), st.integers(0, 38))
def test_common_decimal_holds_both(p1, s1, p2, s2):
    if s1 > p1 or s2 > p2:
        return
    a, b = ty.decimal(p1, s1), ty.decimal(p2, s2)
    try:
        c = ty.common_decimal(a, b)
    except ty.TypeProblem:
        assert max(p1 - s1, p2 - s2) + max(s1, s2) > 38
    else:
        assert ty.widens(a, c) and ty.widens(b, c)


@pytest.mark.parametrize(
    "plan, code",
    [
        (ir.Project(ORDERS, (("x", C("none")),)), "unknown_field"),
        (ir.Filter(ORDERS, C("id")), "not_boolean"),
        (ir.Filter(ORDERS, ir.Compare("=", C("id"), C("country"))), "incomparable_types"),
        (ir.Join(ORDERS, ORDERS, (("id", "id"),)), "join_collision"),
        (ir.Union((ORDERS, CUSTOMERS)), "unequal_branches"),
        (ir.Union((ir.Scan("a", "b", (("x", "Decimal<38,0>"),)), ir.Scan("a", "c", (("x", "Decimal<38,30>"),)))), "decimal_overflow"),
        (ir.Aggregate(ORDERS, (), (("s", "sum", None),)), "aggregate_without_column"),
        (ir.Aggregate(ORDERS, (), (("s", "sum", "country"),)), "bad_aggregate"),
        (ir.Ref("v"), "unexpanded"),
        (ir.Project(ORDERS, (("x", ir.Raw("spark", "1", ("gone",), "Integer")),)), "opaque_reads"),
    ],
)
def test_schema_problems_have_names(plan, code):
    with pytest.raises(SchemaProblem) as e:
        schema_of(plan)
    assert e.value.code == code


def test_nullability_goes_down():
    fields = schema_of(ir.Project(ORDERS, (("a", C("id")), ("n", ir.IsNull(C("total"))))), {("lake", "orders"): {"id"}})
    assert fields["a"].nullability is ty.Nullability.DERIVED and fields["n"].nullability is ty.Nullability.DERIVED
    left = schema_of(ir.Join(ORDERS, CUSTOMERS, (("cust", "cid"),), "left"), {("lake", "customers"): {"cid"}})
    assert left["cid"].nullability is ty.Nullability.NULLABLE


def test_digest_ignores_what_has_no_meaning():
    a, b = ir.Compare(">", C("total"), L(5)), ir.In(C("country"), (L("es"), L("pt")))
    one = ir.Filter(ORDERS, ir.And((a, b)))
    two = ir.Filter(ORDERS, ir.And((ir.In(C("country"), (L("pt"), L("es"), L("pt"))), ir.Compare("<", L(5), C("total")))))
    assert ir.digest(one) == ir.digest(two) != ir.digest(ir.Filter(ORDERS, ir.Or((a, b))))
    assert ir.digest(ir.Lit("Decimal", "1.50")) == ir.digest(ir.Lit("Decimal", "1.5"))
    assert ir.normal_decimal("-0.00") == "0" and ir.normal_decimal("1E+2") == "100"


def test_json_round_trip():
    plan = ir.Limit(ir.Aggregate(ir.Filter(JOIN, ir.Not(ir.IsNull(C("id")))), ("segment",), (("n", "count", None),)), 3)
    assert ir.from_json(json.loads(json.dumps(ir.to_json(plan)))) == plan
    for bad in ({"node": "Nope"}, {"node": "Col", "name": "x", "more": 1}):
        with pytest.raises(ValueError):
            ir.from_json(bad)


def test_views_expand_and_cycles_are_found():
    defs = {"a": ir.Filter(ir.Ref("b"), ir.IsNull(C("id"))), "b": ORDERS, "x": ir.Ref("y"), "y": ir.Ref("x")}
    assert views.expand(ir.Ref("a"), defs) == ir.Filter(ORDERS, ir.IsNull(C("id")))
    for bad in ("x", "none"):
        with pytest.raises(views.ViewProblem):
            views.expand(ir.Ref(bad), defs)


def test_lineage_composes():
    plan = ir.Aggregate(ir.Project(JOIN, (("seg", C("segment")), ("big", ir.Compare(">", C("total"), L(1))))), ("seg",), (("top", "max", "big"),))
    rows = set(views.lineage_rows(plan))
    assert ("top", "lake", "orders", "total", "DIRECT", "AGGREGATION") in rows
    assert ("top", "lake", "orders", "cust", "INDIRECT", "JOIN") in rows
    assert ("seg", "lake", "customers", "segment", "DIRECT", "IDENTITY") in rows
    assert views.facet(plan)["fields"]["seg"]["inputFields"][0]["namespace"] == "lake"


def test_pushdown_keeps_outer_joins_sound():
    caps = {"lake": pushdown.Capabilities(frozenset(ir.COMPARATORS), True, True, True, True)}
    left = ir.Join(ORDERS, CUSTOMERS, (("cust", "cid"),), "left")
    got = pushdown.split(ir.Filter(left, ir.And((ir.IsNull(C("segment")), ir.Compare(">", C("total"), L(1))))), caps)
    assert [r.predicate for r in got.requests] == [ir.Compare(">", C("total"), L(1)), None]
    assert isinstance(got.residual, ir.Filter) and got.residual.predicate == ir.IsNull(C("segment"))
    limited = pushdown.split(ir.Filter(ir.Limit(ORDERS, 3), ir.IsNull(C("id"))), caps)
    assert limited.requests[0].predicate is None


def test_pushdown_refusals():
    caps = {"lake": pushdown.Capabilities(frozenset({"="}), full_scan=False, required_filters=("country",))}
    r = pushdown.split(ir.Filter(ORDERS, ir.Compare(">", C("total"), L(1))), caps).requests[0]
    assert r.refusals == ["no comparator >", "required filter on country is missing", "a scan without a filter is not allowed"]


@pytest.mark.parametrize(
    "have, want, ok",
    [
        ((">", 5), (">", 3), True), ((">", 5), (">=", 5), True), ((">=", 5), (">", 5), False), (("=", 4), ("<", 5), True), (("<", 5), ("<>", 7), True), (("<", 5), ("<>", 3), False), ((">", 3), (">", 5), False),
    ],
)
def test_implication(have, want, ok):
    c = lambda x: ir.Compare(x[0], C("a"), L(x[1]))
    assert matching.implies([c(have)], c(want)) is ok


def test_matching_says_no_when_unsure():
    scan = ir.Scan("lake", "mv", (("n", "Integer"), ("country", "String")))
    view = ir.Aggregate(ORDERS, ("country",), (("n", "count", None),))
    for query, why in (
        (ir.Aggregate(ORDERS, ("cust",), (("n", "count", None),)), "hides"),
        (ir.Aggregate(ORDERS, ("country",), (("s", "sum", "total"),)), "no sum"),
        (ir.Aggregate(ORDERS, ("country",), (("a", "avg", "total"),)), "rolled up"),
        (ir.Project(ORDERS, (("country", C("country")),)), "aggregated"),
        (ir.Aggregate(ir.Filter(ORDERS, ir.Compare(">", C("total"), L(1))), ("country",), (("n", "count", None),)), "hides"),
    ):
        with pytest.raises(matching.NotMatched, match=why):
            matching.match(query, view, scan)


def test_extra_join_needs_a_guarantee():
    view = ir.Project(JOIN, (("id", C("id")), ("segment", C("segment"))))
    query = ir.Project(ORDERS, (("id", C("id")),))
    scan = ir.Scan("lake", "mv", (("id", "Integer"), ("segment", "String")))
    with pytest.raises(matching.NotMatched):
        matching.match(query, view, scan)
    sure = frozenset({matching.Guarantee("orders.cust", "customers.cid")})
    assert matching.match(query, view, scan, sure) == ir.Project(scan, (("id", C("id")),))


def test_filter_tree_forgets():
    tree = matching.FilterTree()
    tree.register("a", ORDERS, ORDERS)
    tree.register("b", JOIN, ORDERS)
    assert tree.candidates(ORDERS) == ["a", "b"] and tree.candidates(ORDERS, supersets=False) == ["a"]
    tree.forget("a")
    assert tree.candidates(ORDERS) == ["b"]


def test_refresh_names_all_reasons():
    plan = ir.Limit(ir.Aggregate(ir.Join(ORDERS, CUSTOMERS, (("cust", "cid"),), "full"), (), (("a", "avg", "total"),)), 1)
    m = refresh.analyze(plan, {("lake", "customers"): refresh.Emits.NONE})
    assert not m.incremental and len(m.reasons) == 4


def test_sql_text_escapes():
    plan = ir.Filter(ORDERS, ir.Compare("=", C("country"), L("o'b\\x")))
    assert r"'o\'b\\x'" in to_sql(plan, "spark") and "'o''b\\x'" in to_sql(plan, "duckdb")


def test_state_store_evicts_the_least_read():
    s = StateStore("r", 2)
    for k in "abc":
        assert s.read((k,)) == ("miss", None)
    s.fill(("a",), {(1,): 1}, 1, "r")
    s.fill(("b",), {(2,): 1}, 1, "r")
    s.read(("a",))
    assert s.fill(("c",), {(3,): 1}, 1, "r") == [("b",)]
    assert s.delta(("b",), {(2,): 1}, 5) == "absent" and s.delta(("a",), {(1,): -1}, 2) == "applied"
    assert s.read(("a",)) == ("hit", {})
    with pytest.raises(Refused):
        s.fill(("b",), {}, 1, "other")


def test_paths_and_health():
    assert ops.path_is_safe("a/b..c/d") and not ops.path_is_safe("a/../b") and not ops.path_is_safe("a/%252e%252e/b") and not ops.path_is_safe("a\\..\\b")
    edges = [("a", "b"), ("b", "c"), ("x", "c")]
    assert ops.health(edges, {"a": "failed", "b": "ok", "c": "warning", "x": "ok"}) == {"a": "failed", "b": "degraded", "c": "degraded", "x": "ok"}
