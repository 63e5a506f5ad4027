"""Connectors: the seed rows of every type, and each operator against its plain meaning."""

import datetime as dt
import json
from decimal import Decimal

import pytest

from marlstone.plans import ir
from marlstone.plans.compile import column
from marlstone.sources import connector, documents
from marlstone.sources.request import Where

ROWS = [
    {"id": 1, "n": 9223372036854775807, "amount": "12.30", "real": 0.5, "text": "", "day": "2024-02-29", "at": "2024-01-01T00:00:00", "flag": True},
    {"id": 2, "n": -9223372036854775808, "amount": "-0.01", "real": -1.5, "text": "50%_off", "day": "1970-01-01", "at": "1969-12-31T23:59:59.999999", "flag": False},
    {"id": 3, "n": 0, "amount": "0.00", "real": 0.0, "text": "añb", "day": None, "at": None, "flag": None},
    {"id": 4},
]
FIELDS = "id:Integer;n:Integer;amount:Decimal<12,2>;real:Float;text:String;day:Date;at:DateTime;flag:Boolean"


NAME = "marlstone.sources.documents:JsonDocuments"


@pytest.fixture()
def options(tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(r) for r in ROWS[:2]))
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(r) for r in ROWS[2:]) + "\n\n")
    return {"path": str(tmp_path), "fields": FIELDS}


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_types_and_nulls(spark, options):
    docs = connector.over(spark, NAME, options)
    got = {r["id"]: r for r in docs.collect()}
    assert got[1]["n"] == 2**63 - 1 and str(got[1]["amount"]) == "12.30" and got[1]["text"] == "" and got[1]["day"].isoformat() == "2024-02-29"
    assert got[2]["at"].isoformat() == "1969-12-31T23:59:59.999999" and all(got[4][c] is None for c in docs.columns[1:])
    assert ids(docs.filter("n > 0")) == [1] and docs.count() == 4


@pytest.mark.parametrize(
    "where, want",
    [
        (Where("n", "eq", 0), [3]), (Where("n", "neq", 0), [1, 2]), (Where("n", "in", [0, 5]), [3]), (Where("n", "in", []), []), (Where("real", "lt", 0), [2]), (Where("real", "le", 0.0), [2, 3]),
        (Where("real", "gt", 0), [1]), (Where("real", "ge", 0), [1, 3]), (Where("text", "like", "50%"), [2]), (Where("text", "like", "a_b"), [3]), (Where("text", "eq", ""), [1]), (Where("text", "isNull"), [4]),
        (Where("text", "isNotNull"), [1, 2, 3]), (Where("day", "eq", dt.date(2024, 2, 29)), [1]), (Where("amount", "eq", Decimal("12.3")), [1]), (Where("at", "lt", dt.datetime(1970, 1, 1)), [2]), (Where("flag", "eq", True), [1]),
    ],
)
def test_operators(spark, options, where, want):
    assert ids(connector.over(spark, NAME, options, (where,), ["id", "text"])) == want


def test_plans_become_requests(spark, options):
    c, lit = ir.Col, ir.Lit.of
    predicate = ir.And((ir.Compare("<", lit(-5), c("n")), ir.Not(ir.IsNull(c("text"))), ir.Or((ir.IsNull(c("day")), ir.Compare("=", c("text"), lit(""))))))
    taken, rest = connector.wheres(predicate)
    assert taken == [Where("n", "gt", -5), Where("text", "isNotNull")] and len(rest) == 1
    assert ids(connector.over(spark, NAME, options, tuple(taken)).filter(column(rest[0]))) == [1, 3]


def test_undeclared_requests_are_rejected(spark, options):
    for where, columns in (((Where("n", "near", 0),), None), ((Where("gone", "eq", 0),), None), ((), ["gone"])):
        with pytest.raises(Exception):
            connector.over(spark, NAME, options, where, columns).collect()


def test_like_and_where():
    assert documents.like("50%_off", r"50\%\_%") and not documents.like("50xy", r"50\%%") and documents.like("a\nb", "a_b")
    assert not documents.holds(Where("x", "neq", 1), None) and documents.holds(Where("x", "isNull"), None)


def test_wrong_value_stops(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "x"}')
    with pytest.raises(Exception, match="no integer"):
        connector.over(spark, NAME, {"path": str(tmp_path), "fields": "id:Integer"}).collect()


def test_only_connectors_load():
    with pytest.raises(TypeError):
        connector.load("collections:OrderedDict", {})
