"""Plans to DataFrames, and plans to SQL text. Catalyst does all physical work."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import types as ty
from . import ir
from .schema import literal_type, schema_of

Reader = Callable[[ir.Scan], DataFrame]
_OPS = {"=": "__eq__", "<>": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _literal(lit: ir.Lit) -> Column:
    return F.lit(str(lit.value)).cast(ty.to_spark(literal_type(lit))) if lit.kind == "Decimal" else F.lit(lit.value)


def column(e: ir.Expr) -> Column:
    match e:
        case ir.Col(name):
            return F.col(_quoted(name))
        case ir.Lit():
            return _literal(e)
        case ir.Compare(op, a, b):
            return getattr(column(a), _OPS[op])(column(b))
        case ir.In(item, values):
            return column(item).isin(*[_literal(v) for v in values]) if values else F.lit(False)
        case ir.IsNull(item):
            return column(item).isNull()
        case ir.And(items):
            return reduce(lambda a, b: a & b, map(column, items), F.lit(True))
        case ir.Or(items):
            return reduce(lambda a, b: a | b, map(column, items), F.lit(False))
        case ir.Not(item):
            return ~column(item)
        case ir.Raw(dialect, text, _, t, _):
            if dialect != "spark":
                raise ValueError(f"a {dialect} fragment doesn't run here")
            return F.expr(text).cast(ty.to_spark(ty.parse(t)))
    raise TypeError(type(e).__name__)


def exact_average(c: Column, t: ty.Type) -> Column:
    """Average of integers or decimals, rounded half away from zero, without floating point."""
    scale = max(t.digits[1] if t.name == "Decimal" else 0, 6)
    return F.round(F.sum(c.cast("decimal(38,6)" if scale == 6 else f"decimal(38,{scale})")) / F.count(c), scale)


def _aggregate(function: str, name: str | None, t: ty.Type | None, out: ty.Type) -> Column:
    if function == "count":
        return F.count(F.lit(1))  # rows, whatever the column
    c = F.col(_quoted(name))
    if function == "avg" and t.name in ("Integer", "Decimal"):
        return exact_average(c, t).cast(ty.to_spark(out))
    return getattr(F, function)(c).cast(ty.to_spark(out))


def to_dataframe(node: ir.Node, read: Reader) -> DataFrame:
    """Lazily; columns sorted by name at the root, as rows have no column order in this algebra."""
    fields = schema_of(node)
    return _dataframe(node, read).select(*[F.col(_quoted(n)) for n in sorted(fields)])


def _dataframe(node: ir.Node, read: Reader) -> DataFrame:
    match node:
        case ir.Scan(_, _, columns):
            return read(node).select(*[F.col(_quoted(n)).cast(ty.to_spark(ty.parse(t))).alias(n) for n, t in columns])
        case ir.Project(input, outputs):
            return _dataframe(input, read).select(*[column(e).alias(n) for n, e in outputs])
        case ir.Filter(input, predicate):
            return _dataframe(input, read).filter(column(predicate))
        case ir.Join(left, right, on, kind):
            a, b = _dataframe(left, read), _dataframe(right, read)
            return a.join(b, reduce(lambda x, y: x & y, [a[_quoted(x)] == b[_quoted(y)] for x, y in on]), kind)
        case ir.Aggregate(input, by, aggregates):
            inner, outer = schema_of(input), schema_of(node)
            aggs = [_aggregate(f, c, inner[c].type if c else None, outer[n].type).alias(n) for n, f, c in aggregates]
            df = _dataframe(input, read)
            if by:
                keys = [F.col(_quoted(n)) for n in by]
                return df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
            total = df.agg(*aggs, F.count(F.lit(1)).alias("__rows"))  # no rows, no group
            return total.filter("__rows > 0").drop("__rows")
        case ir.Union(inputs):
            fields = schema_of(node)
            parts = [_dataframe(i, read).select(*[F.col(_quoted(n)).cast(ty.to_spark(f.type)).alias(n) for n, f in fields.items()]) for i in inputs]
            return reduce(DataFrame.unionByName, parts)
        case ir.Distinct(input):
            return _dataframe(input, read).distinct()
        case ir.Limit(input, n):
            df = _dataframe(input, read)
            return df.orderBy(*[F.col(_quoted(c)).asc_nulls_last() for c in sorted(schema_of(input))]).limit(n)
    raise TypeError(f"{type(node).__name__} is not executable")


# -- SQL text -------------------------------------------------------------------------------------


class Dialect:
    def __init__(self, name: str):
        if name not in ("spark", "duckdb"):
            raise ValueError(f"no dialect {name!r}")
        self.name = name

    def ident(self, name: str) -> str:
        return _quoted(name) if self.name == "spark" else '"' + name.replace('"', '""') + '"'

    def string(self, value: str) -> str:
        value = value.replace("\\", "\\\\").replace("'", "\\'") if self.name == "spark" else value.replace("'", "''")
        return f"'{value}'"

    def type(self, t: ty.Type) -> str:
        text = ty.to_spark(t).simpleString()
        return text if self.name == "spark" else {"timestamp_ntz": "timestamp", "timestamp": "timestamptz", "binary": "blob"}.get(text, text)

    def expr(self, e: ir.Expr) -> str:
        match e:
            case ir.Col(name):
                return self.ident(name)
            case ir.Lit("String", v):
                return self.string(v)
            case ir.Lit("Boolean", v):
                return "true" if v else "false"
            case ir.Lit("Decimal", v):
                return f"cast('{v}' as {self.type(literal_type(e))})"
            case ir.Lit(_, v):
                return f"({v})" if v < 0 else str(v)
            case ir.Compare(op, a, b):
                return f"({self.expr(a)} {op} {self.expr(b)})"
            case ir.In(item, values):
                return f"({self.expr(item)} in ({', '.join(self.expr(v) for v in sorted(set(values), key=str))}))" if values else "false"
            case ir.IsNull(item):
                return f"({self.expr(item)} is null)"
            case ir.And(items):
                return f"({' and '.join(self.expr(i) for i in items)})" if items else "true"
            case ir.Or(items):
                return f"({' or '.join(self.expr(i) for i in items)})" if items else "false"
            case ir.Not(item):
                return f"(not {self.expr(item)})"
            case ir.Raw(dialect, text, _, t, _):
                if dialect != self.name:
                    raise ValueError(f"a {dialect} fragment in {self.name} text")
                return f"cast(({text}) as {self.type(ty.parse(t))})"
        raise TypeError(type(e).__name__)

    def plan(self, node: ir.Node) -> str:
        i = self.ident
        match node:
            case ir.Scan(_, relation, columns):
                return f"select {', '.join(f'cast({i(n)} as {self.type(ty.parse(t))}) as {i(n)}' for n, t in columns)} from {i(relation)}"
            case ir.Project(input, outputs):
                return f"select {', '.join(f'{self.expr(e)} as {i(n)}' for n, e in outputs)} from ({self.plan(input)}) t"
            case ir.Filter(input, p):
                return f"select * from ({self.plan(input)}) t where {self.expr(p)}"
            case ir.Join(a, b, on, kind):
                cond = " and ".join(f"a.{i(x)} = b.{i(y)}" for x, y in on)
                return f"select a.*, b.* from ({self.plan(a)}) a {kind} join ({self.plan(b)}) b on {cond}"
            case ir.Aggregate(input, by, aggregates):
                inner, outer = schema_of(input), schema_of(node)
                items = [i(n) for n in by]
                for n, f, c in aggregates:
                    if f == "count":
                        text = "count(*)"
                    elif f == "avg" and inner[c].type.name in ("Integer", "Decimal"):
                        scale = max(inner[c].type.digits[1] if inner[c].type.name == "Decimal" else 0, 6)
                        text = f"round(cast(sum({i(c)}) as decimal(38,{scale})) / count({i(c)}), {scale})"
                    else:
                        text = f"{f}({i(c)})"
                    items.append(f"cast({text} as {self.type(outer[n].type)}) as {i(n)}")
                tail = f" group by {', '.join(map(i, by))}" if by else " having count(*) > 0"
                return f"select {', '.join(items)} from ({self.plan(input)}) t{tail}"
            case ir.Union(inputs):
                fields = schema_of(node)
                cols = ", ".join(f"cast({i(n)} as {self.type(f.type)}) as {i(n)}" for n, f in sorted(fields.items()))
                return " union all ".join(f"select {cols} from ({self.plan(x)}) t" for x in inputs)
            case ir.Distinct(input):
                return f"select distinct * from ({self.plan(input)}) t"
            case ir.Limit(input, n):
                order = ", ".join(f"{i(c)} asc nulls last" for c in sorted(schema_of(input)))
                return f"select * from ({self.plan(input)}) t order by {order} limit {n}"
        raise TypeError(type(node).__name__)


def to_sql(node: ir.Node, dialect: str = "spark") -> str:
    """A query with the columns in order of their names."""
    d = Dialect(dialect)
    return f"select {', '.join(d.ident(n) for n in sorted(schema_of(node)))} from ({d.plan(node)}) q"
