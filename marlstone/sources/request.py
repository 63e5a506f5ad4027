"""Requests to a source: a fragment of a plan, not SQL. Checked, run on a DataFrame, or written as SQL."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ten filter operators.
OPERATORS = ("eq", "neq", "in", "lt", "le", "gt", "ge", "like", "isNull", "isNotNull")


class RequestProblem(ValueError):
    """A request that the source does not take; the whole of it is rejected."""


@dataclass(frozen=True)
class Where:
    column: str
    op: str
    value: object = None


@dataclass(frozen=True)
class Span:
    """An incremental range of a cursor column: start exclusive, end inclusive."""

    cursor: str
    start: object = None
    end: object = None


@dataclass(frozen=True)
class Request:
    relation: str
    columns: tuple[tuple[str, str], ...]  # output name, column
    where: tuple[Where, ...] = ()
    keys: tuple[dict, ...] = ()  # rows to look up by equality of all their columns
    order_by: tuple[tuple[str, str], ...] = ()  # column, asc or desc; nulls last both ways
    limit: int | None = None
    span: Span | None = None


@dataclass(frozen=True)
class Capabilities:
    operators: frozenset[str] = frozenset(OPERATORS)
    limit: bool = True
    order_by: bool = False
    keys: bool = True


@dataclass
class Budget:
    rows: int = 100_000
    size: int = 64 << 20
    spent: dict = field(default_factory=dict)


def check(r: Request, c: Capabilities) -> None:
    """Rejects the request as a whole if any part is not declared."""
    for w in r.where:
        if w.op not in OPERATORS:
            raise RequestProblem(f"unknown operator {w.op}")
        if w.op not in c.operators:
            raise RequestProblem(f"{w.op} is not declared")
        if w.op == "in" and not isinstance(w.value, (list, tuple)):
            raise RequestProblem("in takes a list")
        if w.op not in ("isNull", "isNotNull") and w.value is None:
            raise RequestProblem(f"{w.op} takes a value")
    if r.limit is not None and (not c.limit or r.limit < 0):
        raise RequestProblem("no limit")
    if r.order_by and not c.order_by:
        raise RequestProblem("no order")
    if r.keys and not c.keys:
        raise RequestProblem("no key lookup")
    if not r.columns:
        raise RequestProblem("no columns")


def condition(w: Where) -> Column:
    c = F.col(f"`{w.column}`")
    match w.op:
        case "eq":
            return c == F.lit(w.value)
        case "neq":
            return c != F.lit(w.value)
        case "in":
            return c.isin(*w.value) if w.value else F.lit(False)
        case "lt":
            return c < F.lit(w.value)
        case "le":
            return c <= F.lit(w.value)
        case "gt":
            return c > F.lit(w.value)
        case "ge":
            return c >= F.lit(w.value)
        case "like":
            return c.like(w.value)
        case "isNull":
            return c.isNull()
        case "isNotNull":
            return c.isNotNull()
    raise RequestProblem(f"unknown operator {w.op}")


def run(r: Request, df: DataFrame, c: Capabilities | None = None) -> DataFrame:
    """The request on a relation; Spark pushes filters and columns to the files."""
    check(r, c or Capabilities(order_by=True))
    for w in r.where:
        df = df.filter(condition(w))
    if r.keys:
        each = [reduce(lambda a, b: a & b, [F.col(f"`{k}`") == F.lit(v) for k, v in key.items()]) for key in r.keys]
        df = df.filter(reduce(lambda a, b: a | b, each))
    if r.span:
        cursor = F.col(f"`{r.span.cursor}`")
        if r.span.start is not None:
            df = df.filter(cursor > F.lit(r.span.start))
        if r.span.end is not None:
            df = df.filter(cursor <= F.lit(r.span.end))
    if r.order_by:
        df = df.orderBy(*[F.col(f"`{n}`").desc_nulls_last() if d == "desc" else F.col(f"`{n}`").asc_nulls_last() for n, d in r.order_by])
    if r.limit is not None:
        df = df.limit(r.limit)
    return df.select(*[F.col(f"`{col}`").alias(out) for out, col in r.columns])


def within_budget(df: DataFrame, budget: Budget) -> DataFrame:
    """df, or an error if it has more rows than the budget; one more row than that is looked at."""
    n = df.limit(budget.rows + 1).count()
    if n > budget.rows:
        raise RequestProblem(f"more than {budget.rows} rows")
    budget.spent["rows"] = n
    return df


def mark_of(df: DataFrame, cursor: str) -> object:
    """The position to take before reading, so that what arrives meanwhile is read again, not lost."""
    return df.agg(F.max(cursor)).first()[0]


@dataclass(frozen=True)
class Witness:
    """How far a reader has come: nowhere (none), at a dataset's snapshot, at a step of a log, or at a
    value of a cursor column. It is taken before what it stands for is read, so rows that arrive
    meanwhile are read again and none is lost."""

    kind: str  # none, snapshot, log, field
    position: object = None

    def __post_init__(self):
        if self.kind not in ("none", "snapshot", "log", "field") or (self.kind == "none") != (self.position is None):
            raise RequestProblem(f"no witness {self.kind} {self.position!r}")

    def reached(self, other: Witness) -> bool:
        """Whether this one is at or past the other; nowhere is before all, kinds don't mix."""
        if other.kind == "none":
            return True
        if self.kind == "none":
            return False
        if self.kind != other.kind:
            raise RequestProblem(f"{self.kind} and {other.kind} have no order")
        return self.position >= other.position


def read_since(df: DataFrame, cursor: str, since: Witness = Witness("none")) -> tuple[DataFrame, Witness]:
    """Rows past a witness of a cursor column, and the witness to go on from. Rows without a cursor are
    read each time there is no witness yet."""
    if since.kind not in ("none", "field"):
        raise RequestProblem(f"a cursor column is not read from a {since.kind}")
    at = mark_of(df, cursor)
    now = since if at is None else Witness("field", at)
    c = F.col(f"`{cursor}`")
    if since.kind == "none":
        return df.filter(c.isNull() if at is None else c.isNull() | (c <= F.lit(at))), now
    return df.filter((c > F.lit(since.position)) & (c <= F.lit(now.position))), now


# What differs between SQL dialects - quotes, placeholder of the n-th value, tuples in
# IN, and how a limit is written.
DIALECTS = {
    "postgres": ('"{}"', "${}", True, "limit"),
    "mysql": ("`{}`", "?", True, "limit"),
    "oracle": ('"{}"', ":{}", True, "fetch"),
    "bigquery": ("`{}`", "@p{}", False, "limit"),
    "clickhouse": ("`{}`", "?", True, "limit"),
    "phoenix": ('"{}"', "?", True, "limit"),
    "derby": ('"{}"', "?", False, "fetch"),
    "spark": ("`{}`", "?", False, "limit"),
}


def literal(value: object, dialect: str) -> str:
    """A value as the dialect writes it. Text is quoted, and in dialects that read backslashes in text
    these are doubled too."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return ("1" if value else "0") if dialect == "oracle" else str(value).upper()
    if isinstance(value, (int, Decimal)):
        return str(value)
    if isinstance(value, float):
        if not math.isfinite(value):
            raise RequestProblem(f"{value} has no literal")
        return repr(value) if dialect != "derby" else f"CAST({value!r} AS DOUBLE)"
    if isinstance(value, dt.datetime):
        text = value.isoformat(" ", "microseconds" if value.microsecond else "seconds")
        return f"toDateTime64('{text}', 6)" if dialect == "clickhouse" else f"TIMESTAMP('{text}')" if dialect == "derby" else f"TIMESTAMP '{text}'"
    if isinstance(value, dt.date):
        return f"toDate('{value}')" if dialect == "clickhouse" else f"TO_DATE('{value}', 'yyyy-MM-dd')" if dialect == "phoenix" else f"DATE('{value}')" if dialect == "derby" else f"DATE '{value}'"
    if isinstance(value, str):
        if "\0" in value:
            raise RequestProblem("text with a zero character")
        if dialect in ("mysql", "bigquery", "clickhouse", "spark"):
            value = value.replace("\\", "\\\\")
            return "'" + value.replace("'", "\\'" if dialect in ("bigquery", "spark") else "''") + "'"
        return "'" + value.replace("'", "''") + "'"
    raise RequestProblem(f"{type(value).__name__} has no literal")


def to_sql(r: Request, dialect: str, inline: bool = False) -> tuple[str, list]:
    """Text with placeholders, and the values for them; inline: with literals instead, and no values."""
    if dialect not in DIALECTS:
        raise RequestProblem(f"no dialect {dialect}")
    quote, mark, tuples, how = DIALECTS[dialect]
    end = quote[-1]
    ident = lambda n: quote.format(n.replace(end, end * 2))
    values: list = []

    def put(v) -> str:
        if inline:
            return literal(v, dialect)
        values.append(v)
        return mark.format(len(values))

    parts = []
    signs = {"eq": "=", "neq": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "like": "LIKE"}
    for w in r.where:
        c = ident(w.column)
        if w.op == "in":
            parts.append(f"{c} IN ({', '.join(put(v) for v in w.value)})" if w.value else ("1 = 0" if dialect in ("oracle", "derby", "phoenix") else "FALSE"))
        elif w.op in ("isNull", "isNotNull"):
            parts.append(f"{c} IS {'NOT ' * (w.op == 'isNotNull')}NULL")
        else:
            parts.append(f"{c} {signs[w.op]} {put(w.value)}")
    if r.keys:
        names = list(r.keys[0])
        if tuples and len(names) > 1 and all(list(k) == names for k in r.keys):
            rows = ", ".join(f"({', '.join(put(k[n]) for n in names)})" for k in r.keys)
            parts.append(f"({', '.join(map(ident, names))}) IN ({rows})")
        else:
            each = [" AND ".join(f"{ident(n)} = {put(v)}" for n, v in k.items()) for k in r.keys]
            parts.append("(" + " OR ".join(f"({e})" for e in each) + ")")
    if r.span and r.span.start is not None:
        parts.append(f"{ident(r.span.cursor)} > {put(r.span.start)}")
    if r.span and r.span.end is not None:
        parts.append(f"{ident(r.span.cursor)} <= {put(r.span.end)}")
    text = f"SELECT {', '.join(f'{ident(c)} AS {ident(o)}' for o, c in r.columns)} FROM {'.'.join(map(ident, r.relation.split('.')))}"
    if parts:
        text += " WHERE " + " AND ".join(parts)
    if r.order_by:
        if dialect == "mysql":
            text += " ORDER BY " + ", ".join(f"{ident(n)} IS NULL, {ident(n)} {d.upper()}" for n, d in r.order_by)
        else:
            text += " ORDER BY " + ", ".join(f"{ident(n)} {d.upper()} NULLS LAST" for n, d in r.order_by)
    if r.limit is not None:
        text += f" LIMIT {r.limit}" if how == "limit" else f" FETCH FIRST {r.limit} ROWS ONLY"
    return text, values
