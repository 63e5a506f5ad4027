"""Any origin as a Spark relation: a connector says what it can evaluate, and reads in partitions.

A read carries its whole request - columns and filters - which is checked against what the connector
declares before anything is read. Spark filters what it is asked above the relation as always.
(Spark's own offer of filters to Python sources is not used: one DataFrame that serves two queries
would keep the first one's filters for the second.)
"""

from __future__ import annotations

import datetime as dt
import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .request import Capabilities, Request, RequestProblem, Where, check


def value_of(raw, kind: T.DataType):
    """A JSON value as a declared type, or an error."""
    if raw is None:
        return None
    match kind:
        case T.LongType():
            if isinstance(raw, bool) or not isinstance(raw, int):
                raise ValueError(f"{raw!r} is no integer")
            return raw
        case T.DoubleType():
            return float(raw)
        case T.DecimalType():
            return Decimal(str(raw)).quantize(Decimal(1).scaleb(-kind.scale))
        case T.BooleanType():
            return bool(raw)
        case T.DateType():
            return dt.date.fromisoformat(raw)
        case T.TimestampNTZType():
            return dt.datetime.fromisoformat(raw)
        case T.TimestampType():
            return dt.datetime.fromisoformat(raw.replace("Z", "+00:00"))
    return raw


@dataclass
class Connector:
    """Subclasses are named 'module:Class' and made from string options, on driver and executors."""

    options: dict[str, str] = field(default_factory=dict)

    def schema(self) -> StructType:
        raise NotImplementedError

    def capabilities(self) -> Capabilities:
        return Capabilities(frozenset(), limit=False, keys=False)

    def estimate(self) -> int | None:
        """Rows, if known without reading."""
        return None

    def mark(self) -> object:
        """The origin's position now, to be taken before reading."""
        return None

    def partitions(self, request: Request) -> list[dict]:
        """Independent pieces of the read, as JSON values."""
        return [{}]

    def read(self, partition: dict, request: Request) -> Iterator[tuple]:
        """Rows of the schema's columns in order, for which all filters of the request are true."""
        raise NotImplementedError


def load(name: str, options: dict[str, str]) -> Connector:
    module, _, cls = name.partition(":")
    made = getattr(importlib.import_module(module), cls)
    if not issubclass(made, Connector):
        raise TypeError(f"{name} is not a connector")
    return made(options)


def _json(value):
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    return str(value) if isinstance(value, Decimal) else value


def _written(where: tuple[Where, ...]) -> str:
    return json.dumps([[w.column, w.op, [_json(v) for v in w.value] if isinstance(w.value, (list, tuple)) else _json(w.value)] for w in where])


def _read_back(text: str, schema: StructType) -> tuple[Where, ...]:
    out = []
    for column, op, value in json.loads(text):
        if column not in schema.names:
            raise RequestProblem(f"no column {column}")
        kind = schema[column].dataType
        out.append(Where(column, op, [value_of(v, kind) for v in value] if isinstance(value, list) else value_of(value, kind)))
    return tuple(out)


@dataclass
class _Piece(InputPartition):
    value: str


class _Reader(DataSourceReader):
    def __init__(self, connector: Connector, request: Request):
        self.connector, self.request = connector, request
        names = connector.schema().names
        self.places = [names.index(c) for _, c in request.columns]

    def partitions(self) -> list[InputPartition]:
        return [_Piece(json.dumps(p)) for p in self.connector.partitions(self.request)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for row in self.connector.read(json.loads(partition.value), self.request):
            yield tuple(row[i] for i in self.places)


class ConnectorSource(DataSource):
    """spark.read.format("marlstone"); use over() for it."""

    @classmethod
    def name(cls) -> str:
        return "marlstone"

    def _connector(self) -> Connector:
        own = ("connector", "where", "columns")
        return load(self.options["connector"], {k: v for k, v in self.options.items() if k not in own})

    def _request(self) -> Request:
        connector = self._connector()
        schema = connector.schema()
        columns = json.loads(self.options.get("columns") or "null") or schema.names
        if unknown := [c for c in columns if c not in schema.names]:
            raise RequestProblem(f"no column {unknown[0]}")
        r = Request(self.options["connector"], tuple((c, c) for c in columns), _read_back(self.options.get("where") or "[]", schema))
        check(r, connector.capabilities())
        return r

    def schema(self) -> StructType:
        schema = self._connector().schema()
        return StructType([schema[c] for c, _ in self._request().columns])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._connector(), self._request())


def over(spark: SparkSession, connector: str, options: dict[str, str], where: tuple[Where, ...] = (), columns: list[str] | None = None) -> DataFrame:
    """The rows of an origin for which all filters hold. Nothing undeclared is asked for: such a
    request is rejected as a whole."""
    spark.dataSource.register(ConnectorSource)
    reader = spark.read.format("marlstone").option("connector", connector).options(**options)
    return reader.option("where", _written(where)).option("columns", json.dumps(columns)).load()


def wheres(predicate) -> tuple[list[Where], list]:
    """Conjuncts of a plan's predicate as filters of a request, and those that are none."""
    from ..plans import ir

    names = {"=": "eq", "<>": "neq", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}
    flip = {"lt": "gt", "gt": "lt", "le": "ge", "ge": "le"}
    taken, rest = [], []
    for e in ir.conjuncts(predicate):
        match e:
            case ir.Compare(op, ir.Col(c), ir.Lit(_, v)):
                taken.append(Where(c, names[op], v))
            case ir.Compare(op, ir.Lit(_, v), ir.Col(c)):
                taken.append(Where(c, flip.get(names[op], names[op]), v))
            case ir.In(ir.Col(c), values):
                taken.append(Where(c, "in", [v.value for v in values]))
            case ir.IsNull(ir.Col(c)):
                taken.append(Where(c, "isNull"))
            case ir.Not(ir.IsNull(ir.Col(c))):
                taken.append(Where(c, "isNotNull"))
            case _:
                rest.append(e)
    return taken, rest
