"""Functions whose arguments and results are held to declared types."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
import datetime as dt

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as ty
from ..types import Type


class ContractProblem(ValueError):
    """A value outside its declared type."""


@dataclass(frozen=True)
class Parameter:
    name: str
    type: Type
    nullable: bool = False


_PYTHON = {"String": str, "Integer": int, "Float": float, "Boolean": bool, "Date": dt.date, "DateTime": dt.datetime, "DateTimeTz": dt.datetime, "Binary": (bytes, bytearray), "Decimal": Decimal, "list": (list, tuple), "Struct": dict, "Vector": (list, tuple)}


def checked(value, t: Type, nullable: bool, where: str):
    """value, or ContractProblem: no conversion is made."""
    if value is None:
        if nullable:
            return None
        raise ContractProblem(f"{where} is null")
    kind = _PYTHON.get(t.name, object)
    if not isinstance(value, kind) or (t.name in ("Integer", "Float") and isinstance(value, bool)):
        raise ContractProblem(f"{where}: {type(value).__name__} is no {t}")
    match t.name:
        case "Integer" if not -(2**63) <= value < 2**63:
            raise ContractProblem(f"{where} is over 64 bits")
        case "Decimal":
            p, s = t.digits
            exponent = value.as_tuple().exponent
            if not isinstance(exponent, int) or -exponent > s or value.adjusted() >= p - s:
                raise ContractProblem(f"{where}: {value} doesn't fit {t}")
        case "list":
            return [checked(x, t.item, True, f"{where}[{i}]") for i, x in enumerate(value)]
        case "Struct":
            if value.keys() != {n for n, _ in t.fields}:
                raise ContractProblem(f"{where} has fields {sorted(value)}")
            return {n: checked(value[n], f, True, f"{where}.{n}") for n, f in t.fields}
        case "Vector" if len(value) != t.size:
            raise ContractProblem(f"{where} has {len(value)} components")
    return value


def scalar(f: Callable, parameters: list[Parameter], returns: Type, nullable: bool = False):
    """f as a column function by Arrow batches; a null for a parameter that takes none gives null."""

    def batch(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns):
            row = [None if _missing(v) else _python(v, p.type) for v, p in zip(row, parameters)]
            if any(v is None and not p.nullable for v, p in zip(row, parameters)):
                out.append(None)
                continue
            args = [checked(v, p.type, p.nullable, p.name) for v, p in zip(row, parameters)]
            out.append(checked(f(*args), returns, nullable, "result"))
        return pd.Series(out, dtype="object")

    return F.pandas_udf(_with_arity(batch, len(parameters)), ty.to_spark(returns))


def _with_arity(batch, n: int):
    """pandas_udf reads the number of columns from the signature."""
    names = ", ".join(f"c{i}" for i in range(n))
    hints = ", ".join(f"c{i}: pd.Series" for i in range(n))
    space = {"batch": batch, "pd": pd}
    exec(f"def run({hints}) -> pd.Series:\n    return batch({names})", space)
    return space["run"]


def _missing(v) -> bool:
    return v is None or (isinstance(v, float) and pd.isna(v)) or v is pd.NaT


def _python(v, t: Type):
    if t.name == "Integer":
        return int(v)
    if t.name == "Float":
        return float(v)
    if t.name == "Boolean":
        return bool(v)
    if t.name in ("list", "Vector"):
        return list(v)
    return v.to_pydatetime() if isinstance(v, pd.Timestamp) else v


def table(f: Callable, parameters: list[Parameter], returns: Type):
    """f as a table function for lateral joins: a list gives a row per item, a struct one row, and
    anything else one row with the column value."""
    if returns.name == "list" and returns.item.name == "Struct":
        schema = ty.to_spark(returns.item)
    elif returns.name == "Struct":
        schema = ty.to_spark(returns)
    else:
        schema = T.StructType([T.StructField("value", ty.to_spark(returns.item if returns.name == "list" else returns))])

    class Rows:
        def eval(self, *args):
            if any(a is None and not p.nullable for a, p in zip(args, parameters)):
                return
            got = checked(f(*[checked(a, p.type, p.nullable, p.name) for a, p in zip(args, parameters)]), returns, True, "result")
            for item in got if returns.name == "list" else [got]:
                yield tuple(item[n.name] for n in schema.fields) if isinstance(item, dict) else (item,)

    return F.udtf(Rows, returnType=schema)


def register_table(spark: SparkSession, name: str, f: Callable, parameters: list[Parameter], returns: Type):
    made = table(f, parameters, returns)
    spark.udtf.register(name, made)
    return made
