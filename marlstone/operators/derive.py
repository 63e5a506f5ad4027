"""Derived tables: declared inputs and outputs, and per-item results that are kept until their item,
function, version or parameters change."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_stack: list[Transform] = []


class Undeclared(ValueError):
    """A read or write that the transform does not name."""


class Transform:
    """A function of named inputs to one output. Inside it only these may be read and written; the
    output may be read too. Transforms don't nest."""

    def __init__(self, f: Callable, inputs: tuple[str, ...], output: str):
        self.f, self.inputs, self.output = f, inputs, output
        self.read: list[str] = []

    @contextlib.contextmanager
    def _running(self):
        if _stack:
            raise Undeclared(f"{self.f.__name__} inside {_stack[-1].f.__name__}")
        _stack.append(self)
        self.read = []
        try:
            yield
        finally:
            _stack.pop()

    def __call__(self, load: Callable[[str], DataFrame], save: Callable[[str, DataFrame], None]) -> dict:
        """Runs and saves; returns what was read and written."""

        def over(name: str) -> DataFrame:
            if name not in (*self.inputs, self.output):
                raise Undeclared(f"{name} is not an input of {self.f.__name__}")
            self.read.append(name)
            return load(name)

        with self._running():
            save(self.output, self.f(over))
        return {"function": self.f.__name__, "read": sorted(set(self.read)), "written": [self.output]}


def transform(inputs: list[str], output: str):
    return lambda f: Transform(f, tuple(inputs), output)


def derivation_key(version: str, name: str, parameters: dict) -> str:
    return json.dumps([name, version, parameters], sort_keys=True)


def derive_items(items: DataFrame, kept: DataFrame | None, f: Callable[[dict], list[dict]], name: str, version: str, parameters: dict, columns: str) -> DataFrame:
    """items (path, digest, ...) -> rows with _item, _anchor_id, _anchor, _derivation, _status and the
    function's own columns.

    Rows of `kept` whose item and derivation still stand are taken over; only other items are
    computed, in batches on the executors; rows of items that are gone go. An item on which the
    function fails gives one row with the error as its status.
    """
    key = derivation_key(version, name, parameters)
    ids = F.sha2(F.concat_ws("|", F.lit(key), F.col("path"), F.col("digest")), 256)
    now = items.withColumn("_derivation", ids)
    schema = f"_item string, _anchor_id string, _anchor int, _derivation string, _status string, {columns}"
    names = [c.strip().split(" ")[0] for c in columns.split(",")]
    inputs = now.columns

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                head = {"_item": row["path"], "_derivation": row["_derivation"]}
                try:
                    got = [head | {"_status": "ok"} | {n: r.get(n) for n in names} for r in f({k: row[k] for k in inputs if k != "_derivation"})]
                except Exception as e:  # an item's failure is a row, not the job's end
                    got = [head | {"_status": f"error: {e}"} | dict.fromkeys(names)]
                for i, r in enumerate(got):
                    r["_anchor"] = i
                    r["_anchor_id"] = f"{row['_derivation'][:32]}-{i}"
                if got:
                    yield pa.RecordBatch.from_pylist(got, schema=pa.schema([(n, types[n]) for n in order]))

    empty = items.sparkSession.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(empty.schema)
    order, types = arrow.names, {f.name: f.type for f in arrow}
    if kept is None:
        return now.mapInArrow(batches, empty.schema)
    fresh = now.join(kept.select("_derivation").distinct(), "_derivation", "left_anti").select(*inputs)
    stay = kept.join(now.select("_derivation"), "_derivation", "left_semi").select(*order)
    return stay.unionByName(fresh.mapInArrow(batches, empty.schema))
