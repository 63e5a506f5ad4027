"""A connector for folders of JSON lines as a schemaless document store: types are declared."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import types as T

from .. import types as ty
from .connector import Connector, value_of
from .request import OPERATORS, Capabilities, Request, Where


def like(text: str, pattern: str) -> bool:
    """SQL LIKE with backslash escapes."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
            continue
        out += ".*" if ch == "%" else "." if ch == "_" else re.escape(ch)
        i += 1
    return re.fullmatch(out, text, re.S) is not None


def holds(w: Where, value) -> bool:
    """Whether a filter is true of a value; nothing but isNull is true of null."""
    if w.op == "isNull":
        return value is None
    if value is None:
        return False
    match w.op:
        case "isNotNull":
            return True
        case "eq":
            return value == w.value
        case "neq":
            return value != w.value
        case "in":
            return value in w.value
        case "lt":
            return value < w.value
        case "le":
            return value <= w.value
        case "gt":
            return value > w.value
        case "ge":
            return value >= w.value
        case "like":
            return like(value, w.value)
    raise ValueError(w.op)


class JsonDocuments(Connector):
    """Options: path of a local or mounted folder, and fields as 'name:Type;name:Type'. A file is a
    partition."""

    def schema(self) -> T.StructType:
        pairs = [f.split(":", 1) for f in self.options["fields"].split(";")]
        return T.StructType([T.StructField(n.strip(), ty.to_spark(ty.parse(t))) for n, t in pairs])

    def capabilities(self) -> Capabilities:
        return Capabilities(frozenset(OPERATORS))

    def partitions(self, request: Request) -> list[dict]:
        folder = self.options["path"]
        return [{"file": f} for f in sorted(os.listdir(folder)) if f.endswith((".json", ".jsonl", ".ndjson"))] or [{}]

    def mark(self) -> object:
        folder = self.options["path"]
        return max((os.stat(f"{folder}/{f}").st_mtime_ns for f in os.listdir(folder)), default=0)

    def read(self, partition: dict, request: Request) -> Iterator[tuple]:
        if "file" not in partition:
            return
        fields = self.schema().fields
        place = {f.name: i for i, f in enumerate(fields)}
        with open(f"{self.options['path']}/{partition['file']}", encoding="utf-8") as lines:
            for line in lines:
                if line.strip():
                    doc = json.loads(line)
                    row = tuple(value_of(doc.get(f.name), f.dataType) for f in fields)
                    if all(holds(w, row[place[w.column]]) for w in request.where):
                        yield row
