"""Reads of origins with bounds: so many at once per origin, so many waiting, rows, bytes and seconds."""

from __future__ import annotations

import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession


class Rejected(RuntimeError):
    """The origin has no room for another read."""


class OverBudget(RuntimeError):
    """A read that was stopped for its rows, bytes or time; none of it is given."""


@dataclass(frozen=True)
class Bounds:
    at_once: int = 4
    waiting: int = 16
    rows: int = 100_000
    size: int = 64 << 20
    seconds: float = 30.0


class Gateway:
    """Answers small interactive reads as Arrow tables. What is over a bound is an error: a part of an
    answer would look like the whole. Large reads stay DataFrames and don't come here."""

    def __init__(self, spark: SparkSession, bounds: Bounds | None = None, **per_origin: Bounds):
        self.spark, self.bounds, self.per_origin = spark, bounds or Bounds(), per_origin
        self.metrics: Counter = Counter()
        self._room: dict[str, threading.BoundedSemaphore] = {}
        self._inside: Counter = Counter()
        self._lock = threading.Lock()

    def read(self, origin: str, make: Callable[[], DataFrame]) -> pa.Table:
        b = self.per_origin.get(origin, self.bounds)
        with self._lock:
            if self._inside[origin] >= b.at_once + b.waiting:
                self.metrics[f"{origin}.rejected"] += 1
                raise Rejected(f"{origin}: {b.at_once} reads and {b.waiting} waiting")
            self._inside[origin] += 1
            room = self._room.setdefault(origin, threading.BoundedSemaphore(b.at_once))
        end = time.monotonic() + b.seconds
        try:
            if not room.acquire(timeout=b.seconds):
                raise OverBudget(f"{origin}: waited {b.seconds} s")
            try:
                return self._run(origin, make, b, end)
            finally:
                room.release()
        except OverBudget:
            self.metrics[f"{origin}.over_budget"] += 1
            raise
        finally:
            with self._lock:
                self._inside[origin] -= 1

    def _run(self, origin: str, make: Callable[[], DataFrame], b: Bounds, end: float) -> pa.Table:
        tag = f"gateway-{uuid.uuid4().hex}"
        got: dict = {}

        def work() -> None:
            try:
                self.spark.sparkContext.addJobTag(tag)
                # one row more than allowed is enough to know
                got["table"] = make().limit(b.rows + 1).toArrow()
            except Exception as e:
                got["error"] = e

        t = InheritableThread(target=work, daemon=True)
        t.start()
        t.join(max(0.0, end - time.monotonic()))
        if t.is_alive():
            self.spark.sparkContext.cancelJobsWithTag(tag)
            raise OverBudget(f"{origin}: over {b.seconds} s")
        if "error" in got:
            self.metrics[f"{origin}.failed"] += 1
            raise got["error"]
        table = got["table"]
        if table.num_rows > b.rows:
            raise OverBudget(f"{origin}: over {b.rows} rows")
        if table.nbytes > b.size:
            raise OverBudget(f"{origin}: over {b.size} bytes")
        self.metrics[f"{origin}.reads"] += 1
        self.metrics[f"{origin}.rows"] += table.num_rows
        return table
