"""Bounds of interactive reads."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from marlstone.sources.gateway import Bounds, Gateway, OverBudget, Rejected


def test_reads_within_bounds(spark):
    g = Gateway(spark)
    assert g.read("a", lambda: spark.range(10)).num_rows == 10 and g.metrics["a.rows"] == 10


def test_rows_bytes_and_time(spark):
    g = Gateway(spark, Bounds(rows=10, size=1000, seconds=3.0))
    with pytest.raises(OverBudget, match="rows"):
        g.read("a", lambda: spark.range(11))
    with pytest.raises(OverBudget, match="bytes"):
        g.read("a", lambda: spark.range(10).select(F.repeat(F.lit("x"), 1000)))
    began = time.monotonic()
    with pytest.raises(OverBudget, match=" s"):
        g.read("a", lambda: spark.range(0, 10**13, 1, 4).agg(F.sum(F.sin("id"))))
    assert time.monotonic() - began < 10 and g.metrics["a.over_budget"] == 3
    with pytest.raises(Exception, match="none"):
        g.read("a", lambda: spark.range(1).select("none"))
    assert g.metrics["a.failed"] == 1


def test_no_more_at_once_and_waiting_than_allowed(spark):
    g = Gateway(spark, Bounds(at_once=1, waiting=1, seconds=20.0))
    go, running, most, results = threading.Event(), [], [], []

    def slow():
        running.append(1)
        most.append(len(running))
        go.wait(10)
        running.pop()
        return spark.range(1)

    threads = [threading.Thread(target=lambda: results.append(g.read("a", slow).num_rows)) for _ in range(2)]
    for t in threads:
        t.start()
    time.sleep(1.0)
    with pytest.raises(Rejected):
        g.read("a", slow)
    assert g.read("b", lambda: spark.range(2)).num_rows == 2  # other origins have room of their own
    go.set()
    for t in threads:
        t.join(20)
    assert results == [1, 1] and max(most) == 1
