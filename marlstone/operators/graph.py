"""Declared links between entities as two-column edges, and bounded traversal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .delta import stored


@dataclass(frozen=True)
class Link:
    name: str
    via: tuple[str, ...]  # columns that hold the other entity's key


@dataclass(frozen=True)
class Entity:
    name: str
    key: tuple[str, ...]
    links: tuple[Link, ...] = ()


def edges(entity: Entity, rows: DataFrame) -> dict[str, DataFrame]:
    """For each link (source, target), without nulls. A key or link of several columns is skipped: no
    one declared how to write a tuple as a value."""
    if len(entity.key) != 1:
        return {}
    return {l.name: rows.select(F.col(entity.key[0]).alias("source"), F.col(l.via[0]).alias("target")).filter("source is not null and target is not null") for l in entity.links if len(l.via) == 1}


def reach(start: DataFrame, links: DataFrame, hops: int) -> DataFrame:
    """(node, hop): nodes within so many hops of `start` (node), each at its least hop."""
    seen = start.select("node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for h in range(1, hops + 1):
        new = front.join(links, front["node"] == links["source"]).select(F.col("target").alias("node")).distinct()
        front = stored(new.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(h)))
        seen = seen.unionByName(front)
    return seen
