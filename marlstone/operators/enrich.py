"""Spatial enrichment: rows with a geometry take values from layers by where they are.

Geometries meet by equal grid cells of their boxes, then by the exact predicate; each pair meets in
one cell, so nothing is deduplicated afterwards. The target keeps all its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

RELATIONS = ("within", "contains", "intersects", "nearest")
METHODS = ("value", "sum", "avg", "min", "max", "count", "distance", "extensive", "intensive", "majority")


@dataclass(frozen=True)
class Take:
    output: str
    method: str
    column: str | None = None


@dataclass(frozen=True)
class Layer:
    """relation of the target to the layer: the target lies within, contains, or intersects the
    layer's geometry, or the k nearest within max_distance. around: buffer of the target."""

    rows: DataFrame
    geometry: str
    relation: str
    take: tuple[Take, ...]
    around: float = 0.0
    k: int = 1
    max_distance: float | None = None


def _cells(df: DataFrame, box: str, size: float, pad: float, prefix: str) -> DataFrame:
    low = lambda c: F.floor((F.col(f"{box}.{c}") - pad) / F.lit(size))
    high = lambda c: F.floor((F.col(f"{box}.{c}") + pad) / F.lit(size))
    return df.filter(F.col(f"{box}.xmin").isNotNull()).withColumn(f"{prefix}x", F.explode(F.sequence(low("xmin"), high("xmax")))).withColumn(f"{prefix}y", F.explode(F.sequence(low("ymin"), high("ymax"))))


def pairs(target: DataFrame, id_col: str, geometry: str, layer: Layer, cell: float) -> DataFrame:
    """Target id and layer row number with what the methods need: columns t, l, distance, area, whole."""
    pad = layer.around + (layer.max_distance or 0.0)
    t = target.select(F.col(id_col).alias("t"), F.col(geometry).alias("tg")).filter("tg is not null").withColumn("tb", geo.st_bbox("tg"))
    l = layer.rows.withColumn("lg", F.col(layer.geometry)).filter("lg is not null").withColumn("lb", geo.st_bbox("lg"))
    a, b = _cells(t, "tb", cell, pad, "c"), _cells(l, "lb", cell, 0.0, "c")
    met = a.join(b, ["cx", "cy"])
    # of all cells that both touch only the one with their common low corner keeps the pair
    corner = lambda c: F.floor(F.greatest(F.col(f"tb.{c}") - pad, F.col(f"lb.{c}")) / F.lit(cell))
    met = met.filter((F.col("cx") == corner("xmin")) & (F.col("cy") == corner("ymin")))
    met = met.filter((F.col("lb.xmin") <= F.col("tb.xmax") + pad) & (F.col("lb.xmax") >= F.col("tb.xmin") - pad) & (F.col("lb.ymin") <= F.col("tb.ymax") + pad) & (F.col("lb.ymax") >= F.col("tb.ymin") - pad))
    if layer.relation == "nearest":
        met = met.withColumn("distance", geo.st_distance("tg", "lg")).filter(F.col("distance") <= F.lit(layer.max_distance))
        w = Window.partitionBy("t").orderBy("distance", F.xxhash64("lg"))
        met = met.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= layer.k).drop("n")
    elif layer.around:
        met = met.withColumn("distance", geo.st_distance("tg", "lg")).filter(F.col("distance") <= F.lit(layer.around))
    else:
        test = {"within": geo.st_contains("lg", "tg"), "contains": geo.st_contains("tg", "lg"), "intersects": geo.st_intersects("tg", "lg")}[layer.relation]
        met = met.filter(test).withColumn("distance", F.lit(0.0))
    if any(x.method in ("extensive", "intensive", "majority", "value") for x in layer.take):
        if layer.relation == "intersects" and not layer.around:
            met = met.withColumn("area", geo.st_intersection_area("tg", "lg")).withColumn("whole", geo.st_area("lg"))
        else:
            met = met.withColumn("area", F.lit(0.0)).withColumn("whole", F.lit(None).cast("double"))
    return met.drop("cx", "cy", "tb", "lb", "tg")


def _taken(x: Take, layer: Layer) -> Column:
    c = F.col(x.column) if x.column else None
    match x.method:
        case "count":
            return F.count(F.lit(1))
        case "distance":
            return F.min("distance")
        case "value":  # of several the one with the largest overlap, then the nearest
            return F.max_by(c, F.struct("area", -F.col("distance"), F.xxhash64("lg")))
        case "extensive":
            return F.sum(F.try_divide(c * F.col("area"), F.col("whole")))
        case "intensive":
            return F.try_divide(F.sum(c * F.col("area")), F.sum("area"))  # null where all only touch
        case "sum" | "avg" | "min" | "max":
            return getattr(F, x.method)(c)
    raise ValueError(f"no method {x.method!r}")


def enrich(target: DataFrame, id_col: str, geometry: str, layers: list[Layer], cell: float) -> DataFrame:
    """target with an output column for each take of each layer; counts are 0 where nothing is met.
    cell: the grid's width, near the size of a usual layer geometry."""
    out = target
    for layer in layers:
        if layer.relation not in RELATIONS or any(x.method not in METHODS for x in layer.take):
            raise ValueError(f"unknown relation or method in {layer.relation}")
        if layer.relation == "nearest" and layer.max_distance is None:
            raise ValueError("nearest needs max_distance: without a bound it would meet every pair")
        met = pairs(target, id_col, geometry, layer, cell)
        plain = [x for x in layer.take if x.method != "majority"]
        got = met.groupBy("t").agg(*[_taken(x, layer).alias(x.output) for x in plain] or [F.count(F.lit(1)).alias("__n")])
        for x in (x for x in layer.take if x.method == "majority"):
            each = met.groupBy("t", F.col(x.column).alias("v")).agg(F.sum("area").alias("a"))
            best = each.groupBy("t").agg(F.min_by("v", F.struct(-F.col("a"), "v")).alias(x.output))
            got = got.join(best, "t", "left")
        got = got.drop("__n")
        out = out.join(got, out[id_col] == got["t"], "left").drop("t")
        for x in layer.take:
            if x.method == "count":
                out = out.withColumn(x.output, F.coalesce(x.output, F.lit(0)))
    return out


def spatial_order(df: DataFrame, geometry: str, partitions: int) -> DataFrame:
    """df with a covering <geometry>_bbox and its rows along the Hilbert curve of box centres."""
    box = f"{geometry}_bbox"
    df = df.withColumn(box, geo.st_bbox(geometry))
    mid = lambda a, b: (F.col(f"{box}.{a}") + F.col(f"{box}.{b}")) / 2
    return df.withColumn("__h", geo.hilbert_cell(mid("xmin", "xmax"), mid("ymin", "ymax"))).repartitionByRange(partitions, "__h").sortWithinPartitions("__h").drop("__h")


def pyramid(points: DataFrame, x: str, y: str, zoom: int, levels: int, cells: int = 32) -> DataFrame:
    """Counts by square cells of Web-Mercator-like tiles: `cells` by `cells` in a tile at each zoom,
    each coarser level rolled up from the finer one by a shift, never from the points."""
    n = F.lit(float((1 << zoom) * cells))
    base = points.select(
        F.floor((F.col(x) + 180.0) / 360.0 * n).alias("cx"),
        F.floor((F.lit(90.0) - F.col(y)) / 180.0 * n).alias("cy"),
    ).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")).withColumn("zoom", F.lit(zoom))
    out, level = base, base
    for z in range(zoom - 1, zoom - levels, -1):
        level = level.groupBy(F.shiftright("cx", 1).alias("cx"), F.shiftright("cy", 1).alias("cy")).agg(F.sum("n").alias("n")).withColumn("zoom", F.lit(z))
        out = out.unionByName(level)
    side = cells.bit_length() - 1
    return out.select("zoom", F.shiftright("cx", side).alias("tile_x"), F.shiftright("cy", side).alias("tile_y"), "cx", "cy", "n")
