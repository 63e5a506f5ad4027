"""Tiles of a spatial table: an index along the Hilbert curve, one tile's bytes, spatial left joins."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, mvt
from .delta import stored
from .enrich import Layer, Take, pairs
from .joins import places

#: Features of a tile that the driver puts together; beyond it tile_bytes refuses, and tile_parts or a pyramid serves.
MOST_FEATURES = 200_000
#: Features in one part of a tile that the executors put together.
PART_FEATURES = 10_000


def tile_index(df: DataFrame, geometry: str, id_col: str, cuts: int) -> tuple[DataFrame, list[int], int]:
    """df with its box and Hilbert place, dealt in `cuts` ranges and sorted inside them; the inner cut
    places (approximate quantiles); and the sum of all ids mod 2^64, to compare with the source's."""
    box = f"{geometry}_bbox"
    df = df.withColumn(box, geo.st_bbox(geometry))
    mid = lambda a, b: (F.col(f"{box}.{a}") + F.col(f"{box}.{b}")) / 2
    df = df.withColumn("hilbert", geo.hilbert_cell(mid("xmin", "xmax"), mid("ymin", "ymax")))
    places, total = df.agg(F.percentile_approx("hilbert", [i / cuts for i in range(1, cuts)] or [0.5], 1000), F.sum(F.col(id_col).cast("decimal(38,0)"))).first()
    ordered = df.repartitionByRange(cuts, "hilbert").sortWithinPartitions("hilbert", id_col)
    return ordered, sorted(set(places or [])), int(total or 0) % (1 << 64)


def _cut(df: DataFrame, geometry: str, id_col: str, z: int, x: int, y: int) -> DataFrame:
    """The features of a tile of a table in degrees: id, Hilbert place, type, commands. Rows outside are
    skipped by their box, and geometry is cut on the executors."""
    x0, y0, x1, y1 = mvt.tile_bounds(z, x, y)
    pad = (x1 - x0) * mvt.BUFFER / mvt.EXTENT
    lon = lambda m: m / mvt.HALF_WORLD * 180
    lat = lambda m: math.degrees(2 * math.atan(math.exp(m / mvt.HALF_WORLD * math.pi)) - math.pi / 2)
    box = f"{geometry}_bbox"
    if box not in df.columns:
        df = df.withColumn(box, geo.st_bbox(geometry))
    near = df.filter((F.col(f"{box}.xmin") <= lon(x1 + pad)) & (F.col(f"{box}.xmax") >= lon(x0 - pad)) & (F.col(f"{box}.ymin") <= lat(y1 + pad)) & (F.col(f"{box}.ymax") >= lat(y0 - pad)))
    mid = lambda a, b: (F.col(f"{box}.{a}") + F.col(f"{box}.{b}")) / 2

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [(i, h, k, c) for i, h, g in zip(*(col.to_pylist() for col in batch.columns)) if g is not None for k, c in mvt.features(geo.decode(g), z, x, y)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], ["id", "h", "kind", "commands"])

    return near.select(F.col(id_col).cast("long").alias("id"), geo.hilbert_cell(mid("xmin", "xmax"), mid("ymin", "ymax")).alias("h"), geometry).mapInArrow(batches, "id long, h long, kind int, commands binary")


_ORDER = ("h", "id", "kind", "commands")


def tile_bytes(df: DataFrame, geometry: str, id_col: str, layer: str, z: int, x: int, y: int) -> bytes:
    """The tile on the driver, for reading one at a time: up to a bound, beyond which tile_parts has it."""
    got = _cut(df, geometry, id_col, z, x, y).orderBy(*_ORDER).limit(MOST_FEATURES + 1).collect()
    if len(got) > MOST_FEATURES:
        raise ValueError(f"tile {z}/{x}/{y} has over {MOST_FEATURES} features")
    return mvt.tile(layer, [(r["id"], r["kind"], bytes(r["commands"])) for r in got])


def tile_parts(df: DataFrame, geometry: str, id_col: str, layer: str, z: int, x: int, y: int, part_features: int = PART_FEATURES) -> DataFrame:
    """The whole tile, however many features it has, as rows (part, bytes) that make it in their order;
    none, if it has none. Features are placed and put together on the executors; the driver sees the
    sum of their lengths. Parts are cut by place, so equal tiles have equal parts."""
    encode = F.pandas_udf(_feature, "binary")
    cut = stored(_cut(df, geometry, id_col, z, x, y))
    placed = places(cut, [F.col(c).asc() for c in _ORDER], "place").select("place", encode("id", "kind", "commands").alias("feature"))
    part = F.floor((F.col("place") - 1) / part_features) + 1
    parts = stored(placed.groupBy(part.alias("part")).agg(F.expr("listagg(feature) within group (order by place)").alias("bytes")))
    size, last = parts.agg(F.sum(F.length("bytes")), F.max("part")).first()
    ends = [(n, bytearray(b)) for n, b in zip((0, last + 1), mvt.layer_ends(layer, size))] if last else []
    return parts.unionByName(df.sparkSession.createDataFrame(ends, "part long, bytes binary"))


def _feature(ids: pd.Series, kinds: pd.Series, commands: pd.Series) -> pd.Series:
    return pd.Series([mvt.feature(int(i), int(k), bytes(c)) for i, k, c in zip(ids, kinds, commands)], dtype=object)


def spatial_left_join(left: DataFrame, id_col: str, left_geometry: str, right: DataFrame, right_geometry: str, relation: str, cell: float) -> DataFrame:
    """Each left row with each right row that it lies within (contains, intersects); rows without one
    once, with nulls. The inner pairs are found by cells and met again by the left row's id."""
    layer = Layer(right.withColumn("__right", F.struct(*right.columns)), right_geometry, relation, (Take("n", "count"),))
    met = pairs(left, id_col, left_geometry, layer, cell).select(F.col("t").alias("__t"), "__right")
    return left.join(met, left[id_col] == met["__t"], "left").drop("__t").withColumnRenamed("__right", "right")


def geo_contract(df: DataFrame, geometry: str, srid: Column | None = None) -> tuple[str, int | None]:
    """The one geometry type of a column (Any, if several) and its one SRID; two SRIDs are an error.
    Types and SRIDs are distinct values of a small domain."""
    kinds = F.pandas_udf(_kinds, "string")
    row = df.filter(F.col(geometry).isNotNull()).agg(F.collect_set(kinds(geometry)), F.collect_set(srid if srid is not None else F.lit(None).cast("int"))).first()
    if len(row[1]) > 1:
        raise ValueError(f"{geometry} mixes SRIDs {sorted(row[1])}")
    return (row[0][0] if len(row[0]) == 1 else "Any"), (row[1][0] if row[1] else None)


def _kinds(s: pd.Series) -> pd.Series:
    return s.map(lambda v: "".join(geo.decode(v)[:2]))
