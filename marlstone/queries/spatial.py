"""Geometry functions and spatial enrichment, over points and boxes made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators.enrich import Layer, Take, enrich, pyramid
from ..session import table
from . import query


def _points(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.col("c_acctbal").alias("w"), (F.col("c_custkey") % 100).cast("double").alias("x"), (F.col("c_nationkey") * 2).cast("double").alias("y")).withColumn("g", geo.st_point("x", "y"))


def _boxes(spark, d):
    """Boxes of 10 by 10 in a row, one per region, with a value."""
    r = table(spark, d, "region").withColumn("x", F.col("r_regionkey") * 20.0)
    text = F.format_string("POLYGON ((%f 0, %f 0, %f 10, %f 10, %f 0))", "x", F.col("x") + 10, F.col("x") + 10, "x", "x")
    return r.select("r_regionkey", (F.col("r_regionkey") + 1.0).alias("v"), geo.st_geomfromtext(text).alias("g"))


_IN = "px > bx and px < bx + 10 and py > 0 and py < 10"
_PT = "(select c_custkey, cast(c_custkey % 100 as double) as px, cast(c_nationkey * 2 as double) as py from customer)"
_BX = "(select r_regionkey, cast(r_regionkey + 1 as double) as v, cast(r_regionkey * 20 as double) as bx from region)"


@query("geo_measures", "select r_regionkey, 100.0::double as area, 'POLYGON ((' || cast(r_regionkey * 20 as int) || ' 0, ' || cast(r_regionkey * 20 + 10 as int) || ' 0, ' || cast(r_regionkey * 20 + 10 as int) || ' 10, ' || cast(r_regionkey * 20 as int) || ' 10, ' || cast(r_regionkey * 20 as int) || ' 0))' as wkt, cast(r_regionkey * 20 as double) as xmin, cast(r_regionkey * 20 + 10 as double) as xmax from region")
def measures(spark, d):
    b = _boxes(spark, d).withColumn("b", geo.st_bbox("g"))
    return b.select("r_regionkey", geo.st_area("g").alias("area"), geo.st_astext("g").alias("wkt"), F.col("b.xmin").alias("xmin"), F.col("b.xmax").alias("xmax"))


@query("geo_distance", "select c_custkey, round(sqrt(px * px + py * py), 9) as dist from " + _PT + " t")
def distance(spark, d):
    p = _points(spark, d).withColumn("o", geo.st_point(F.lit(0.0), F.lit(0.0)))
    return p.select("c_custkey", F.round(geo.st_distance("g", "o"), 9).alias("dist"))


@query("geo_box_intersects", "select c_custkey from " + _PT + " t where px between 10 and 30 and py between 5 and 20")
def box(spark, d):
    """Points in a box: plain comparisons first, which files can skip by, then the exact predicate."""
    p = _points(spark, d).filter("x between 10 and 30 and y between 5 and 20").withColumn("e", F.lit(bytearray(geo.st_make_envelope(10, 5, 30, 20))))
    return p.filter(geo.st_intersects("g", "e")).select("c_custkey")


@query("enrich_within", f"select c_custkey, max(v) as v, count(v) as n from {_PT} p left join {_BX} b on {_IN} group by c_custkey")
def within(spark, d):
    layer = Layer(_boxes(spark, d), "g", "within", (Take("v", "max", "v"), Take("n", "count")))
    return enrich(_points(spark, d).select("c_custkey", "g"), "c_custkey", "g", [layer], 10.0).select("c_custkey", "v", "n")


@query("enrich_contains_sum", f"select r_regionkey, count(c_custkey) as n, cast(sum(c_custkey) as bigint) as s from {_BX} b left join {_PT} p on {_IN} group by r_regionkey")
def contains(spark, d):
    pts = _points(spark, d).select("c_custkey", "g")
    return enrich(_boxes(spark, d).select("r_regionkey", "g"), "r_regionkey", "g", [Layer(pts, "g", "contains", (Take("n", "count"), Take("s", "sum", "c_custkey")))], 10.0).select("r_regionkey", "n", "s")


@query("enrich_around", f"select r_regionkey, count(c_custkey) as n from {_BX} b left join {_PT} p on greatest(bx - px, 0, px - bx - 10) ** 2 + greatest(-py, 0, py - 10) ** 2 <= 25 group by r_regionkey")
def around(spark, d):
    pts = _points(spark, d).select("c_custkey", "g")
    return enrich(_boxes(spark, d).select("r_regionkey", "g"), "r_regionkey", "g", [Layer(pts, "g", "intersects", (Take("n", "count"),), around=5.0)], 10.0).select("r_regionkey", "n")


@query("enrich_nearest", f"select c_custkey, min(dist) as dist from (select c_custkey, round(sqrt(greatest(bx - px, 0, px - bx - 10) ** 2 + greatest(-py, 0, py - 10) ** 2), 9) as dist from {_PT} p, {_BX} b) q where dist <= 8 group by 1")
def nearest(spark, d):
    layer = Layer(_boxes(spark, d), "g", "nearest", (Take("dist", "distance"),), k=1, max_distance=8.0)
    got = enrich(_points(spark, d).select("c_custkey", "g"), "c_custkey", "g", [layer], 10.0)
    return got.filter("dist is not null").select("c_custkey", F.round("dist", 9).alias("dist"))


_STRIP = "(select n_nationkey as k, cast(n_nationkey * 3 as double) as sx, cast(4 + n_regionkey as double) as w from nation)"


@query(
    "enrich_areal",
    f"""select k, round(sum(v * part / 10), 9) as extensive, round(sum(v * part) / sum(part), 9) as intensive from {_STRIP} s
    left join (select *, 10.0::double as side from {_BX} b) b on sx < bx + side and sx + w > bx
    left join lateral (select least(sx + w, bx + side) - greatest(sx, bx) as part) x on true group by k""",
)
def areal(spark, d):
    """Strips over the boxes take their share of each total, and the mean weighed by what they cover."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 3.0).alias("x"), (F.lit(4.0) + F.col("n_regionkey")).alias("w"))
    text = F.format_string("POLYGON ((%f 0, %f 0, %f 10, %f 10, %f 0))", "x", F.col("x") + F.col("w"), F.col("x") + F.col("w"), "x", "x")
    layer = Layer(_boxes(spark, d), "g", "intersects", (Take("extensive", "extensive", "v"), Take("intensive", "intensive", "v")))
    got = enrich(n.select("k", geo.st_geomfromtext(text).alias("g")), "k", "g", [layer], 10.0)
    met = F.col("extensive") > 0  # a strip that only touches a box has no part of it
    return got.select("k", F.round(F.when(met, F.col("extensive")), 9).alias("extensive"), F.round(F.when(met, F.col("intensive")), 9).alias("intensive"))


@query(
    "geo_hilbert_cells",
    """with recursive c as (
      select c_custkey, cast(floor((c_custkey % 100 + 180.0) / 360 * 65536) as bigint) as x, cast(floor((c_nationkey * 2 + 90.0) / 180 * 65536) as bigint) as y from customer
    ), h(c_custkey, x, y, s, d) as (
      select c_custkey, x, y, 32768::bigint, 0::bigint from c
      union all
      select c_custkey,
        case when ry = 0 then case when rx = 1 then s - 1 - (y & (s - 1)) else y & (s - 1) end else x & (s - 1) end,
        case when ry = 0 then case when rx = 1 then s - 1 - (x & (s - 1)) else x & (s - 1) end else y & (s - 1) end,
        s // 2, d + s * s * xor(3 * rx, ry)
      from (select *, case when (x & s) > 0 then 1::bigint else 0 end as rx, case when (y & s) > 0 then 1::bigint else 0 end as ry from h where s > 0) q
    ) select c_custkey, d as cell from h where s = 0""",
)
def hilbert_cells(spark, d):
    """Each customer's place on the curve."""
    return _points(spark, d).select("c_custkey", geo.hilbert_cell("x", "y").alias("cell"))


@query(
    "geo_concave_overlap",
    f"select k, round(sum(case when part <= 0 then 0 else part * 10 - (greatest(0, least(sx + w, bx + 7) - greatest(sx, bx + 3))) * 6 end), 9) as overlap from {_STRIP} s join {_BX} b on sx < bx + 10 and sx + w > bx join lateral (select least(sx + w, bx + 10) - greatest(sx, bx) as part) x on true group by k",
)
def concave(spark, d):
    """Strips that stand on two feet over the boxes with a notch: both are concave."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 3.0).alias("x"), (F.lit(4.0) + F.col("n_regionkey")).alias("w"))
    e = F.col("x") + F.col("w")
    # feet below the boxes' lower side, so that the overlap is the strip's
    strip = F.format_string("POLYGON ((%f -5, %f -5, %f -1, %f -1, %f -5, %f -5, %f 10, %f 10, %f -5))", "x", F.col("x") + 1, F.col("x") + 1, e - 1, e - 1, e, e, "x", "x")
    r = table(spark, d, "region").withColumn("b", F.col("r_regionkey") * 20.0)
    notched = F.format_string("POLYGON ((%f 0, %f 0, %f 10, %f 10, %f 4, %f 4, %f 10, %f 10, %f 0))", "b", F.col("b") + 10, F.col("b") + 10, F.col("b") + 7, F.col("b") + 7, F.col("b") + 3, F.col("b") + 3, "b", "b")
    met = n.withColumn("sg", geo.st_geomfromtext(strip)).join(F.broadcast(r.select("b", geo.st_geomfromtext(notched).alias("bg"))), (F.col("x") < F.col("b") + 10) & (e > F.col("b")))  # five regions
    return met.groupBy("k").agg(F.round(F.sum(geo.st_intersection_area("sg", "bg")), 9).alias("overlap"))


@query("geo_pyramid", "select z as zoom, cast(floor((px + 180) / 360 * 2 ** z * 32) as bigint) as cx, cast(floor((90 - py) / 180 * 2 ** z * 32) as bigint) as cy, count(*) as n from " + _PT + " t, (values (4), (3), (2)) l(z) group by all")
def pyramid_counts(spark, d):
    return pyramid(_points(spark, d), "x", "y", 4, 3).select("zoom", "cx", "cy", "n")


@query("geo_hilbert_order", "select true as same, true as near")
def hilbert(spark, d):
    """Places on the curve are distinct for distinct cells, and neighbours on it touch."""
    p = spark.range(256).select((F.col("id") % 16).alias("i"), F.floor(F.col("id") / 16).alias("j"))
    cell = 65536 / 16
    p = p.withColumn("h", F.floor(geo.hilbert_cell((F.col("i") + 0.5) * 360.0 / 16 - 180, (F.col("j") + 0.5) * 180.0 / 16 - 90) / (cell * cell)))
    from pyspark.sql import Window

    w = Window.orderBy("h")  # 256 rows
    step = p.select("h", (F.abs(F.col("i") - F.lag("i").over(w)) + F.abs(F.col("j") - F.lag("j").over(w))).alias("s"))
    return step.agg((F.count_distinct("h") == 256).alias("same"), (F.max("s") == 1).alias("near"))


@query("geo_tile_index", "select count(*) as n, cast(sum(c_custkey) % 18446744073709551616 as varchar) as checksum from customer")
def tile_index(spark, d):
    """Rows along the Hilbert curve lose none: the sum of ids mod 2^64 is the source's."""
    from ..operators.tiles import tile_index as index

    ordered, _, total = index(_points(spark, d).select("c_custkey", "g"), "g", "c_custkey", 4)
    return ordered.agg(F.count(F.lit(1)).alias("n")).withColumn("checksum", F.lit(str(total)))


@query("geo_vector_tile", "select true as has_bytes, true as repeatable, true as empty_elsewhere")
def vector_tile(spark, d):
    """The tile of all points twice, dealt in another way, and its neighbour; compared part by part."""
    from ..operators.tiles import tile_parts

    p = _points(spark, d).select("c_custkey", "g")
    dealt = p.repartition("c_custkey")
    one, two, none = (tile_parts(x, "g", "c_custkey", "customers", 1, i, 0) for x, i in ((dealt, 1), (p.repartition("g", "c_custkey"), 1), (dealt, 0)))
    size = lambda t, name: t.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0)).alias(name))
    same = one.join(two.withColumnRenamed("bytes", "again"), "part", "full").agg(F.coalesce(F.every(F.col("bytes").eqNullSafe(F.col("again"))), F.lit(True)).alias("repeatable"))
    sizes = size(one, "n").crossJoin(size(none, "other"))
    return sizes.crossJoin(same).select((F.col("n") > 0).alias("has_bytes"), "repeatable", ((F.col("other") == 0) | (F.col("other") < F.col("n"))).alias("empty_elsewhere"))


@query("geo_left_join", f"select c_custkey, r_regionkey from {_PT} p left join {_BX} b on {_IN}")
def left_join(spark, d):
    from ..operators.tiles import spatial_left_join

    pts = _points(spark, d).select("c_custkey", "g")
    boxes = _boxes(spark, d).select("r_regionkey", F.col("g").alias("z"))
    return spatial_left_join(pts, "c_custkey", "g", boxes, "z", "within", 10.0).select("c_custkey", F.col("right.r_regionkey").alias("r_regionkey"))


@query("geo_sql_functions", "select c_custkey, round(sqrt(px * px + py * py), 9) as dist from " + _PT + " t where px between 10 and 30 and py between 5 and 20")
def sql_functions(spark, d):
    """The same predicates by their SQL names."""
    geo.register(spark)
    _points(spark, d).createOrReplaceTempView("geo_points")
    box = "st_geomfromtext('POLYGON ((10 5, 30 5, 30 20, 10 20, 10 5))')"
    return spark.sql(f"select c_custkey, round(st_distance(g, st_point(0D, 0D)), 9) as dist from geo_points where x between 10 and 30 and y between 5 and 20 and st_intersects(g, {box})")
