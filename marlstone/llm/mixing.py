"""Mixing sources to target weights.

Rows get a hash-random key, are cut into key ranges inside each source, and get the exact running
total of sizes before them from three small sums: over ranges of ranges, over ranges, and inside one
range. A hash key is uniform, so equal slices of it hold about equal row counts and no sampling pass
is needed; a source with a third of all rows just has more slices. No task ever holds a source.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; sizes
that are all 0 take nothing; repeated rows are mixed as separate rows; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import cut, word_count

#: Rows in a slice of the key, and slices in a slice of slices, about.
SLICE_ROWS = 1024
SLICE_FAN = 1024
#: No source gives more than so many times its size.
MOST_EPOCHS = 3
#: Alike rows that one task brings back at a time.
ALIKE_ROWS = 4096


def _targets(sizes: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """source totals -> targets: min(most * size, level * weight), level chosen so that they sum to
    the total. Weights go by the sources' order, so one task ranks them: it has a row for each source,
    whatever its documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(
        F.array(*[F.lit(float(x)) for x in weights]),
        (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    cap = (F.lit(most) * F.col("source_size")).cast("long")
    ranked = sizes.withColumn("weight", w).withColumn("cap", cap)
    ranked = ranked.withColumn("fill", F.col("cap") / F.col("weight"))
    # Sources reach their caps in order of fill = cap / weight. With those before a row capped, the
    # level of the others is (total - caps before) / weights from here on.
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    lvl = ranked.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("caps"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("left"),
    ).withColumn("level", (F.col("total") - F.col("caps")) / F.col("left"))
    open_ = F.col("fill") > F.col("level")
    level = F.first(F.when(open_, F.col("level")), ignorenulls=True).over(
        by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return lvl.withColumn("lvl", level).select(
        "source",
        "source_size",
        "n_rows",
        F.when(F.col("lvl").isNull() | (F.col("fill") <= F.col("lvl")), F.col("cap").cast("double"))
        .otherwise(F.col("weight") * F.col("lvl"))
        .alias("target"),
    )


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _apart(groups: DataFrame) -> DataFrame:
    """A row for each of a group's alike rows, each after the words of those before it; the rows of a
    large group are brought back by many tasks."""
    groups = cut(groups)
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {ALIKE_ROWS}")))
    blocks = groups.filter("copies > 1").withColumn("block", block).repartition("key", "block")
    last = F.least(F.col("copies"), (F.col("block") + 1) * ALIKE_ROWS) - 1
    several = blocks.withColumn("k", F.explode(F.sequence(F.col("block") * ALIKE_ROWS, last)))
    several = several.withColumn("before", F.col("before") + F.col("k") * F.col("size")).drop("block", "k")
    return groups.filter("copies = 1").unionByName(several).drop("copies")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    most: int = MOST_EPOCHS,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, source.

    Sources in code point order weigh `weights` in turn and share the total number of words; none
    passes `most` times its size. Each source's budget is its target rounded to whole words. Full
    epochs take every document; the last, partial epoch takes documents in key order and cuts the
    one at the budget, so the words taken equal the budget exactly.
    """
    id_ = F.col(id_col) if docs.schema[id_col].dataType == StringType() else F.col(id_col).cast("long")
    rows = docs.select(id_.alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = cut(rows.groupBy("source", "id", "size").agg(F.count(F.lit(1)).alias("copies")))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("size").cast("string")))
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    rows = rows.withColumn("key", key)
    targets = cut(_targets(sizes, weights, most))

    r = rows.alias("r")
    t = targets.alias("t")
    placed = (
        r.join(t, _same(F.col("r.source"), F.col("t.source")))
        .select("r.id", "r.source", "r.size", "r.copies", "r.key", "t.source_size", "t.target", "t.n_rows")
        .withColumn("slices", F.floor(F.col("n_rows") / SLICE_ROWS) + 1)
        .withColumn(
            "slice",
            F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("slices") / F.lit(2**32)),
        )
        .drop("slices", "n_rows")
    )
    placed = cut(placed)

    per_slice = placed.groupBy("source", "slice").agg(F.sum(F.col("size") * F.col("copies")).alias("s"))
    per_slice = per_slice.withColumn("band", F.floor(F.col("slice") / SLICE_FAN))
    per_band = per_slice.groupBy("source", "band").agg(F.sum("s").alias("s"))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    bands = per_band.select(
        "source",
        "band",
        F.coalesce(
            F.sum("s").over(up_to(Window.partitionBy("source").orderBy("band"))), F.lit(0)
        ).alias("before_band"),
    )
    slices = per_slice.select(
        "source",
        "slice",
        "band",
        F.coalesce(
            F.sum("s").over(up_to(Window.partitionBy("source", "band").orderBy("slice"))), F.lit(0)
        ).alias("before_slice"),
    )
    b, s = bands.alias("b"), slices.alias("s")
    starts = s.join(
        b, _same(F.col("s.source"), F.col("b.source")) & (F.col("s.band") == F.col("b.band"))
    ).select("s.source", "s.slice", (F.col("before_band") + F.col("before_slice")).alias("start"))

    inside = Window.partitionBy("source", "slice").orderBy("key", "id", "size")
    p = placed.withColumn(
        "within", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(up_to(inside)), F.lit(0))
    ).alias("p")
    s = starts.alias("s")
    full = p.join(
        s, _same(F.col("p.source"), F.col("s.source")) & (F.col("p.slice") == F.col("s.slice"))
    ).select("p.*", (F.col("start") + F.col("within")).alias("before"))
    full = full.drop("copies") if rows.filter("copies > 1").isEmpty() else _apart(full)
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5D) div source_size")).otherwise(0)
    rest = budget - F.col("epochs") * F.col("source_size") - F.col("before")
    return (
        full.withColumn("epochs", epochs)
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest)))
        .select(
            F.col("id").alias(id_col),
            "size",
            "source_size",
            "target",
            (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"),
            F.col("source").alias(source_col),
        )
    )
