"""Exact quantiles of groups of any size, from counted values instead of held ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .delta import stored
from .joins import running_sum


def quantiles(df: DataFrame, by: list[str], column: str, wanted: dict[str, float], discrete: bool = False) -> DataFrame:
    """For each group its quantiles of a column, each output named with its share; null without values.

    A continuous one lies between the two values around its place, a discrete one is the first value
    with so great a share at or below it. Values are counted, and their running counts over ranges give
    the values at these places: no group's values are ever together in one task.
    """
    counted = stored(df.groupBy(*by, F.col(column).alias("__v")).agg(F.count(column).alias("__n")))
    total = counted.groupBy(*[F.col(b).alias(f"__by{i}") for i, b in enumerate(by)]).agg(F.sum("__n").alias("__total"))
    upto = running_sum(counted, by, [F.col("__v").asc_nulls_first()], "__n", "__upto")
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"__by{i}")) for i, b in enumerate(by)], F.lit(True))
    placed = upto.join(total, same)
    at = lambda place: F.min(F.when(F.col("__upto") > place, F.col("__v")))
    found, out = [], []
    for i, (name, share) in enumerate(wanted.items()):
        if discrete:
            found.append(at(F.greatest(F.ceil(F.col("__total") * share), F.lit(1)) - 1).alias(f"__lo{i}"))
            out.append(F.col(f"__lo{i}").alias(name))
        else:
            place = (F.col("__total") - 1) * F.lit(float(share))
            found += [at(F.floor(place)).alias(f"__lo{i}"), at(F.ceil(place)).alias(f"__hi{i}"), F.max(place - F.floor(place)).alias(f"__part{i}")]
            out.append(F.when(F.col(f"__lo{i}") == F.col(f"__hi{i}"), F.col(f"__lo{i}").cast("double")).otherwise(F.col(f"__lo{i}") * (1 - F.col(f"__part{i}")) + F.col(f"__hi{i}") * F.col(f"__part{i}")).alias(name))
    return placed.groupBy(*by).agg(*found).select(*by, *out)
