"""Exact deduplication by content hash, with the bytes compared inside each hash group.

The texts travel once: partial aggregation over (128-bit hash, text) folds equal texts inside each
map task first, so a text copied onto a third of all rows arrives as one row per task. The group
key holds the normalised bytes themselves, so two texts that collide in the hash stay two groups.
Everything after that moves only ids, hashes and lengths.

Defined cases: a null text counts as empty; an empty table gives an empty result; repeated rows
each get a row, and all rows of the id and length that stay are kept, since nothing tells them apart; a
null id ranks after all others; two texts under both hashes stop the run; other columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS

_SHIFT = Decimal(2**65)
_TOP = Decimal(2**63)


def _wide(c):
    return c.cast("decimal(38,0)")


def keep_longest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the most code points before normalisation stays, then the smallest
    id. That order is packed in one decimal, which a hash aggregate can hold without sorting texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.regexp_replace(text, SPACE_CLASS, "").alias("norm"),
        F.length(text).cast("long").alias("points"),
    ).select(
        "id",
        "norm",
        F.unhex(F.md5("norm")).alias("key"),
        F.sha2("norm", 256).alias("sha"),
        # points * 2^65 + (2^63 - id); the second part is 0 for a null id and over 0 otherwise
        (
            _wide(F.col("points")) * F.lit(_SHIFT)
            + F.coalesce(F.lit(_TOP) - _wide(F.col("id")), F.lit(Decimal(0)))
        )
        .cast("decimal(38,0)")
        .alias("rank"),
    )
    texts = rows.groupBy("key", "sha", "norm").agg(
        F.count(F.lit(1)).alias("n"), F.max("rank").alias("best")
    )
    # The text leaves here. A second text under the same two hashes would make the join below
    # ambiguous, so it stops the run instead.
    groups = texts.groupBy("key", "sha").agg(
        F.max("n").alias("n"), F.max("best").alias("best"), F.count(F.lit(1)).alias("texts")
    )
    groups = groups.select(
        F.col("key"),
        F.col("sha"),
        F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share both hashes")).cast("long"))
        .otherwise(F.col("n"))
        .alias("group_size"),
        F.col("best"),
        (F.col("best") % F.lit(_SHIFT)).cast("decimal(38,0)").alias("rest"),
    ).select(
        "key",
        "sha",
        "group_size",
        "best",
        F.when(F.col("rest") > 0, (F.lit(_TOP) - F.col("rest")).cast("long")).alias("keep_id"),
    )
    # Both sides are dealt anew by one text of both hashes, not by the aggregation's partitions, so
    # that AQE can split the rows of a hot text.
    both = F.concat(F.hex("key"), "sha")
    return (
        rows.drop("norm")
        .withColumn("both", both)
        .join(groups.withColumn("both", both).drop("key", "sha"), "both")
        .select(
            F.col("id").alias(id_col),
            "keep_id",
            "group_size",
            (F.col("rank") == F.col("best")).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )
