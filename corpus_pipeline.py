"""A corpus cleaned, deduplicated, mixed and encoded: each stage works on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import exact_dedup, mixing, segmentation, simhash, toxicity
from marlstone.llm.common import SPACE_CLASS, cut, free_name, join_apart, row_name

#: No SQL expresses a learned classifier or sampled segmentations; the tests hold the stages against
#: brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs.columns, "toxicity_score")
    return toxicity.with_scores(docs, model, out=score).filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised text the one that op4 keeps stays, once."""
    sha, keep_doc, keep_sha = (free_name(docs.columns, n) for n in ("own_sha", "keep_doc", "keep_sha"))
    kept = exact_dedup.keep_longest(docs).filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy(F.col("doc_id").alias(keep_doc), F.col("text_sha256").alias(keep_sha))
    kept = cut(kept.agg(F.count(F.lit(1)).alias("n")))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn(sha, F.sha2(F.regexp_replace(text, SPACE_CLASS, ""), 256))
    found = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept[keep_doc]) & (keyed[sha] == kept[keep_sha]), "left_semi")
    if kept.filter("n > 1").isEmpty():
        return found.drop(sha)
    # rows with one id and equal texts: the longest stays, once
    row = F.max_by(F.struct(*docs.columns), F.struct(F.length(text), F.xxhash64(text))).alias("row")
    return found.groupBy("doc_id", sha).agg(row).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the smallest id stays, once; null is the last id."""
    a, b, keep_a, keep_b = (free_name(docs.columns, n) for n in ("row_a", "row_b", "keep_a", "keep_b"))
    keyed = docs.withColumns(dict(zip((a, b), row_name(docs))))
    marked = cut(simhash.fingerprints(keyed, keep=(a, b)))
    # the row names themselves settle ties, so a component keeps one of several rows without an id
    best = F.min(F.struct(F.col("id").isNull(), "id", a, b)).alias("best")
    kept = join_apart(marked, simhash.roots(marked), ["fp"]).groupBy("root").agg(best)
    kept = cut(kept.select(F.col(f"best.{a}").alias(keep_a), F.col(f"best.{b}").alias(keep_b)))
    found = keyed.join(kept, (keyed[a] == kept[keep_a]) & (keyed[b] == kept[keep_b]), "left_semi")
    return _once(found, marked, kept, (a, b), (keep_a, keep_b)).drop(a, b)


def _once(found: DataFrame, marked: DataFrame, kept: DataFrame, names: tuple[str, str], keep: tuple[str, str]) -> DataFrame:
    """found without repeats of rows that are alike in all columns; their texts travel only if there are
    any."""
    rows = marked.join(kept, (marked[names[0]] == kept[keep[0]]) & (marked[names[1]] == kept[keep[1]]), "left_semi")
    again = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return found if again.isEmpty() else found.dropDuplicates(list(names))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document; the one at a source's budget is cut there."""
    a, b, mix_key, size, cuts, cut_at = (free_name(docs.columns, n) for n in ("row_a", "row_b", "mix_key", "mix_size", "mix_cuts", "mix_cut"))
    keyed = docs.withColumns(dict(zip((a, b), row_name(docs))))
    name = F.concat(F.hex(a), F.lit("-"), F.hex(b))
    mixed = mixing.mix(keyed.select(name.alias(mix_key), "text", "source"), id_col=mix_key).filter("taken > 0")
    # -1 for each whole epoch, then where the partial one is cut
    times = F.concat(F.array_repeat(F.lit(-1), F.expr("cast(taken div size as int)")), F.when(F.expr("taken % size > 0"), F.array(F.expr("cast(taken % size as int)"))).otherwise(F.array().cast("array<int>")))
    mixed = mixed.withColumn("times", times).groupBy(mix_key).agg(F.flatten(F.sort_array(F.collect_list("times"))).alias(cuts), F.count(F.lit(1)).alias("n"))
    mixed = cut(mixed)
    if not mixed.filter("n > 1").isEmpty():  # rows alike in all columns: one takes for all
        keyed = keyed.dropDuplicates([a, b])
    keyed = keyed.withColumn(mix_key, name)
    rows = keyed.join(mixed.drop("n"), mix_key).withColumn(cut_at, F.explode(cuts))
    words = F.filter(F.split("text", f"{SPACE_CLASS}+"), lambda w: w != "")
    text = F.when(F.col(cut_at) < 0, F.col("text")).otherwise(F.array_join(F.slice(words, 1, F.greatest(F.lit(1), F.col(cut_at))), " "))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each row with their token ids, checked by decoding."""
    return segmentation.sample_segmentations(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
