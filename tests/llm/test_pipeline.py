"""The pipeline's stages against brute force, on their own inputs."""

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from marlstone.llm import toxicity
from marlstone.llm.queries import op3_sentencepiece_topk

from .test_dedup import brute_exact, brute_near


def documents(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet")


def test_stages_are_the_dealt_ones_in_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mix_sources", "sentencepiece"]


def test_each_stage_on_its_predecessor(spark, small_dir):
    docs = documents(spark, small_dir)
    model = toxicity.learn(docs, spark.read.parquet(f"{small_dir}/labels.parquet"))
    a = cp.cut(cp.drop_toxic(spark, docs, small_dir))
    assert sorted(a.collect()) == sorted(r for r in docs.collect() if model.score(r["text"]) < toxicity.THRESHOLD)

    b = cp.cut(cp.drop_exact_copies(spark, a, small_dir))
    want = {i for i, _, _, kept, _ in brute_exact([(r["doc_id"], r["text"]) for r in a.collect()]) if kept}
    assert b.columns == docs.columns and sorted(r["doc_id"] for r in b.collect()) == sorted(want)

    c = cp.cut(cp.drop_near_copies(spark, b, small_dir))
    want = [i for i, _, root in brute_near([(r["doc_id"], r["text"]) for r in b.collect()]) if i == root]
    assert c.columns == docs.columns and sorted(r["doc_id"] for r in c.collect()) == sorted(want)

    d = cp.cut(cp.mix_sources(spark, c, small_dir))
    size = {r["doc_id"]: len(r["text"].encode().split()) for r in c.collect()}
    taken = Counter()
    for r in d.collect():
        taken[r["doc_id"]] += len(r["text"].encode().split())
    assert d.columns == docs.columns
    assert all(n <= 3 * size[i] for i, n in taken.items())
    assert abs(sum(taken.values()) - sum(size.values())) <= c.select("source").distinct().count()

    e = cp.encode(spark, d, small_dir)
    assert e.filter("not round_trip").isEmpty() and e.filter("sample = 1").count() == d.count()


def test_run_gives_the_stages_result(spark, small_dir):
    out = cp.run(spark, small_dir)
    assert out.count() > 0 and out.filter("not round_trip").isEmpty()


def test_the_token_ids_come_out(spark, small_dir):
    docs = documents(spark, small_dir).limit(20)
    got = cp.encode(spark, docs, small_dir).collect()
    assert len(got) > 20 and all(len(r["ids"]) == r["n_pieces"] for r in got)
    assert "ids_sha256" in op3_sentencepiece_topk(spark, small_dir).columns


def test_op3_gives_the_token_ids_beside_their_digest(spark, small_dir):
    got = op3_sentencepiece_topk(spark, small_dir).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in documents(spark, small_dir).collect()}
    assert all(len(r["ids"]) == r["n_pieces"] for r in got)
    assert all(hashlib.sha256(np.array(r["ids"], dtype="<i4").tobytes()).hexdigest() == r["ids_sha256"] for r in got)


def few(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_one_row_of_a_component_stays_whatever_its_ids(spark, small_dir):
    a, b, c = (" ".join(f"{x}{n * n}" for n in range(60)) for x in "abc")
    rows = [(None, a), (None, a), (5, b), (None, b), (7, b), (3, c), (5, c)]
    got = cp.drop_near_copies(spark, few(spark, rows), small_dir).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("None", a), ("5", b), ("3", c)])


def test_rows_of_two_components_that_share_an_id(spark, small_dir):
    a, b, c = (" ".join(f"{x}{n * n}" for n in range(60)) for x in "abc")
    rows = [(1, a), (None, a), (5, a), (None, b), (5, c)]
    got = cp.drop_near_copies(spark, few(spark, rows), small_dir).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("1", a), ("None", b), ("5", c)])


def test_mix_takes_as_many_words_of_rows_alike(spark, small_dir):
    docs = few(spark, [(1, "a b c d")] * 6 + [(None, "e f")] * 5 + [(2, "g h i")]).withColumn("source", F.when(F.col("doc_id") == 2, "b").otherwise("a"))
    got = cp.mix_sources(spark, docs, small_dir).collect()
    assert sum(len(r["text"].split()) for r in got) == 6 * 4 + 5 * 2 + 3


def test_rows_of_one_id_that_differ_in_white_space_stay_once(spark, small_dir):
    got = cp.drop_exact_copies(spark, few(spark, [(1, "x y  z"), (1, "x y z"), (2, "x y z")]), small_dir).collect()
    assert [(r["doc_id"], r["text"]) for r in got] == [(1, "x y  z")]


def test_stages_on_odd_documents(spark, odd_docs, small_dir, no_docs):
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, odd_docs, small_dir)
        assert got.columns == odd_docs.columns, name
        assert got.count() >= 1, name
        assert stage(spark, no_docs, small_dir).count() == 0, name
    assert cp.encode(spark, odd_docs, small_dir).count() > 0
    kept = cp.drop_exact_copies(spark, odd_docs, small_dir).select("doc_id", "text").collect()
    assert Counter(r["doc_id"] for r in kept) == Counter([2, 5, 6, 7, 8, None]), kept


def test_clean_documents_stay(spark, small_dir):
    docs = documents(spark, small_dir)
    labels = spark.read.parquet(f"{small_dir}/labels.parquet").filter("toxic = 0").select("doc_id")
    clean = docs.join(labels, "doc_id", "left_semi")
    kept = cp.drop_toxic(spark, docs, small_dir).join(labels, "doc_id", "left_semi")
    assert kept.count() >= 0.95 * clean.count()
    assert docs.select(F.max("doc_id")).first()[0] is not None
