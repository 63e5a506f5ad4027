"""Queries over whole tables: nothing is left out by an id."""

import math
import os

import pytest

import __spark_entry__ as entry
from marlstone.operators import joins

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_places_over_several_slices(spark):
    from pyspark.sql import functions as F

    rows = [(k, None if k % 5 == 0 else k * 7919 % 13) for k in range(500)]
    df = spark.createDataFrame(rows, "k long, x long")
    got = joins.places(df, [F.col("x").asc_nulls_last(), F.col("k").asc()], "place", slice_rows=40)
    want = [k for k, _ in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))]
    assert [r["k"] for r in got.orderBy("place").collect()] == want
    assert {r["place"] for r in got.collect()} == set(range(1, 501))


def small_tables(spark, at):
    customers = [(k, f"c{k}", k % 25, float(k), "m") for k in range(1, 701)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame([(i, f"r{i}") for i in range(5)], "r_regionkey int, r_name string").write.parquet(f"{at}/region.parquet")
    vectors = [(i, [float((i * a) % 17 + 1) for a in (3, 5, 7)]) for i in range(250)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return customers, vectors


def test_spatial_and_vector_queries_take_every_row(spark, tmp_path):
    customers, vectors = small_tables(spark, tmp_path)
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    points = {k: (float(k % 100), n * 2.0) for k, _, n, _, _ in customers}
    assert {r["c_custkey"]: r["dist"] for r in run("geo_distance")} == {k: pytest.approx(math.hypot(*p)) for k, p in points.items()}
    away = lambda p, b: math.hypot(max(b - p[0], 0, p[0] - b - 10), max(-p[1], 0, p[1] - 10))
    assert {r["r_regionkey"]: r["n"] for r in run("enrich_around")} == {i: sum(away(p, i * 20) <= 5 for p in points.values()) for i in range(5)}
    near = {k: min(away(p, i * 20) for i in range(5)) for k, p in points.items()}
    assert {r["c_custkey"]: r["dist"] for r in run("enrich_nearest")} == {k: pytest.approx(x) for k, x in near.items() if x <= 8}

    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    want = {q: sorted((round(cosine(v, w), 6) for _, w in vectors), reverse=True)[:5] for q, v in vectors if q % 100 == 0}
    got: dict = {}
    for r in sorted(run("vector_top_k"), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["score"])
    assert got.keys() == want.keys() and all(got[q] == pytest.approx(want[q], abs=2e-6) for q in want)


@needs_data
def test_outer_joins_have_rows_without_a_partner(spark):
    right, full = (entry.queries()[n](spark, SF) for n in ("join_right", "join_full"))
    assert right.count() == spark.read.parquet(f"{SF}/orders.parquet").count() and not right.filter("p_partkey is null").isEmpty()
    assert not full.filter("p_partkey is null").isEmpty() and not full.filter("n_nationkey is null").isEmpty()
