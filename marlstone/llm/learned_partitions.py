"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is cut into balanced parts with few edges across, and a small
network learns to tell a vector's part, with the parts of its neighbours as soft targets. All rows
are then indexed: each goes to its most probable part. A query goes to its several most probable
parts and is compared with all vectors there, in double precision. How many parts a query needs is
measured on sample rows kept out of the training, for a stated recall; the sample is thinner than
the table, so neighbours there are farther and the measured recall errs low. Where parts hold very
many rows there is a second level: each part is cut again by a network of its own, fitted on a
bounded sample of its rows, and both levels together have the stated recall.

A part is compared in cells of bounded blocks of candidates and of queries, so a part that grows,
or a vector copied onto a third of all rows, means more cells and no larger one. Of equal vectors
only the k + 1 with the smallest ids can be among anyone's k nearest (ties go to smaller ids, one
may be the query itself), so no others go on.

Defined cases: vectors that are null, all zero, or hold a null or non-finite component take no part,
nor do rows with a null id; a vector meets those of its own length, of which the most frequent one
in the sample is partitioned and every other is searched whole; rows with one id are rows of their
own, as queries and as candidates; an empty table gives no rows; with fewer than k candidates all
are returned; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows the index is fitted on at most (smallest hash of the id), and of these the rows kept out.
SAMPLE_ROWS = 8192
HELD_ROWS = 512
#: Neighbours of a graph node, rows a part should have, and bounds of the number of parts.
GRAPH_K = 10
PART_ROWS = 16
PARTS = (8, 256)
HIDDEN = 96
TARGET_RECALL = 0.95
#: Rows of a part from which the parts are cut again, and into how many at most.
SECOND_ROWS = 50_000
SECOND_PARTS = 64
#: Rows in a block of candidates or of queries, about.
BLOCK_ROWS = 4096


def nearest_in(x: np.ndarray, y: np.ndarray, k: int, skip_self: bool) -> np.ndarray:
    """Positions in y of the k nearest of each row of x."""
    k = min(k, len(y) - skip_self)
    out = np.empty((len(x), max(0, k)), dtype=np.int64)
    if k <= 0:
        return out
    yy = (y * y).sum(1)
    for at in range(0, len(x), 1024):
        d = yy[None] - 2 * x[at : at + 1024] @ y.T
        if skip_self:
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def _bisect(x: np.ndarray, members: np.ndarray, src: np.ndarray, dst: np.ndarray, passes: int = 12) -> np.ndarray:
    """A balanced side for each member: the median of the widest direction, then swaps of pairs that
    most reduce the edges between the sides."""
    centred = x[members] - x[members].mean(0)
    direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
    side = np.zeros(len(members), dtype=bool)
    side[np.argsort(centred @ direction, kind="stable")[len(members) // 2 :]] = True
    place = np.full(len(x), -1)
    place[members] = np.arange(len(members))
    inside = (place[src] >= 0) & (place[dst] >= 0)
    a, b = place[src[inside]], place[dst[inside]]
    for _ in range(passes):
        other = side[a] != side[b]
        gain = np.bincount(a, np.where(other, 1, -1), len(members)) + np.bincount(b, np.where(other, 1, -1), len(members))
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left = left[np.argsort(-gain[left], kind="stable")]
        right = right[np.argsort(-gain[right], kind="stable")]
        n = min(len(left), len(right))
        good = int((gain[left[:n]] + gain[right[:n]] > 0).sum())
        if not good:
            break
        moved = max(1, good // 3)  # not all at once: each swap changes its neighbours' gains
        side[left[:moved]], side[right[:moved]] = True, False
    return side


def partition_graph(x: np.ndarray, neighbours: np.ndarray, parts: int) -> np.ndarray:
    """A part for each row, balanced to within one row a level, by recursive bisection."""
    src = np.repeat(np.arange(len(x)), neighbours.shape[1])
    dst = neighbours.ravel()
    part = np.zeros(len(x), dtype=np.int64)
    groups = 1
    while groups < parts:
        for g in range(groups):
            members = np.flatnonzero(part == g)
            if len(members) > 1:
                part[members[_bisect(x, members, src, dst)]] = g + groups
        groups *= 2
    return part


@dataclass
class Router:
    """A network of one hidden layer over standardised vectors."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(((x - self.mean) * self.scale) @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def parts(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n most probable parts of each row, most probable first, ties to the smaller."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :n]


def train(x: np.ndarray, target: np.ndarray, seed: int = 0, epochs: int = 30, batch: int = 256, rate: float = 3e-3) -> Router:
    """Cross-entropy against target distributions, by Adam."""
    rng = np.random.default_rng(seed)
    d, parts = x.shape[1], target.shape[1]
    scale = 1 / max(1e-12, float(x.std()))
    r = Router(x.mean(0), scale, rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts))
    z = (x - r.mean) * scale
    weights = [r.w1, r.b1, r.w2, r.b2]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(z), batch):
            pick = order[at : at + batch]
            h = np.maximum(z[pick] @ r.w1 + r.b1, 0)
            o = h @ r.w2 + r.b2
            p = np.exp(o - o.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - target[pick]) / len(pick)
            gh = (g @ r.w2.T) * (h > 0)
            step += 1
            for i, grad in enumerate((z[pick].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                weights[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return r


def fit(sample: np.ndarray, n_rows: int, k: int = 10, target_recall: float = TARGET_RECALL, most_parts: int | None = None) -> Router:
    """Partition and train on all but a held part of the sample; choose the probes on that part."""
    sample = np.unique(sample, axis=0)
    sample = sample[np.random.default_rng(1).permutation(len(sample))]
    held = min(HELD_ROWS, len(sample) // 8)
    test, x = sample[:held], sample[held:]
    parts = PARTS[0]
    while parts < (most_parts or PARTS[1]) and parts * PART_ROWS < n_rows:
        parts *= 2
    while parts > 1 and parts * 4 > len(x):
        parts //= 2
    neighbours = nearest_in(x, x, GRAPH_K, True)
    part = partition_graph(x, neighbours, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), part), 1.0)
    if neighbours.shape[1]:
        for j in range(neighbours.shape[1]):
            np.add.at(target, (np.arange(len(x)), part[neighbours[:, j]]), 1.0)
    router = train(x, target / target.sum(1, keepdims=True))
    router.probes = parts
    if held and parts > 1:
        near = nearest_in(test, x, k, False)
        rank = np.argsort(router.parts(test, parts), axis=1)  # place of each part in a query's order
        home = router.parts(x, 1)[:, 0]
        needed = np.take_along_axis(rank, home[near], axis=1)
        share = np.array([(needed < m).mean() for m in range(1, parts + 1)])
        router.probes = int(np.argmax(share >= target_recall)) + 1
    return router


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as doubles, which hold every float exactly."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _routed(vectors: DataFrame, size: int, router: Router, inner: dict[int, Router], whole: bool) -> DataFrame:
    """(row, id, v, part, sub): a row for each part that a vector goes to, as a query (whole) to several.
    inner: routers of the parts that are cut again."""

    def parts_of(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(positions, part, sub) of one probe after another."""
        firsts = router.parts(x, router.probes if whole else 1)
        for j in range(firsts.shape[1]):
            if not inner:
                yield np.arange(len(x)), firsts[:, j], np.zeros(len(x))
                continue
            for part in np.unique(firsts[:, j]):
                at = np.flatnonzero(firsts[:, j] == part)
                second = inner.get(int(part))
                subs = second.parts(x[at], second.probes if whole else 1) if second else np.zeros((len(at), 1))
                for i in range(subs.shape[1]):
                    yield at, np.full(len(at), part), subs[:, i]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sizes = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            usual = np.flatnonzero(sizes == size)
            found = []
            if len(usual):
                found = [(usual[at], part, sub) for at, part, sub in parts_of(_matrix(batch.column("v").take(pa.array(usual))))]
            rest = np.flatnonzero(sizes != size)  # a part for each other length
            for at, part, sub in [*found, (rest, -sizes[rest], np.zeros(len(rest)))]:
                if len(at):
                    some = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(part.astype(np.int32)), pa.array(sub.astype(np.int32))], ["row", "id", "v", "part", "sub"])

    return vectors.select("row", "id", "v").mapInArrow(batches, f"row long, id long, v {dict(vectors.dtypes)['v']}, part int, sub int")


def _inner_routers(placed: DataFrame, k: int, target_recall: float) -> dict[int, Router]:
    """Routers of the parts with SECOND_ROWS rows or more, each fitted where its sample is. There are
    PARTS[1] of them at most, and each is as large as its parameters."""
    sizes = placed.filter("part >= 0").groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SECOND_ROWS)
    sizes = {r["part"]: r["n"] for r in sizes.collect()}
    if not sizes:
        return {}

    def fitted(key: tuple, table: pa.Table) -> pa.Table:
        router = fit(_matrix(table.column("v").combine_chunks()), sizes[key[0].as_py()], k, target_recall, SECOND_PARTS)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([pickle.dumps(router)], pa.binary())], ["part", "router"])

    order = Window.partitionBy("part").orderBy(F.xxhash64("id", "row"))
    sample = placed.filter(F.col("part").isin(list(sizes))).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= SAMPLE_ROWS)
    got = sample.select("part", "v").groupBy("part").applyInArrow(fitted, "part int, router binary")
    return {r["part"]: pickle.loads(r["router"]) for r in got.collect()}


def _cell_search(k: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_row", "query_id", "row", "vec_id", "score"]
        if not len(left) or not len(right):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())], names=names)
        whole = lambda t: _matrix(t.column("v").combine_chunks())
        long = lambda t, c: t.column(c).to_numpy()
        order = np.lexsort((long(left, "row"), long(left, "id")))
        rows, ids, x, q = long(left, "row")[order], long(left, "id")[order], whole(left)[order], whole(right)
        # Gram products only shortlist; what is within their rounding of the k-th is measured exactly.
        xx = (x * x).sum(1)
        found: list[list[np.ndarray]] = [[] for _ in names]
        for i, (row, id_) in enumerate(zip(long(right, "row"), long(right, "id"))):
            d = xx - 2 * (x @ q[i]) + q[i] @ q[i]
            d[rows == row] = np.inf
            if len(d) > k:
                kth = np.partition(d, k - 1)[k - 1]
                near = np.flatnonzero(d <= kth + 1e-9 * (1 + xx.max() + q[i] @ q[i]))
            else:
                near = np.arange(len(d))
            near = near[rows[near] != row]
            score = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
            best = np.lexsort((rows[near], ids[near], score))[:k]
            for to, part in zip(found, (np.full(len(best), row), np.full(len(best), id_), rows[near[best]], ids[near[best]], score[best])):
                to.append(part)
        return pa.table([pa.array(np.concatenate(c)) for c in found], names=names)

    return search


def search(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS, target_recall: float = TARGET_RECALL) -> DataFrame:
    """Queries are the rows whose id is divisible by `every`. (query_id, rank, vec_id, score)."""
    v = F.col(vector_col)
    v = v if dict(vectors.dtypes)[vector_col] == "array<float>" else v.cast("array<double>")
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
        .filter(F.col("id").isNotNull() & F.col("v").isNotNull())
        .filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
        .filter(F.exists("v", lambda x: x != 0))
    )
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))  # once written, a row keeps its number
    n = rows.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    got = rows.orderBy(F.xxhash64("id", "v"), "id").limit(sample_rows).select("v").toArrow().column(0).to_pylist()
    sizes, counts = np.unique([len(x) for x in got], return_counts=True)
    size = int(sizes[counts.argmax()])
    sample = np.array([x for x in got if len(x) == size], dtype=np.float64)
    two_levels = n >= SECOND_ROWS * PARTS[1]  # then some part has SECOND_ROWS rows
    level_recall = target_recall**0.5 if two_levels else target_recall
    router = fit(sample, n, k, level_recall)

    # Equal vectors beyond the k + 1 smallest ids are nobody's nearest; the limit works before the shuffle.
    equal = Window.partitionBy("v").orderBy("id", "row")
    candidates = rows.withColumn("n", F.row_number().over(equal)).filter(F.col("n") <= k + 1).drop("n")
    inner: dict[int, Router] = {}
    if two_levels:
        candidates = cut(candidates)
        inner = _inner_routers(cut(_routed(candidates, size, router, {}, False)), k, level_recall)
    candidates = cut(_routed(candidates, size, router, inner, False))
    queries = cut(_routed(rows.filter(F.col("id") % every == 0), size, router, inner, True))
    # One row for each part of a part.
    blocks = cut(
        candidates.groupBy("part", "sub").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("cs"))
        .join(queries.groupBy("part", "sub").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("qs")), ["part", "sub"])
    )
    if blocks.count() <= PARTS[1] * SECOND_PARTS:  # other lengths may add parts without end
        blocks = F.broadcast(blocks)
    block = lambda of: F.pmod(F.xxhash64("row"), F.col(of)).cast("int")
    every_one = lambda of: F.explode(F.sequence(F.lit(0), (F.col(of) - 1).cast("int")))
    left = candidates.join(blocks, ["part", "sub"]).select("row", "id", "v", "part", "sub", block("cs").alias("c"), every_one("qs").alias("q"))
    right = queries.join(blocks, ["part", "sub"]).select("row", "id", "v", "part", "sub", every_one("cs").alias("c"), block("qs").alias("q"))
    cells = left.groupBy("part", "sub", "c", "q").cogroup(right.groupBy("part", "sub", "c", "q"))
    found = cells.applyInArrow(_cell_search(k), "query_row long, query_id long, row long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy("score", "vec_id", "row")
    return (
        found.withColumn("rank", F.row_number().over(order).cast("int"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
