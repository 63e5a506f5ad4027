"""Keeping a view up by deltas. A delta is a DataFrame with a signed weight for each row.

Scans, projections, filters and unions pass deltas on; an inner join adds the three products of
old and new; groups and distinct rows that a delta touches are computed before and after it. State
is the deltas that came, each a table in buckets of its key, appended as it comes and put together now
and then. A step reads only the buckets that its delta touches, so its work follows the delta. What a
circuit stands on is one entry of a log a step: a restarted circuit goes on from the last, and a batch
that comes again changes nothing.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as ty
from ..plans import ir
from ..plans.compile import column
from ..plans.refresh import analyze
from ..plans.schema import schema_of
from ..session import released_at_end

WEIGHT = "__weight"
BUCKET = "__bucket"
#: Buckets of a state, and deltas of it from which they are put together.
BUCKETS = 32
COMPACT = 8


def shared_folder(spark: SparkSession) -> str:
    """Where state lives: spark.checkpoint.dir, or a folder of our own where that is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.gettempdir() + "/marlstone"


_own: dict[str, str] = {}


def own_folder(spark: SparkSession) -> str:
    """A folder of this application in the shared one, deleted when it ends."""
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/{app}-states"
    if _own.get(app) != path:
        released_at_end(spark, path)
        _own[app] = path
    return path


def stored(df: DataFrame) -> DataFrame:
    spark, path = df.sparkSession, f"{own_folder(df.sparkSession)}/state-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_delta(df: DataFrame, weight: int | Column = 1) -> DataFrame:
    """Rows of a table as inserts (or deletes, with weight -1)."""
    return df.withColumn(WEIGHT, (F.lit(weight) if isinstance(weight, int) else weight).cast("long"))


def consolidate(delta: DataFrame) -> DataFrame:
    """One row for each distinct row, with the sum of its weights; zero ones go."""
    names = [c for c in delta.columns if c != WEIGHT]
    return delta.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.sum(WEIGHT).alias(WEIGHT)).filter(F.col(WEIGHT) != 0)


def from_upserts(changes: DataFrame, current: DataFrame, key: list[str], order: str, deleted: str | None = None) -> DataFrame:
    """A change log with the latest row of a key last -> the delta against `current`."""
    names = [c for c in changes.columns if c not in (order, deleted)]
    latest = changes.groupBy(*key).agg(F.max_by(F.struct(*names, *([deleted] if deleted else [])), order).alias("r"))
    gone = F.col(f"r.{deleted}") if deleted else F.lit(False)
    put = latest.filter(~F.coalesce(gone, F.lit(False))).select(*[F.col(f"r.{n}") for n in names])
    old = current.select(*names).join(latest.select(*[F.col(k).alias(f"__{k}") for k in key]), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]), "left_semi")
    return consolidate(as_delta(put).unionByName(as_delta(old, -1)))


def rows_of(integral: DataFrame) -> DataFrame:
    """A multiset of rows from its weights; a weight below zero is an error."""
    negative = F.raise_error(F.concat(F.lit("a row has weight "), F.col(WEIGHT).cast("string"))).cast("long")
    times = F.when(F.col(WEIGHT) < 0, negative).otherwise(F.col(WEIGHT))
    return integral.withColumn("__n", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).drop("__n", WEIGHT)


def _aggregate(df: DataFrame, node: ir.Aggregate) -> DataFrame:
    """Aggregates of consolidated weighted rows; a group is there while it has rows."""
    inner, outer = schema_of(node.input), schema_of(node)
    w, out = F.col(WEIGHT), []
    for name, function, col in node.aggregates:
        kind = ty.to_spark(outer[name].type)
        if function == "count":
            out.append(F.sum(w).cast(kind).alias(name))
        elif function == "sum":
            c = F.col(f"`{col}`")
            out.append(F.sum(c.cast(kind) * (w if isinstance(kind, (T.LongType, T.DoubleType)) else w.cast("decimal(20,0)"))).cast(kind).alias(name))
        elif function in ("min", "max"):
            out.append(getattr(F, function)(F.when(w > 0, F.col(f"`{col}`"))).alias(name))
        else:
            raise ValueError(f"{function} has no delta rule")
    grouped = df.groupBy(*[F.col(f"`{c}`") for c in node.by]) if node.by else df.groupBy()
    return grouped.agg(F.sum(w).alias("__rows"), *out).filter("__rows > 0").drop("__rows")


class Circuit:
    """A compiled plan with the state of its joins, groups and distincts."""

    def __init__(self, spark: SparkSession, plan: ir.Node, count_work: bool = False, folder: str | None = None):
        """count_work: add up in `work` the rows that steps look at (deltas, and touched groups before
        and after), for a decision between steps and recomputing. folder: where state lives on; a
        circuit of the same plan and folder goes on where the last one stopped."""
        from ..catalog.datasets import Store

        mode = analyze(plan)
        if not mode.incremental:
            raise ValueError("no incremental form: " + "; ".join(mode.reasons))
        self.spark, self.plan = spark, plan
        self.folder = folder or f"{own_folder(spark)}/circuit-{uuid.uuid4().hex}"
        self.store = Store(spark, self.folder)
        self.state: dict[str, list[str]] = {}  # tables, by place in the plan
        self.steps, self.batch, self.out = 0, None, ""
        self.count_work, self.work = count_work, 0
        if log := self.store.names("_log"):
            last = json.loads(self.store.read(f"_log/{log[-1]}"))
            if last["plan"] != repr(plan):
                raise ValueError("the folder has the state of another plan")
            self.steps, self.batch, self.out, self.state = (last[k] for k in ("step", "batch", "out", "state"))

    def _schema(self, node: ir.Node) -> T.StructType:
        return T.StructType([T.StructField(n, ty.to_spark(f.type)) for n, f in schema_of(node).items()] + [T.StructField(WEIGHT, T.LongType())])

    def _empty(self, node: ir.Node) -> DataFrame:
        return self.spark.createDataFrame([], self._schema(node))

    def step(self, deltas: dict[tuple[str, str], DataFrame], batch: int | None = None) -> DataFrame:
        """The view's own delta for these deltas of its leaves; state moves on. batch: a number that
        grows; the last one that was applied gives its delta again and changes nothing."""
        if batch is not None and self.batch is not None and batch <= self.batch:
            if batch < self.batch:
                raise ValueError(f"batch {batch} came after batch {self.batch}")
            return self.spark.read.schema(self._schema(self.plan)).parquet(f"{self.folder}/{self.out}")
        new: dict[str, tuple[str, T.StructType]] = {}
        name = f"out-{uuid.uuid4().hex[:12]}"
        consolidate(self._delta(self.plan, deltas, "0", new)).write.parquet(f"{self.folder}/{name}")
        schemas = {path: schema for path, (_, schema) in new.items()}
        state = {path: [*self.state.get(path, ()), table] for path, (table, _) in new.items()}
        state = {**self.state, **state}
        done = [p for p, tables in state.items() if len(tables) > COMPACT and p in schemas]
        old = [t for p in done for t in state[p]]
        for p in done:
            state[p] = [self._put_together(state[p], schemas[p])]
        entry = {"plan": repr(self.plan), "step": self.steps + 1, "batch": batch, "out": name, "state": state}
        if not self.store.create(f"_log/{self.steps + 1:012d}.json", json.dumps(entry)):
            raise ValueError(f"step {self.steps + 1} was taken by another circuit")
        self.steps, self.batch, self.out, self.state = self.steps + 1, batch, name, state
        for t in old:
            self.store.delete(t)
        return self.spark.read.schema(self._schema(self.plan)).parquet(f"{self.folder}/{name}")

    def _append(self, delta: DataFrame, bucket: Column) -> tuple[str, DataFrame, list[int]]:
        """Write a delta in buckets: its table, itself as read again, and the buckets it has rows in."""
        table = f"delta-{uuid.uuid4().hex[:12]}"
        delta.withColumn(BUCKET, bucket).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.folder}/{table}")
        touched = [int(n.split("=")[1]) for n in self.store.names(table) if n.startswith(BUCKET)]
        return table, self._tables([table], delta.schema), touched

    def _tables(self, tables: list[str], schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
        """Rows of tables, from the given buckets alone."""
        paths = [f"{self.folder}/{t}" for t in tables]
        if not paths or buckets == []:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())]))
        df = reduce(DataFrame.unionAll, [reader.parquet(p) for p in paths])
        return (df if buckets is None else df.filter(F.col(BUCKET).isin(buckets))).drop(BUCKET)

    def _put_together(self, tables: list[str], schema: T.StructType) -> str:
        table = f"state-{uuid.uuid4().hex[:12]}"
        reader = self.spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())]))
        df = reduce(DataFrame.unionAll, [reader.parquet(f"{self.folder}/{t}") for t in tables])
        consolidate(df).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.folder}/{table}")
        return table

    def _delta(self, node: ir.Node, deltas, path: str, new: dict[str, tuple[str, T.StructType]]) -> DataFrame:
        sub = lambda n, k: self._delta(n, deltas, f"{path}.{k}", new)
        match node:
            case ir.Scan(source, relation, columns):
                d = deltas.get((source, relation))
                if d is None:
                    return self._empty(node)
                return d.select(*[F.col(f"`{n}`").cast(ty.to_spark(ty.parse(t))).alias(n) for n, t in columns], WEIGHT)
            case ir.Project(input, outputs):
                return sub(input, 0).select(*[column(e).alias(n) for n, e in outputs], WEIGHT)
            case ir.Filter(input, predicate):
                return sub(input, 0).filter(column(predicate))
            case ir.Union(inputs):
                fields = schema_of(node)
                parts = [sub(x, k).select(*[F.col(f"`{n}`").cast(ty.to_spark(f.type)).alias(n) for n, f in fields.items()], WEIGHT) for k, x in enumerate(inputs)]
                return reduce(DataFrame.unionByName, parts)
            case ir.Join(left, right, on, _):
                # equal keys are in one bucket on both sides: what the right key is as the left's type
                kinds = [ty.to_spark(schema_of(left)[i].type) for i, _ in on]
                left_table, da, in_a = self._append(sub(left, 0), _bucket([F.col(f"`{i}`") for i, _ in on]))
                right_table, db, in_b = self._append(sub(right, 1), _bucket([F.col(f"`{j}`").try_cast(t) for (_, j), t in zip(on, kinds)]))
                new[f"{path}/l"], new[f"{path}/r"] = (left_table, da.schema), (right_table, db.schema)
                a = self._tables(self.state.get(f"{path}/l", []), da.schema, in_b)
                b = self._tables(self.state.get(f"{path}/r", []), db.schema, in_a)
                if self.count_work:
                    self.work += da.count() + db.count()
                names = [*schema_of(left), *schema_of(right)]

                def product(x: DataFrame, y: DataFrame) -> DataFrame:
                    y = y.withColumnRenamed(WEIGHT, "__other")
                    met = x.join(y, reduce(lambda p, q: p & q, [x[f"`{i}`"] == y[f"`{j}`"] for i, j in on]))
                    return met.select(*[F.col(f"`{n}`") for n in names], (F.col(WEIGHT) * F.col("__other")).alias(WEIGHT))

                return product(da, db).unionByName(product(a, db)).unionByName(product(da, b))
            case ir.Aggregate(input, by, _):
                return self._recomputed(input, list(by), lambda df: as_delta(_aggregate(df, node)), sub(input, 0), path, new)
            case ir.Distinct(input):
                names = list(schema_of(input))
                unique = lambda df: as_delta(df.filter(F.col(WEIGHT) > 0).drop(WEIGHT))
                return self._recomputed(input, names, unique, sub(input, 0), path, new)
        raise TypeError(type(node).__name__)

    def _recomputed(self, input: ir.Node, by: list[str], f, delta: DataFrame, path: str, new: dict[str, tuple[str, T.StructType]]) -> DataFrame:
        table, delta, touched_buckets = self._append(consolidate(delta), _bucket([F.col(f"`{c}`") for c in by]))
        new[path] = (table, delta.schema)
        before = self._tables(self.state.get(path, []), delta.schema, touched_buckets)
        after = before.unionByName(delta)
        if by:
            touched = delta.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(by)]).distinct()
            same = lambda df: reduce(lambda p, q: p & q, [df[f"`{c}`"].eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)])
            before, after = (x.join(touched, same(x), "left_semi") for x in (before, after))
        if self.count_work:
            self.work += delta.count() + before.count() + after.count()
        old = f(consolidate(before))
        return f(consolidate(after)).unionByName(old.withColumn(WEIGHT, -F.col(WEIGHT)))


def _bucket(keys: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int") if keys else F.lit(0)
