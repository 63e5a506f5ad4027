"""Event-time windows over batches and streams, and views kept up from streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.delta import Circuit, consolidate, rows_of, own_folder
from ..plans import ir
from ..session import table
from ..streaming import streams
from . import query

EVENTS = ir.Scan("bus", "events", (("event_type", "String"), ("user_id", "Integer")))
BY_TYPE = ir.Aggregate(EVENTS, ("event_type",), (("n", "count", None), ("top", "max", "user_id")))
_TUMBLING = "select time_bucket(interval 1 hour, ts) as window_start, time_bucket(interval 1 hour, ts) + interval 1 hour as window_end, event_type, count(*) as n from events group by all"


@query("window_tumbling", _TUMBLING)
def tumbling(spark, d):
    return streams.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"], n=F.count(F.lit(1)))


@query("window_sliding", "select w as window_start, w + interval 2 hour as window_end, count(*) as n from (select time_bucket(interval 1 hour, ts) - interval (k) hour as w from events, (values (0), (1)) s(k)) t group by all")
def sliding(spark, d):
    return streams.sliding(table(spark, d, "events"), "ts", "2 hours", "1 hour", [], n=F.count(F.lit(1)))


@query(
    "window_session",
    """select user_id, min(ts) as window_start, max(ts) + interval 6 hour as window_end, count(*) as n from (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from
    (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as fresh from events) a) b group by user_id, s""",
)
def session(spark, d):
    return streams.sessions(table(spark, d, "events"), "ts", "6 hours", ["user_id"], n=F.count(F.lit(1)))


def _stream(spark, d):
    """Events as a file stream in three batches."""
    path = f"{own_folder(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, d, "events")
    for i in range(3):
        e.filter(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path), path


@query("stream_tumbling", _TUMBLING)
def stream_tumbling(spark, d):
    """The same windows from a stream; all events are within the stated lateness."""
    source, path = _stream(spark, d)
    out = f"{path}-out"
    agg = streams.tumbling(source, "ts", "1 hour", ["event_type"], late="10000 days", n=F.count(F.lit(1)))

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/{number}")

    q = agg.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("window_start timestamp_ntz, window_end timestamp_ntz, event_type string, n long").parquet(f"{out}/{q.lastProgress['batchId']}")


@query("stream_maintained_view", "select event_type, count(*) as n, max(user_id) as top from events group by 1")
def maintained(spark, d):
    source, path = _stream(spark, d)
    circuit, seen = Circuit(spark, BY_TYPE), []
    q = streams.maintain(source.select("event_type", "user_id"), circuit, ("bus", "events"), lambda delta, n: seen.append(delta), f"{path}-state")
    q.awaitTermination()
    total = seen[0]
    for delta in seen[1:]:
        total = total.unionByName(delta)
    return rows_of(consolidate(total))


@query("stream_deduplicated", "select count(*) as n from (select distinct user_id, event_type from events) t")
def deduplicated(spark, d):
    source, path = _stream(spark, d)
    once = streams.deduplicated(source, ["user_id", "event_type"], "ts", "10000 days")
    out = f"{path}-out"
    q = once.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"))
