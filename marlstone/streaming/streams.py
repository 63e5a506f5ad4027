"""Streams: event-time windows with watermarks, change streams into views, and last-by-key state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.delta import Circuit, as_delta
from ..plans import ir


def _marked(df: DataFrame, time: str, late: str | None) -> DataFrame:
    """df with a watermark, which only instants can carry: a time without zone is read as UTC."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late else df


def _bounds(df: DataFrame, time: str) -> list:
    """The window's two ends in the type of the input's time."""
    kind = dict(df.dtypes)[time]
    return [F.col(f"w.{e}").cast(kind).alias(f"window_{e}") for e in ("start", "end")]


def tumbling(df: DataFrame, time: str, width: str, by: list[str], late: str | None = None, **aggs) -> DataFrame:
    """Windows side by side. late: how long an event may come after newer ones (streams only)."""
    return sliding(df, time, width, width, by, late, **aggs)


def sliding(df: DataFrame, time: str, width: str, slide: str, by: list[str], late: str | None = None, **aggs) -> DataFrame:
    out = _marked(df, time, late).groupBy(F.window(time, width, slide).alias("w"), *by).agg(*[a.alias(n) for n, a in aggs.items()])
    return out.select(*_bounds(df, time), *by, *aggs)


def sessions(df: DataFrame, time: str, gap: str, by: list[str], late: str | None = None, **aggs) -> DataFrame:
    """Runs of events with less than `gap` between neighbours."""
    out = _marked(df, time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(*[a.alias(n) for n, a in aggs.items()])
    return out.select(*_bounds(df, time), *by, *aggs)


def deduplicated(df: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first of the rows with equal keys that come within the watermark."""
    return _marked(df, time, late).dropDuplicatesWithinWatermark(keys)


def maintain(stream: DataFrame, circuit: Circuit, leaf: tuple[str, str], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Feed a stream of inserts (or of rows with weights) through a circuit; each micro-batch is one
    step, and its output delta goes to `sink` with the batch's number. A batch whose sink failed comes
    again: the circuit then gives the same delta and its state stays, so only the sink must take a
    number twice. After a restart go on with a circuit of the same folder."""

    def step(batch: DataFrame, number: int) -> None:
        delta = batch if "__weight" in batch.columns else as_delta(batch)
        sink(circuit.step({leaf: delta}, batch=number), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintainable(plan: ir.Node) -> bool:
    from ..plans.refresh import analyze

    return analyze(plan).incremental
