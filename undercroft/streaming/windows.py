"""Windowed streams: hour maxima, sessions of moments, incidents with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from undercroft.session import scratch_path


def hour_max(rows: DataFrame, keys: tuple[str, ...], ts: str = "ts", value: str = "value", late: str = "2 days") -> DataFrame:
    """Largest value per key and hour; a late value inside the watermark only raises it."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), *keys).agg(F.max(value).alias("value")).select(
        *keys, F.col("window.start").alias("hour"), "value")


def sessions(rows: DataFrame, keys: tuple[str, ...], ts: str = "ts", gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Incidents on the stream: moments no further apart than the gap (the exact rule)."""
    marked = rows.withWatermark(ts, late) if rows.isStreaming else rows
    return marked.groupBy(F.session_window(ts, gap), *keys).agg(
        F.count(F.lit(1)).alias("n_moments"), F.max(ts).alias("ended")).select(
        *keys, F.col("session_window.start").alias("started"), "ended", "n_moments")


def deduplicated(rows: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "2 days") -> DataFrame:
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


OUTPUT = "facility_id long, started timestamp, ts timestamp, n int, is_new boolean, late boolean"
STATE = "started long, n int"


def fire_incidents(signals: DataFrame, hours: int = 24, late: str = "2 days") -> DataFrame:
    """Incidents keyed by their first signal: signals of a facility within the window of it belong to it, a later one opens the next.

    Signals come without those of bursts (``operators.neighbours.burst_neighbours`` on the batch).  State is two numbers
    a facility, dropped when the watermark passes the incident's end.  A signal from before the running incident is
    given out as late, without a start, and changes nothing.
    """
    span = hours * 3_600_000_000

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        started, n = state.get if state.exists else (None, 0)
        stamps = pd.concat([f["ts"] for f in frames]).sort_values()
        out = []
        for t in stamps:
            at = int(t.value // 1000)
            if started is not None and at < started:
                out.append((key[0], pd.NaT, t, 0, False, True))
                continue
            new = started is None or at - started >= span
            started, n = (at, 1) if new else (started, n + 1)
            out.append((key[0], pd.Timestamp(started, unit="us"), t, n, new, False))
        state.update((started, n))
        state.setTimeoutTimestamp(max((started + span) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["facility_id", "started", "ts", "n", "is_new", "late"])

    return signals.withWatermark("ts", late).groupBy("facility_id").applyInPandasWithState(
        fold, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_available(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append", schema: str | None = None, day: str | None = None) -> DataFrame:
    """Drains a stream into a folder per batch (inside one per day, if a day column is named) and returns what it wrote."""
    path = scratch_path(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch_id", F.lit(batch_id))
        parts = [day, "batch_id"] if day else ["batch_id"]
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option(
        "checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema or stream.withColumn("batch_id", F.lit(0)).schema).parquet(path)


def closed(rows: DataFrame, ts: str, after: str = "10 days") -> DataFrame:
    """A last row, all null but a time behind all others: it moves the watermark past them, so that append mode gives out what was still open."""
    end = rows.agg((F.max(ts) + F.expr(f"INTERVAL {after}")).alias(ts))
    return end.select(*[F.col(ts) if c == ts else F.lit(None).cast(kind).alias(c) for c, kind in rows.dtypes])
