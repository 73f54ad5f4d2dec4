"""Journal rows off a stream into events and hourly readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from undercroft.functions.mapping import alarm_flag, event_code, metric, metric_unit, reading_value
from undercroft.sources.writers import read_greatest, write_batch

COUNTERS = ("received", "events", "skipped")
READING_KEYS = ("sensor_id", "metric", "hour")
READING_SCHEMA = "sensor_id string, facility_id string, metric string, hour timestamp, value double, unit string, day date"


def targets_by_channel(sensors: DataFrame) -> DataFrame:
    """One row per channel with the sensors it feeds (a channel sits on a few units)."""
    return sensors.groupBy("channel_id").agg(F.collect_list(F.struct("sensor_id", "facility_id", "channel_type")).alias("_targets"))


def map_rows(rows: DataFrame, sensors: DataFrame) -> DataFrame:
    """Journal rows with the events and readings they become, per target sensor.

    A row stays one row: its targets travel as an array, so counting skipped rows needs no
    second grouping.
    """
    def hit(t):
        code = event_code(t["channel_type"], F.col("value"), F.col("alarm"))
        number = F.when(code.isNull(), reading_value(t["channel_type"], F.col("value")))
        return F.struct(t["sensor_id"].alias("sensor_id"), t["facility_id"].alias("facility_id"), code.alias("code"),
                        metric(t["channel_type"]).alias("metric"), metric_unit(t["channel_type"]).alias("unit"),
                        number.alias("number"))

    typed = rows.withColumn("alarm", alarm_flag("alarm"))
    joined = typed.join(targets_by_channel(sensors), "channel_id", "left")
    hits = F.filter(F.transform(F.coalesce("_targets", F.array()), hit),
                    lambda h: h["code"].isNotNull() | h["number"].isNotNull())
    return joined.withColumn("hits", hits).drop("_targets")


def events_of(mapped: DataFrame) -> DataFrame:
    rows = mapped.select("event_id", "ts", F.explode(F.filter("hits", lambda h: h["code"].isNotNull())).alias("h"))
    return rows.select("h.sensor_id", "h.facility_id", F.col("ts").alias("occurred_at"), F.col("h.code").alias("code"),
                       F.col("event_id").alias("source_event_id"))


def readings_of(mapped: DataFrame) -> DataFrame:
    """Largest value per sensor, metric and hour."""
    rows = mapped.select("ts", F.explode(F.filter("hits", lambda h: h["number"].isNotNull())).alias("h"))
    return rows.groupBy("h.sensor_id", "h.facility_id", "h.metric", F.date_trunc("hour", "ts").alias("hour"), "h.unit").agg(
        F.max("h.number").alias("value")).withColumn("day", F.to_date("hour"))


def counters() -> list[Column]:
    """What a batch counts while its rows pass."""
    events = F.size(F.filter("hits", lambda h: h["code"].isNotNull()))
    return [F.count(F.lit(1)).alias("received"), F.coalesce(F.sum(events), F.lit(0)).alias("events"), F.coalesce(F.sum((F.size("hits") == 0).cast("int")), F.lit(0)).alias("skipped")]


def start_ingest(rows: DataFrame, sensors: DataFrame, path: str, checkpoint: str, received_at: str | None = None) -> StreamingQuery:
    """Runs the stream until the available input is done.

    Events, readings and counters of a batch land in ``events``, ``readings`` (both by day) and ``counters`` under the batch
    id, so a replayed batch changes nothing and a day's history is one folder.  Counters are observed while events are written.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        mapped = map_rows(batch, sensors).persist()
        stamp = F.current_timestamp() if received_at is None else F.lit(received_at).cast("timestamp")
        seen = Observation()
        write_batch(events_of(mapped.observe(seen, *counters())).withColumns({"received_at": stamp, "day": F.to_date("occurred_at")}), f"{path}/events", batch_id)
        write_batch(readings_of(mapped), f"{path}/readings", batch_id)
        counted = batch.sparkSession.createDataFrame([tuple(seen.get[c] for c in COUNTERS)], ", ".join(f"{c} long" for c in COUNTERS))
        write_batch(counted.withColumn("day", F.to_date(stamp)), f"{path}/counters", batch_id)
        mapped.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested_readings(spark: SparkSession, path: str, days: Sequence[str] = ()) -> DataFrame:
    """The largest value per sensor, metric and hour over all batches."""
    return read_greatest(spark, f"{path}/readings", READING_SCHEMA, READING_KEYS, carried=("facility_id", "unit", "day"), days=days)
