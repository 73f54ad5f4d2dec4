"""Streaming operators, drained from the event files; the batch rule is the check."""

from __future__ import annotations

from pyspark.sql import functions as F

from undercroft.functions.calendar import is_day_off
from undercroft.queries.base import query
from undercroft.queries.functions import CODE_SQL, FLAG_SQL
from undercroft.session import scratch_path
from undercroft.streaming import bursts as bu
from undercroft.streaming import ingest as ing
from undercroft.streaming import windows as win


def event_stream(t):
    """The events file as a stream."""
    schema = t.events.schema
    return t.spark.readStream.schema(schema).parquet(f"{t.folder}/events*.parquet").withColumn("ts", F.date_trunc("second", "ts").cast("timestamp"))


def raw_stream(t):
    """Typed journal rows as a stream of files derived from the events."""
    path = scratch_path(t.spark, "raw-stream")
    rows = t.raw_journal.select("event_id", "channel_id", "ts", "alarm", "value")
    rows.repartitionByRange(4, "ts").write.parquet(path)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


def sensor_dictionary(t):
    """Every channel feeds its sensor; guard channels feed three sections; some are unknown."""
    rows = t.raw_journal.select("channel_id", F.col("stype").alias("channel_type")).distinct().filter("channel_id % 13 <> 0")
    spread = F.when(F.col("channel_type") == "Состояние охраны", F.array(*[F.lit(i) for i in range(3)])).otherwise(F.array(F.lit(0)))
    return rows.withColumn("i", F.explode(spread)).select(
        "channel_id", "channel_type", F.concat(F.lit("C"), F.col("channel_id").cast("string"), F.lit("-"), F.col("i").cast("string")).alias("sensor_id"),
        F.concat(F.lit("U"), (F.col("channel_id") % 60 + F.col("i")).cast("string")).alias("facility_id"))


SPREAD_SQL = f"SELECT r.*, CASE WHEN stype = 'Состояние охраны' THEN 3 ELSE 1 END AS fan, {CODE_SQL} AS code, TRY_CAST(replace(value, ',', '.') AS DOUBLE) AS v FROM ({FLAG_SQL}) r WHERE channel_id % 13 <> 0"
FITS = "((stype = 'Датчик температуры' AND v BETWEEN -60 AND 150) OR (stype = 'Газовый датчик' AND v BETWEEN 0 AND 100)) AND v NOT IN (327.68, -100, 255)"


def ingested(t):
    path = scratch_path(t.spark, "ingest")
    ing.start_ingest(raw_stream(t), sensor_dictionary(t), path, f"{path}-state").awaitTermination()
    return path


@query("ingest_stream_events", "code:s n:i sources:i", f"SELECT code, sum(fan) AS n, count(DISTINCT event_id) AS sources FROM ({SPREAD_SQL}) WHERE code IS NOT NULL GROUP BY code")
def _(t):
    return t.spark.read.parquet(f"{ingested(t)}/events").groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_event_id").alias("sources"))


@query("ingest_stream_readings", "sensor_id:s metric:s hour:t value:d", f"""
    SELECT concat('C', channel_id, '-0') AS sensor_id, CASE stype WHEN 'Датчик температуры' THEN 'temperature_c' ELSE 'methane_pct' END AS metric, date_trunc('hour', ts) AS hour, max(v) AS value FROM ({SPREAD_SQL}) WHERE {FITS} GROUP BY channel_id, stype, 3""")
def _(t):
    return ing.ingested_readings(t.spark, ingested(t))


@query("ingest_counters", "received:i events:i skipped:i", f"""
    SELECT (SELECT count(*) FROM raw_journal) AS received, (SELECT sum(fan) FROM ({SPREAD_SQL}) WHERE code IS NOT NULL) AS events,
           (SELECT count(*) FROM raw_journal) - (SELECT count(*) FROM ({SPREAD_SQL}) WHERE code IS NOT NULL OR {FITS}) AS skipped""")
def _(t):
    return t.spark.read.parquet(f"{ingested(t)}/counters").agg(*[F.sum(c).alias(c) for c in ("received", "events", "skipped")])


@query("hour_max_reading_stream", "user_id:i hour:t value:d", "SELECT user_id, date_trunc('hour', ts) AS hour, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2")
def _(t):
    stream = win.hour_max(event_stream(t).filter("event_type = 'purchase'"), ("user_id",))
    got = win.run_available(t.spark, stream, "hour-max", mode="update")
    return got.groupBy("user_id", "hour").agg(F.max("value").alias("value"))


@query("access_incident_stream", "section:i started:t ended:t n_moments:i", """
    SELECT section, min(ts) AS started, max(ts) AS ended, count(*) AS n_moments FROM (SELECT *, sum(b) OVER (PARTITION BY section ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g
      FROM (SELECT section, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY section ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b
            FROM (SELECT user_id % 50 AS section, date_trunc('second', ts) AS ts, event_id FROM events WHERE event_type IN ('error', 'click')))) GROUP BY section, g""")
def _(t):
    path = scratch_path(t.spark, "moments")
    rows = t.events.filter("event_type IN ('error', 'click')").select((F.col("user_id") % 50).alias("section"), F.date_trunc("second", "ts").alias("ts"))
    rows.write.parquet(path)
    win.closed(rows, "ts").write.mode("append").parquet(path)
    stream = t.spark.readStream.schema(rows.schema).parquet(path)
    # Append mode: an incident is given out once, when the watermark has passed it.
    return win.run_available(t.spark, win.sessions(stream, ("section",)), "sessions").filter("section IS NOT NULL")


@query("session_window_batch", "section:i started:t ended:t n_moments:i", """
    SELECT section, min(ts) AS started, max(ts) AS ended, count(*) AS n_moments FROM (SELECT *, sum(b) OVER (PARTITION BY section ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g
      FROM (SELECT section, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY section ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM journal WHERE event_type IN ('error', 'click'))) GROUP BY section, g""")
def _(t):
    return win.sessions(t.journal.filter("event_type IN ('error', 'click')"), ("section",))


@query("deduplicated_stream", "n:i", "SELECT count(*) AS n FROM events")
def _(t):
    path = scratch_path(t.spark, "twice")
    for _i in range(2):
        t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts")).write.mode("append").parquet(path)
    stream = t.spark.readStream.schema("event_id long, ts timestamp").parquet(path)
    return win.run_available(t.spark, win.deduplicated(stream, late="60 days"), "dedup").agg(F.count(F.lit(1)).alias("n"))


@query("fire_incident_stream", "facility_id:i started:t signals:i", """
    WITH RECURSIVE s AS (SELECT user_id % 40 AS facility_id, date_trunc('second', ts) AS ts FROM events WHERE event_type = 'error'), r AS (
      SELECT facility_id, min(ts) AS started FROM s GROUP BY 1 UNION ALL
      SELECT r.facility_id, (SELECT min(ts) FROM s WHERE s.facility_id = r.facility_id AND s.ts >= r.started + INTERVAL 24 HOUR) FROM r WHERE EXISTS (SELECT 1 FROM s WHERE s.facility_id = r.facility_id AND s.ts >= r.started + INTERVAL 24 HOUR))
    SELECT r.facility_id, r.started, (SELECT count(*) FROM s WHERE s.facility_id = r.facility_id AND s.ts >= r.started AND s.ts < r.started + INTERVAL 24 HOUR) AS signals FROM r""")
def _(t):
    rows = event_stream(t).filter("event_type = 'error'").select((F.col("user_id") % 40).alias("facility_id"), "ts")
    got = win.run_available(t.spark, win.fire_incidents(rows), "incidents")
    return got.filter("NOT late").groupBy("facility_id", "started").agg(F.count(F.lit(1)).alias("signals"))


FIRE_SQL = """
    s AS (SELECT event_id, object_id, gallery, picket, channel_id % 40 AS facility_id, ts, day FROM journal WHERE event_type IN ('error', 'click')),
    b AS (SELECT *, (SELECT count(DISTINCT (o.gallery, o.picket)) FROM s o WHERE o.object_id = s.object_id AND o.day = s.day AND o.ts BETWEEN s.ts - INTERVAL 60 MINUTE AND s.ts + INTERVAL 60 MINUTE) - 1 > 2 AS burst FROM s)"""


def fire_signals(t):
    """Fire signals as a stream of files out of order, and a last row that lets all others be judged."""
    path = scratch_path(t.spark, "fire-signals")
    rows = t.journal.filter("event_type IN ('error', 'click')").selectExpr("event_id", "object_id", "gallery", "picket", "channel_id % 40 AS facility_id", "ts")
    rows.repartition(4, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    win.closed(rows, "ts").write.mode("append").parquet(path)
    return t.spark.readStream.schema(rows.schema).parquet(path)


def judged_signals(t):
    with bu.rocks_state(t.spark):
        return win.run_available(t.spark, bu.burst_free_incidents(fire_signals(t)), "burst-incidents")


@query("fire_bursts_stream", "object_id:i facility_id:i ts:t burst:b n:i", f"WITH {FIRE_SQL} SELECT object_id, facility_id, ts, CAST(burst AS INT) AS burst, count(*) AS n FROM b GROUP BY 1, 2, 3, 4")
def _(t):
    return judged_signals(t).groupBy("object_id", "facility_id", "ts", "burst").agg(F.count(F.lit(1)).alias("n"))


@query("fire_incident_burst_free_stream", "facility_id:i started:t signals:i", f"""
    WITH RECURSIVE {FIRE_SQL}, q AS (SELECT object_id, facility_id, ts FROM b WHERE NOT burst), r AS (
      SELECT facility_id, min(ts) AS started FROM q GROUP BY 1 UNION ALL
      SELECT r.facility_id, (SELECT min(ts) FROM q WHERE q.facility_id = r.facility_id AND q.ts >= r.started + INTERVAL 24 HOUR) FROM r WHERE EXISTS (SELECT 1 FROM q WHERE q.facility_id = r.facility_id AND q.ts >= r.started + INTERVAL 24 HOUR))
    SELECT r.facility_id, r.started, (SELECT count(*) FROM q WHERE q.facility_id = r.facility_id AND q.ts >= r.started AND q.ts < r.started + INTERVAL 24 HOUR) AS signals FROM r""")
def _(t):
    return judged_signals(t).filter("NOT burst").groupBy("facility_id", "started").agg(F.count(F.lit(1)).alias("signals"))


@query("late_rows_kept", "day:D n:i off:b", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(isodow(CAST(ts AS DATE)) >= 6 OR CAST(ts AS DATE) <= DATE '2024-01-08' AS INT) AS off FROM events GROUP BY 1")
def _(t):
    """Rows arriving in any order land in their own day: history is partitioned by event time."""
    stream = event_stream(t).select("event_id", F.to_date("ts").alias("day"))
    got = win.run_available(t.spark, stream, "late", day="day")
    return got.groupBy("day").agg(F.count(F.lit(1)).alias("n")).withColumn("off", is_day_off("day"))
