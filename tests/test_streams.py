"""Streams give what batches give; replays and late rows change nothing."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from undercroft.session import scratch_path
from undercroft.sources.writers import read_greatest, write_batch
from undercroft.streaming import ingest as ing
from undercroft.streaming import windows as win

T = dt.datetime(2024, 3, 5, 10)
SENSORS = [(1, "C1", "P-1", "Датчик дыма"), (2, "C2-a", "S-1", "Состояние охраны"), (2, "C2-b", "S-2", "Состояние охраны"), (3, "C3", "P-1", "Датчик температуры")]
ROWS = [(10, 1, T, "t", "Обнаружен дым"), (11, 2, T, "f", "На охране"), (12, 3, T, "f", "21,5"), (13, 3, T + dt.timedelta(minutes=20), "f", "25,0"),
        (14, 99, T, "t", "Обнаружен дым"), (15, 1, T, "false", "Обнаружен дым"), (16, 3, T + dt.timedelta(hours=1), "f", "327,68")]


def test_ingest_counts_and_hour_max(spark):
    rows = spark.createDataFrame(ROWS, "event_id long, channel_id long, ts timestamp, alarm string, value string")
    sensors = spark.createDataFrame(SENSORS, "channel_id long, sensor_id string, facility_id string, channel_type string")
    mapped = ing.map_rows(rows, sensors)
    assert tuple(mapped.agg(*ing.counters()).first()) == (7, 3, 3)
    path = scratch_path(spark, "rows")
    shuffled = ROWS[:]
    random.Random(2).shuffle(shuffled)
    for part in (shuffled[:3], shuffled[3:]):
        spark.createDataFrame(part, rows.schema).write.mode("append").parquet(path)
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    for _ in range(2):  # the second start finds nothing new
        ing.start_ingest(stream, sensors, out, state).awaitTermination()
    got = spark.read.parquet(f"{out}/events")
    assert spark.read.parquet(f"{out}/counters").agg(F.sum("received"), F.sum("events"), F.sum("skipped")).first()[:] == (7, 3, 3)
    assert sorted((r.sensor_id, r.code) for r in got.collect()) == [("C1", "SMOKE_DETECTED"), ("C2-a", "SECURITY_ARMED"), ("C2-b", "SECURITY_ARMED")]
    assert [(r.sensor_id, r.hour, r.value) for r in ing.ingested_readings(spark, out).collect()] == [("C3", T, 25.0)]


def test_batches_overwrite_themselves_only(spark):
    path, schema = scratch_path(spark, "table"), "k long, value double, day date"
    make = lambda rows: spark.createDataFrame(rows, schema)
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    write_batch(make([(1, 5.0, d1), (2, 1.0, d2)]), path, 0)
    write_batch(make([(1, 99.0, d1)]), path, 1)
    write_batch(make([(1, 3.0, d1), (3, 9.0, d1)]), path, 1)
    assert sorted(tuple(r)[:2] for r in read_greatest(spark, path, schema, ["k"]).collect()) == [(1, 5.0), (2, 1.0), (3, 9.0)]
    assert [r.k for r in read_greatest(spark, path, schema, ["k"], days=[str(d2)]).collect()] == [2]


def test_fire_incident_state(spark):
    stamps = [0, 1, 23.9, 24, 30, 60]
    path = scratch_path(spark, "signals")
    rows = spark.createDataFrame([(1, T + dt.timedelta(hours=h)) for h in stamps], "facility_id long, ts timestamp")
    rows.coalesce(1).write.parquet(path)
    got = win.run_available(spark, win.fire_incidents(spark.readStream.schema(rows.schema).parquet(path)), "inc")
    starts = sorted({(r.started - T).total_seconds() / 3600 for r in got.collect()})
    assert starts == [0, 24, 60] and got.filter("is_new").count() == 3


def test_session_stream_equals_batch(spark):
    rnd = random.Random(4)
    rows = spark.createDataFrame([(rnd.randint(0, 3), T + dt.timedelta(minutes=rnd.randint(0, 900))) for _ in range(150)], "u long, ts timestamp")
    path = scratch_path(spark, "moments")
    rows.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    win.closed(rows, "ts").write.mode("append").parquet(path)
    got = win.run_available(spark, win.sessions(spark.readStream.schema(rows.schema).parquet(path), ("u",)), "sess").filter("u IS NOT NULL")
    key = lambda df: sorted((r.u, r.started, r.ended, r.n_moments) for r in df.collect())
    assert key(got) == key(win.sessions(rows, ("u",)))


def test_late_signals_stand_apart(spark):
    path, schema = scratch_path(spark, "late-signals"), "facility_id long, ts timestamp"
    for hours in ([50], [10, 51], [90]):
        spark.createDataFrame([(1, T + dt.timedelta(hours=h)) for h in hours], schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are read in order of time
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = [(None if r.late else (r.started - T).total_seconds() / 3600, r.n, r.late) for r in win.run_available(spark, win.fire_incidents(stream), "inc").orderBy("ts").collect()]
    assert got == [(None, 0, True), (50, 1, False), (50, 2, False), (90, 1, False)]
