import datetime as dt

import pytest
from pyspark.sql import functions as F

from undercroft.plans import cadence as cd
from undercroft.plans.run import Predictor, Predictors, forecasts_of, run_planned

AT = "2024-03-05 12:00:00"
NOW = dt.datetime(2024, 3, 5, 12)
DAY = dt.datetime(2024, 3, 5)
CARDS = "prediction_id string, facility_id long, direction string, bucket timestamp, status string, assignee string, verdict string, probability double, level string, computed_at timestamp, run_id long"
ORDERS = "order_id string, prediction_id string, facility_id long, direction string, status string, created_at timestamp, due_at timestamp, number string"


def scores(units, at):
    return units.select("facility_id", (F.col("facility_id") / 10).alias("probability"), F.lit("HIGH").alias("level"))


def tables(spark, cards=()):
    return spark.createDataFrame(list(cards), CARDS), spark.createDataFrame([], ORDERS)


def predictors(**hooks):
    held = Predictors()
    held.add("FIRE_RISK", Predictor(scores, **hooks))
    held.add("FLOOD_RISK", Predictor(scores))
    return held


def test_what_is_due(spark):
    units = spark.range(1, 6).withColumnRenamed("id", "facility_id")
    events = spark.createDataFrame([(1, NOW), (2, NOW - dt.timedelta(hours=2)), (3, NOW - dt.timedelta(hours=24, minutes=30)), (4, NOW - dt.timedelta(hours=26)), (9, NOW)], "facility_id long, ts timestamp")
    runs = spark.createDataFrame([("FIRE_RISK", 1, NOW - dt.timedelta(hours=1), True, 5), ("FIRE_RISK", 0, NOW - dt.timedelta(hours=9), True, 5)], cd.RUNS)
    none, _ = tables(spark)
    fresh = [("a", 1, "FIRE_RISK", DAY, "NEW", None, None, 0.1, "LOW", NOW - dt.timedelta(hours=1), 1), ("b", 1, "FLOOD_RISK", DAY, "NEW", None, None, 0.1, "LOW", DAY, 1)]
    held = predictors(candidates=cd.moved_since)

    def plan(cards, log=runs, own=held):
        return {c: (at, sorted(r.facility_id for r in u.collect()), full) for c, (at, u, full) in cd.planned(own, units, cards, events, log, AT).items()}

    everything = [1, 2, 3, 4, 5]
    assert plan(none) == {"FIRE_RISK": (AT, everything, True), "FLOOD_RISK": ("2024-03-05 00:00:00", everything, True)}
    done, _ = tables(spark, fresh)
    assert plan(done) == {"FIRE_RISK": (AT, [1, 3], False)}  # a new event, and one that left the look-back; 9 is no unit
    assert plan(done, runs.filter("false"))["FIRE_RISK"] == (AT, everything, True)
    assert plan(done, own=predictors())["FIRE_RISK"] == (AT, everything, True)
    yesterday, _ = tables(spark, [(*r[:3], DAY - dt.timedelta(days=1), *r[4:9], NOW - dt.timedelta(days=1), 1) for r in fresh])
    assert set(plan(yesterday)) == {"FIRE_RISK", "FLOOD_RISK"}


def test_nothing_due_changes_nothing(spark):
    units = spark.range(1, 3).withColumnRenamed("id", "facility_id")
    held = Predictors()
    held.add("FLOOD_RISK", Predictor(scores))
    cards, orders = tables(spark, [("b", 1, "FLOOD_RISK", DAY, "NEW", None, None, 0.1, "LOW", DAY, 1)])
    out = cd.run_due(held, units, cards, orders, spark.createDataFrame([], "facility_id long, ts timestamp"), spark.createDataFrame([], cd.RUNS), AT, 4)
    assert out["runs"].count() == out["created"].count() == 0 and out["cards"].collect() == cards.collect()


def test_hooks_of_a_forecast(spark):
    start = dt.datetime(2024, 3, 4, 23)
    own = Predictor(scores, incident=lambda at: F.when(F.col("facility_id") == 1, F.lit(start)), last_event=lambda at: F.lit(at).cast("timestamp") - F.expr("INTERVAL 2 HOURS"),
                    level=lambda at: F.when(F.col("facility_id") == 2, "LOW"), summary=lambda at: F.concat(F.lit("n "), F.col("facility_id").cast("string")))
    rows = {r.facility_id: r for r in forecasts_of("FIRE_RISK", own, spark.range(1, 3).withColumnRenamed("id", "facility_id"), AT, 3).collect()}
    assert (rows[1].bucket, rows[2].bucket) == (start, DAY) and rows[1].event_at == NOW - dt.timedelta(hours=2)
    assert (rows[2].level, rows[2].summary) == ("LOW", "n 2") and rows[1].level == "LOW"  # no own level: the bounds of the direction
    plain = {r.facility_id: r for r in forecasts_of("FLOOD_RISK", Predictor(scores), spark.range(1, 2).withColumnRenamed("id", "facility_id"), AT, 3).collect()}
    assert (plain[1].level, plain[1].event_at, plain[1].summary, plain[1].bucket) == ("HIGH", None, None, DAY)


def test_incident_card_is_copied_when_something_new_came(spark):
    """A finished card stays; a later event of the same incident opens its copy, an older one does not."""
    start = DAY + dt.timedelta(hours=1)
    cards, orders = tables(spark, [(f"c{f}", f, "FIRE_RISK", start, "DECIDED", "u", "AGREED", 0.5, "HIGH", DAY + dt.timedelta(hours=6), 1) for f in (1, 2)])
    held = Predictors()
    held.add("FIRE_RISK", Predictor(scores, incident=lambda at: F.lit(start), last_event=lambda at: F.when(F.col("facility_id") == 1, F.lit(NOW)).otherwise(F.lit(start))))
    units = spark.range(1, 3).withColumnRenamed("id", "facility_id")
    out = run_planned(held, {"FIRE_RISK": (AT, units)}, cards, orders, AT, 2)["cards"].collect()
    assert sorted((r.facility_id, r.bucket, r.status) for r in out) == [(1, start, "DECIDED"), (1, NOW, "NEW"), (2, start, "DECIDED")]


def test_live_blocks_reach_unfinished_cards_of_the_run(spark):
    block = "array<struct<type:string,title:string,data:string>>"
    old = [("table", "old", "1"), ("factors", "why", "2")]
    schema = CARDS + f", blocks {block}"
    cards = spark.createDataFrame([("c1", 1, "FIRE_RISK", DAY, "IN_REVIEW", "u", None, 0.5, "HIGH", DAY, 1, old), ("c2", 2, "FIRE_RISK", DAY, "DECIDED", "u", "AGREED", 0.5, "HIGH", DAY, 1, old), ("c3", 3, "FIRE_RISK", DAY, "IN_REVIEW", "u", None, 0.5, "HIGH", DAY, 1, old)], schema)
    held = Predictors()
    held.add("FIRE_RISK", Predictor(scores, live_blocks=lambda units, at: units.select("facility_id", F.array(F.struct(F.lit("table").alias("type"), F.lit("fresh").alias("title"), F.lit("3").alias("data"))).alias("live_blocks"))))
    units = spark.range(1, 3).withColumnRenamed("id", "facility_id")
    out = {r.prediction_id: [b.title for b in r.blocks] for r in run_planned(held, {"FIRE_RISK": (AT, units)}, cards, tables(spark)[1], AT, 2)["cards"].collect() if r.blocks}
    assert out == {"c1": ["fresh", "why"], "c2": ["old", "why"], "c3": ["old", "why"]}


def test_a_batch_played_again_gives_the_same(spark, tmp_path):
    units = spark.range(0, 4).withColumnRenamed("id", "facility_id")
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for k, rows in enumerate([[(0, DAY), (1, DAY)], [(2, NOW)], [(2, NOW + dt.timedelta(hours=30))]]):
        spark.createDataFrame(rows, "facility_id long, ts timestamp").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("facility_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    cards, orders = tables(spark)

    def drain(state):
        cd.serve(stream, predictors(candidates=cd.moved_since), units, cards, orders, path, str(tmp_path / state), every=None).awaitTermination()
        log = sorted(tuple(r) for r in cd.served(spark, path, "runs", cd.RUNS).collect())
        return log, sorted(map(str, cd.served(spark, path, "cards", CARDS).collect()))

    first = drain("a")
    assert [(d, k, full, n) for d, k, _, full, n in first[0]] == [("FIRE_RISK", 0, True, 4), ("FIRE_RISK", 1, False, 1), ("FIRE_RISK", 2, True, 4), ("FLOOD_RISK", 0, True, 4), ("FLOOD_RISK", 2, True, 4)]
    assert drain("b") == first  # without its checkpoint the job starts over and overwrites itself
    with pytest.raises(Exception, match="number"):
        cd.serve(stream, predictors(), units.withColumnRenamed("facility_id", "number"), cards, orders, str(tmp_path / "c"), str(tmp_path / "d"), every=None).awaitTermination()
