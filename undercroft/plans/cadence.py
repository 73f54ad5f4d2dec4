"""Runs by cadence: what is due now, over which units, and the stream that keeps calling.

A daily direction runs once a day over all its units.  A direction of the stream runs with every batch: over all units the first
time of a day, then only over its candidates, the units that an event reached or left since the last run.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from undercroft import config
from undercroft.functions.clock import shift
from undercroft.operators.cards import done_today
from undercroft.plans.run import Predictors, run_planned
from undercroft.session import stored
from undercroft.sources.writers import write_batch

RUNS = "direction string, run_id long, at timestamp, full boolean, scored long"


def moved_since(events: DataFrame, since: str, at: str, hours: int = 24, ts: str = "ts") -> DataFrame:
    """Facilities with an event after ``since``, or with one that the look-back of ``hours`` held then and holds no more."""
    now, then = F.lit(at).cast("timestamp"), F.lit(since).cast("timestamp")
    came = (F.col(ts) > then) & (F.col(ts) <= now)
    left = (F.col(ts) > shift(then, -hours * 3600)) & (F.col(ts) <= shift(now, -hours * 3600))
    return events.filter(came | left).select("facility_id").distinct()


def last_runs(runs: DataFrame) -> dict[str, str]:
    """Moment of each direction's last run: a row a direction."""
    rows = runs.groupBy("direction").agg(F.date_format(F.max("at"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")).collect()
    return {r["direction"]: r["at"] for r in rows}


def planned(predictors: Predictors, units: DataFrame, cards: DataFrame, events: DataFrame, runs: DataFrame, at: str) -> Mapping[str, tuple[str, DataFrame, bool]]:
    """Moment, units and whether it is a full run, of every direction that is due at ``at``.

    A daily direction computes for the start of its day.  A stream direction without candidates of its own takes all units
    every time; so does one whose last run is not known.
    """
    done = {r["direction"] for r in done_today(cards, at).filter("done").collect()}  # a row a direction
    before, out = last_runs(runs), {}
    for code in predictors.due():
        own = predictors.held[code]
        if config.DIRECTION[code].cadence != "stream":
            if code not in done:
                out[code] = (at[:10] + " 00:00:00", units, True)
        elif code not in done or own.candidates is None or code not in before:
            out[code] = (at, units, True)
        else:
            out[code] = (at, units.join(own.candidates(events, before[code], at), "facility_id", "left_semi"), False)
    return out


def run_due(predictors: Predictors, units: DataFrame, cards: DataFrame, orders: DataFrame, events: DataFrame, runs: DataFrame, at: str, run_id: int, last_number: int = 0) -> Mapping[str, DataFrame]:
    """As ``run_directions``, of what is due; ``runs`` are the log's new rows, one for each direction that ran."""
    spark = units.sparkSession
    plan = planned(predictors, units, cards, events, runs, at)
    if not plan:
        return {"cards": cards, "orders": orders, "created": spark.createDataFrame([], orders.schema), "runs": spark.createDataFrame([], RUNS)}
    result = dict(run_planned(predictors, {code: (moment, part) for code, (moment, part, _) in plan.items()}, cards, orders, at, run_id, last_number))
    whole = spark.createDataFrame([(code, full) for code, (_, _, full) in plan.items()], "direction string, full boolean")
    counts = result["forecasts"].groupBy("direction").agg(F.count(F.lit(1)).alias("scored"))
    result["runs"] = whole.join(counts, "direction", "left").select(
        "direction", F.lit(run_id).cast("long").alias("run_id"), F.lit(at).cast("timestamp").alias("at"), "full", F.coalesce("scored", F.lit(0)).cast("long").alias("scored"))
    return result


def version(spark: SparkSession, path: str, before: int, first: DataFrame) -> DataFrame:
    """The table as the last run before ``before`` left it; ``first`` if none did."""
    try:
        latest = spark.read.parquet(path).filter(F.col("run") < before).agg(F.max("run")).first()[0]
    except AnalysisException:
        latest = None
    return first if latest is None else spark.read.schema(first.schema).parquet(f"{path}/run={latest}")


def serve(events: DataFrame, predictors: Predictors, units: DataFrame, cards: DataFrame, orders: DataFrame, path: str, checkpoint: str,
          clock: Callable[[DataFrame], str | None] | None = None, lookback_days: int = 2, every: str | None = "1 minute") -> StreamingQuery:
    """The job that stays: every batch of ``facility_id, ts`` is kept, and what is due then runs over it.

    ``every`` is the trigger's interval; None drains what is there.  The moment of a run is the latest event so far, so a batch
    that is played again gives what it gave; a live job may hand in its own ``clock``.  Each run writes its tables under its
    batch and reads those of the run before, so a lost job goes on where it stood.  Of the events only the days of the
    look-back are read.
    """
    spark = units.sparkSession

    def latest(held: DataFrame) -> str | None:
        return held.agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]

    def write(table: DataFrame, name: str, batch_id: int) -> None:
        table.write.mode("overwrite").parquet(f"{path}/{name}/run={batch_id}")

    def run(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.select("facility_id", "ts").withColumn("day", F.to_date("ts")), f"{path}/events", batch_id)
        held = spark.read.schema("facility_id long, ts timestamp, day date, batch long").parquet(f"{path}/events").filter(F.col("batch") <= batch_id)
        at = clock(batch) if clock else latest(held)
        if at is None:
            return
        near = held.filter(F.col("day") >= F.date_sub(F.lit(at).cast("date"), lookback_days))
        now_cards, now_orders = (version(spark, f"{path}/{n}", batch_id, first) for n, first in (("cards", cards), ("orders", orders)))
        log = spark.createDataFrame([], RUNS) if batch_id == 0 else version(spark, f"{path}/runs", batch_id, spark.createDataFrame([], RUNS))
        numbered = now_orders.filter(F.col("number").startswith(at[:4])).agg(F.max(F.element_at(F.split("number", "-"), -1).cast("int"))).first()[0] if "number" in now_orders.columns else 0
        result = run_due(predictors, units, now_cards, now_orders, near, log, at, batch_id, numbered or 0)
        log = stored(log.unionByName(result["runs"]))
        for name in ("cards", "orders"):
            write(result[name], name, batch_id)
        write(log, "runs", batch_id)  # last: a run without it is played again

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def served(spark: SparkSession, path: str, name: str, schema: str | None = None) -> DataFrame:
    """A table as the last finished run left it."""
    rows = spark.read.parquet(f"{path}/runs")
    latest = rows.agg(F.max("run")).first()[0]
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/{name}/run={latest}")

