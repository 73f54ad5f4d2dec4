"""Incident cards as a keyed table merge: a run's forecasts against stored cards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undercroft import config
from undercroft.functions.cards import level_for, level_from, level_order, replace_blocks
from undercroft.functions.clock import shift
from undercroft.operators.journal import side_by_side

PAIR = ("facility_id", "direction")
#: Stored cards that one task of a merge joins.
CARDS_A_PART = 250_000
FRESH = ("probability", "level", "computed_at", "run_id")


def untouched() -> Column:
    """Nobody took or decided the card."""
    return (F.col("status") == "NEW") & F.col("assignee").isNull() & F.col("verdict").isNull()


def assign_levels(forecasts: DataFrame, bands: Sequence[tuple[str, float]] | None = None) -> DataFrame:
    """Own level first, then the bounds of the run, then those of the direction."""
    by_p = level_from("probability", bands) if bands else level_for("probability", "direction")
    own = F.col("level") if "level" in forecasts.columns else F.lit(None)
    return forecasts.withColumn("level", F.coalesce(own, by_p))


def merge_parts(cards: DataFrame) -> int:
    """Parts of a merge by the number of cards, so that what a task sorts does not grow with the store.

    0 leaves the parts to the planner: each core has no more cards than a part then.
    """
    parts = -(-cards.count() // CARDS_A_PART)
    return parts if parts > cards.sparkSession.sparkContext.defaultParallelism else 0


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    return df.repartition(parts, *keys) if parts else df


def merge_plan(cards: DataFrame, forecasts: DataFrame, parts: int | None = None) -> DataFrame:
    """What each forecast does: ``follow`` an untouched card, ``insert`` one, ``refresh`` a
    taken one, or ``none``.

    ``forecasts`` holds one row per facility and direction: (pair, bucket, computed_at,
    event_at, ...).  Stored cards meet it on the pair and fold into one row before the
    decision, with partial sums on the map side.
    """
    c = cards.select(*PAIR, F.col("prediction_id").alias("_id"), F.col("bucket").alias("_bucket"),
                     F.col("status").alias("_st"), F.col("computed_at").alias("_at"), untouched().alias("_free"))
    f = forecasts.select(*PAIR, F.col("bucket").alias("item_bucket"), F.col("computed_at").alias("at"), "event_at")
    parts = merge_parts(cards) if parts is None else parts
    joined = dealt(f, parts, *PAIR).join(dealt(c, parts, *PAIR), list(PAIR), "left")
    later = F.col("_bucket") >= F.col("item_bucket")
    folded = joined.groupBy(*PAIR, "item_bucket", "at", "event_at").agg(
        F.max(F.col("_st").isin(*config.CARDS_IN_WORK).cast("int")).alias("_busy"),
        F.max(F.when(F.col("_free"), F.struct("_bucket", "_id"))).alias("_open"),
        F.max(F.when(later, F.struct("_bucket", "_id", "_st", "_at"))).alias("_late"),
        F.max(F.when(F.col("_bucket") == F.col("item_bucket"), F.struct("_id", "_st"))).alias("_same"),
        F.max(F.when(F.col("_bucket") == F.col("at"), F.struct("_id", "_st"))).alias("_now"),
    )
    busy = F.coalesce(F.col("_busy") == 1, F.lit(False))
    follow = ~busy & F.col("_open").isNotNull()
    keep_bucket = F.col("_same").isNotNull() & (F.col("_same._id") != F.col("_open._id"))
    finished = F.col("_late._st").isin(*config.FINISHED_CARDS)
    newer = F.coalesce(F.col("event_at") > F.col("_late._at"), F.lit(False))
    copy = finished & newer
    action = (
        F.when(busy, F.when(F.col("_same").isNotNull(), "refresh").otherwise("none"))
        .when(follow, "follow")
        .when(F.col("_late").isNull(), "insert")
        .when(copy & F.col("_now").isNull(), "insert")
        .when(copy | ~finished, "refresh")
        .otherwise("none")
    )
    target = (
        F.when(busy, F.col("_same._id")).when(follow, F.col("_open._id"))
        .when(copy, F.col("_now._id")).when(~finished, F.col("_late._id")))
    bucket = (
        F.when(busy, F.col("item_bucket"))
        .when(follow, F.when(keep_bucket, F.col("_open._bucket")).otherwise(F.col("item_bucket")))
        .when(F.col("_late").isNull(), F.col("item_bucket")).when(copy, F.col("at")).otherwise(F.col("_late._bucket")))
    is_new = F.when(follow, F.coalesce(bucket != F.col("_open._bucket"), F.lit(False))).otherwise(F.col("action") == "insert")
    return folded.withColumn("action", action).select(
        *PAIR, "action", target.alias("target_id"), bucket.alias("bucket"), is_new.alias("is_new"))


def merge_cards(cards: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Cards after the run, with ``is_new`` on those the run opened.

    Taken cards keep level and probability and only refresh ``computed_at``; finished
    cards are frozen.
    """
    parts = merge_parts(cards)
    plan = merge_plan(cards, forecasts, parts)
    fresh = dealt(forecasts.select(*PAIR, *[F.col(c).alias(f"_f_{c}") for c in FRESH]), parts, *PAIR).join(plan, list(PAIR))
    changes = fresh.filter(F.col("action").isin("follow", "refresh")).select(
        F.col("target_id").alias("prediction_id"), F.col("action").alias("_a"), F.col("bucket").alias("_b"),
        F.col("is_new").alias("_new"), *[f"_f_{c}" for c in FRESH])
    follow = F.col("_a") == "follow"
    live = (F.col("_a") == "refresh") & ~F.col("status").isin(*config.FINISHED_CARDS)
    kept = dealt(cards, parts, "prediction_id").join(dealt(changes, parts, "prediction_id"), "prediction_id", "left")
    updated = kept.withColumns({
        **{c: F.when(follow | (live if c == "computed_at" else F.lit(False)), F.col(f"_f_{c}")).otherwise(F.col(c)) for c in FRESH},
        "bucket": F.when(follow, F.col("_b")).otherwise(F.col("bucket")),
        "is_new": F.coalesce(F.col("_new") & follow, F.lit(False)),
    }).select(*cards.columns, "is_new")
    opened = fresh.filter("action = 'insert'").select(
        F.concat_ws("-", "direction", F.col("facility_id").cast("string"), F.unix_seconds("bucket").cast("string")).alias("prediction_id"),
        *PAIR, "bucket", F.lit("NEW").alias("status"), F.lit(None).cast("string").alias("assignee"),
        F.lit(None).cast("string").alias("verdict"), *[F.col(f"_f_{c}").alias(c) for c in FRESH],
        F.lit(True).alias("is_new"))
    return updated.unionByName(opened.select(*[c for c in opened.columns if c in (*cards.columns, "is_new")]),
                               allowMissingColumns=True)


def refresh_taken(cards: DataFrame, live: DataFrame, at: str) -> DataFrame:
    """Live blocks over the stored ones of unfinished cards; level and factors stay.

    ``live`` is (prediction_id, live_blocks).
    """
    joined = cards.join(live, "prediction_id", "left")
    hit = F.col("live_blocks").isNotNull() & ~F.col("status").isin(*config.FINISHED_CARDS)
    return joined.withColumn("blocks", F.when(hit, replace_blocks(F.col("blocks"), F.col("live_blocks"))).otherwise(F.col("blocks"))).withColumn(
        "computed_at", F.when(hit, F.lit(at).cast("timestamp")).otherwise(F.col("computed_at"))).drop("live_blocks")


def stale_refresh(cards: DataFrame, at: str, minutes: int = 5) -> DataFrame:
    """Unfinished cards of today not refreshed for ``minutes``."""
    now = F.lit(at).cast("timestamp")
    return cards.filter(
        (F.col("bucket") == F.date_trunc("day", now)) & (F.col("computed_at") <= shift(now, -minutes * 60))
        & ~F.col("status").isin(*config.FINISHED_CARDS))


def done_today(cards: DataFrame, at: str) -> DataFrame:
    """Whether each direction has already run today: by bucket for daily, by time for stream ones."""
    today = F.date_trunc("day", F.lit(at).cast("timestamp"))
    stream = F.col("direction").isin(*[d.code for d in config.DIRECTIONS if d.cadence == "stream"])
    done = F.when(stream, F.col("computed_at") >= today).otherwise(F.col("bucket") == today)
    return cards.groupBy("direction").agg((F.max(done.cast("int")) == 1).alias("done"))


def busy_facilities(cards: DataFrame) -> DataFrame:
    return cards.filter(F.col("status").isin(*config.CARDS_IN_WORK)).select(*PAIR).distinct()


def without_busy(forecasts: DataFrame, cards: DataFrame) -> DataFrame:
    return forecasts.join(busy_facilities(cards), list(PAIR), "left_anti")


def suppressed_level(cards: DataFrame, at: str | Column) -> DataFrame:
    """Highest level order muted on a facility at a moment."""
    now = F.lit(at).cast("timestamp") if isinstance(at, str) else at
    return cards.filter(F.col("suppress_until") > now).groupBy(*PAIR).agg(F.max(level_order("level")).alias("muted"))


def run_report(merged: DataFrame, orders_created: DataFrame, started: str, finished: str) -> DataFrame:
    """Counts and duration of one run, one row."""
    a, b = F.lit(started).cast("timestamp"), F.lit(finished).cast("timestamp")
    return side_by_side(
        merged.agg(F.count_if("is_new").alias("prediction_count"), F.count(F.lit(1)).alias("cards")),
        orders_created.agg(F.count(F.lit(1)).alias("order_count")),
    ).withColumn("duration_ms", ((F.unix_micros(b) - F.unix_micros(a)) / 1000).cast("long"))


def stream_lag(events: DataFrame, since: str, started: str, finished: str) -> DataFrame:
    """Events received since the previous run and the largest delay in milliseconds."""
    lo, hi, end = (F.lit(x).cast("timestamp") for x in (since, started, finished))
    rows = events.filter((F.col("received_at") > lo) & (F.col("received_at") <= hi))
    return rows.agg(F.count(F.lit(1)).alias("stream_events"),
                    F.max((F.unix_micros(end) - F.unix_micros("occurred_at")) / 1000).cast("long").alias("stream_lag_ms"))
