"""Work orders: follow the fresh forecast, create the missing ones, one open per facility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undercroft import config
from undercroft.functions.cards import audit_row, level_order
from undercroft.functions.clock import local_midnight, shift
from undercroft.operators.cards import PAIR
from undercroft.operators.ordered import ranked


def default_due(at: str | Column = "computed_at", direction: str | Column = "direction",
                horizon: str | Column = "horizon_hours") -> Column:
    """Next local midnight for daily directions, part of the horizon for stream ones."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    out = shift(local_midnight(c(at)), 86400)
    for d in config.DIRECTIONS:
        if d.cadence == "stream":
            later = F.timestamp_micros((F.unix_micros(c(at)) + c(horizon) * d.due_factor * 3.6e9).cast("long"))
            out = F.when(c(direction) == d.code, later).otherwise(out)
    return out


def first_work_type(direction: str = "direction") -> Column:
    out = F.lit(None).cast("string")
    for d in config.DIRECTIONS:
        if d.work_types:
            out = F.when(F.col(direction) == d.code, d.work_types[0]).otherwise(out)
    return out


def with_order_state(candidates: DataFrame, orders: DataFrame) -> DataFrame:
    """Candidates with the newest untouched order of their pair and whether an open one exists.

    ``candidates`` holds one row per facility and direction.
    """
    state = orders.groupBy(*PAIR).agg(
        F.max(F.when(F.col("status") == "AUTO_CREATED", F.struct("created_at", "order_id", "prediction_id"))).alias("_auto"),
        F.max((~F.col("status").isin(*config.CLOSED_ORDERS)).cast("int")).alias("_open"))
    return candidates.join(state, list(PAIR), "left")


def follow_orders(orders: DataFrame, candidates: DataFrame) -> DataFrame:
    """Untouched orders move to the fresh forecast, or are rejected when the risk fell."""
    moved = with_order_state(candidates, orders).filter(F.col("_auto").isNotNull()).select(
        F.col("_auto.order_id").alias("order_id"), F.col("prediction_id").alias("_p"), default_due().alias("_due"),
        F.col("level").isin(*config.ORDER_LEVELS).alias("_keep"))
    hit = F.col("_p").isNotNull()
    return orders.join(moved, "order_id", "left").withColumns({
        "prediction_id": F.when(hit & F.col("_keep"), F.col("_p")).otherwise(F.col("prediction_id")),
        "due_at": F.when(hit & F.col("_keep"), F.col("_due")).otherwise(F.col("due_at")),
        "status": F.when(hit & ~F.col("_keep"), "REJECTED").otherwise(F.col("status")),
    }).select(*orders.columns)


def follow_log(orders: DataFrame, candidates: DataFrame, actor: str = "pipeline") -> DataFrame:
    """Audit rows of the moves: relinks to another card and automatic rejections."""
    rows = with_order_state(candidates, orders).filter(F.col("_auto").isNotNull())
    keep = F.col("level").isin(*config.ORDER_LEVELS)
    moved = rows.filter(~keep | (F.col("_auto.prediction_id") != F.col("prediction_id")))
    code = F.when(keep, "relink").otherwise("auto_reject")
    payload = F.struct(F.col("_auto.prediction_id").cast("string").alias("from"),
                       F.col("prediction_id").cast("string").alias("to"), "level")
    return moved.select(audit_row("order", F.col("_auto.order_id"), code, F.lit(actor), payload).alias("r")).select("r.*")


def create_orders(orders: DataFrame, candidates: DataFrame, cards: DataFrame, year: int, last_number: int) -> DataFrame:
    """New orders: level asks for one, none is open, the level beats the muted one."""
    muted = cards.filter(F.col("suppress_until").isNotNull()).select(
        *PAIR, "suppress_until", level_order("level").alias("_lv"))
    ready = with_order_state(candidates, orders).filter(
        F.col("_auto").isNull() & (F.coalesce("_open", F.lit(0)) == 0) & F.col("level").isin(*config.ORDER_LEVELS))
    ready = ready.drop("suppress_until").join(muted, list(PAIR), "left").groupBy(
        "prediction_id", *PAIR, "level", "horizon_hours", "computed_at").agg(
        F.max(F.when(F.col("suppress_until") > F.col("computed_at"), F.col("_lv")).otherwise(0)).alias("_muted"))
    wanted = ready.filter(level_order("level") > F.col("_muted"))
    numbered = ranked(wanted, [F.col(c) for c in (*PAIR, "prediction_id")], rank="_n")
    number = F.format_string("%d-%04d", F.lit(year), F.col("_n") + last_number)
    return numbered.select(
        F.concat(F.lit("WO-"), number).alias("order_id"), number.alias("number"), "prediction_id", *PAIR,
        first_work_type().alias("work_type"), default_due().alias("due_at"), F.lit("AUTO_CREATED").alias("status"),
        F.lit("pipeline").alias("created_by"), F.col("computed_at").alias("created_at"))


def suppress_until(reason: str | Column, at: str | Column) -> Column:
    """End of the mute by the reason of a rejection."""
    r = F.col(reason) if isinstance(reason, str) else reason
    hours = F.lit(config.MUTE_FALLBACK_HOURS)
    for code, h in config.MUTE_HOURS.items():
        hours = F.when(r == code, h).otherwise(hours)
    c = F.col(at) if isinstance(at, str) else at
    return F.timestamp_micros(F.unix_micros(c) + hours.cast("long") * 3_600_000_000)
