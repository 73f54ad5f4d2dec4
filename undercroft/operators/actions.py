"""Replay of a dispatcher action log into card and order states.

Every action maps the joint state (card status, order status) to another one, so a
stretch of the log is one array: where each starting state ends up.  Arrays compose,
which lets a long log be folded by day in parallel and the days chained afterwards.
No entity's whole log ever sits in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undercroft import config

CARD = config.CARD_STATUSES
ORDER = ("NONE", *config.ORDER_STATUSES)
EVENTS = ("take", "release", "decide_order", "decide_busy", "decide_close", "assign", "reject", "close_yes", "close_no")


def step(event: str, card: str, order: str) -> tuple[str, str] | None:
    """Next joint state, or None when the action is not allowed from this one."""
    rule = {(a, e): (src, dst) for a, e, src, dst in config.TRANSITIONS}
    verb = event.split("_")[0]
    entity = "prediction" if verb in ("take", "release", "decide") else "order"
    src, dst = rule[(verb, entity)]
    if (card if entity == "prediction" else order) not in src:
        return None
    if verb in ("take", "release"):
        return dst, order
    if event == "decide_order":
        return dst, "CONFIRMED" if order in ("NONE", "AUTO_CREATED") else order
    if event == "decide_busy":  # a crew already works on the facility
        return ("DECIDED", order) if order == "NONE" else (dst, "CONFIRMED" if order == "AUTO_CREATED" else order)
    if event == "decide_close":
        return "DECIDED", "REJECTED" if order in ("AUTO_CREATED", "CONFIRMED") else order
    if verb in ("assign", "reject"):
        return card, dst
    end = "CLOSED_CONFIRMED" if event == "close_yes" else "CLOSED_NOT_CONFIRMED"
    return end, end


def code_of(card: str, order: str) -> int:
    return CARD.index(card) * len(ORDER) + ORDER.index(order)


def _tables() -> tuple[dict[str, list[int]], dict[str, list[bool]]]:
    moves, allowed = {}, {}
    for e in EVENTS:
        row, ok = [], []
        for c in CARD:
            for o in ORDER:
                nxt = step(e, c, o)
                row.append(code_of(*(nxt or (c, o))))
                ok.append(nxt is not None)
        moves[e], allowed[e] = row, ok
    return moves, allowed


def _lookup(table: dict[str, list], event: Column) -> Column:
    pairs = [x for e, row in table.items() for x in (F.lit(e), F.array(*[F.lit(v) for v in row]))]
    return F.element_at(F.create_map(*pairs), event)


def event_of(action: str = "action", level: str = "level", fact: str = "fact", busy: str = "busy") -> Column:
    """Replay event of a log row; the decided level and the crew's finding pick the branch."""
    needs = F.col(level).isin(*config.ORDER_LEVELS)
    return (
        F.when(F.col(action) == "decide", F.when(needs & F.col(busy), "decide_busy").when(needs, "decide_order").otherwise("decide_close"))
        .when(F.col(action) == "close", F.when(F.col(fact), "close_yes").otherwise("close_no"))
        .otherwise(F.col(action)))


def replay(log: DataFrame, start: DataFrame, key: str = "prediction_id", ts: str = "ts",
           tiebreak: Sequence[str] = ("seq",), event: str = "event") -> DataFrame:
    """Log rows with the state before and after them and whether the action was allowed.

    ``start`` is (key, card_status, order_status); unknown events change nothing.
    """
    moves, allowed = _tables()
    size = len(CARD) * len(ORDER)
    identity = F.array(*[F.lit(i) for i in range(size)])
    known = log.filter(F.col(event).isin(*EVENTS)).withColumn("_b", F.to_date(ts))
    order = F.sort_array(F.collect_list(F.struct(ts, *tiebreak, event)))
    chunks = known.groupBy(key, "_b").agg(order.alias("_acts"))
    composed = F.aggregate(
        "_acts", identity,
        lambda acc, a: F.transform(acc, lambda s: F.element_at(_lookup(moves, a[event]), s + 1)))
    days = chunks.withColumn("_map", composed)
    # Days are chained by doubling: a round puts the map of 1, 2, 4, ... days earlier before the own one.
    longest = known.select(key, "_b").distinct().groupBy(key).count().agg(F.max("count")).first()[0] or 1
    chain, step = Window.partitionBy(key).orderBy("_b"), 1
    days = days.withColumn("_upto", F.col("_map"))
    while step < longest:
        days = days.withColumn("_far", F.lag("_upto", step).over(chain))
        days = days.withColumn("_upto", F.when(F.col("_far").isNull(), F.col("_upto")).otherwise(F.transform("_far", lambda s: F.element_at("_upto", s + 1))))
        step *= 2
    first = _code(F.col("card_status"), F.col("order_status"))
    entered = days.withColumn("_before", F.lag("_upto").over(chain)).join(
        start.select(key, first.alias("_s0")), key, "left").withColumn("_s0", F.coalesce("_s0", F.lit(0))).withColumn(
        "_s", F.coalesce(F.element_at("_before", F.col("_s0") + 1), F.col("_s0")))
    # Inside a chunk the states are laid out in one array, then exploded next to the actions.
    steps = F.aggregate(
        "_acts", F.array(F.col("_s")),
        lambda acc, a: F.concat(acc, F.array(F.element_at(_lookup(moves, a[event]), F.element_at(acc, -1) + 1))))
    rows = entered.withColumn("_st", steps).select(
        key, F.posexplode("_acts").alias("_i", "_a"), "_st").select(
        key, "_a.*", F.element_at("_st", F.col("_i") + 1).alias("_from"), F.element_at("_st", F.col("_i") + 2).alias("_to"))
    ok = F.element_at(_lookup(allowed, F.col(event)), F.col("_from") + 1)
    names = lambda c, half: F.element_at(
        F.array(*[F.lit(x) for x in (CARD if half == 0 else ORDER)]),
        ((F.floor(c / len(ORDER)) if half == 0 else c % len(ORDER)) + 1).cast("int"))
    return rows.select(key, ts, *tiebreak, event, ok.alias("allowed"),
                       names(F.col("_from"), 0).alias("card_before"), names(F.col("_to"), 0).alias("card_status"),
                       names(F.col("_from"), 1).alias("order_before"), names(F.col("_to"), 1).alias("order_status"))


def _code(card: Column, order: Column) -> Column:
    c = F.array_position(F.array(*[F.lit(x) for x in CARD]), card) - 1
    o = F.array_position(F.array(*[F.lit(x) for x in ORDER]), F.coalesce(order, F.lit("NONE"))) - 1
    return (c * len(ORDER) + o).cast("int")


def final_states(replayed: DataFrame, key: str = "prediction_id", ts: str = "ts",
                 tiebreak: Sequence[str] = ("seq",)) -> DataFrame:
    last = F.struct(ts, *tiebreak)
    return replayed.groupBy(key).agg(
        F.max_by("card_status", last).alias("card_status"), F.max_by("order_status", last).alias("order_status"),
        F.count_if("allowed").alias("applied"), F.count_if(~F.col("allowed")).alias("ignored"))
