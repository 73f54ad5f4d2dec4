"""Read queries of the journal, the map, the dashboard and the live charts.

DataFrames in, DataFrames out.  A page is an order and a limit (a top-k per
partition, merged), never a full sort that is then cut.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undercroft import config
from undercroft.functions.cards import level_order
from undercroft.functions.clock import local_midnight, shift
from undercroft.operators.grids import forward_fill

MAX_PAGE = 500
SORTABLE = ("computed_at", "probability", "risk", "horizon_hours", "direction", "status", "summary", "facility_id")


@dataclass(frozen=True)
class Scope:
    """What an actor may see: everything, one district, or one collector."""

    kind: str = "ALL"
    value: str | int | None = None


def scope_filter(df: DataFrame, scope: Scope) -> DataFrame:
    """A scope without a value hides everything."""
    column = {"DISTRICT": "district", "COMPLEX": "collector"}.get(scope.kind)
    if column is None:
        return df
    return df.filter(F.lit(False) if scope.value is None else F.col(column) == scope.value)


def scoped_by_facility(df: DataFrame, facilities: DataFrame, scope: Scope) -> DataFrame:
    """Same for tables without the facility columns: a semi join."""
    if scope.kind not in ("DISTRICT", "COMPLEX"):
        return df
    return df.join(scope_filter(facilities, scope).select("facility_id"), "facility_id", "left_semi")


def day_bounds(first: str | None = None, last: str | None = None, column: str = "computed_at") -> Column:
    """Both days included."""
    hit = F.lit(True)
    if first:
        hit = hit & (F.col(column) >= F.lit(first[:10]).cast("timestamp"))
    if last:
        hit = hit & (F.col(column) < shift(F.lit(last[:10]).cast("timestamp"), 86400))
    return hit


@dataclass(frozen=True)
class SortBy:
    """A column of ``SORTABLE`` and a direction; ``risk`` is the order of levels."""

    column: str
    falling: bool = False

    def __post_init__(self) -> None:
        if self.column not in SORTABLE:
            raise ValueError(f"rows are not sorted by {self.column}")

    def order(self) -> Column:
        by = level_order("level") if self.column == "risk" else F.col(self.column)
        return by.desc() if self.falling else by.asc()


@dataclass(frozen=True)
class Box:
    """West, south, east, north; its borders count in."""

    west: float
    south: float
    east: float
    north: float

    def holds(self, lon: str = "lon", lat: str = "lat") -> Column:
        return F.col(lon).between(self.west, self.east) & F.col(lat).between(self.south, self.north)


def one_page(rows: DataFrame, page: int, size: int, most: int = MAX_PAGE) -> DataFrame:
    """Page ``page`` (from 1) of at most ``most`` rows of an ordered frame."""
    size = sorted((1, size, most))[1]
    return rows.offset(size * max(0, page - 1)).limit(size)


def finished_last() -> Column:
    return F.col("status").isin(*config.FINISHED_CARDS).cast("int")


def journal_order(sort: SortBy | None = None, key: str = "prediction_id") -> list[Column]:
    """Finished cards last, then severity (or the asked field), then the newest."""
    return [finished_last().asc(), sort.order() if sort else level_order("level").desc(),
            F.col("computed_at").desc(), F.col(key).asc()]


def journal_filter(cards: DataFrame, facilities: DataFrame, scope: Scope = Scope(), directions: Sequence[str] = (),
                   levels: Sequence[str] = (), statuses: Sequence[str] = (), district=None, assignee: str | None = None,
                   first: str | None = None, last: str | None = None) -> DataFrame:
    rows = cards.filter(day_bounds(first, last))
    for column, values in (("direction", directions), ("level", levels), ("status", statuses)):
        if values:
            rows = rows.filter(F.col(column).isin(*values))
    if assignee:
        rows = rows.filter(F.col("assignee") == assignee)
    rows = scope_filter(rows.join(facilities, "facility_id"), scope)
    return rows.filter(F.col("district") == district) if district is not None else rows


def journal(rows: DataFrame, sort: SortBy | None = None, page: int = 1, size: int = 20) -> DataFrame:
    return one_page(rows.orderBy(*journal_order(sort)), page, size)


def order_links(cards: DataFrame, orders: DataFrame) -> DataFrame:
    """Own order of a card, else the newest open order of its facility and direction that
    belongs to another card.

    The two newest open orders per pair are enough: at most one of them can be its own.
    """
    own = orders.groupBy("prediction_id").agg(
        F.min(F.struct("order_id", "status")).alias("_own")).select(
        "prediction_id", F.col("_own.order_id").alias("order_id"), F.col("_own.status").alias("order_status"))
    opened = orders.filter(~F.col("status").isin(*config.CLOSED_ORDERS))
    by_owner = opened.groupBy("facility_id", "direction", "prediction_id").agg(
        F.max(F.struct("created_at", "order_id")).alias("_o"))
    top = by_owner.groupBy("facility_id", "direction").agg(
        F.max(F.struct("_o", "prediction_id")).alias("_1"))
    rest = by_owner.join(top, ["facility_id", "direction"]).filter(
        F.col("prediction_id") != F.col("_1.prediction_id")).groupBy("facility_id", "direction").agg(F.max("_o").alias("_2"))
    pair = top.join(rest, ["facility_id", "direction"], "left")
    other = F.when(F.col("_1.prediction_id") != F.col("prediction_id"), F.col("_1._o.order_id")).otherwise(F.col("_2.order_id"))
    return cards.join(own, "prediction_id", "left").join(pair, ["facility_id", "direction"], "left").withColumn(
        "facility_order_id", F.when(F.col("order_id").isNull(), other)).drop("_1", "_2")


def timeseries(readings: DataFrame, keys: Sequence[str] = ("facility_id",)) -> DataFrame:
    """Readings in time order, one row per point."""
    return readings.select(*keys, "metric", "ts", "value").orderBy(*keys, "metric", "ts")


def top_risks(cards: DataFrame, limit: int = 10) -> DataFrame:
    open_cards = cards.filter(~F.col("status").isin(*config.FINISHED_CARDS))
    return open_cards.orderBy(*journal_order()).limit(min(max(limit, 1), 100))


def summary(cards: DataFrame, orders: DataFrame) -> DataFrame:
    """Counters by level (open cards, the dispatcher's word first), direction, card and order
    status, and the total; registry keys without rows are zero, unknown keys stay.

    One pass over the cards: a row is counted under each of its counters.
    """
    spark = cards.sparkSession
    final = F.coalesce(F.col("dispatcher_level"), F.col("level"))
    opened = ~F.col("status").isin(*config.FINISHED_CARDS)
    marks = F.array(
        F.struct(F.lit("level").alias("counter"), F.when(opened, final).alias("key")),
        F.struct(F.lit("direction").alias("counter"), F.col("direction").alias("key")),
        F.struct(F.lit("status").alias("counter"), F.col("status").alias("key")),
        F.struct(F.lit("total").alias("counter"), F.lit("all").alias("key")))
    found = cards.select(F.explode(marks).alias("m")).select("m.*").unionByName(
        orders.select(F.lit("order_status").alias("counter"), F.col("status").alias("key"))
    ).filter(F.col("key").isNotNull()).groupBy("counter", "key").agg(F.count(F.lit(1)).alias("n"))
    keys = [("level", c) for c in config.LEVEL_ORDER] + [("direction", d.code) for d in config.DIRECTIONS if d.enabled]
    keys += [("status", c) for c in config.CARD_STATUSES] + [("order_status", c) for c in config.ORDER_STATUSES] + [("total", "all")]
    registry = spark.createDataFrame(keys, "counter string, key string")
    return found.join(F.broadcast(registry), ["counter", "key"], "full_outer").fillna(0, ["n"])


def map_points(cards: DataFrame, facilities: DataFrame, directions: Sequence[str] = (), levels: Sequence[str] = (),
               district=None, box: Box | None = None, scope: Scope = Scope()) -> DataFrame:
    """Most probable card per facility; filters come before the choice, borders count in."""
    places = scope_filter(facilities, scope)
    if district is not None:
        places = places.filter(F.col("district") == district)
    if box:
        places = places.filter(box.holds())
    rows = cards
    for column, values in (("direction", directions), ("level", levels)):
        if values:
            rows = rows.filter(F.col(column).isin(*values))
    # The best card is an aggregate with map-side combine: a hot facility never lands in one window.
    best = rows.join(places.select("facility_id"), "facility_id", "left_semi").groupBy("facility_id").agg(
        F.max_by(F.struct("prediction_id", "direction", "level", "probability"),
                 F.struct(F.col("probability"), -F.col("prediction_id"))).alias("b"))
    return places.join(best.select("facility_id", "b.*"), "facility_id")


def map_lines(collectors: DataFrame, scope: Scope = Scope()) -> DataFrame:
    return scope_filter(collectors, scope)


def orders_page(orders: DataFrame, statuses: Sequence[str] = (), due_before: str | None = None, page: int = 1,
                size: int = 20) -> DataFrame:
    rows = orders.filter(F.col("status").isin(*statuses)) if statuses else orders
    if due_before:
        rows = rows.filter(day_bounds(None, due_before, "due_at"))
    return one_page(rows.orderBy("due_at", "order_id"), page, size)


def alerts(cards: DataFrame, level: str = "CRITICAL", status: str = "NEW") -> DataFrame:
    """Count and newest of critical new cards; no row when there are none."""
    hit = cards.filter((F.col("level") == level) & (F.col("status") == status))
    return hit.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.max("computed_at").alias("newest_at"))


def model_metrics(metrics: DataFrame) -> DataFrame:
    """Newest evaluation per enabled direction in registry order; a direction with a note and
    no evaluation gets a row without numbers."""
    spark = metrics.sparkSession
    known = [(i, d.code, d.note) for i, d in enumerate(config.DIRECTIONS) if d.enabled]
    registry = spark.createDataFrame(known, "position int, direction string, note string")
    values = [c for c in metrics.columns if c != "direction"]
    newest = metrics.groupBy("direction").agg(F.max_by(F.struct(*values), "evaluated_at").alias("m"))
    return F.broadcast(registry).join(newest, "direction", "left").filter(
        F.col("m").isNotNull() | (F.col("note") != "")).select("position", "direction", "note", "m.*")


def publish_metric(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row per direction: the fresh evaluation takes the stored one's place."""
    return stored.join(fresh.select("direction"), "direction", "left_anti").unionByName(fresh)


def run_health(runs: DataFrame, cards: DataFrame) -> DataFrame:
    """Last finished run, worst compute time and shortest horizon of its last day, and the last
    run that received stream events within an hour.  One row."""
    done = runs.filter("status = 'DONE'").withColumn("_k", F.lit(1))
    last = done.groupBy("_k").agg(F.max_by(F.struct("started_at", "finished_at", "duration_ms"), "started_at").alias("r"))
    at = F.coalesce(F.col("r.finished_at"), F.col("r.started_at"))
    head = last.select("_k", at.alias("last_run_at"), F.col("r.duration_ms").alias("last_run_ms"))
    recent = cards.withColumn("_k", F.lit(1)).join(F.broadcast(head), "_k").filter(
        F.col("computed_at") >= shift("last_run_at", -86400)).groupBy("_k").agg(
        F.max("compute_ms").alias("max_compute_ms"), F.min("horizon_hours").alias("min_horizon_hours"))
    stream = done.filter("stream_events > 0").join(F.broadcast(head), "_k").filter(
        F.col("started_at") >= shift("last_run_at", -3600)).groupBy("_k").agg(
        F.max_by(F.struct("stream_lag_ms", "stream_events"), "started_at").alias("s"))
    return head.join(recent, "_k", "left").join(stream, "_k", "left").select(
        "last_run_at", "last_run_ms", F.coalesce("max_compute_ms", F.lit(0)).alias("max_compute_ms"),
        F.coalesce("min_horizon_hours", F.lit(0)).alias("min_horizon_hours"),
        F.col("s.stream_lag_ms").alias("stream_lag_ms"), F.coalesce(F.col("s.stream_events"), F.lit(0)).alias("stream_events"))


# --- live charts ---------------------------------------------------------------------


def sensor_table(sensors: DataFrame, signals: DataFrame, at: str, buckets: int = 6) -> DataFrame:
    """Sensors of every unit with the day's signal count, buckets and last stamp."""
    now = F.lit(at).cast("timestamp")
    back = F.floor((F.unix_micros(now) - F.unix_micros("ts")) / (24 // buckets * 3.6e9))
    day = signals.filter((F.col("ts") >= shift(now, -86400)) & (F.col("ts") < now)).groupBy("facility_id", "sensor_id").agg(
        F.count(F.lit(1)).alias("signals"), F.max("ts").alias("last"),
        *[F.count_if(back == buckets - 1 - i).alias(f"bucket_{i}") for i in range(buckets)])
    return sensors.join(day, ["facility_id", "sensor_id"], "left").fillna(0, ["signals", *[f"bucket_{i}" for i in range(buckets)]])


def hour_grid(units: DataFrame, keys: Sequence[str], at: str, hours: int) -> DataFrame:
    now = F.lit(at).cast("timestamp")
    start = F.date_trunc("hour", shift(now, -hours * 3600))
    step = F.expr("INTERVAL 1 HOUR")
    last = F.date_trunc("hour", shift(now, -1))
    return units.select(*keys).distinct().select(*keys, F.explode(F.sequence(start, last, step)).alias("hour"))


def hourly_temperature(units: DataFrame, readings: DataFrame, at: str, hours: int = 24, look_back_days: int = 7) -> DataFrame:
    """Hourly maximum with the last known value carried on; a unit without readings takes its
    collector's.  ``units`` is (facility_id, collector), ``readings`` (facility_id, collector, ts, value).

    Only the last week of readings is folded to hours before the carry.
    """
    now = F.lit(at).cast("timestamp")
    start = F.date_trunc("hour", shift(now, -hours * 3600))
    recent = readings.filter((F.col("ts") >= shift(start, -look_back_days * 86400)) & (F.col("ts") < now))
    hourly = recent.groupBy("facility_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.max("value").alias("v"))
    shared = recent.groupBy("collector", F.date_trunc("hour", "ts").alias("hour")).agg(F.max("value").alias("v"))
    have = hourly.select("facility_id").distinct()
    lacking = units.join(have, "facility_id", "left_anti").join(shared, "collector").select("facility_id", "hour", "v")
    known = hourly.unionByName(lacking)
    grid = hour_grid(known, ("facility_id",), at, hours + look_back_days * 24)
    filled = forward_fill(grid.join(known, ["facility_id", "hour"], "left"), ("facility_id",), "hour", "v")
    return filled.filter((F.col("hour") >= start) & F.col("v").isNotNull())


def hourly_signal_counts(units: DataFrame, signals: DataFrame, at: str, hours: int = 24) -> DataFrame:
    """Bins of an hour over the last day, oldest 0, empty ones zero."""
    now = F.lit(at).cast("timestamp")
    start = shift(now, -hours * 3600)
    bin_ = F.least(F.lit(hours - 1), F.floor((F.unix_micros("ts") - F.unix_micros(start)) / 3.6e9)).cast("int")
    counts = signals.filter((F.col("ts") >= start) & (F.col("ts") < now)).groupBy("facility_id", bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = units.select("facility_id", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("bin"))
    return grid.join(counts, ["facility_id", "bin"], "left").fillna(0, ["n"])


def timeline(marked: DataFrame, unit: str | int, at: str, limit: int = 40) -> DataFrame:
    """Newest signals of one unit over the last day with their burst note."""
    now = F.lit(at).cast("timestamp")
    rows = marked.filter((F.col("facility_id") == unit) & (F.col("ts") >= shift(now, -86400)) & (F.col("ts") < now))
    return rows.withColumn("burst", F.col("nb") > config.BURST_NEIGHBOURS).orderBy(
        F.col("ts").desc(), "sensor_id").limit(limit)


def daily_counts(units: DataFrame, events: DataFrame, at: str, days: int = 30, keys: Sequence[str] = ("facility_id",)) -> DataFrame:
    """Events of the last local days, zeros included; day 0 is the oldest."""
    now = F.lit(at).cast("timestamp")
    start = shift(local_midnight(now), -(days - 1) * 86400)
    index = F.floor((F.unix_micros("ts") - F.unix_micros(start)) / 8.64e10).cast("int")
    counts = events.filter((F.col("ts") >= start) & (F.col("ts") < now)).groupBy(*keys, index.alias("i")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = units.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("i"))
    return grid.join(counts, [*keys, "i"], "left").fillna(0, ["n"])


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Newest row per key, as an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def eligible_units(kind: DataFrame, sensors: DataFrame, events: DataFrame, types: Sequence[str], codes: Sequence[str],
                   only_kind: str | None = None, members: DataFrame | None = None) -> DataFrame:
    """Units a direction applies to: a sensor of the types or an event of the codes on any member.

    ``kind`` is (facility_id, kind, parent_id); with ``members`` child pickets are left out.
    """
    units = kind if only_kind is None else kind.filter(F.col("kind") == only_kind)
    has = sensors.filter(F.col("sensor_type").isin(*types)).select("facility_id").unionByName(
        events.filter(F.col("code").isin(*codes)).select("facility_id"))
    if members is None:
        return units.join(has, "facility_id", "left_semi").select("facility_id")
    top = units.filter(F.col("parent_id").isNull())
    via = members.join(has.withColumnRenamed("facility_id", "member"), "member", "left_semi")
    return top.join(via, "facility_id", "left_semi").select("facility_id")
