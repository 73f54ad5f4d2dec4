"""Access panels: section x day, and section x day x hour of the point.

All windows end before the point of calculation.  One sparse table of daily facts
meets the grid in one join; every look-back window of a section shares one sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undercroft.functions.clock import boundary_diff, night, shift
from undercroft.operators.grids import Rolling, days_since, dense_grid, filled_grid, in_life, units_by_day
from undercroft.operators.intervals import disarm_hours_by_day, is_open_at, overlaps_any
from undercroft.operators.neighbours import line_neighbours
from undercroft.operators.ordered import asof_last
from undercroft.session import light, stored

KEY = ("object_id", "gallery", "section")
PASSPORT = ("is_branch", "no_entry", "n_pickets", "n_contact", "n_motion", "n_emergency_exit",
            "n_hatch", "n_vent_shaft")
CALENDAR = ("is_holiday", "is_weekend", "is_day_off", "day_off_chain", "is_long_weekend",
            "is_school_vacation", "day_of_week", "month", "quarter", "season", "day_of_month",
            "week_of_year", "day_of_year")


@dataclass
class AccessInputs:
    """Tables of the panel. ``alarm`` and ``armed`` are hourly roll-ups by section."""

    unit: DataFrame
    alarm: DataFrame
    armed: DataFrame
    disarm_window: DataFrame
    guard_unknown: DataFrame
    fault_day: DataFrame
    access_chain: DataFrame
    section_info: DataFrame
    calendar: DataFrame


def daily_counts(alarm: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Moments, night moments, widest hour and last hour per day."""
    return alarm.groupBy(*keys, F.to_date("hour").alias("day")).agg(
        F.sum("n_moments").alias("n_moments"), F.max("n_channels").alias("n_channels"),
        F.sum(F.when(night("hour"), F.col("n_moments")).otherwise(0)).alias("n_night"),
        F.max("hour").alias("last_hour"),
    )


def sparse_days(t: AccessInputs) -> DataFrame:
    """One row per section and day that has any fact, four sources folded in one aggregate."""
    day = F.to_date("hour").alias("day")
    parts = [
        t.alarm.select(*KEY, day, F.col("n_moments").alias("m_all"),
                       F.when(night("hour"), F.col("n_moments")).alias("m_night"), F.col("hour").alias("last_all")),
        t.armed.select(*KEY, day, F.col("n_moments").alias("m_armed"), F.col("hour").alias("last_armed")),
        t.fault_day.select(*KEY, "day", "n_fault"),
        t.access_chain.select(*KEY, F.date_add(F.to_date("completed_ts"), 1).alias("day"), F.lit(1).alias("chain")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return rows.groupBy(*KEY, "day").agg(
        *[F.sum(c).alias(c) for c in ("m_all", "m_night", "m_armed", "n_fault")],
        F.max("last_all").alias("last_all"), F.max("last_armed").alias("last_armed"), F.max("chain").alias("chain"),
    )


def dense_days(t: AccessInputs, sparse: DataFrame, more: Sequence[DataFrame] = ()) -> DataFrame:
    """The grid of sections and days with the facts of the day, those of the line beside it and ``more`` (key, day, ...)."""
    facts = sparse.unionByName(line_neighbours(
        sparse.select(*KEY, "day", F.col("m_armed").isNotNull().cast("int").alias("had_armed"), F.coalesce("m_all", F.lit(0)).alias("m_all")),
        ("object_id", "gallery"), "section", (-1, 1), {"nb_ev": "had_armed", "nb_m": "m_all"}), allowMissingColumns=True)
    for df in more:
        facts = facts.unionByName(df, allowMissingColumns=True)
    dense = filled_grid(t.unit, KEY, facts, keep=("n_channels",)).join(
        light(stored(disarm_hours_by_day(t.disarm_window))), ["object_id", "day"], "left")
    return dense.withColumn("had_alarm", F.col("m_all").isNotNull().cast("int")).withColumn(
        "had_armed", F.col("m_armed").isNotNull().cast("int")
    ).fillna(0, ["m_all", "m_night", "m_armed", "n_fault", "chain", "disarm_hours", "nb_ev", "nb_m"])


def network_days(object_day: DataFrame) -> DataFrame:
    """Shares of sections with an event over the whole network: yesterday, last week and
    the same dates of earlier years.

    Works on one row per day.  Same dates: every day hands its counts to the days of year
    no further than three away on a 365-day circle, and a running sum over years leaves
    the current year out, so no day meets another day.
    """
    nd = object_day.groupBy("day").agg(F.sum("ev").alias("ev"), F.sum("n").alias("n"))
    w = Rolling((), "day")
    shares = w.cumulate(nd, "ev", "n").select(
        "day", *[(w.sum("ev", k) / w.sum("n", k)).alias(f"net_event_share_{k}d") for k in (1, 7)])
    gap = lambda a, b: F.least(F.abs(a - b), 365 - F.abs(a - b))
    targets = F.filter(F.sequence(F.lit(1), F.lit(366)), lambda a: gap(a, F.dayofyear("day")) <= 3)
    handed = nd.select(F.year("day").alias("y"), F.explode(targets).alias("doy"), "ev", "n").groupBy("doy", "y").agg(
        F.sum("ev").alias("ev"), F.sum("n").alias("n"))
    before = Window.partitionBy("doy").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    dated = handed.select("doy", "y", (F.sum("ev").over(before) / F.sum("n").over(before)).alias(
        "date_event_share_prev_years"))
    return shares.withColumn("doy", F.dayofyear("day")).withColumn("y", F.year("day")).join(
        dated, ["doy", "y"], "left").drop("doy", "y")


def object_days(units: DataFrame, sparse: DataFrame) -> DataFrame:
    """One row per object and day of its sections' lives; made, as the network day is, from days with facts, not from the grid."""
    sums = sparse.groupBy("object_id", "day").agg(
        F.sum("m_all").alias("m_obj"), F.count("m_all").alias("units_alarmed"), F.count("m_armed").alias("ev"))
    return units_by_day(units, ("object_id",), "n").join(sums, ["object_id", "day"], "left").fillna(0, ["m_obj", "units_alarmed", "ev"]).select(
        "object_id", "day", "m_obj", "units_alarmed", "ev", "n")


def guard_days(days: DataFrame, windows: DataFrame) -> DataFrame:
    """Guard mode at midnight and hours since it changed, per object and day."""
    points = days.select("object_id", "day", F.col("day").cast("timestamp").alias("_at"))
    changes = windows.select("object_id", F.col("t_from").alias("ts")).unionByName(
        windows.filter("NOT open_end").select("object_id", F.col("t_to").alias("ts"))).distinct()
    opened = is_open_at(points, windows, ("object_id",), "_at", "is_disarmed_at_0")
    last = asof_last(opened, changes, ("object_id",), "_at", "ts", {"_change": F.col("ts")})
    return last.select("object_id", "day", "is_disarmed_at_0",
                       boundary_diff("hour", "_change", "_at").alias("hours_since_guard_change"))


def access_daily(t: AccessInputs, guard_filter: bool = True, more: Sequence[DataFrame] = ()) -> DataFrame:
    """``more`` are columns by key and day that the panel carries along: they join its grid while it is narrow."""
    # Days with facts and object-days are read by several branches: both are stored once.  The grid is not: its rows stay
    # where they are spread, so no shuffle or stored table grows with them.
    sparse = stored(in_life(sparse_days(t), t.unit, KEY))
    per_object = stored(object_days(t.unit, sparse))
    carried = [c for df in more for c in df.columns if c not in (*KEY, "day")]
    ow = Rolling(("object_id",))
    objects = ow.cumulate(per_object, "m_obj", "units_alarmed").select(
        "object_id", "day", ow.sum("m_obj", 1).alias("obj_alarms_1d"), ow.sum("m_obj", 7).alias("obj_alarms_7d"),
        ow.sum("units_alarmed", 7).alias("obj_units_alarmed_7d"))
    w = Rolling(KEY)
    age = F.datediff("day", w.first())
    rolled = w.cumulate(dense_days(t, sparse, more), "m_all", "m_armed", "had_alarm", "had_armed", "m_night", "disarm_hours", "n_fault",
                        "nb_ev", "nb_m").select(
        *KEY, "day", F.col("had_armed").alias("label"), "n_channels", "chain", *carried,
        *[F.coalesce(w.sum("m_all", k), F.lit(0)).alias(f"n_alarms_{k}d") for k in (1, 7, 30, 90, 365)],
        *[F.coalesce(w.sum("m_armed", k), F.lit(0)).alias(f"n_armed_{k}d") for k in (1, 7, 30, 90)],
        *[(F.coalesce(w.sum("had_alarm", k), F.lit(0)) / float(k)).alias(f"alarm_day_share_{k}d") for k in (7, 30, 90, 365)],
        (F.coalesce(w.sum("had_armed", 30), F.lit(0)) / 30.0).alias("armed_day_share_30d"),
        F.coalesce(days_since(w.last_where(F.col("had_alarm") == 1)), age + 1).alias("days_since_last_alarm"),
        F.coalesce(days_since(w.last_where(F.col("had_armed") == 1)), age + 1).alias("days_since_last_armed"),
        *[F.coalesce(w.sum("m_night", k), F.lit(0)).alias(f"_night_{k}") for k in (30, 365)],
        *[F.coalesce(w.sum("disarm_hours", k), F.lit(0.0)).alias(f"disarm_hours_{k}d") for k in (1, 7, 30)],
        F.coalesce(w.lag("had_armed", 7), F.lit(0)).alias("armed_same_weekday_1w"),
        F.coalesce(w.lag("had_armed", 364), F.lit(0)).alias("armed_same_day_1y"),
        F.coalesce(boundary_diff("hour", w.last_where(F.lit(True), "last_all"), F.col("day").cast("timestamp")),
                   24 * (age + 1)).alias("hours_since_last_alarm"),
        F.coalesce(boundary_diff("hour", w.last_where(F.lit(True), "last_armed"), F.col("day").cast("timestamp")),
                   24 * (age + 1)).alias("hours_since_last_armed"),
        *[F.coalesce(w.sum("n_fault", k), F.lit(0)).alias(f"faults_{k}d") for k in (1, 7, 30)],
        F.coalesce(w.sum("nb_ev", 1), F.lit(0)).alias("nb_events_1d"),
        F.coalesce(w.sum("nb_ev", 7), F.lit(0)).alias("nb_events_7d"),
        F.coalesce(w.sum("nb_m", 7), F.lit(0)).alias("nb_alarms_7d"),
        age.alias("unit_age_days"),
    )
    panel = (
        rolled.withColumn("trend_7_90", F.col("alarm_day_share_7d") / F.greatest("alarm_day_share_90d", F.lit(0.001)))
        .withColumn("night_share_30d", F.col("_night_30") / F.greatest("n_alarms_30d", F.lit(1)))
        .withColumn("night_share_365d", F.col("_night_365") / F.greatest("n_alarms_365d", F.lit(1)))
        .withColumn("disarm_share_30d", F.col("disarm_hours_30d") / 720.0)
        .withColumn("has_access_chain_1d", F.col("chain").cast("int"))
        .withColumn("naive", (F.col("n_armed_1d") > 0).cast("int"))
        .drop("_night_30", "_night_365", "disarm_hours_30d", "chain")
    )
    # All that an object-day or a day knows is one table, which the panel meets once; stored, so that its size is known
    # and the wide panel is shuffled to it only where it is large.
    around = (
        objects.join(guard_days(per_object, t.disarm_window), ["object_id", "day"], "left")
        .join(network_days(per_object), "day", "left").join(t.calendar.select("day", *CALENDAR), "day")
    )
    if guard_filter:
        around = around.join(unknown_days(per_object, t.guard_unknown), ["object_id", "day"], "left_anti")
    counts = ["obj_alarms_1d", "obj_alarms_7d", "obj_units_alarmed_7d"]
    return panel.join(t.section_info.select(*KEY, *PASSPORT), list(KEY), "left").join(
        light(stored(around.fillna(0, counts))), ["object_id", "day"])


def unknown_days(days: DataFrame, unknown: DataFrame, hours: int = 24) -> DataFrame:
    """Object-days whose label window overlaps a period of unknown guard mode."""
    points = days.select("object_id", "day").withColumn("_lo", F.col("day").cast("timestamp")).withColumn(
        "_hi", shift("_lo", hours * 3600))
    return overlaps_any(points, unknown, ("object_id",), "_lo", "_hi", "_u").filter("_u").select("object_id", "day")


def seen_at(t: AccessInputs, hours: Sequence[int]) -> DataFrame:
    """What the facts around a day tell its points: an array ``_seen`` by section and day, one entry a point.

    No window reaches further than a day, so a fact is handed to its own day and the two beside it;
    days and points without facts cost nothing.
    """
    day = F.to_date("hour")
    facts = t.armed.select(*KEY, "hour", F.col("n_moments").alias("m"), F.col("hour").alias("le")).unionByName(
        t.alarm.select(*KEY, "hour", F.col("n_moments").alias("al"), F.col("hour").alias("la")), allowMissingColumns=True)
    # Dealt by section while they are narrow: the folds of a day are many columns. A section has two rows an hour at most.
    handed = facts.repartition(*KEY).withColumn("day", F.explode(F.array(F.date_sub(day, 1), day, F.date_add(day, 1))))
    # Hours from the midnight of the day to the fact.
    at = (F.unix_micros("hour") - F.unix_micros(F.col("day").cast("timestamp"))) / 3_600_000_000
    folds = {}
    for h in hours:
        ago = lambda n, h=h: (at >= h - n) & (at < h)
        within = lambda n, c, ago=ago: F.coalesce(F.sum(F.when(ago(n), F.col(c))), F.lit(0))
        folds |= {
            f"_label_{h}": F.max(((at >= h) & (at < h + 24) & F.col("le").isNotNull()).cast("int")),
            f"_naive_{h}": F.max((ago(24) & F.col("le").isNotNull()).cast("int")),
            f"_al1_{h}": within(1, "al"), f"_al6_{h}": within(6, "al"), f"_m1_{h}": within(1, "m"), f"_m6_{h}": within(6, "m"),
            f"_la_{h}": F.max(F.when((at >= 0) & (at < h), F.col("la"))), f"_le_{h}": F.max(F.when((at >= 0) & (at < h), F.col("le")))}
    folded = handed.groupBy(*KEY, "day").agg(*[c.alias(n) for n, c in folds.items()])
    return folded.select(*KEY, "day", F.array(*[F.struct(*[F.col(f"_{c}_{h}").alias(c) for c in (
        "label", "naive", "al1", "al6", "m1", "m6", "la", "le")]) for h in hours]).alias("_seen"))


def before_life(t: AccessInputs) -> DataFrame:
    """Last alarm and last event of a section before the first day of its life, and the end of that life."""
    lives = t.unit.select(*KEY, "hour_from", "hour_to")
    last = lambda df, out: df.join(lives, list(KEY)).filter(F.col("hour") < F.to_date("hour_from").cast("timestamp")).groupBy(*KEY).agg(F.max("hour").alias(out))
    return lives.drop("hour_from").join(last(t.alarm, "_la0"), list(KEY), "left").join(last(t.armed, "_le0"), list(KEY), "left")


def access_rolling(t: AccessInputs, hours: Sequence[int] = (0, 6, 12, 18)) -> DataFrame:
    """Several points a day: features of the day, label and freshness at the point."""
    at_hour = F.timestamp_micros(F.unix_micros(F.col("day").cast("timestamp")) + F.col("as_of_hour").cast("long") * 3_600_000_000)
    base = access_daily(t, guard_filter=False, more=[seen_at(t, hours)]).drop("label", "naive")
    spread = F.explode(F.array(*[F.lit(int(h)) for h in hours]))
    moments = dense_grid(t.unit.groupBy("object_id").agg(F.min("hour_from").alias("hour_from"), F.max("hour_to").alias("hour_to")), ("object_id",))
    moments = moments.withColumn("as_of_hour", spread).select("object_id", at_hour.alias("as_of"))
    guard = is_open_at(moments, t.disarm_window, ("object_id",), "as_of", "is_disarmed_at_t")
    guard = overlaps_any(guard.withColumn("_hi", shift("as_of", 86400)), t.guard_unknown, ("object_id",),
                         "as_of", "_hi", "_u").drop("_hi")
    # What an object knows of its guard is one row a day too; points are spread last.
    known = guard.filter("NOT _u").groupBy("object_id", F.to_date("as_of").alias("day")).agg(F.collect_list(F.struct(
        F.hour("as_of").alias("as_of_hour"), "as_of", "is_disarmed_at_t")).alias("_points"))
    wide = base.join(light(stored(known)), ["object_id", "day"]).join(before_life(t), list(KEY))
    wide = wide.withColumn("_p", F.explode("_points")).filter(shift("_p.as_of", 86400) <= shift("hour_to", 3600))
    at = F.element_at("_seen", F.element_at(F.create_map(*[F.lit(int(x)) for i, h in enumerate(hours, 1) for x in (h, i)]), F.col("_p.as_of_hour")))
    z = lambda c: F.coalesce(F.col(f"_s.{c}"), F.lit(0))
    age = 24 * (F.col("unit_age_days") + 1)

    def freshness(last: str, first: str, day: str) -> Column:
        """From the last one of the day; else from the days before, which count from the life's first day if they know none; else from before it."""
        older = F.when(F.col(day) == age, boundary_diff("hour", first, "as_of"))
        return F.coalesce(boundary_diff("hour", last, "as_of"), older, F.col(day) + F.col("as_of_hour"))

    points = wide.withColumn("_s", at).select(
        *[c for c in base.columns if c != "_seen"], "_p.*", z("label").alias("label"), z("naive").alias("naive"),
        z("al1").alias("alarms_last_1h"), z("al6").alias("alarms_last_6h"), z("m1").alias("events_last_1h"), z("m6").alias("events_last_6h"),
        F.col("_s.la").alias("_la"), F.col("_s.le").alias("_le"), "_la0", "_le0")
    return (
        points.withColumn("hours_since_last_alarm_t", freshness("_la", "_la0", "hours_since_last_alarm"))
        .withColumn("hours_since_last_event_t", freshness("_le", "_le0", "hours_since_last_armed"))
        .drop("_la", "_le", "_la0", "_le0")
    )


def panel_stats(panel: DataFrame, keys: Sequence[str] = KEY, day: str = "day") -> DataFrame:
    """Rows, positives, base, units, period and naive share of a panel."""
    return panel.agg(
        F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positives"),
        F.round(F.avg("label"), 6).alias("base"), F.countDistinct(F.struct(*keys)).alias("units"),
        F.min(day).cast("string").alias("day_from"), F.max(day).cast("string").alias("day_to"),
        F.round(F.avg("naive"), 6).alias("naive_share"))
