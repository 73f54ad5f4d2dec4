"""State changes, half-open intervals and what is inside them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undercroft import config
from undercroft.functions.clock import boundary_diff, shift
from undercroft.operators.ordered import neighbour_row, neighbour_rows, stab_count, state_runs, sweep


def state_changes(states: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Rows whose value differs from the previous one of the key (ties by value)."""
    return state_runs(states, keys, ts, value, "_next").drop("_next")


def disarm_windows(guard: DataFrame, keys: Sequence[str] = ("object_id",), ts: str = "ts",
                   value: str = "value", off: str = "off", open_forever: bool = False) -> DataFrame:
    """[off, next change). The open one ends with the last record seen, or never
    (``open_forever``, the online rule)."""
    steps = state_runs(guard, keys, ts, value, "_next").filter(F.col(value) == off)
    if open_forever:
        return steps.select(*keys, F.col(ts).alias("t_from"), F.col("_next").alias("t_to"),
                            F.col("_next").isNull().alias("open_end"))
    seen = guard.groupBy(*keys).agg(F.max(ts).alias("_seen"))
    return steps.join(seen, list(keys)).select(
        *keys, F.col(ts).alias("t_from"), F.coalesce("_next", "_seen").alias("t_to"),
        F.col("_next").isNull().alias("open_end"),
    )


def guard_unknown(guard: DataFrame, dump_end: str, keys: Sequence[str] = ("object_id",), ts: str = "ts",
                  silence_hours: int = config.GUARD_SILENCE_HOURS) -> DataFrame:
    """Pauses of the guard channel longer than the limit, and the tail to the end of the dump."""
    stamps = guard.select(*keys, ts).distinct()
    inner = neighbour_row(stamps, keys, ts, [], {"t_from": F.col(ts)}).select(
        *keys, "t_from", F.col(ts).alias("t_to")
    )
    tail = stamps.groupBy(*keys).agg(F.max(ts).alias("t_from")).withColumn(
        "t_to", F.lit(dump_end).cast("timestamp")
    )
    return inner.unionByName(tail).filter(
        F.col("t_from").isNotNull() & (boundary_diff("hour", "t_from", "t_to") > silence_hours)
    )


def cut(intervals: DataFrame, keys: Sequence[str], lo: str, hi: str, unit: str, out: str) -> DataFrame:
    """Splits intervals at day or hour boundaries; pieces are (keys, out, a, b)."""
    step = F.expr(f"INTERVAL 1 {unit.upper()}")
    pieces = intervals.filter(F.col(hi) > F.col(lo)).select(
        *keys, lo, hi,
        F.explode(F.sequence(F.date_trunc(unit, lo), F.date_trunc(unit, hi), step)).alias("_start"),
    )
    size = {"day": 86400, "hour": 3600}[unit]
    return pieces.select(
        *keys, (F.to_date("_start") if unit == "day" else F.col("_start")).alias(out),
        F.greatest(lo, "_start").alias("a"), F.least(F.col(hi), shift("_start", size)).alias("b"),
    ).filter(F.col("b") > F.col("a"))


def disarm_hours_by_day(windows: DataFrame, keys: Sequence[str] = ("object_id",)) -> DataFrame:
    """Hours off guard per day, in whole minutes of boundary count."""
    return cut(windows, keys, "t_from", "t_to", "day", "day").groupBy(*keys, "day").agg(
        (F.sum(boundary_diff("minute", "a", "b")) / 60.0).alias("disarm_hours")
    )


def overlap_hours(intervals: DataFrame, keys: Sequence[str], at: Column, hours: Mapping[str, int],
                  lo: str = "t_from", hi: str = "t_to") -> DataFrame:
    """Hours of the intervals inside [at - w, at) for several w in one pass; open ends clip at ``at``."""
    end = F.least(F.coalesce(F.col(hi), at), at)

    def inside(w: int) -> Column:
        start = F.greatest(F.col(lo), shift(at, -w * 3600))
        return F.greatest(F.lit(0), F.unix_micros(end) - F.unix_micros(start)) / 3.6e9

    return intervals.groupBy(*keys).agg(*[F.sum(inside(w)).alias(n) for n, w in hours.items()])


def on_intervals(states: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "value", on: str = "on",
                 cap_hours: int = config.MAX_ON_HOURS, open_hours: int = 0) -> DataFrame:
    """[on, next record) of a channel, capped; without a next record it lasts ``open_hours``."""
    seen = states.select(*keys, ts, value).distinct()
    stepped = neighbour_row(seen, keys, ts, [value], {"_next": F.col(ts)}, forward=True)
    end = F.least(F.coalesce(F.col("_next"), shift(ts, open_hours * 3600)), shift(ts, cap_hours * 3600))
    return stepped.filter(F.col(value) == on).select(*keys, F.col(ts).alias("a"), end.alias("b"))


def pump_hours(rows: DataFrame, keys: Sequence[str] = ("channel_id",), on: str = "on", off: str = "off",
               unavailable: Sequence[str] = ("unavailable",), all_running: str = "all_running",
               flooded: str = "flooded") -> DataFrame:
    """Changes, minutes on and alarm moments per pump and hour.

    One long table of measures and a single final aggregation take the place of
    three aggregates, a union of their keys and three joins.
    """
    state = rows.filter(F.col("value").isin(on, off)).select(*keys, "ts", "value").distinct()
    stepped = neighbour_rows(state, keys, "ts", ["value"], {"_prev": F.col("value")}, {"_next": F.col("ts")})
    changed = stepped.filter(F.col("_prev") != F.col("value")).select(
        *keys, F.date_trunc("hour", "ts").alias("hour"), F.lit(1).alias("n_changes"))
    spans = stepped.filter(F.col("value") == on).select(
        *keys, F.col("ts").alias("a"),
        F.least(F.coalesce("_next", "ts"), shift("ts", config.MAX_ON_HOURS * 3600)).alias("b"))
    minutes = cut(spans, keys, "a", "b", "hour", "hour").select(
        *keys, "hour", (boundary_diff("second", "a", "b") / 60.0).alias("on_minutes")
    )
    alarm = rows.filter(F.col("alarm") & F.col("value").isin(*unavailable, all_running, flooded))
    kind = (
        F.when(F.col("value").isin(*unavailable), "n_unavail")
        .when(F.col("value") == all_running, "n_all_pumps").otherwise("n_flooded")
    )
    marks = alarm.select(*keys, F.date_trunc("hour", "ts").alias("hour"), "ts", kind.alias("_kind")).distinct()
    marks = marks.select(*keys, "hour", *[
        (F.col("_kind") == k).cast("int").alias(k) for k in ("n_unavail", "n_all_pumps", "n_flooded")
    ])
    long = changed.unionByName(minutes, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)
    return long.groupBy(*keys, "hour").agg(*[
        F.coalesce(F.sum(c), F.lit(0)).alias(c)
        for c in ("n_changes", "on_minutes", "n_unavail", "n_all_pumps", "n_flooded")
    ])


def is_open_at(points: DataFrame, windows: DataFrame, keys: Sequence[str], at: str, out: str) -> DataFrame:
    """1/0 whether a window holds the point; null for keys that have no windows at all."""
    covered = windows.select(*keys).distinct().withColumn("_cov", F.lit(1))
    counted = stab_count(points, windows, keys, at, "t_from", "t_to", "_n")
    return counted.join(covered, list(keys), "left").withColumn(
        out, F.when(F.col("_cov").isNotNull(), (F.col("_n") > 0).cast("int"))
    ).drop("_n", "_cov")


def overlaps_any(points: DataFrame, windows: DataFrame, keys: Sequence[str], lo: str, hi: str, out: str) -> DataFrame:
    """True when some window [t_from, t_to) overlaps [lo, hi): started before hi, not over by lo.

    Windows started before ``hi`` minus windows ended by ``lo``: two sweeps, no pairs.
    """
    start = windows.select(*keys, F.col("t_from").alias("_t"), F.lit(2).alias("_o"), F.lit(1).alias("_d"))
    over = windows.select(*keys, F.col("t_to").alias("_t"), F.lit(0).alias("_o"), F.lit(1).alias("_d"))
    begun = sweep(points, start, keys, hi, "_begun")
    both = sweep(begun, over, keys, lo, "_over")
    return both.withColumn(out, F.col("_begun") > F.col("_over")).drop("_begun", "_over")


def state_share_by_hour(changes: DataFrame, keys: Sequence[str], at: Column, hours: int, on: str,
                        ts: str = "ts", value: str = "value") -> DataFrame:
    """Share of each of the last ``hours`` hours in the ON state.

    The state before the window is carried in, from just before it; keys without any record are absent.  Runs of a state are
    found by hour buckets, so no key's rows meet in one task.
    """
    start = F.date_trunc("hour", shift(at, -hours * 3600))
    end = shift(start, hours * 3600)
    known = changes.filter(F.col(ts) < at)
    before = (
        known.filter(F.col(ts) < start).groupBy(*keys)
        .agg(F.max_by(value, F.struct(ts, value)).alias(value)).withColumn(ts, start - F.expr("INTERVAL 1 MICROSECOND"))
    )
    rows = known.filter(F.col(ts) >= start).select(*keys, ts, value).unionByName(
        before.select(*keys, ts, value))
    runs = state_runs(rows, keys, ts, value, "_next", bucket="hour").filter(F.col(value) == on)
    spans = runs.select(*keys, value, F.col(ts).alias("a"), F.coalesce("_next", end).alias("b"))
    on_time = cut(spans, keys, "a", "b", "hour", "hour").groupBy(*keys, "hour").agg(
        F.sum((F.unix_micros("b") - F.unix_micros("a")) / 3.6e9).alias("share")
    )
    grid = known.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(start, shift(end, -3600), F.expr("INTERVAL 1 HOUR"))).alias("hour")
    )
    return grid.join(on_time, [*keys, "hour"], "left").fillna(0.0, ["share"])
