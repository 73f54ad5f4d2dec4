"""Statistics of a label before any model: base rates, naive rules, rhythm, lifts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undercroft import config
from undercroft.functions.clock import boundary_diff, shift
from undercroft.operators.grids import dense_grid
from undercroft.operators.journal import side_by_side
from undercroft.operators.ordered import stab_count


def pct(a: Column, b: Column, digits: int = 3) -> Column:
    return F.when(b > 0, F.round(100.0 * a / b, digits))


def target_stats_hourly(alarm: DataFrame, units: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """Base rate and naive precision/recall on the hour grid, without building the grid.

    Between two alarm hours a < b of a unit the hours with an alarm ahead are the last
    ``horizon`` before b, those with an alarm behind the first ``horizon`` from a, and
    those with both the overlap: three lengths per pair of neighbours, clipped to life.
    A unit has at most one row per hour here, which bounds the window.
    """
    w = Window.partitionBy(*keys).orderBy("hour")
    n = lambda c: F.floor(F.unix_seconds(c) / 3600)
    rows = (
        alarm.select(*keys, "hour").distinct()
        .join(units.select(*keys, "hour_from", "hour_to"), list(keys))
        .select(*keys, "hour", n("hour_from").alias("_lo"), n("hour_to").alias("_hi"), n("hour").alias("_a"))
        .withColumn("_prev", F.lag("_a").over(w)).withColumn("_next", F.lead("_a").over(w))
    )

    def size(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0), F.least(hi, F.col("_hi")) - F.greatest(lo, F.col("_lo")) + 1)

    a, prev, nxt = F.col("_a"), F.col("_prev"), F.col("_next")
    ahead = size(F.greatest(F.coalesce(prev, a - horizon), a - horizon), a - 1)
    behind = size(a, F.least(F.coalesce(nxt - 1, a + horizon - 1), a + horizon - 1))
    both = F.when(nxt.isNotNull(), size(F.greatest(a, nxt - horizon), F.least(nxt - 1, a + horizon - 1))).otherwise(0)
    sums = rows.agg(F.sum(ahead).alias("positive"), F.sum(behind).alias("predicted"), F.sum(both).alias("hit"))
    cells = units.agg(F.sum(boundary_diff("hour", "hour_from", "hour_to") + 1).alias("cells"))
    return side_by_side(cells, sums).select(
        "cells", "positive", "predicted", "hit",
        pct(F.col("positive"), F.col("cells")).alias("base_pct"),
        pct(F.col("hit"), F.col("predicted")).alias("naive_precision_pct"),
        pct(F.col("hit"), F.col("positive")).alias("naive_recall_pct"),
    )


def target_stats_daily(alarm: DataFrame, units: DataFrame, keys: Sequence[str]) -> DataFrame:
    days = alarm.select(*keys, F.to_date("hour").alias("day")).distinct()
    w = Window.partitionBy(*keys).orderBy("day")
    repeated = F.datediff(F.lead("day").over(w), F.col("day")) == 1
    events = days.withColumn("_r", repeated).agg(
        F.count(F.lit(1)).alias("positive"), F.count_if("_r").alias("repeated"))
    cells = units.agg(F.sum(boundary_diff("day", "hour_from", "hour_to") + 1).alias("cells"))
    return side_by_side(cells, events).select(
        "cells", "positive", "repeated", pct(F.col("positive"), F.col("cells")).alias("base_pct"),
        pct(F.col("repeated"), F.col("positive")).alias("naive_precision_pct"),
    )


def unit_days(alarm: DataFrame, keys: Sequence[str], *extra: str) -> DataFrame:
    return alarm.select(*keys, *extra, F.to_date("hour").alias("day")).distinct()


def share_by(alarm: DataFrame, keys: Sequence[str], by: str | Column, name: str) -> DataFrame:
    """Distinct unit-days per value and their share of the total, one decimal.

    The total window runs over one row per value.
    """
    group = (F.col(by) if isinstance(by, str) else by).alias(name)
    counts = alarm.select(group, *keys, F.to_date("hour").alias("day")).distinct().groupBy(name).agg(
        F.count(F.lit(1)).alias("unit_days"))
    total = counts.agg(F.sum("unit_days").alias("_t")).withColumn("_k", F.lit(1))
    return counts.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").select(
        name, "unit_days", F.round(100.0 * F.col("unit_days") / F.col("_t"), 1).alias("share_pct"))


def top_object(alarm: DataFrame, keys: Sequence[str]) -> DataFrame:
    counts = unit_days(alarm, keys).groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(F.struct("object_id", "n"), F.struct(F.col("n"), -F.col("object_id")))
    return counts.agg(best.alias("b"), F.sum("n").alias("t")).select(
        "b.object_id", F.col("b.n").alias("unit_days"), F.round(100.0 * F.col("b.n") / F.col("t"), 1).alias("share_pct"))


def share_by_split(alarm: DataFrame, units: DataFrame, keys: Sequence[str],
                   splits: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Cells, positives and base per time split; lives are clipped to the split."""
    marks = F.explode(F.array(*[
        F.struct(F.lit(n).alias("split"), F.lit(lo).cast("date").alias("lo"), F.lit(hi).cast("date").alias("hi"))
        for n, lo, hi in splits]))
    life = units.select("*", marks.alias("s")).select(
        "s.split", F.greatest(F.lit(0), F.datediff(
            F.least(F.to_date("hour_to"), F.date_sub("s.hi", 1)), F.greatest(F.to_date("hour_from"), F.col("s.lo"))
        ) + 1).alias("_d"))
    cells = life.groupBy("split").agg(F.sum("_d").alias("unit_days"))
    hits = unit_days(alarm, keys).select("day", marks.alias("s")).filter(
        (F.col("day") >= F.col("s.lo")) & (F.col("day") < F.col("s.hi"))
    ).groupBy("s.split").agg(F.count(F.lit(1)).alias("positive_days"))
    return cells.join(hits, "split", "left").fillna(0, ["positive_days"]).withColumn(
        "base_pct", pct(F.col("positive_days"), F.col("unit_days")))


def cover_lift(target_days: DataFrame, event_days: DataFrame, life: DataFrame, key: str = "object_id",
               reach: int = 1) -> DataFrame:
    """How often target days have an event within ``reach`` days, against chance.

    Chance is the same share over all days of life of the keys that have target days.
    """
    near = event_days.select(key, F.explode(F.expr(
        f"sequence(date_sub(day, {reach}), date_add(day, {reach}), INTERVAL 1 DAY)")).alias("day")
    ).distinct().withColumn("_c", F.lit(1))
    target = target_days.select(key, "day").distinct()
    alive = life.select(key, "day").distinct().join(target.select(key), key, "left_semi")

    def covered(df: DataFrame, n: str, hit: str) -> DataFrame:
        return df.join(near, [key, "day"], "left").agg(F.count(F.lit(1)).alias(n), F.count("_c").alias(hit))

    both = side_by_side(covered(target, "obs_n", "obs_hit"), covered(alive, "exp_n", "exp_hit"))
    observed, expected = F.try_divide("obs_hit", "obs_n"), F.try_divide("exp_hit", "exp_n")
    return both.select(
        "obs_n", "obs_hit", "exp_n", "exp_hit",
        F.round(100.0 * observed, 2).alias("observed_pct"), F.round(100.0 * expected, 2).alias("expected_pct"),
        F.when(expected > 0, F.round(observed / expected, 2)).alias("lift"),
    )


def label_version_stats(signals: DataFrame, grid: DataFrame, keys: Sequence[str],
                        versions: Mapping[str, tuple[int, int]], holdout: str) -> DataFrame:
    """Per label version and period: base, naive precision and recall, week rhythm.

    ``signals`` holds a 0/1 column per version; ``versions`` maps it to its allowed hours
    on workdays and days off.  ``grid`` carries ``is_day_off``.  One window pass serves
    all versions; they are unpivoted after it.
    """
    per_day = signals.groupBy(*keys, "day").agg(*[F.max(v).alias(v) for v in versions])
    panel = grid.join(per_day, [*keys, "day"], "left").fillna(0, list(versions))
    w = Window.partitionBy(*keys).orderBy("day")
    yesterday = F.datediff(F.col("day"), F.lag("day").over(w)) == 1
    packed = F.array(*[
        F.struct(
            F.lit(v).alias("version"), F.col(v).alias("ev"),
            F.coalesce(((F.lag(v).over(w) == 1) & yesterday).cast("int"), F.lit(0)).alias("alert"),
            F.lit(hours[0]).alias("h_work"), F.lit(hours[1]).alias("h_off"),
        ) for v, hours in versions.items()
    ])
    period = F.when(F.col("day") < F.lit(holdout).cast("date"), F.year("day").cast("string")).otherwise("holdout")
    long = panel.withColumn("_v", packed).select(
        "is_day_off", period.alias("period"), F.explode("_v").alias("v")).select("is_day_off", "period", "v.*")
    ev, off = F.col("ev"), F.col("is_day_off")
    sums = long.groupBy("version", "period").agg(
        F.count(F.lit(1)).alias("unit_days"), F.sum(ev).alias("events"), F.sum("alert").alias("alerts"),
        F.sum(F.col("alert") * ev).alias("hits"),
        F.sum(F.when(off == 0, ev)).alias("_ew"), F.count_if(off == 0).alias("_nw"),
        F.sum(F.when(off == 1, ev)).alias("_eo"), F.count_if(off == 1).alias("_no"),
        F.max("h_work").alias("_hw"), F.max("h_off").alias("_ho"),
    )
    work = F.try_divide("_ew", "_nw") / F.col("_hw")
    rest = F.try_divide("_eo", "_no") / F.col("_ho")
    return sums.select(
        "version", "period", "unit_days", "events", F.round(F.col("events") / F.col("unit_days"), 6).alias("base"),
        F.when(F.col("alerts") > 0, F.round(F.col("hits") / F.col("alerts"), 4)).alias("naive_precision"),
        F.when(F.col("events") > 0, F.round(F.col("hits") / F.col("events"), 4)).alias("naive_recall"),
        F.when(F.col("_eo") > 0, F.round(work / rest, 3)).alias("week_rhythm"),
    )


def week_ratio(events: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Event rate on workdays over the rate on days off, over the life grid."""
    hit = grid.join(events.select(*keys, "day").distinct().withColumn("_e", F.lit(1)), [*keys, "day"], "left")
    e = F.coalesce("_e", F.lit(0))
    return hit.agg(F.avg(F.when(F.col("is_day_off") == 0, e)).alias("work_rate"),
                   F.avg(F.when(F.col("is_day_off") == 1, e)).alias("off_rate")).withColumn(
        "ratio", F.when(F.col("off_rate") > 0, F.col("work_rate") / F.col("off_rate")))


def criteria_screen(hours: DataFrame, unit_day: DataFrame, life: DataFrame, wet: DataFrame,
                    keys: Sequence[str], criteria: Mapping[str, tuple[Column, int, int]], train_end: str) -> DataFrame:
    """Boolean criteria on signal hours, screened together.

    ``hours`` carries (keys, day, hour, day_off and hour facts), ``unit_day`` the facts of
    a unit-day, ``life`` (keys, day, day_off), ``wet`` (day, wet).  Each signal hour is
    tested once; what it meets is a bit mask, so a unit-day is one small window and no table
    of unit-days by criterion is held. Denominators of the life grid are made once.
    """
    if len(criteria) > 62:  # bits of a mask
        items = list(criteria.items())
        return criteria_screen(hours, unit_day, life, wet, keys, dict(items[:62]), train_end).unionByName(
            criteria_screen(hours, unit_day, life, wet, keys, dict(items[62:]), train_end))
    names = list(criteria)
    bits = {n: F.lit(1 << i).cast("long") for i, n in enumerate(names)}
    met = sum((F.when(c, bits[n]).otherwise(F.lit(0).cast("long")) for n, (c, _, _) in criteria.items()), F.lit(0).cast("long"))
    rows = hours.join(unit_day, [*keys, "day"]).select(
        *keys, "day", "day_off", "pump_ratio", "adjacent", ((F.hour("hour") >= 8) & (F.hour("hour") < 16)).alias("_morning"), met.alias("_met")).filter("_met <> 0")
    # A criterion counts a unit-day at the first hour that meets it; the largest pump ratio comes first.
    day = Window.partitionBy(*keys, "day").orderBy(F.desc_nulls_last("pump_ratio"))
    before, whole = day.rowsBetween(Window.unboundedPreceding, -1), day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    some = lambda c: F.coalesce(F.bit_or(F.when(c, F.col("_met"))).over(whole), F.lit(0).cast("long"))
    marked = rows.withColumns({
        "_seen": F.coalesce(F.bit_or("_met").over(before), F.lit(0).cast("long")),
        "_near": some(F.col("adjacent")), "_told": some(F.col("adjacent").isNotNull())}).join(wet, "day", "left")
    each = F.filter(F.array(*[F.struct(F.lit(n).alias("criterion"), bits[n].alias("bit")) for n in names]),
                    lambda x: F.col("_met").bitwiseAND(x["bit"]) != 0)
    has = lambda mask: F.col(mask).bitwiseAND(F.col("_c.bit")) != 0
    new = F.col("_new")
    per_object = marked.withColumn("_c", F.explode(each)).withColumns({
        "_new": ~has("_seen"), "_adj": F.when(has("_told"), has("_near").cast("int")), "criterion": F.col("_c.criterion"),
    }).groupBy("criterion", "object_id").agg(
        F.count_if(new).alias("_n"), F.count_if(new & (F.col("day") < F.lit(train_end).cast("date"))).alias("_train"),
        F.count_if(~F.col("day_off")).alias("_hw"), F.count_if(F.col("day_off")).alias("_ho"), F.count_if("_morning").alias("_h816"),
        F.count_if(new & F.col("wet")).alias("_wet"), F.count_if(new & ~F.col("wet")).alias("_dry"),
        F.sum(F.when(new, F.col("pump_ratio"))).alias("_ps"), F.count(F.when(new, F.col("pump_ratio"))).alias("_pc"),
        F.sum(F.when(new, F.col("_adj"))).alias("_adj"),
    )
    sums = per_object.groupBy("criterion").agg(
        F.max("_n").alias("_top"), *[F.sum(c).alias(c) for c in
                                     ("_n", "_train", "_hw", "_ho", "_h816", "_wet", "_dry", "_ps", "_pc", "_adj")])
    base = life.join(wet, "day", "left").agg(
        F.count_if(~F.col("day_off")).alias("_lw"), F.count_if(F.col("day_off")).alias("_lo"),
        F.count_if(F.col("wet")).alias("_lwet"), F.count_if(~F.col("wet")).alias("_ldry"))
    hours_on = F.create_map(*[x for n, (_, a, _) in criteria.items() for x in (F.lit(n), F.lit(float(a)))])
    hours_off = F.create_map(*[x for n, (_, _, b) in criteria.items() for x in (F.lit(n), F.lit(float(b)))])
    full = sums.withColumn("_k", F.lit(1)).join(F.broadcast(base.withColumn("_k", F.lit(1))), "_k")
    work = F.try_divide(F.col("_hw"), F.col("_lw") * F.element_at(hours_on, F.col("criterion")))
    rest = F.try_divide(F.col("_ho"), F.col("_lo") * F.element_at(hours_off, F.col("criterion")))
    rhythm = F.try_divide(work, rest)
    lift = F.try_divide(F.try_divide("_wet", "_lwet"), F.try_divide("_dry", "_ldry"))
    out = full.select(
        "criterion", F.col("_n").alias("positive_unit_days"), F.col("_train").alias("positive_unit_days_train"),
        F.round(F.col("_top") / F.col("_n"), 3).alias("top_object_share"),
        F.round(rhythm, 3).alias("workday_to_day_off"), F.round(lift, 3).alias("weather_lift"),
        F.round(F.try_divide("_ps", "_pc"), 2).alias("pump_vs_normal"),
        F.round(F.col("_adj") / F.col("_n"), 3).alias("adjacent_share"),
        F.round(F.col("_h816") / (F.col("_hw") + F.col("_ho")), 3).alias("share_8_16"),
        ((F.col("_train") >= 1000) & (F.col("_top") / F.col("_n") <= 0.5)).alias("passes_volume"),
        F.coalesce(rhythm.between(1 / 1.5, 1.5), F.lit(False)).alias("passes_week"),
        F.coalesce(lift > 1.0, F.lit(False)).alias("passes_weather"),
    )
    return out


def choose_criterion(screen: DataFrame) -> DataFrame:
    """Among criteria that pass everything: lift within 5 % of the best, then the largest volume."""
    passed = screen.filter("passes_volume AND passes_week AND passes_weather")
    best = passed.agg(F.max("weather_lift").alias("_b")).withColumn("_k", F.lit(1))
    close = passed.withColumn("_k", F.lit(1)).join(F.broadcast(best), "_k").filter(
        F.col("weather_lift") >= F.col("_b") * 0.95)
    return close.agg(F.max_by("criterion", F.struct("positive_unit_days", "criterion")).alias("criterion"))


def scenario_lift(panel: DataFrame, signals: Mapping[str, Column]) -> DataFrame:
    """P(label | signal) over the base, for all rows and for rows with no event yesterday."""
    tests = F.array(F.lit("*"), *[F.when(c, F.lit(n)) for n, c in signals.items()])
    sets = F.filter(F.array(F.lit("all"), F.when(F.col("naive") == 0, F.lit("no_event_yesterday"))),
                    lambda x: x.isNotNull())
    rows = (
        panel.select("label", F.explode(sets).alias("subset"), F.filter(tests, lambda x: x.isNotNull()).alias("_t"))
        .select("label", "subset", F.explode("_t").alias("signal"))
        .groupBy("subset", "signal").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("events_ahead"))
    )
    base = rows.filter("signal = '*'").select("subset", (F.col("events_ahead") / F.col("rows")).alias("_base"))
    share = F.col("events_ahead") / F.col("rows")
    return rows.filter("signal <> '*'").join(F.broadcast(base), "subset").select(
        "subset", "signal", "rows", "events_ahead", F.round(100.0 * share, 3).alias("event_ahead_pct"),
        F.when(F.col("_base") > 0, F.round(share / F.col("_base"), 2)).alias("lift"))


#: Counts up to this one get exact bounds; beyond it the approximation is right to a millionth.
EXACT_COUNTS = 1000


def poisson_cdf(k: Column, mean: Column) -> Column:
    """P(X <= k) of a Poisson variable, for k up to ``EXACT_COUNTS``: the last term by logarithms, the others from it."""
    log_factorial = F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda s, i: s + F.when(i > 1, F.log(i.cast("double"))).otherwise(0.0))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] * (k - i) / mean
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    below = F.aggregate(F.filter(F.sequence(F.lit(0), k), lambda i: i < k), start, add)["total"]
    return F.exp(k * F.log(mean) - mean - log_factorial) * below


def poisson_mean(k: Column, probability: float) -> Column:
    """The mean at which P(X <= k) is the probability, by sixty halvings."""
    start = F.struct(F.lit(0.0).alias("lo"), (k + 10 * F.sqrt(k + 1) + 20).cast("double").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["lo"] + s["hi"]) / 2
        more = poisson_cdf(k, middle) > probability
        return F.struct(F.when(more, middle).otherwise(s["lo"]).alias("lo"), F.when(more, s["hi"]).otherwise(middle).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halve)["lo"]


def poisson_bounds(k: Column, exposure: Column) -> tuple[Column, Column]:
    """95 % interval of a Poisson rate: exact for small counts, by Wilson-Hilferty quantiles beyond."""
    z, small = 1.959963984540054, k <= EXACT_COUNTS
    n = F.when(small, k).otherwise(0).cast("int")

    def half_quantile(n: Column, sign: float) -> Column:
        return n * F.pow(1 - 1 / (9 * n) + sign * z / (3 * F.sqrt(n)), 3)

    low = F.when(k == 0, 0.0).when(small, poisson_mean(F.greatest(n - 1, F.lit(0)), 0.975)).otherwise(half_quantile(k.cast("double"), -1.0))
    high = F.when(small, poisson_mean(n, 0.025)).otherwise(half_quantile((k + 1).cast("double"), 1.0))
    return F.try_divide(low, exposure), F.try_divide(high, exposure)


def burn_in_curve(channels: DataFrame, events: DataFrame, unit: str, censor: str,
                  buckets: Sequence[tuple[int, int]] = config.AGE_BUCKETS) -> DataFrame:
    """Event rate by age bucket. ``channels`` is (channel_id, object_id, first_day, last_day),
    ``events`` distinct (channel_id, object_id, day). Births before the censor day drop."""
    life = channels.groupBy(unit).agg(
        F.min("first_day").alias("born"), F.max("last_day").alias("dead"), F.count(F.lit(1)).alias("_n")
    ).filter(F.col("born") >= F.lit(censor).cast("date"))
    marks = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in buckets])
    exposure = life.select("*", F.explode(marks).alias("b")).groupBy("b.lo", "b.hi").agg(
        F.sum(F.greatest(F.lit(0), F.least(F.col("b.hi"), F.datediff("dead", "born")) - F.col("b.lo") + 1)
              * F.col("_n")).alias("exposure"))
    age = F.datediff("day", "born")
    bucket = None
    for lo, hi in buckets:
        hit = age.between(lo, hi)
        bucket = F.when(hit, lo) if bucket is None else bucket.when(hit, lo)
    hits = events.join(life.select(unit, "born"), unit).groupBy(bucket.alias("lo")).agg(
        F.count(F.lit(1)).alias("events"))
    table = exposure.join(hits, "lo", "left").fillna(0, ["events"])
    rate = F.try_divide("events", "exposure")
    low, high = poisson_bounds(F.col("events"), F.col("exposure"))
    mature = table.agg(F.max_by(rate, F.col("lo")).alias("_m")).withColumn("_k", F.lit(1))
    return table.withColumn("_k", F.lit(1)).join(F.broadcast(mature), "_k").select(
        "lo", "hi", "events", "exposure", rate.alias("rate"), low.alias("ci_low"), high.alias("ci_high"),
        F.when(F.col("_m") > 0, F.round(rate / F.col("_m"), 2)).alias("ratio_to_mature"),
        F.col("_m").alias("mature_rate"))


def burn_in_days(curve: DataFrame, ratio: float = config.BURN_IN_RATIO) -> DataFrame:
    """First bucket from which every bucket's lower bound is within ``ratio`` of the mature rate.
    The curve has one row per bucket."""
    last = F.max("lo").over(Window.partitionBy())
    bad = F.col("ci_low") > ratio * F.col("mature_rate")
    rows = curve.withColumn("_last", last).filter(F.col("lo") < F.col("_last"))
    worst = F.max(F.when(bad, F.col("lo"))).over(Window.partitionBy())
    return rows.withColumn("_w", worst).agg(
        F.min(F.when(F.col("_w").isNull() | (F.col("lo") > F.col("_w")), F.col("lo"))).alias("burn_in_days"))


def schedule_check(readings: DataFrame, windows: DataFrame, before_days: int = 60, after_days: int = 14) -> DataFrame:
    """Records per day inside a maintenance window against the days before it.

    ``readings`` is (object_id, day, v); days are counted first, so the range condition
    meets one row per object and day.
    """
    days = readings.groupBy("object_id", "day").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("v") >= 1).alias("_high"))
    joined = days.join(windows.select("object_id", "start", "end"), "object_id").filter(
        (F.col("day") >= F.date_sub("start", before_days)) & (F.col("day") <= F.date_add("end", after_days)))
    n = F.col("_n")
    sums = joined.groupBy("object_id", "start", "end").agg(
        F.coalesce(F.sum(F.when(F.col("day") < F.col("start"), n)), F.lit(0)).alias("_b"),
        F.coalesce(F.sum(F.when(F.col("day").between(F.col("start"), F.col("end")), n)), F.lit(0)).alias("_i"),
        F.coalesce(F.sum(F.when(F.col("day") > F.col("end"), F.col("_high"))), F.lit(0)).alias("high_after"),
    )
    before, inside = F.col("_b") / before_days, F.col("_i") / (F.datediff("end", "start") + 1)
    return sums.select(
        "object_id", "start", "end", F.round(before, 1).alias("per_day_before"),
        F.round(inside, 1).alias("per_day_inside"),
        F.when(before > 0, F.round(inside / before, 3)).alias("inside_to_before"), "high_after")


def schedule_months_check(readings: DataFrame, plan: DataFrame, workdays: DataFrame) -> DataFrame:
    """Share of workdays with a reading in the scheduled months against the other months.

    Hits are counted per object and month of year, workdays per month of year: no object
    by day grid is made.
    """
    work = F.broadcast(workdays.select("day"))  # calendar-sized
    hits = readings.select("object_id", "day").distinct().join(work, "day").groupBy(
        "object_id", F.month("day").alias("_mo")).agg(F.count(F.lit(1)).alias("_h"))
    sizes = workdays.groupBy(F.month("day").alias("_mo")).agg(F.count(F.lit(1)).alias("_d"))
    rows = plan.select("object_id", "months", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("_mo")).join(
        F.broadcast(sizes), "_mo").join(hits, ["object_id", "_mo"], "left").fillna(0, ["_h"])
    planned = F.array_contains("months", F.col("_mo"))
    share = lambda c: F.round(F.coalesce(F.try_divide(F.sum(F.when(c, F.col("_h"))), F.sum(F.when(c, F.col("_d")))), F.lit(0.0)), 4)
    return rows.groupBy("object_id").agg(share(planned).alias("share_in"), share(~planned).alias("share_out")).withColumn(
        "lift", F.when(F.col("share_out") > 0, F.round(F.col("share_in") / F.col("share_out"), 2)))


def expert_load(episodes: DataFrame, split: str, first: str, last: str) -> DataFrame:
    """Episodes per level and period: per year, per day, share repeated next day."""
    s = F.lit(split).cast("date")
    calib = F.datediff(s, F.lit(first).cast("date"))
    hold = F.datediff(F.lit(last).cast("date"), s)
    period = F.when(F.col("day") < s, "calibration").otherwise("holdout")
    days = F.when(F.col("period") == "calibration", calib).otherwise(hold)
    return episodes.filter(F.col("signal") | (F.col("level") == "CRITICAL")).groupBy("level", period.alias("period")).agg(
        F.count(F.lit(1)).alias("episodes"), F.round(F.avg("next_label"), 4).alias("next_day_rate"),
    ).withColumn("per_year", F.round(F.col("episodes") / days * 365, 1)).withColumn(
        "per_day", F.round(F.col("episodes") / days, 3))


def stratified_examples(df: DataFrame, by: str, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """Up to n rows per stratum in the order of the MD5 of seed and keys: repeatable, and a plain top-n per
    group, which Spark cuts to n rows per task before the shuffle.
    """
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    order = Window.partitionBy(by).orderBy("_h", *keys)
    return df.withColumn("_h", h).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_h", "_r")


def window_share(events: DataFrame, windows: DataFrame, flag: str) -> DataFrame:
    """Share of events with the flag inside and outside windows of their object.

    A window is a day interval; events of an object and day are tested together.
    """
    per_day = events.groupBy("object_id", "day").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(flag).cast("int")).alias("_f"))
    spans = windows.select("object_id", F.col("start").cast("timestamp").alias("t_from"),
                           shift(F.col("end").cast("timestamp"), 86400).alias("t_to"))
    marked = stab_count(per_day.withColumn("_at", F.col("day").cast("timestamp")), spans, ["object_id"],
                        "_at", "t_from", "t_to", "_w")
    return marked.groupBy((F.col("_w") > 0).alias("in_window")).agg(
        F.sum("_n").alias("events"), F.round(F.sum("_f") / F.sum("_n"), 3).alias("share"))


def not_in_windows(rows: DataFrame, windows: DataFrame, day: str = "day", extra_days: int = 0) -> DataFrame:
    """Rows whose day lies in no [start, end + extra] window of their object."""
    spans = windows.select("object_id", F.col("start").cast("timestamp").alias("t_from"),
                           shift(F.col("end").cast("timestamp"), (extra_days + 1) * 86400).alias("t_to"))
    marked = stab_count(rows.withColumn("_at", F.col(day).cast("timestamp")), spans, ["object_id"],
                        "_at", "t_from", "t_to", "_w")
    return marked.filter("_w = 0").drop("_w", "_at")


def life_days(units: DataFrame, keys: Sequence[str], calendar: DataFrame) -> DataFrame:
    return dense_grid(units, keys).join(F.broadcast(calendar.select("day", "is_day_off")), "day")
