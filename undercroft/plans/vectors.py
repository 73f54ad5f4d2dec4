"""Feature vectors of one run: every unit at one moment, one pass per source table.

The windows end at the moment of the run, so a window is a condition inside one
aggregation; there is no loop over facilities and no cache between vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undercroft import config
from undercroft.functions.calendar import is_day_off, is_holiday, season
from undercroft.functions.cards import hours_back
from undercroft.functions.clock import local_day, local_midnight, shift
from undercroft.operators.features import FeatureGraph, value
from undercroft.operators.intervals import on_intervals, overlap_hours
from undercroft.operators.ordered import state_runs
from undercroft.operators.sessions import flag_events
from undercroft.plans.flood import melt, pump_growth
from undercroft.session import stored

ACCESS_TYPES = ("DOOR_OPEN", "MOTION")
DAY = 86400
PUMP_STATES = ("PUMP_ON", "PUMP_OFF")
WATER_TYPES = ("FLOODED", "FLOOD_SENSOR_OPEN")


CALENDAR_NAMES = ("day_of_week", "day_of_month", "day_of_year", "week_of_year", "is_day_off")


def calendar_columns(day: Column) -> dict[str, Column]:
    return {
        "day_of_week": F.weekday(day), "day_of_month": F.dayofmonth(day), "day_of_year": F.dayofyear(day),
        "week_of_year": F.weekofyear(day), "is_day_off": is_day_off(day).cast("int"),
    }


def guard_runs(known: DataFrame) -> DataFrame:
    """Changes of the guard mode with the stamp of the next one, stored: windows, hours and
    the last change all read them."""
    guard = known.filter(F.col("code").isin("SECURITY_ARMED", "SECURITY_DISARMED")).select(
        "facility_id", "ts", F.col("code").alias("value"))
    return stored(state_runs(guard, ("facility_id",), "ts", "value", "next"))


def access_moments(known: DataFrame, windows: DataFrame, sensors: DataFrame) -> DataFrame:
    """Access moments with the event flag, by the online rule."""
    contacts = sensors.filter("sensor_type = 'CONTACT'").groupBy("facility_id").agg(F.count(F.lit(1)).alias("n_contact"))
    moment = known.filter(F.col("code").isin(*ACCESS_TYPES)).select(
        "facility_id", F.col("sensor_id").alias("channel_id"), "ts",
        F.when(F.col("code") == "MOTION", "motion").otherwise("contact").alias("kind"),
        F.lit(None).cast("int").alias("entry_dist")).distinct()
    return flag_events(moment.join(contacts, "facility_id", "left"), windows, ("facility_id",), ("facility_id",),
                       exact=True, near_entry=False)


def back_days(ts: str, at: Column) -> Column:
    """Number of whole days from the moment of the run back to a stamp."""
    return F.floor((F.unix_micros(at) - F.unix_micros(ts) - 1) / 8.64e10)


@dataclass(frozen=True)
class AccessInputs:
    """``events``: (facility_id, sensor_id, code, ts); ``facilities``: (facility_id, collector, born), ``born`` may be null."""

    events: DataFrame
    facilities: DataFrame
    sensors: DataFrame
    at: str

    @property
    def now(self) -> Column:
        return F.lit(self.at).cast("timestamp")


ACCESS = FeatureGraph("UNAUTHORIZED_ACCESS", "units")


@ACCESS.frame("known")
def _(i: AccessInputs) -> DataFrame:
    return i.events.filter(F.col("ts") < i.now)


@ACCESS.frame("units", "known")
def _(i: AccessInputs, known: DataFrame) -> DataFrame:
    seen = known.groupBy("facility_id").agg(
        F.min("ts").alias("_seen"),
        F.countDistinct(F.when(F.col("code").isin(*ACCESS_TYPES), F.col("sensor_id"))).alias("_channels"))
    return i.facilities.join(seen, "facility_id", "left").withColumn("_life", F.least(F.coalesce(F.col("born"), F.col("_seen"), i.now), i.now))


@ACCESS.frame("guard", "known")
def _(i: AccessInputs, known: DataFrame) -> DataFrame:
    return guard_runs(known)


@ACCESS.frame("windows", "guard")
def _(i: AccessInputs, runs: DataFrame) -> DataFrame:
    return runs.filter("value = 'SECURITY_DISARMED'").select("facility_id", F.col("ts").alias("t_from"), F.col("next").alias("t_to"))


@ACCESS.frame("days", "known", "windows")
def _(i: AccessInputs, known: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per unit and day back: every share and distinct-day count is a plain sum over it."""
    m = access_moments(known, windows, i.sensors).withColumn("_d", back_days("ts", i.now))
    hit = F.col("event")
    return stored(m.groupBy("facility_id", "_d").agg(
        F.count(F.lit(1)).alias("_a"), F.count_if(hit).alias("_e"), F.max("ts").alias("_la"), F.max(F.when(hit, F.col("ts"))).alias("_le")))


def upto(c: str, n: int) -> Column:
    return F.coalesce(F.sum(F.when(F.col("_d") < n, F.col(c))), F.lit(0))


def days_with(c: str, n: int) -> Column:
    return F.count_if((F.col("_d") < n) & (F.col(c) > 0)) / float(n)


@ACCESS.frame("own", "days", on=("facility_id",))
def _(i: AccessInputs, days: DataFrame) -> DataFrame:
    return days.groupBy("facility_id").agg(
        upto("_a", 7).alias("_a7"), upto("_e", 7).alias("_e7"), upto("_e", 90).alias("_e90"),
        days_with("_a", 7).alias("_da7"), days_with("_a", 365).alias("_da365"), days_with("_e", 30).alias("_de30"),
        F.max("_la").alias("_la"), F.max("_le").alias("_le"), F.max(((F.col("_d") == 6) & (F.col("_e") > 0)).cast("int")).alias("_same"))


@ACCESS.frame("objects", "days", on=("collector",))
def _(i: AccessInputs, days: DataFrame) -> DataFrame:
    return days.join(i.facilities.select("facility_id", "collector"), "facility_id").groupBy("collector").agg(
        upto("_a", 1).alias("_oa1"), upto("_a", 7).alias("_oa7"), F.count_if(F.col("_d") < 7).alias("_ou7"))


@ACCESS.frame("hours", "windows", on=("facility_id",))
def _(i: AccessInputs, windows: DataFrame) -> DataFrame:
    return overlap_hours(windows, ("facility_id",), i.now, {"_h7": 168, "_h30": 720})


@ACCESS.frame("change", "guard", on=("facility_id",))
def _(i: AccessInputs, runs: DataFrame) -> DataFrame:
    """The first arming without a disarming before it is no change."""
    return runs.groupBy("facility_id").agg(
        F.max("ts").alias("_hi"), F.min("ts").alias("_lo"),
        F.max(F.when(F.col("value") == "SECURITY_DISARMED", F.col("ts"))).alias("_off")).select(
        "facility_id", F.when(F.col("_hi") > F.col("_lo"), F.col("_hi")).otherwise(F.col("_off")).alias("_change"))


@ACCESS.frame("network", "days", "units", on=())
def _(i: AccessInputs, days: DataFrame, units: DataFrame) -> DataFrame:
    return network_share(days, units, i.now).drop("_k")


def counted(**columns: str) -> dict[str, Callable[[AccessInputs], Column]]:
    return {n: lambda i, c=c: F.coalesce(F.col(c), F.lit(0)) for n, c in columns.items()}


ACCESS.add(counted(n_alarms_7d="_a7", n_armed_7d="_e7", n_armed_90d="_e90", alarm_day_share_7d="_da7", alarm_day_share_365d="_da365", armed_day_share_30d="_de30", armed_same_weekday_1w="_same"), ["own"])
ACCESS.add(counted(obj_alarms_1d="_oa1", obj_alarms_7d="_oa7", obj_units_alarmed_7d="_ou7"), ["objects"])
ACCESS.add(counted(disarm_hours_7d="_h7"), ["hours"])
ACCESS.add(counted(n_channels="_channels"), ["units"])
ACCESS.add({"unit_age_days": lambda i: F.floor((F.unix_micros(i.now) - F.unix_micros("_life")) / 8.64e10)}, ["units"])
ACCESS.add({n: lambda i, c=c: F.coalesce(back_days(c, i.now) + 1, value("unit_age_days") + 1) for n, c in (("days_since_last_alarm", "_la"), ("days_since_last_armed", "_le"))}, ["own"], ["unit_age_days"])
ACCESS.add({n: lambda i, c=c: F.coalesce(boundary_hours(c, i.now), 24 * (value("unit_age_days") + 1)) for n, c in (("hours_since_last_alarm", "_la"), ("hours_since_last_armed", "_le"))}, ["own"], ["unit_age_days"])
ACCESS.add({"disarm_share_30d": lambda i: F.coalesce(F.col("_h30"), F.lit(0)) / 720.0}, ["hours"])
ACCESS.add({"hours_since_guard_change": lambda i: boundary_hours("_change", i.now)}, ["change"])
ACCESS.add({n: lambda i, n=n: F.col(n) for n in ("net_event_share_1d", "net_event_share_7d", "date_event_share_prev_years")}, ["network"])
ACCESS.add({n: lambda i, n=n: calendar_columns(F.to_date(i.now))[n] for n in CALENDAR_NAMES})
ACCESS.add({"day_off_chain": lambda i: F.when(is_day_off(F.to_date(i.now)), day_off_run(F.to_date(i.now))).otherwise(0)})


def access_vector(events: DataFrame, facilities: DataFrame, sensors: DataFrame, at: str, names: Sequence[str] | None = None) -> DataFrame:
    """The access features of every facility at the moment of a run: all, or those that a model names."""
    return ACCESS.build(AccessInputs(events, facilities, sensors, at), names)


def boundary_hours(ts: str, now: Column) -> Column:
    """Whole hours from the start of the stamp's hour."""
    return F.floor((F.unix_micros(now) - F.unix_micros(F.date_trunc("hour", ts))) / 3.6e9)


def day_off_run(day: Column, limit: int | None = None) -> Column:
    """Length of the run of days off around a date; a limit cuts longer ones.  No run is longer than a year, which bounds the search."""
    far = limit or 366
    reach = F.sequence(F.lit(1), F.lit(far))

    def side(sign: int) -> Column:
        work = F.filter(reach, lambda i: ~is_day_off(F.date_add(day, sign * i)))
        return F.coalesce(F.array_min(work), F.lit(far + 1)) - 1

    run = side(1) + side(-1) + 1
    return F.least(run, F.lit(limit)) if limit else run


def network_share(per_day: DataFrame, units: DataFrame, now: Column) -> DataFrame:
    """Share of unit-days with an event over the network: last day, last week, and the same
    dates of earlier years.  Alive unit-days are the denominator."""
    d, e = F.col("_d"), F.col("_e")
    hits = per_day.agg(F.count_if((d < 1) & (e > 0)).alias("_h1"), F.count_if((d < 7) & (e > 0)).alias("_h7"))
    back = lambda k: (F.col("_life") < shift(now, -k * DAY)).cast("int")
    alive = units.agg(F.sum(back(0)).alias("_a1"), sum_columns([F.sum(back(k)) for k in range(7)]).alias("_a7"))
    today = F.to_date(now)
    gap = lambda c: F.least(F.abs(F.dayofyear(c) - F.dayofyear(today)), 365 - F.abs(F.dayofyear(c) - F.dayofyear(today)))
    day = F.to_date(shift(now, -DAY))
    past = per_day.withColumn("_day", F.date_sub(day, d.cast("int")))
    same = (F.year("_day") < F.year(today)) & (gap(F.col("_day")) <= 3)
    dated = past.agg(F.count_if(same & (e > 0)).alias("_hs"), F.min("_day").alias("_first"))
    # Dates of earlier years near today's: a few dozen per unit life, made per unit without a join.
    dates = F.filter(F.sequence(F.make_date(F.year("_first"), F.lit(1), F.lit(1)), F.make_date(F.year(today), F.lit(1), F.lit(1)),
                                F.expr("INTERVAL 1 DAY")), lambda c: (F.year(c) < F.year(today)) & (gap(c) <= 3))
    marks = dated.select(F.lit(1).alias("_k"), "_hs", F.coalesce(dates, F.array().cast("array<date>")).alias("_dates"))
    alive_dated = units.withColumn("_k", F.lit(1)).join(F.broadcast(marks), "_k").agg(
        F.sum(F.size(F.filter("_dates", lambda c: F.to_date("_life") <= c))).alias("_as"), F.max("_hs").alias("_hs"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    share = lambda h, a: F.when(F.col(a) > 0, F.col(h) / F.col(a))
    return one(hits).join(one(alive), "_k").join(one(alive_dated), "_k").select(
        "_k", share("_h1", "_a1").alias("net_event_share_1d"), share("_h7", "_a7").alias("net_event_share_7d"),
        share("_hs", "_as").alias("date_event_share_prev_years"))


def sum_columns(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


# --- flood --------------------------------------------------------------------------


def flood_vector(events: DataFrame, facilities: DataFrame, sensors: DataFrame, water_days: DataFrame,
                 weather: DataFrame, at: str) -> DataFrame:
    """57 flood features per facility at the last local midnight.

    ``events``: (facility_id, sensor_id, code, ts) in UTC; ``facilities``: (facility_id,
    collector, district); ``sensors``: (facility_id, sensor_type); ``water_days``:
    (facility_id, day, is_water); ``weather``: hourly, one area.
    """
    p = local_midnight(F.lit(at).cast("timestamp"))
    # One scan of the events: hour rows per sensor and code carry every counter, the first and
    # the last stamps. The point lies on the hour, so hour rows cut the windows exactly.
    hourly = stored(events.filter(F.col("ts") < p).groupBy("facility_id", "sensor_id", "code", F.date_trunc("hour", "ts").alias("_h")).agg(
        F.count(F.lit(1)).alias("_n"), F.countDistinct("ts").alias("_m"), F.min("ts").alias("_lo"), F.max("ts").alias("_hi")))
    age = lambda c: (F.unix_micros(p) - F.unix_micros(c)) / 3.6e9
    within = lambda n: age("_h") <= n
    label = hourly.filter(F.col("code").isin(*WATER_TYPES)).withColumn("day", local_day("_h")).join(
        water_days.select("facility_id", "day", "is_water"), ["facility_id", "day"])
    water = F.col("is_water")
    evt = label.groupBy("facility_id", "is_water", "_h").agg(F.sum("_m").alias("_m"), F.max("_hi").alias("_hi")).groupBy("facility_id").agg(
        *[F.count_if(water & within(n)).alias(f"evt_hours_{n}h") for n in (6, 12, 24, 168, 720, 2160, 8760)],
        *[F.count_if(~water & within(n)).alias(f"check_hours_{n}h") for n in (24, 168, 720)],
        *[F.sum(F.when(water & within(n), F.col("_m")).otherwise(0)).alias(f"m_evt_{n}h") for n in (24, 168)],
        F.max(F.when(water, F.col("_hi"))).alias("_last"))
    state, code = F.col("code").isin(*PUMP_STATES), F.col("code")
    counts = hourly.groupBy("facility_id").agg(
        F.min("_lo").alias("_first"),
        *[F.sum(F.when(state & within(n), F.col("_n")).otherwise(0)).alias(f"chg_{n}h") for n in (1, 6, 24)],
        *[F.sum(F.when((code == c) & within(n), F.col("_m")).otherwise(0)).alias(f"{k}_{n}h")
          for k, c in (("unavail", "PUMP_UNAVAILABLE"), ("allp", "PUMP_ALL_RUNNING")) for n in (24, 168)])
    blink = hourly.filter(state & within(168)).groupBy("facility_id", "sensor_id", "_h").agg(F.sum("_n").alias("_n")).filter(
        F.col("_n") > config.BLINK_CHANGES_PER_HOUR).groupBy("facility_id").agg(
        F.count_if(within(24)).alias("blink_24h"), F.count(F.lit(1)).alias("blink_168h"))
    lately = events.filter((F.col("ts") < p) & (F.col("ts") >= shift(p, -744 * 3600)) & state).select(
        "facility_id", "sensor_id", "ts", F.col("code").alias("value"))
    on = on_minutes(lately, p)
    unit = facilities.select("facility_id", "collector", "district")
    for part in (evt, counts, blink, on):
        unit = unit.join(part, "facility_id", "left")
    sums = [c for c in unit.columns if c not in ("facility_id", "collector", "district", "_first", "_last")]
    unit = stored(unit.fillna(0, sums))  # summed to objects and complexes, then read again
    level = ("m_evt_24h", "m_evt_168h", "chg_24h", "blink_24h", "unavail_24h", "allp_24h", "allp_168h", "on_min_24h")
    by_object = unit.groupBy("collector").agg(*[F.sum(c).alias(f"_o_{c}") for c in level])
    by_complex = unit.groupBy("district").agg(*[F.sum(c).alias(f"_c_{c}") for c in level])
    full = (
        unit.join(by_object, "collector", "left").join(by_complex, "district", "left")
        .join(unit_sensors(hourly, sensors), "facility_id", "left")
        .fillna(0, ["unit_pumps", "unit_flood_sensors"]).withColumn("_k", F.lit(1))
        .join(F.broadcast(run_weather(weather, p)), "_k"))
    start = F.date_trunc("hour", F.coalesce("_first", p))
    pumps = F.greatest(F.col("unit_pumps"), F.lit(1))
    day = F.to_date(shift(p, 3 * 3600))
    c = F.col
    ring = lambda a, b: {n: c(f"{a}{m}") - c(f"{b}{m}") for n, m in b_names(a).items()}
    out = {
        **{f"pump_changes_{n}h": c(f"chg_{n}h") for n in (1, 6, 24)},
        **{f"pump_blink_hours_{n}h": c(f"blink_{n}h") for n in (24, 168)},
        **{f"pump_on_share_{n}h": c(f"on_min_{n}h") / (60.0 * n * pumps) for n in (24, 168)},
        "pump_on_growth_24_720": pump_growth(c("on_min_24h"), c("on_min_720h")),
        **{f"pump_unavailable_{n}h": c(f"unavail_{n}h") for n in (24, 168)},
        **{f"pump_all_running_{n}h": c(f"allp_{n}h") for n in (24, 168)},
        **{f"evt_hours_{n}h": c(f"evt_hours_{n}h") for n in (24, 168, 720, 2160, 8760)},
        "evt_moments_168h": c("m_evt_168h"),
        "evt_hours_since_last": F.coalesce(F.floor(age(F.date_trunc("hour", "_last"))), F.floor(age(start)) + 1),
        **ring("_o_", ""), **ring("_c_", "_o_"),
        "unit_pumps": c("unit_pumps"), "unit_flood_sensors": c("unit_flood_sensors"),
        "unit_age_days": F.datediff(day, local_day(start)),
        **{f"recent_evt_hours_{n}h": c(f"evt_hours_{n}h") for n in (6, 12)},
        "recent_check_hours_24h": c("check_hours_24h"), "recent_pump_on_share_6h": c("on_min_6h") / (60.0 * 6 * pumps),
        **{f"check_hours_{n}h": c(f"check_hours_{n}h") for n in (168, 720)},
        **{w: c(w) for w in WEATHER}, "cal_hour": F.lit(0), "cal_season": season(day), "cal_month": F.month(day),
        "cal_day_of_year": F.dayofyear(day), "cal_day_of_week": F.weekday(day), "cal_is_day_off": is_day_off(day).cast("int"),
        "cal_is_holiday": is_holiday(day).cast("int"),
        "cal_day_off_chain": F.when(is_day_off(day), day_off_run(day)).otherwise(0),
    }
    return full.select("facility_id", *[v.alias(n) for n, v in out.items()])


WEATHER = ("weather_precip_24h", "weather_precip_72h", "weather_precip_168h", "weather_rain_72h", "weather_snowfall_72h",
           "weather_temp_mean_24h", "weather_temp_max_72h", "weather_snow_depth_cm", "weather_melt_72h_cm")


def b_names(prefix: str) -> dict[str, str]:
    """Feature names of the ring between two levels, by the outer level's prefix."""
    if prefix == "_o_":
        return {"obj_events_24h": "m_evt_24h", "obj_events_168h": "m_evt_168h", "obj_pump_changes_24h": "chg_24h",
                "obj_pump_blink_24h": "blink_24h", "obj_pump_unavailable_24h": "unavail_24h",
                "obj_pump_all_running_24h": "allp_24h", "obj_pump_on_minutes_24h": "on_min_24h"}
    return {"cx_events_24h": "m_evt_24h", "cx_events_168h": "m_evt_168h", "cx_pump_blink_24h": "blink_24h",
            "cx_pump_unavailable_24h": "unavail_24h", "cx_pump_all_running_168h": "allp_168h"}


def on_minutes(states: DataFrame, p: Column, hours: Sequence[int] = (6, 24, 168, 720)) -> DataFrame:
    """Minutes in the ON state inside look-back windows ending at ``p``."""
    spans = on_intervals(states, ("facility_id", "sensor_id"), on="PUMP_ON", open_hours=config.MAX_ON_HOURS)
    got = overlap_hours(spans, ("facility_id",), p, {f"on_min_{n}h": n for n in hours}, "a", "b")
    return got.select("facility_id", *[(F.col(f"on_min_{n}h") * 60).alias(f"on_min_{n}h") for n in hours])


def unit_sensors(seen_codes: DataFrame, sensors: DataFrame) -> DataFrame:
    """Pumps and flood sensors of a unit by the dictionary, by the journal when it has none."""
    named = sensors.groupBy("facility_id").agg(
        F.count_if(F.col("sensor_type") == "PUMP").alias("_p"), F.count_if(F.col("sensor_type") == "FLOOD_SENSOR").alias("_f"))
    types = (*WATER_TYPES, *PUMP_STATES, "PUMP_ALL_RUNNING", "PUMP_UNAVAILABLE")
    seen = seen_codes.filter(F.col("code").isin(*types)).groupBy(
        "facility_id", "sensor_id").agg(
        F.max((F.col("code") != "FLOOD_SENSOR_OPEN").cast("int")).alias("_pump"),
        F.max((F.col("code") == "FLOOD_SENSOR_OPEN").cast("int")).alias("_flood")).groupBy("facility_id").agg(
        F.sum("_pump").alias("_jp"), F.sum("_flood").alias("_jf"))
    none = F.coalesce(F.col("_p") + F.col("_f"), F.lit(0)) == 0
    return named.join(seen, "facility_id", "full_outer").select(
        "facility_id", F.coalesce(F.when(none, F.col("_jp")).otherwise(F.col("_p")), F.lit(0)).alias("unit_pumps"),
        F.coalesce(F.when(none, F.col("_jf")).otherwise(F.col("_f")), F.lit(0)).alias("unit_flood_sensors"))


def run_weather(weather: DataFrame, p: Column) -> DataFrame:
    """Weather windows before the point, one row."""
    rows = weather.filter((F.col("hour") < p) & (F.col("hour") >= shift(p, -168 * 3600)))
    back = (F.unix_seconds(p) - F.unix_seconds("hour")) / 3600
    w = lambda c, n: F.coalesce(F.sum(F.when(back <= n, F.col(c))), F.lit(0.0))
    now, before = F.max(F.when(back == 1, F.col("snow_depth"))), F.max(F.when(back == 72, F.col("snow_depth")))
    return rows.agg(
        *[w("precip", n).alias(f"weather_precip_{n}h") for n in (24, 72, 168)], w("rain", 72).alias("weather_rain_72h"),
        w("snowfall", 72).alias("weather_snowfall_72h"),
        F.avg(F.when(back <= 24, F.col("temp"))).alias("weather_temp_mean_24h"),
        F.max(F.when(back <= 72, F.col("temp"))).alias("weather_temp_max_72h"),
        (F.coalesce(now, F.lit(0.0)) * 100).alias("weather_snow_depth_cm"), melt(before, now).alias("weather_melt_72h_cm"),
    ).withColumn("_k", F.lit(1))



# --- work types ----------------------------------------------------------------------


def flood_work_type() -> Column:
    """Standing water asks for pumping, a blinking or missing pump for a check, the rest is planned work."""
    pump = (F.col("pump_blink_hours_24h") > 0) | (F.col("pump_unavailable_24h") > 0)
    return F.when(F.col("evt_hours_24h") > 0, "Откачка воды").when(pump, "Проверка приямка и насоса").otherwise("Гидроизоляция")


def access_work_type() -> Column:
    """A fresh event asks for the response group, a fresh alarm for a look at the entry, a guard mode
    silent for over a week for a check of the access system."""
    back = lambda c: hours_back(c, "unit_age_days")
    return (
        F.when(back("hours_since_last_armed") < 24, "Выезд группы реагирования")
        .when(back("hours_since_last_alarm") < 24, "Осмотр люка и запорного механизма")
        .when(back("hours_since_guard_change") > config.GUARD_SILENCE_HOURS, "Проверка СКУД").otherwise("Замена замка"))
