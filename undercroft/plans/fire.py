"""Fire panel: picket x day, label = a signal outside a burst that day."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undercroft import config
from undercroft.functions.clock import boundary_diff, shift
from undercroft.functions.mapping import decimal
from undercroft.operators.grids import Rolling, days_since, filled_grid, in_life, units_by_day
from undercroft.operators.neighbours import burst_neighbours, line_neighbours
from undercroft.operators.ordered import stab_count
from undercroft.session import light, stored

KEY = ("object_id", "gallery", "picket")
EVENT_FACTS = ("ev_to_midnight", "ev_channels", "ev_smoke", "ev_heat", "ev_temp")
COMPLEX_COUNTS = ("gas_mid", "gas_ge1", "gas_ge1_off", "phase_off", "fan_off", "talk", "door")


@dataclass
class FireInputs:
    """``alarm``: (key, moment, channel_id, stype); ``fault``: (key, day, n); ``temp``:
    (key, day, t_max, t_mean); ``objtemp``: (object_id, day, obj_t_max); ``cxday``: complex day."""

    unit: DataFrame
    alarm: DataFrame
    fault: DataFrame
    temp: DataFrame
    objtemp: DataFrame
    cxday: DataFrame
    object_complex: DataFrame
    weather: DataFrame
    humidity: DataFrame
    external: DataFrame
    calendar: DataFrame


def event_day(alarm: DataFrame, keys: Sequence[str] = KEY, ts: str = "moment",
              burst: int = config.BURST_NEIGHBOURS) -> DataFrame:
    """Signals of a unit-day split into events and bursts, with the facts of the events."""
    marked = burst_neighbours(alarm, ("object_id",), tuple(k for k in keys if k != "object_id"), ts)
    single = F.col("nb") <= burst
    only = lambda c: F.when(single, c)
    day = F.to_date(ts)
    return marked.groupBy(*keys, day.alias("day")).agg(
        F.count_if(single).alias("m_ev"), F.count_if(~single).alias("m_chk"),
        boundary_diff("minute", F.max(only(F.col(ts))), shift(F.max(day).cast("timestamp"), 86400)).alias("ev_to_midnight"),
        F.countDistinct(only(F.col("channel_id"))).alias("ev_channels"),
        *[F.max(only((F.col("stype") == t).cast("int"))).alias(n) for n, t in (
            ("ev_smoke", config.SMOKE_TYPE), ("ev_heat", config.HEAT_TYPE), ("ev_temp", config.TEMPERATURE_TYPE))],
    )


def unit_days(t: FireInputs) -> DataFrame:
    """Dense unit x day grid with everything known about the day itself.

    Sums over objects and lines are made of the days with facts, before the grid: its rows stay where they are spread.
    """
    facts = event_day(t.alarm).unionByName(
        t.fault.select(*KEY, "day", F.col("n").alias("faults")), allowMissingColumns=True
    ).unionByName(t.temp.select(*KEY, "day", "t_max", "t_mean"), allowMissingColumns=True)
    sparse = in_life(facts, t.unit, KEY).groupBy(*KEY, "day").agg(*[
        F.max(c).alias(c) for c in ("m_ev", "m_chk", *EVENT_FACTS, "faults", "t_max", "t_mean")])
    sparse = stored(sparse)  # read by the object sums, the line neighbours and the panel
    flag = lambda c: F.coalesce((F.col(c) > 0).cast("int"), F.lit(0))
    marked = sparse.withColumn("ev", flag("m_ev")).withColumn("chk", flag("m_chk"))
    sums = marked.groupBy("object_id", "day").agg(F.sum("ev").alias("o_ev"), F.sum("chk").alias("o_chk"))
    od = units_by_day(t.unit, ("object_id",), "o_units").join(sums, ["object_id", "day"], "left").fillna(0, ["o_ev", "o_chk"])
    line = line_neighbours(marked, ("object_id", "gallery"), "picket",
                           [d for d in range(-config.LINE_PICKETS, config.LINE_PICKETS + 1) if d], {"l_ev": "ev"})
    context = od.join(t.objtemp, ["object_id", "day"], "left").join(t.object_complex, "object_id", "left").join(
        t.cxday, ["complex_id", "day"], "left").fillna(0, list(COMPLEX_COUNTS))
    context = light(stored(context))  # its size is known before the join: the grid is not shuffled to meet a small one
    ud = filled_grid(t.unit, KEY, sparse.unionByName(line, allowMissingColumns=True)).fillna(
        0, ["m_ev", "m_chk", "faults", "l_ev"]).withColumn("ev", flag("m_ev")).withColumn("chk", flag("m_chk"))
    w = Rolling(KEY)
    return (
        ud.join(context, ["object_id", "day"])
        .withColumn("rep", F.col("ev") * F.coalesce(w.lag("ev", 1), F.lit(0)))
        .withColumn("n_ev", F.col("o_ev") - F.col("ev")).withColumn("n_chk", F.col("o_chk") - F.col("chk"))
        .withColumn("o_walk", (F.col("o_chk") > 0).cast("int"))
        .withColumn("n_chk_share", F.col("n_chk") / F.greatest(F.col("o_units") - 1, F.lit(1)))
    )


def weather_days(t: FireInputs) -> DataFrame:
    """Weather before the day: one row per day, so the unkeyed window is calendar-sized."""
    w = Rolling((), "day")
    one = {
        "wx_temp_mean_1d": "temp_mean", "wx_temp_max_1d": "temp_max", "wx_precip_1d": "precip_mm",
        "wx_rh_mean_1d": "rh_mean", "wx_rh_max_1d": "rh_max", "wx_dew_mean_1d": "dew_mean",
        "wx_pressure_change_1d": "pressure_change", "wx_wind_mean_1d": "wind_mean", "wx_gust_max_1d": "gust_max",
        "wx_cloud_mean_1d": "cloud_mean", "wx_soil_temp_1d": "soil_temp", "wx_pm25_mean_1d": "pm25_mean",
        "wx_pm10_mean_1d": "pm10_mean", "wx_co_max_1d": "co_max", "cal_fireworks_1d": "fireworks",
    }
    days = t.weather.join(t.humidity, "day", "left").join(t.external, "day", "left")
    return days.select(
        "day", *[w.lag(c, 1).alias(n) for n, c in one.items()], w.max("temp_max", 7).alias("wx_temp_max_7d"),
        w.mean("rh_mean", 7).alias("wx_rh_mean_7d"), w.max("pm25_max", 7).alias("wx_pm25_max_7d"),
        F.col("fireworks").alias("cal_fireworks"))


def fire_daily(t: FireInputs) -> DataFrame:
    days = unit_days(t)
    w = Rolling(KEY)

    def s(c: str, n: int) -> Column:
        return F.coalesce(w.sum(c, n), F.lit(0))

    def since(flag: str) -> Column:
        return days_since(w.last_where(F.col(flag) > 0), cap=config.DAYS_CAP)

    summed = ("ev", "m_ev", "l_ev", "o_walk", "chk", "n_ev", "n_chk", "n_chk_share", "rep", "faults", *COMPLEX_COUNTS)
    rolled = w.cumulate(days, *summed).select(
        *KEY, "day", F.col("ev").alias("label"),
        *[s("ev", n).alias(f"evt_days_{n}d") for n in (1, 7, 30, 90, 365)],
        s("m_ev", 30).alias("evt_moments_30d"), since("ev").alias("evt_days_since"),
        F.coalesce(w.total_before("ev"), F.lit(0)).alias("evt_days_all"),
        *[s("l_ev", n).alias(f"line_events_{n}d") for n in (1, 7, 30)],
        since("o_walk").alias("obj_walk_days_since"), s("o_walk", 365).alias("obj_walks_365d"),
        *[s("chk", n).alias(f"chk_days_{n}d") for n in (30, 365)], since("chk").alias("chk_days_since"),
        *[s("n_ev", n).alias(f"obj_events_{n}d") for n in (1, 7, 30)],
        F.coalesce(w.sum("n_chk_share", 1), F.lit(0.0)).alias("obj_check_share_1d"), s("n_chk", 30).alias("obj_checks_30d"),
        w.max("obj_t_max", 1).alias("obj_temp_max_1d"), w.mean("obj_t_max", 30).alias("_obj_t_30"),
        w.max("t_max", 1).alias("tmp_max_1d"), w.mean("t_mean", 1).alias("tmp_mean_1d"),
        w.mean("t_mean", 7).alias("tmp_mean_7d"), w.mean("t_mean", 30).alias("_t_mean_30"), w.max("t_max", 30).alias("_t_max_30"),
        w.max("gas_max", 1).alias("gas_max_1d"), w.max("gas_max", 7).alias("gas_max_7d"),
        w.mean("gas_mean", 30).alias("gas_mean_30d"), s("gas_mid", 7).alias("gas_mid_7d"),
        s("gas_ge1", 30).alias("gas_ge1_30d"), s("gas_ge1_off", 365).alias("gas_ge1_off_365d"),
        since("gas_ge1").alias("gas_days_since_ge1"),
        *[s("faults", n).alias(f"hw_faults_{n}d") for n in (1, 7, 30)],
        *[s(c, n).alias(f"{p}_{c}_{n}d") for p, c in (("pwr", "phase_off"), ("pwr", "fan_off"), ("ppl", "talk"), ("ppl", "door"))
          for n in (1, 7)],
        F.coalesce(w.min("ev_to_midnight", 1), F.lit(1440)).alias("rec_to_midnight_1d"),
        F.coalesce(w.max("ev_channels", 1), F.lit(0)).alias("rec_channels_1d"),
        s("rep", 365).alias("rec_repeats_365d"), F.coalesce(w.total_before("rep"), F.lit(0)).alias("rec_repeats_all"),
        s("m_ev", 1).alias("rec_moments_1d"),
        *[F.coalesce(w.max(f"ev_{k}", 1), F.lit(0)).alias(f"rec_{k}_1d") for k in ("smoke", "heat", "temp")],
    )
    lines = t.unit.groupBy("object_id", "gallery").agg(
        F.min("picket").alias("_lo"), F.max("picket").alias("_hi"), F.count(F.lit(1)).alias("geo_object_units"))
    # The wide panel stays where its windows left it: units carry what their line knows, days are broadcast.
    units = t.unit.select(*KEY, "hour_from", "n_smoke", "n_temp", "n_heat").join(lines, ["object_id", "gallery"])
    around = t.calendar.select("day", "day_of_week", "is_day_off", "season", "month", "day_of_year").join(weather_days(t), "day", "left")
    p = F.col("picket")
    full = rolled.join(units, list(KEY)).filter(F.col("day") > F.to_date("hour_from")).join(F.broadcast(around), "day")
    return (
        full.withColumn("naive", (F.col("evt_days_1d") > 0).cast("int"))
        .withColumn("obj_walk_phase", F.col("obj_walk_days_since") * F.col("obj_walks_365d") / 365.0)
        .withColumn("unit_age_days", F.datediff("day", F.to_date("hour_from")))
        .withColumn("obj_temp_rise", F.col("obj_temp_max_1d") - F.col("_obj_t_30"))
        .withColumn("tmp_delta_30d", F.col("tmp_mean_1d") - F.col("_t_mean_30"))
        .withColumn("tmp_max_rise", F.col("tmp_max_1d") - F.col("_t_max_30"))
        .withColumn("cond_dew_minus_unit", F.col("wx_dew_mean_1d") - F.col("tmp_mean_1d"))
        .withColumn("cond_dew_minus_object", F.col("wx_dew_mean_1d") - F.col("obj_temp_max_1d"))
        .withColumn("cond_outside_minus_object", F.col("wx_temp_mean_1d") - F.col("obj_temp_max_1d"))
        .withColumn("geo_position", (p - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1)))
        .withColumn("geo_to_edge", F.least(p - F.col("_lo"), F.col("_hi") - p))
        .withColumnsRenamed({"n_smoke": "unit_smoke", "n_temp": "unit_temp", "n_heat": "unit_heat",
                             "day_of_week": "week_day_of_week", "is_day_off": "week_is_day_off",
                             "season": "cal_season", "month": "cal_month", "day_of_year": "cal_day_of_year"})
        .drop("_obj_t_30", "_t_mean_30", "_t_max_30", "_lo", "_hi", "hour_from")
    )


# --- input tables from typed journal rows -------------------------------------------


def temperature_days(rows: DataFrame, keys: Sequence[str], lo: float = -40.0, hi: float = 125.0) -> DataFrame:
    v = decimal("value")
    return rows.withColumn("_v", v).filter(F.col("_v").between(lo, hi)).groupBy(*keys, "day").agg(
        F.max("_v").alias("t_max"), F.avg("_v").alias("t_mean"))


def gas_days(rows: DataFrame, calendar: DataFrame, keys: Sequence[str] = ("object_id",)) -> DataFrame:
    """Gas of an object and day: maximum, mean, banded counts, high readings off work hours."""
    v, h = F.col("_v"), F.hour("ts")
    off = (F.col("is_day_off") == 1) | (h < 8) | (h >= 16)
    return (
        rows.withColumn("_v", decimal("value")).filter(F.col("_v").between(0, 100))
        .join(F.broadcast(calendar.select("day", "is_day_off")), "day")
        .groupBy(*keys, "day").agg(
            F.max(v).alias("gas_max"), F.avg(v).alias("gas_mean"), F.count_if((v >= 0.1) & (v < 1)).alias("gas_mid"),
            F.count_if(v >= 1).alias("gas_ge1"), F.count_if((v >= 1) & off).alias("gas_ge1_off"))
    )


def complex_days(states: DataFrame, gas: DataFrame, object_complex: DataFrame) -> DataFrame:
    """Complex day: counted states and the gas of its objects, either may be missing."""
    counted = states.join(object_complex, "object_id").groupBy("complex_id", "day").agg(*[
        F.sum(c).alias(c) for c in ("phase_off", "fan_off", "talk", "door")])
    folded = gas.join(object_complex, "object_id").groupBy("complex_id", "day").agg(
        F.max("gas_max").alias("gas_max"), F.avg("gas_mean").alias("gas_mean"),
        *[F.sum(c).alias(c) for c in ("gas_mid", "gas_ge1", "gas_ge1_off")])
    return counted.join(folded, ["complex_id", "day"], "full_outer")


def alive_units(units: DataFrame, days: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Units of an object alive on a day, only for the asked (object, day) pairs.

    Births minus deaths up to the day: a running sum, no unit is spread over its life.
    """
    spans = units.select("object_id", F.to_date("hour_from").cast("timestamp").alias("lo"),
                         F.to_date("hour_to").cast("timestamp").alias("hi"))
    points = days.select("object_id", "day").distinct().withColumn("_at", F.col("day").cast("timestamp"))
    return stab_count(points, spans, ("object_id",), "_at", "lo", "hi", "units_alive", closed="both").drop("_at")
