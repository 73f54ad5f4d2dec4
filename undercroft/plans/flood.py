"""Flood panel: picket x hour, label = a water hour in the next 24."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undercroft.functions.clock import boundary_diff
from undercroft.operators.grids import Rolling, dense_grid
from undercroft.operators.ordered import exact_quantile
from undercroft.session import stored

KEY = ("object_id", "gallery", "picket")
MEASURES = ("m_evt", "had_evt", "chg", "blink", "on_min", "unavail", "allp", "had_check")
GROUP_MEASURES = ("m_evt", "chg", "blink", "on_min", "unavail", "allp")


@dataclass
class FloodInputs:
    """``alarm``/``check_signal``: (key, hour, n_moments); ``pump``: hourly pump rows with an
    optional picket; ``weather``: hourly; ``unit_meta``: (key, n_pumps, n_flood_sensors)."""

    unit: DataFrame
    alarm: DataFrame
    check_signal: DataFrame
    pump: DataFrame
    unit_meta: DataFrame
    object_complex: DataFrame
    weather: DataFrame
    calendar: DataFrame


def blink_threshold(pump: DataFrame, end: str, q: float = 0.99) -> DataFrame:
    """Quantile of hourly changes on pump-days without a failure, before the cut-off."""
    bad = pump.filter("n_unavail > 0 OR n_flooded > 0").select(
        "channel_id", F.to_date("hour").alias("day")).distinct()
    healthy = pump.filter((F.col("hour") < F.lit(end).cast("timestamp")) & (F.col("n_changes") > 0)).withColumn(
        "day", F.to_date("hour")).join(bad, ["channel_id", "day"], "left_anti")
    return exact_quantile(healthy.select(F.col("n_changes").cast("double").alias("n_changes")), "n_changes", q)


def unit_hours(t: FloodInputs, blink: float) -> DataFrame:
    """Dense unit x hour grid; alarms, checks and pumps are folded before the one join."""
    flag = (F.col("n_changes") > blink).cast("int")
    rows = t.alarm.select(*KEY, "hour", F.col("n_moments").alias("m_evt"), F.lit(1).alias("had_evt")).unionByName(
        t.check_signal.select(*KEY, "hour", F.lit(1).alias("had_check")), allowMissingColumns=True
    ).unionByName(
        t.pump.filter(F.col("picket").isNotNull()).select(
            *KEY, "hour", F.col("n_changes").alias("chg"), flag.alias("blink"), F.col("on_minutes").alias("on_min"),
            F.col("n_unavail").alias("unavail"), F.col("n_all_pumps").alias("allp")), allowMissingColumns=True)
    sparse = rows.groupBy(*KEY, "hour").agg(*[
        (F.max if m.startswith("had_") else F.sum)(m).alias(m) for m in MEASURES])
    return dense_grid(t.unit, KEY, unit="hour").join(sparse, [*KEY, "hour"], "left").fillna(0, list(MEASURES))


def group_hours(t: FloodInputs, blink: float) -> DataFrame:
    """Hour sums by object: events of units, pumps with and without a picket."""
    flag = (F.col("n_changes") > blink).cast("int")
    inside = t.alarm.join(t.unit.select(*KEY, "hour_from", "hour_to"), list(KEY)).filter(
        F.col("hour").between(F.col("hour_from"), F.col("hour_to")))
    events = inside.groupBy(*KEY, "hour").agg(F.sum("n_moments").alias("m_evt"))
    rows = events.select("object_id", "hour", "m_evt", F.lit(1).alias("units_evt")).unionByName(
        t.pump.select("object_id", "hour", F.col("n_changes").alias("chg"), flag.alias("blink"),
                      F.col("on_minutes").alias("on_min"), F.col("n_unavail").alias("unavail"),
                      F.col("n_all_pumps").alias("allp")), allowMissingColumns=True)
    return rows.groupBy("object_id", "hour").agg(*[
        F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in (*GROUP_MEASURES, "units_evt")])


def group_rolled(hours: DataFrame, spans: DataFrame, key: str, prefix: str) -> DataFrame:
    """Look-back sums on the dense grid of a group, from its first to its last unit hour."""
    grid = dense_grid(spans.groupBy(key).agg(F.min("hour_from").alias("hour_from"), F.max("hour_to").alias("hour_to")),
                      (key,), unit="hour")
    dense = grid.join(hours, [key, "hour"], "left").fillna(0, list(GROUP_MEASURES))
    w = Rolling((key,), "hour")
    wanted = [("m_evt", 24), ("m_evt", 168), ("chg", 24), ("blink", 24), ("on_min", 24), ("unavail", 24),
              ("allp", 24), ("allp", 168)]
    return w.cumulate(dense, *GROUP_MEASURES).select(key, "hour", *[w.sum(m, n).alias(f"{prefix}{m}_{n}h") for m, n in wanted])


def weather_rolled(weather: DataFrame) -> DataFrame:
    """Weather before the hour. One row per hour of the whole network bounds the window."""
    w = Rolling((), "hour")
    return w.cumulate(weather, "precip", "rain", "snowfall").select(
        "hour",
        *[F.coalesce(w.sum("precip", n), F.lit(0.0)).alias(f"weather_precip_{n}h") for n in (24, 72, 168)],
        F.coalesce(w.sum("rain", 72), F.lit(0.0)).alias("weather_rain_72h"),
        F.coalesce(w.sum("snowfall", 72), F.lit(0.0)).alias("weather_snowfall_72h"),
        w.mean("temp", 24).alias("weather_temp_mean_24h"), w.max("temp", 72).alias("weather_temp_max_72h"),
        (F.coalesce(w.lag("snow_depth", 1), F.lit(0.0)) * 100).alias("weather_snow_depth_cm"),
        melt(w.lag("snow_depth", 72), w.lag("snow_depth", 1)).alias("weather_melt_72h_cm"),
    )


def melt(before: Column, now: Column) -> Column:
    """Snow lost in centimetres, never negative."""
    return F.greatest(F.lit(0.0), F.coalesce(before, F.lit(0.0)) - F.coalesce(now, F.lit(0.0))) * 100


def flood_hourly(t: FloodInputs, blink: float, horizon: int = 24) -> DataFrame:
    hours = unit_hours(t, blink)
    w = Rolling(KEY, "hour")

    def s(m: str, n: int) -> Column:
        return F.coalesce(w.sum(m, n), F.lit(0))

    first = w.first()
    unit = w.cumulate(hours, *MEASURES).select(
        *KEY, "hour", w.next_sum("had_evt", horizon).alias("_next"), w.next_rows(horizon).alias("_rows"),
        *[s("chg", n).alias(f"pump_changes_{n}h") for n in (1, 6, 24)],
        *[s("blink", n).alias(f"pump_blink_hours_{n}h") for n in (24, 168)],
        *[s("on_min", n).alias(f"_on_{n}") for n in (6, 24, 168, 720)],
        *[s("unavail", n).alias(f"pump_unavailable_{n}h") for n in (24, 168)],
        *[s("allp", n).alias(f"pump_all_running_{n}h") for n in (24, 168)],
        *[s("had_evt", n).alias(f"evt_hours_{n}h") for n in (24, 168, 720, 2160, 8760)],
        s("m_evt", 168).alias("evt_moments_168h"), s("m_evt", 24).alias("_m_24"),
        F.coalesce(boundary_diff("hour", w.last_where(F.col("had_evt") == 1), F.col("hour")),
                   boundary_diff("hour", first, F.col("hour")) + 1).alias("evt_hours_since_last"),
        boundary_diff("day", first, F.col("hour")).alias("unit_age_days"),
        *[s("had_evt", n).alias(f"recent_evt_hours_{n}h") for n in (6, 12)],
        s("had_check", 24).alias("recent_check_hours_24h"),
        *[s("had_check", n).alias(f"check_hours_{n}h") for n in (168, 720)],
    )
    by_object = stored(group_hours(t, blink))
    by_complex = by_object.join(t.object_complex, "object_id").groupBy("complex_id", "hour").agg(*[
        F.sum(m).alias(m) for m in GROUP_MEASURES])
    # Stored, so that their size is known: the wide hours of units are shuffled to them only where they are large.
    objects = stored(group_rolled(by_object, t.unit, "object_id", "_o_"))
    complexes = stored(group_rolled(by_complex, t.unit.join(t.object_complex, "object_id"), "complex_id", "_c_"))
    about = t.unit.select(*KEY, "hour_to").join(t.unit_meta, list(KEY)).join(t.object_complex, "object_id")
    joined = (
        unit.join(about, list(KEY))
        .filter((F.col("_rows") == horizon)
                & (F.col("hour") + F.expr(f"INTERVAL {horizon - 1} HOURS") <= F.col("hour_to")))
        .join(objects, ["object_id", "hour"], "left").join(complexes, ["complex_id", "hour"], "left")
        .join(stored(weather_rolled(t.weather)), "hour", "left")
        .withColumn("day", F.to_date("hour")).join(F.broadcast(t.calendar), "day")
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    pumps = F.greatest(F.col("n_pumps"), F.lit(1))
    own = {"chg_24h": "pump_changes_24h", "blink_24h": "pump_blink_hours_24h", "on_min_24h": "_on_24",
           "unavail_24h": "pump_unavailable_24h", "allp_24h": "pump_all_running_24h",
           "m_evt_24h": "_m_24", "m_evt_168h": "evt_moments_168h"}
    ring = {"m_evt_24h": "obj_events_24h", "m_evt_168h": "obj_events_168h", "chg_24h": "obj_pump_changes_24h",
            "blink_24h": "obj_pump_blink_24h", "unavail_24h": "obj_pump_unavailable_24h",
            "allp_24h": "obj_pump_all_running_24h", "on_min_24h": "obj_pump_on_minutes_24h"}
    outer = {"m_evt_24h": "cx_events_24h", "m_evt_168h": "cx_events_168h", "blink_24h": "cx_pump_blink_24h",
             "unavail_24h": "cx_pump_unavailable_24h", "allp_168h": "cx_pump_all_running_168h"}
    weather = [f"weather_{c}" for c in ("precip_24h", "precip_72h", "precip_168h", "rain_72h", "snowfall_72h")]
    depth = ["weather_snow_depth_cm", "weather_melt_72h_cm"]
    return joined.fillna(0.0, [*weather, *depth]).select(
        *KEY, "hour", (F.col("_next") > 0).cast("int").alias("label"),
        (F.col("evt_hours_24h") > 0).cast("int").alias("naive"),
        *[c for c in unit.columns if not c.startswith("_") and c not in (*KEY, "hour")],
        (F.col("_on_24") / (60.0 * 24 * pumps)).alias("pump_on_share_24h"),
        (F.col("_on_168") / (60.0 * 168 * pumps)).alias("pump_on_share_168h"),
        pump_growth(F.col("_on_24"), F.col("_on_720")).alias("pump_on_growth_24_720"),
        (F.col("_on_6") / (60.0 * 6 * pumps)).alias("recent_pump_on_share_6h"),
        *[(z(f"_o_{m}") - F.col(own[m])).alias(n) for m, n in ring.items()],
        *[(z(f"_c_{m}") - z(f"_o_{m}")).alias(n) for m, n in outer.items()],
        F.col("n_pumps").alias("unit_pumps"), F.col("n_flood_sensors").alias("unit_flood_sensors"),
        *weather, "weather_temp_mean_24h", "weather_temp_max_72h", *depth,
        F.hour("hour").alias("cal_hour"), *[F.col(c).alias(f"cal_{c}") for c in (
            "season", "month", "day_of_year", "day_of_week", "is_day_off", "is_holiday", "day_off_chain")],
    )


def pump_growth(on_24: Column, on_720: Column) -> Column:
    """Minutes on per hour of the last day against the last 30 days."""
    return (on_24 / 24.0) / F.greatest(on_720 / 720.0, F.lit(0.1))


def midnight_rows(panel: DataFrame) -> DataFrame:
    """The model reads one point a day."""
    return panel.filter(F.hour("hour") == 0)
