"""Rows at or after the point of calculation may change the label and nothing else."""

import datetime as dt

from undercroft.functions.calendar import calendar
from undercroft.plans import access, fire, flood

POINT = dt.datetime(2024, 3, 1)
H, D = dt.timedelta(hours=1), dt.timedelta(days=1)


def differing(a, b):
    return {c for c in a.asDict() if a[c] != b[c]}


def access_tables(spark, future):
    at = [POINT - 10 * D + 5 * H, POINT - 5 * D + 23 * H, POINT - D + 4 * H]
    extra = [POINT, POINT + 3 * H, POINT + 13 * H] if future else []
    hours = [(1, -1, 2, h, 3, 2, 1) for h in at + extra]
    roll = "object_id long, gallery long, section long, hour timestamp, n_alarms long, n_moments long, n_channels long"
    windows = [(1, POINT - 3 * D, POINT - 2 * D, False)] + ([(1, POINT + 2 * H, POINT + 5 * H, False)] if future else [])
    chains = [(1, -1, 2, POINT - 6 * H)] + ([(1, -1, 2, POINT + H)] if future else [])
    faults = [(1, -1, 2, (POINT - 4 * D).date(), 2, 1)] + ([(1, -1, 2, POINT.date(), 5, 1)] if future else [])
    f = spark.createDataFrame
    return access.AccessInputs(
        unit=f([(1, -1, 2, dt.datetime(2023, 1, 1), dt.datetime(2024, 3, 31, 23), 4), (1, -1, 3, dt.datetime(2023, 1, 1), dt.datetime(2024, 3, 31, 23), 2)],
               "object_id long, gallery long, section long, hour_from timestamp, hour_to timestamp, n_channels int"),
        alarm=f(hours, roll), armed=f(hours, roll), disarm_window=f(windows, "object_id long, t_from timestamp, t_to timestamp, open_end boolean"),
        guard_unknown=f([(1, POINT - 90 * D, POINT - 80 * D)], "object_id long, t_from timestamp, t_to timestamp"),
        fault_day=f(faults, "object_id long, gallery long, section long, day date, n_fault long, n_fault_channels long"),
        access_chain=f(chains, "object_id long, gallery long, section long, completed_ts timestamp"),
        section_info=f([(1, -1, s, 0, 0, 3, 2, 1, 0, 1, 0) for s in (2, 3)], "object_id long, gallery long, section long, " + ", ".join(f"{c} long" for c in access.PASSPORT)),
        calendar=calendar(spark, "2022-01-01", "2024-12-31"))


def test_access_daily(spark):
    rows = [access.access_daily(access_tables(spark, future)).filter("day = DATE '2024-03-01' AND section = 2").collect()[0] for future in (False, True)]
    assert differing(*rows) == {"label"} and (rows[0].label, rows[1].label) == (0, 1)
    r = rows[0]
    assert (r.naive, r.n_alarms_1d, r.n_alarms_30d, r.days_since_last_alarm, r.hours_since_last_alarm, r.has_access_chain_1d) == (1, 2, 6, 1, 20, 1)
    assert (r.faults_7d, r.disarm_hours_7d, r.is_disarmed_at_0, r.hours_since_guard_change, r.night_share_30d) == (2, 24.0, 0, 48, 1.0)
    other = access.access_daily(access_tables(spark, False)).filter("day = DATE '2024-03-01' AND section = 3").collect()[0]
    assert (other.nb_events_1d, other.nb_alarms_7d, other.n_alarms_365d) == (1, 4, 0)


def test_access_rolling(spark):
    rows = [access.access_rolling(access_tables(spark, future)).filter("as_of = TIMESTAMP '2024-02-29 12:00:00' AND section = 2").collect()[0] for future in (False, True)]
    assert differing(*rows) == {"label"} and rows[1].label == 1 and rows[0].label == 0
    assert rows[0].naive == 1 and rows[0].hours_since_last_alarm_t == 8 and rows[0].alarms_last_6h == 0


def flood_tables(spark, future):
    f = spark.createDataFrame
    life = (POINT - 40 * D, POINT + 3 * D)
    extra = [POINT, POINT + 2 * H] if future else []
    key = "object_id long, gallery long, picket long"
    sig = lambda hs: f([(1, -1, 5, h, 2) for h in hs], f"{key}, hour timestamp, n_moments long")
    pumps = [(9, 1, -1, 5, POINT - 2 * H), (12, 2, -1, None, POINT - 3 * H)] + [(9, 1, -1, 5, h) for h in extra]
    return flood.FloodInputs(
        unit=f([(1, -1, 5, *life), (1, -1, 6, *life), (2, -1, 7, *life)], f"{key}, hour_from timestamp, hour_to timestamp"),
        alarm=sig([POINT - 5 * H, POINT - 3 * D, *extra]), check_signal=sig([POINT - 8 * D, *extra]),
        pump=f([(*p, 20, 30.0, 1, 1, 0) for p in pumps], "channel_id long, object_id long, gallery long, picket long, hour timestamp, n_changes long, on_minutes double, n_unavail long, n_all_pumps long, n_flooded long"),
        unit_meta=f([(1, -1, 5, 1, 1), (1, -1, 6, 0, 1), (2, -1, 7, 1, 0)], f"{key}, n_pumps int, n_flood_sensors int"),
        object_complex=f([(1, 100), (2, 100)], "object_id long, complex_id long"),
        weather=f([(POINT - i * H, 1.0 + (50 if i <= 0 and future else 0), 1.0, 0.0, 3.0, 0.1) for i in range(200, -30, -1)], "hour timestamp, precip double, rain double, snowfall double, temp double, snow_depth double"),
        calendar=calendar(spark, "2023-01-01", "2024-12-31"))


def test_flood_hourly(spark):
    rows = [flood.flood_hourly(flood_tables(spark, future), 14).filter("hour = TIMESTAMP '2024-03-01 00:00:00' AND picket = 5").collect()[0] for future in (False, True)]
    assert differing(*rows) == {"label"} and (rows[0].label, rows[1].label) == (0, 1)
    r = rows[0]
    assert (r.naive, r.evt_hours_24h, r.evt_hours_168h, r.check_hours_720h, r.pump_blink_hours_24h, r.evt_hours_since_last) == (1, 1, 2, 1, 1, 5)
    assert (r.cx_pump_unavailable_24h, r.obj_pump_changes_24h, r.weather_precip_24h) == (1, 0, 24.0)
    beside = flood.flood_hourly(flood_tables(spark, False), 14).filter("hour = TIMESTAMP '2024-03-01 00:00:00' AND picket = 6").collect()[0]
    assert (beside.obj_events_24h, beside.obj_pump_on_minutes_24h, beside.evt_hours_24h) == (2, 30.0, 0)


def fire_tables(spark, future):
    f = spark.createDataFrame
    key = "object_id long, gallery long, picket long"
    walk = [(1, -1, p, POINT - 2 * D + 10 * H + dt.timedelta(minutes=4 * p), p, "Датчик дыма") for p in (1, 2, 3, 4)]
    night = [(1, -1, 1, POINT - 30 * dt.timedelta(minutes=1), 1, "Датчик дыма")]
    after = [(1, -1, p, POINT + dt.timedelta(minutes=5 * p), p, "Тепловой датчик") for p in (1, 2, 3, 4)] + [(1, -1, 1, POINT + 9 * H, 1, "Датчик дыма")] if future else []
    days = [(POINT + i * D).date() for i in range(-60, 3)]
    pad = lambda v: 99.0 if future and v >= POINT.date() else 1.0
    wide = lambda names: f([(d, *[pad(d)] * len(names)) for d in days], "day date, " + ", ".join(f"{n} double" for n in names))
    external = wide(("wind_mean", "gust_max", "cloud_mean", "soil_temp", "pm25_mean", "pm25_max", "pm10_mean", "co_max")).selectExpr("*", "0 AS fireworks")
    return fire.FireInputs(
        unit=f([(1, -1, p, POINT - 50 * D, POINT + 2 * D, 1, 1, 0) for p in (1, 2, 3, 4)], f"{key}, hour_from timestamp, hour_to timestamp, n_smoke int, n_temp int, n_heat int"),
        alarm=f(walk + night + after, f"{key}, moment timestamp, channel_id long, stype string"),
        fault=f([(1, -1, 1, d, int(pad(d))) for d in days], f"{key}, day date, n long"), temp=f([(1, -1, 1, d, pad(d), pad(d)) for d in days], f"{key}, day date, t_max double, t_mean double"),
        objtemp=f([(1, d, pad(d)) for d in days], "object_id long, day date, obj_t_max double"),
        cxday=f([(100, d, *[int(pad(d))] * 4, pad(d), pad(d), *[int(pad(d))] * 3) for d in days], "complex_id long, day date, phase_off long, fan_off long, talk long, door long, gas_max double, gas_mean double, gas_mid long, gas_ge1 long, gas_ge1_off long"),
        object_complex=f([(1, 100)], "object_id long, complex_id long"), weather=wide(("temp_mean", "temp_max", "precip_mm")),
        humidity=wide(("rh_mean", "rh_max", "dew_mean", "pressure_change")), external=external, calendar=calendar(spark, "2023-01-01", "2024-12-31"))


def test_fire_daily(spark):
    rows = [fire.fire_daily(fire_tables(spark, future)).filter("day = DATE '2024-03-01' AND picket = 1").collect()[0] for future in (False, True)]
    assert differing(*rows) == {"label"} and (rows[0].label, rows[1].label) == (0, 1)
    r = rows[0]
    # The walk is a burst; the 23:30 signal stays an event although a walk begins after midnight.
    assert (r.naive, r.evt_days_7d, r.chk_days_30d, r.obj_walk_days_since, r.rec_to_midnight_1d, r.rec_smoke_1d, r.hw_faults_7d) == (1, 1, 1, 2, 30, 1, 7)
