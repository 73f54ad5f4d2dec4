"""Feature panels, look-back windows, run-time vectors."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from undercroft.functions.clock import shift
from undercroft.operators import evaluate as ev
from undercroft.operators import grids as gr
from undercroft.operators import intervals as iv
from undercroft.operators import journal as jr
from undercroft.plans import access, flood, vectors
from undercroft.queries.base import query
from undercroft.queries.intervals import ACC_WINDOWS_SQL, CUT_DAY_SQL, PUMP_HOUR_SQL, UNKNOWN_SQL, acc_windows, unknown
from undercroft.queries.journal import EVENT_SQL, flagged
from undercroft.queries.targets import LIFE_SQL, life
from undercroft.session import stored

# --- look-back windows over the seven-year grid ----------------------------------------

DENSE_SQL = f"SELECT unit_id, object_id, day, is_day_off, coalesce(m, 0) AS m, coalesce(ev, 0) AS ev FROM ({LIFE_SQL}) LEFT JOIN unit_event USING (unit_id, object_id, day)"


def dense(t):
    facts = t.unit_event.select("unit_id", "object_id", "day", "m", "ev")
    return life(t).join(facts, ["unit_id", "object_id", "day"], "left").fillna(0, ["m", "ev"])


def rng(n: int) -> str:
    return f"OVER (PARTITION BY unit_id ORDER BY day RANGE BETWEEN INTERVAL {n} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"


@query("rolling_sum", "unit_id:i day:D s1:i s7:i s30:i mean90:d max365:i", f"""
    SELECT unit_id, day, coalesce(sum(m) {rng(1)}, 0) AS s1, coalesce(sum(m) {rng(7)}, 0) AS s7, coalesce(sum(m) {rng(30)}, 0) AS s30, avg(m) {rng(90)} AS mean90, max(m) {rng(365)} AS max365 FROM ({DENSE_SQL})""")
def _(t):
    w = gr.Rolling(("unit_id",))
    z = lambda c: F.coalesce(c, F.lit(0))
    rows = w.top(dense(t).withColumn("_one", F.lit(1)), "m", 365, "max365")
    return w.cumulate(rows, "m", "_one").select("unit_id", "day", z(w.sum("m", 1)).alias("s1"), z(w.sum("m", 7)).alias("s7"), z(w.sum("m", 30)).alias("s30"),
                           w.mean_of("m", "_one", 90).alias("mean90"), "max365")


@query("since_last", "unit_id:i day:D since:i capped:i", f"""
    SELECT unit_id, day, coalesce(date_diff('day', last, day), date_diff('day', first, day) + 1) AS since, least(coalesce(date_diff('day', last, day), 3650), 3650) AS capped
    FROM (SELECT *, max(CASE WHEN ev = 1 THEN day END) OVER (PARTITION BY unit_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last, min(day) OVER (PARTITION BY unit_id) AS first FROM ({DENSE_SQL}))""")
def _(t):
    w = gr.Rolling(("unit_id",))
    last = w.last_where(F.col("ev") == 1)
    return dense(t).select("unit_id", "day", F.coalesce(gr.days_since(last), F.datediff("day", w.first()) + 1).alias("since"),
                           gr.days_since(last, cap=3650).alias("capped"))


@query("look_ahead_label", "unit_id:i day:D label:i rows_next:i", f"""
    SELECT unit_id, day, CASE WHEN sum(ev) OVER w > 0 THEN 1 ELSE 0 END AS label, count(*) OVER w AS rows_next FROM ({DENSE_SQL}) WINDOW w AS (PARTITION BY unit_id ORDER BY day ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)""")
def _(t):
    w = gr.Rolling(("unit_id",))
    return dense(t).select("unit_id", "day", (w.ahead_sum("ev", 24) > 0).cast("int").alias("label"), w.ahead_rows(24).alias("rows_next"))


@query("lag_lead", "unit_id:i day:D week_ago:i year_ago:i first:D", f"""
    SELECT unit_id, day, lag(ev, 7) OVER w AS week_ago, lag(ev, 364) OVER w AS year_ago, min(day) OVER (PARTITION BY unit_id) AS first FROM ({DENSE_SQL}) WINDOW w AS (PARTITION BY unit_id ORDER BY day)""")
def _(t):
    w = gr.Rolling(("unit_id",))
    return dense(t).select("unit_id", "day", w.lag("ev", 7).alias("week_ago"), w.lag("ev", 364).alias("year_ago"), w.first().alias("first"))


@query("trailing_sums", "day:D precip_3d_mm:d melt_3d_cm:d", """
    SELECT day, sum(precip_mm) OVER w AS precip_3d_mm, sum(melt_cm) OVER w AS melt_3d_cm FROM (SELECT *, snow_cm / 10 AS melt_cm FROM weather_daily) WINDOW w AS (ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def _(t):
    from undercroft.operators.labels import trailing_weather

    return trailing_weather(t.weather_daily.withColumn("melt_cm", F.col("snow_cm") / 10))


@query("rolling_median", "object_id:i hour:t v:d norm:d", """
    SELECT a.object_id, a.hour, a.v, (SELECT median(b.v) FROM (SELECT object_id, hour, max(value) AS v FROM journal WHERE event_type = 'purchase' GROUP BY 1, 2) b
        WHERE b.object_id = a.object_id AND b.hour >= a.hour - INTERVAL 10 DAY AND b.hour <= a.hour - INTERVAL 1 HOUR) AS norm
    FROM (SELECT object_id, hour, max(value) AS v FROM journal WHERE event_type = 'purchase' GROUP BY 1, 2) a""")
def _(t):
    hourly = t.journal.filter("event_type = 'purchase'").groupBy("object_id", "hour").agg(F.max("value").alias("v"))
    return gr.rolling_median(hourly, ("object_id",), "hour", "v", "norm", days=10)


@query("network_share", "day:D net_1d:d net_7d:d prev_years:d", f"""
    WITH nd AS (SELECT day, CAST(sum(ev) AS DOUBLE) AS ev, count(*) AS n FROM ({DENSE_SQL}) GROUP BY day)
    SELECT a.day, sum(ev) OVER (ORDER BY a.day ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) / sum(n) OVER (ORDER BY a.day ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS net_1d,
           sum(ev) OVER (ORDER BY a.day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) / sum(n) OVER (ORDER BY a.day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS net_7d, d.prev_years
    FROM nd a LEFT JOIN (SELECT x.day, sum(y.ev) / sum(y.n) AS prev_years FROM nd x JOIN nd y ON year(y.day) < year(x.day)
        AND least(abs(dayofyear(y.day) - dayofyear(x.day)), 365 - abs(dayofyear(y.day) - dayofyear(x.day))) <= 3 GROUP BY x.day) d ON d.day = a.day""")
def _(t):
    days = dense(t).groupBy("object_id", "day").agg(F.sum("ev").alias("ev"), F.count(F.lit(1)).alias("n"))
    got = access.network_days(days)
    return got.select("day", F.col("net_event_share_1d").alias("net_1d"), F.col("net_event_share_7d").alias("net_7d"),
                      F.col("date_event_share_prev_years").alias("prev_years"))


@query("decaying_memory", "unit_id:i day:D hawkes_tau0_5:d hawkes_tau30:d", f"""
    SELECT d.unit_id, d.day, coalesce(sum(exp(-date_diff('day', e.day, d.day) / 0.5)), 0) AS hawkes_tau0_5, coalesce(sum(exp(-date_diff('day', e.day, d.day) / 30.0)), 0) AS hawkes_tau30
    FROM (SELECT unit_id, day FROM ({DENSE_SQL})) d LEFT JOIN (SELECT unit_id, day FROM unit_event WHERE ev = 1) e ON e.unit_id = d.unit_id AND e.day < d.day GROUP BY 1, 2""")
def _(t):
    return gr.decaying_memory(dense(t), ("unit_id",), "ev", (0.5, 30))


@query("latest_per_key", "facility_id:i direction:s prediction_id:i", """
    SELECT facility_id, direction, arg_max(prediction_id, (computed_at, prediction_id)) AS prediction_id FROM card GROUP BY 1, 2""")
def _(t):
    from undercroft.plans.serving import latest_per_key

    ordered = t.card.select("facility_id", "direction", "prediction_id", F.struct("computed_at", "prediction_id").alias("o"))
    return latest_per_key(ordered, ("facility_id", "direction"), "o")


# --- first slice: journal to panel and rule point ---------------------------------------


def slice_panel(t):
    """Events of one month folded to hours, put on a day grid with look-back windows."""
    section = ("object_id", "gallery", "section")
    events = stored(flagged(t))
    armed = jr.hourly_rollup(events.filter("event"), section)
    lives = jr.unit_life(t.journal, t.moment.select("channel_id", *section), section)
    days = armed.groupBy(*section, F.to_date("hour").alias("day")).agg(F.sum("n_moments").alias("m"))
    grid = gr.dense_grid(lives, section).join(days, [*section, "day"], "left").fillna(0, ["m"])
    w = gr.Rolling(section)
    z = lambda c: F.coalesce(c, F.lit(0))
    rows = grid.withColumn("ev", (F.col("m") > 0).cast("int"))
    return w.cumulate(rows, "m", "ev").select(
        *section, "day", F.col("ev").alias("y"), z(w.sum("m", 1)).alias("n_1d"), z(w.sum("m", 7)).alias("n_7d"), z(w.sum("ev", 7)).alias("days_7d"),
        z(w.sum("ev", 30)).alias("days_30d"), F.coalesce(gr.days_since(w.last_where(F.col("ev") == 1)), F.datediff("day", w.first()) + 1).alias("since"),
    ).withColumn("naive", (F.col("n_1d") > 0).cast("int"))


SLICE_SQL = f"""
    WITH e AS (SELECT object_id, gallery, section, CAST(ts AS DATE) AS day, count(*) AS m FROM ({EVENT_SQL}) WHERE event GROUP BY 1, 2, 3, 4),
    u AS (SELECT object_id, gallery, section, min(lo) AS lo, max(hi) AS hi FROM (SELECT DISTINCT object_id, gallery, section, channel_id FROM moment) JOIN (SELECT channel_id, min(day) AS lo, max(day) AS hi FROM journal GROUP BY 1) USING (channel_id) GROUP BY 1, 2, 3),
    g AS (SELECT object_id, gallery, section, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM u),
    d AS (SELECT g.*, coalesce(m, 0) AS m, CASE WHEN m IS NULL THEN 0 ELSE 1 END AS ev FROM g LEFT JOIN e USING (object_id, gallery, section, day))
    SELECT object_id, gallery, section, day, ev AS y, coalesce(lag(m) OVER w, 0) AS n_1d, coalesce(sum(m) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) AS n_7d,
           coalesce(sum(ev) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) AS days_7d, coalesce(sum(ev) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 0) AS days_30d,
           coalesce(date_diff('day', max(CASE WHEN ev = 1 THEN day END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), day), date_diff('day', min(day) OVER (PARTITION BY object_id, gallery, section), day) + 1) AS since,
           CASE WHEN coalesce(lag(m) OVER w, 0) > 0 THEN 1 ELSE 0 END AS naive FROM d WINDOW w AS (PARTITION BY object_id, gallery, section ORDER BY day)"""


@query("access_slice", "object_id:i gallery:i section:i day:D y:i n_1d:i n_7d:i days_7d:i days_30d:i since:i naive:i", SLICE_SQL)
def _(t):
    return slice_panel(t)


@query("access_slice_point", "precision:d recall:d alerts:i hits:i", f"SELECT round(sum(naive * y) / sum(naive), 6) AS precision, round(sum(naive * y) / sum(y), 6) AS recall, sum(naive) AS alerts, sum(naive * y) AS hits FROM ({SLICE_SQL})")
def _(t):
    return ev.rule_point(slice_panel(t), F.col("naive") == 1)


# --- access panels ---------------------------------------------------------------------


def access_inputs(t):
    return access.AccessInputs(
        unit=t.acc_unit, alarm=t.acc_alarm, armed=t.acc_armed, disarm_window=acc_windows(t), guard_unknown=unknown(t), fault_day=t.acc_fault,
        access_chain=t.acc_chain, section_info=t.section_info, calendar=t.cal)


K = "object_id, gallery, section"
ACC_GRID_SQL = f"SELECT {K}, n_channels, CAST(unnest(generate_series(date_trunc('day', hour_from), date_trunc('day', hour_to), INTERVAL 1 DAY)) AS DATE) AS day FROM acc_unit"
ACC_DENSE_SQL = f"""
    SELECT g.{K.replace(', ', ', g.')}, g.day, g.n_channels, coalesce(a.m, 0) AS m_all, coalesce(a.night, 0) AS m_night, CASE WHEN a.m IS NULL THEN 0 ELSE 1 END AS had_alarm, coalesce(r.m, 0) AS m_armed,
           CASE WHEN r.m IS NULL THEN 0 ELSE 1 END AS had_armed, coalesce(w.disarm_hours, 0) AS disarm_hours, a.last AS last_all, r.last AS last_armed, coalesce(f.n_fault, 0) AS n_fault
    FROM ({ACC_GRID_SQL}) g
    LEFT JOIN (SELECT {K}, CAST(hour AS DATE) AS day, sum(n_moments) AS m, sum(CASE WHEN hour(hour) >= 22 OR hour(hour) < 6 THEN n_moments ELSE 0 END) AS night, max(hour) AS last FROM acc_alarm GROUP BY ALL) a USING ({K}, day)
    LEFT JOIN (SELECT {K}, CAST(hour AS DATE) AS day, sum(n_moments) AS m, max(hour) AS last FROM acc_armed GROUP BY ALL) r USING ({K}, day)
    LEFT JOIN ({CUT_DAY_SQL}) w ON w.object_id = g.object_id AND w.day = g.day LEFT JOIN acc_fault f USING ({K}, day)"""


def acc(n: int) -> str:
    return f"OVER (PARTITION BY {K} ORDER BY day RANGE BETWEEN INTERVAL {n} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"


def past(c: str, n: int) -> str:
    return f"coalesce(sum({c}) {acc(n)}, 0)"


BEFORE = f"OVER (PARTITION BY {K} ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
ACC_COLUMNS = {
    **{f"n_alarms_{n}d:i": past("m_all", n) for n in (1, 7, 30, 90, 365)}, **{f"n_armed_{n}d:i": past("m_armed", n) for n in (1, 7, 30, 90)},
    **{f"alarm_day_share_{n}d:d": f"{past('had_alarm', n)} / {n}.0" for n in (7, 30, 90, 365)}, "armed_day_share_30d:d": f"{past('had_armed', 30)} / 30.0",
    "trend_7_90:d": f"({past('had_alarm', 7)} / 7.0) / greatest({past('had_alarm', 90)} / 90.0, 0.001)",
    "days_since_last_alarm:i": f"coalesce(date_diff('day', max(CASE WHEN had_alarm = 1 THEN day END) {BEFORE}, day), date_diff('day', first, day) + 1)",
    "days_since_last_armed:i": f"coalesce(date_diff('day', max(CASE WHEN had_armed = 1 THEN day END) {BEFORE}, day), date_diff('day', first, day) + 1)",
    "hours_since_last_alarm:i": f"coalesce(date_diff('hour', max(last_all) {BEFORE}, CAST(day AS TIMESTAMP)), 24 * (date_diff('day', first, day) + 1))",
    "hours_since_last_armed:i": f"coalesce(date_diff('hour', max(last_armed) {BEFORE}, CAST(day AS TIMESTAMP)), 24 * (date_diff('day', first, day) + 1))",
    **{f"night_share_{n}d:d": f"{past('m_night', n)} / greatest({past('m_all', n)}, 1)" for n in (30, 365)},
    **{f"disarm_hours_{n}d:d": past("disarm_hours", n) for n in (1, 7)}, "disarm_share_30d:d": f"{past('disarm_hours', 30)} / 720.0",
    "armed_same_weekday_1w:i": f"coalesce(lag(had_armed, 7) OVER (PARTITION BY {K} ORDER BY day), 0)", "armed_same_day_1y:i": f"coalesce(lag(had_armed, 364) OVER (PARTITION BY {K} ORDER BY day), 0)",
    **{f"faults_{n}d:i": past("n_fault", n) for n in (1, 7, 30)}, "nb_events_1d:i": past("nb_ev", 1), "nb_events_7d:i": past("nb_ev", 7), "nb_alarms_7d:i": past("nb_m", 7),
    "unit_age_days:i": "date_diff('day', first, day)",
}
PASSPORT, CAL = access.PASSPORT, access.CALENDAR
ACC_SPEC = " ".join(ACC_COLUMNS) + " obj_alarms_1d:i obj_alarms_7d:i obj_units_alarmed_7d:i has_access_chain_1d:i is_disarmed_at_0:i hours_since_guard_change:i net_event_share_1d:d net_event_share_7d:d date_event_share_prev_years:d n_channels:i "
ACC_SPEC += " ".join(f"{c}:i" for c in (*PASSPORT, *CAL))
ACC_PANEL_SQL = f"""
    WITH dense AS ({ACC_DENSE_SQL}),
    near AS (SELECT a.{K.replace(', ', ', a.')}, a.day, sum(b.had_armed) AS nb_ev, sum(b.m_all) AS nb_m FROM dense a JOIN dense b ON b.object_id = a.object_id AND b.gallery = a.gallery AND b.day = a.day AND abs(b.section - a.section) = 1 GROUP BY ALL),
    d2 AS (SELECT dense.*, coalesce(nb_ev, 0) AS nb_ev, coalesce(nb_m, 0) AS nb_m, min(dense.day) OVER (PARTITION BY dense.object_id, dense.gallery, dense.section) AS first FROM dense LEFT JOIN near USING ({K}, day)),
    r AS (SELECT {K}, day, n_channels, had_armed AS label, {', '.join(f"{v} AS {n.split(':')[0]}" for n, v in ACC_COLUMNS.items())} FROM d2),
    od AS (SELECT object_id, day, sum(m_all) AS m, sum(had_alarm) AS u FROM dense GROUP BY 1, 2),
    obj AS (SELECT object_id, day, coalesce(sum(m) OVER (PARTITION BY object_id ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) AS obj_alarms_1d, coalesce(sum(m) OVER w, 0) AS obj_alarms_7d, coalesce(sum(u) OVER w, 0) AS obj_units_alarmed_7d
            FROM od WINDOW w AS (PARTITION BY object_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
    win AS ({ACC_WINDOWS_SQL}), change AS (SELECT object_id, t_from AS ts FROM win UNION SELECT object_id, t_to FROM win WHERE NOT open_end),
    gd AS (SELECT od.object_id, od.day, CASE WHEN od.object_id IN (SELECT object_id FROM win) THEN CAST(EXISTS (SELECT 1 FROM win w WHERE w.object_id = od.object_id AND w.t_from <= od.day AND w.t_to > od.day) AS INT) END AS is_disarmed_at_0,
           date_diff('hour', c.ts, CAST(od.day AS TIMESTAMP)) AS hours_since_guard_change FROM od ASOF LEFT JOIN change c ON c.object_id = od.object_id AND c.ts < od.day),
    nd AS (SELECT day, CAST(sum(had_armed) AS DOUBLE) AS ev, count(*) AS n FROM dense GROUP BY day),
    nt AS (SELECT day, sum(ev) OVER a / sum(n) OVER a AS net_event_share_1d, sum(ev) OVER b / sum(n) OVER b AS net_event_share_7d FROM nd
           WINDOW a AS (ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), b AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
    ny AS (SELECT x.day, sum(y.ev) / sum(y.n) AS date_event_share_prev_years FROM nd x JOIN nd y ON year(y.day) < year(x.day) AND least(abs(dayofyear(y.day) - dayofyear(x.day)), 365 - abs(dayofyear(y.day) - dayofyear(x.day))) <= 3 GROUP BY x.day),
    unk AS ({UNKNOWN_SQL})
    SELECT r.*, obj_alarms_1d, obj_alarms_7d, obj_units_alarmed_7d, CAST(EXISTS (SELECT 1 FROM acc_chain c WHERE c.object_id = r.object_id AND c.gallery = r.gallery AND c.section = r.section AND CAST(c.completed_ts AS DATE) = r.day - 1) AS INT) AS has_access_chain_1d,
           is_disarmed_at_0, hours_since_guard_change, net_event_share_1d, net_event_share_7d, date_event_share_prev_years, {', '.join(f's.{c}' for c in PASSPORT)}, {', '.join(f'cal.{c}' for c in CAL if c != 'is_long_weekend')},
           CASE WHEN day_off_chain >= 3 THEN 1 ELSE 0 END AS is_long_weekend, CASE WHEN n_armed_1d > 0 THEN 1 ELSE 0 END AS naive
    FROM r LEFT JOIN obj USING (object_id, day) LEFT JOIN gd USING (object_id, day) LEFT JOIN nt USING (day) LEFT JOIN ny USING (day) JOIN section_info s USING ({K}) JOIN cal USING (day)"""
UNKNOWN_DAY = "EXISTS (SELECT 1 FROM unk u WHERE u.object_id = p.object_id AND u.t_from < p.day + INTERVAL 1 DAY AND u.t_to > p.day)"


@query("access_daily", f"object_id:i gallery:i section:i day:D label:i naive:i {ACC_SPEC}",
       f"SELECT * FROM ({ACC_PANEL_SQL}) p WHERE NOT {UNKNOWN_DAY.replace('FROM unk', f'FROM ({UNKNOWN_SQL})')}")
def _(t):
    return access.access_daily(access_inputs(t))


@query("panel_stats", "rows:i positives:i base:d units:i day_from:s day_to:s naive_share:d", f"""
    SELECT count(*) AS rows, sum(label) AS positives, round(avg(label), 6) AS base, count(DISTINCT (object_id, gallery, section)) AS units, CAST(min(day) AS VARCHAR) AS day_from, CAST(max(day) AS VARCHAR) AS day_to,
           round(avg(naive), 6) AS naive_share FROM ({ACC_PANEL_SQL}) p WHERE NOT {UNKNOWN_DAY.replace('FROM unk', f'FROM ({UNKNOWN_SQL})')}""")
def _(t):
    return access.panel_stats(access.access_daily(access_inputs(t)))


ROLL_ACC_SQL = f"""
    WITH b AS (SELECT p.*, h AS as_of_hour, CAST(p.day AS TIMESTAMP) + h * INTERVAL 1 HOUR AS as_of FROM ({ACC_PANEL_SQL}) p CROSS JOIN (SELECT unnest([0, 6, 12, 18]) AS h)),
    unk AS ({UNKNOWN_SQL}), win AS ({ACC_WINDOWS_SQL}),
    c AS (SELECT b.object_id, b.gallery, b.section, b.as_of, count(r.hour) FILTER (r.hour >= b.as_of) AS nxt, count(r.hour) FILTER (r.hour < b.as_of) AS prv, coalesce(sum(r.n_moments) FILTER (r.hour >= b.as_of - INTERVAL 1 HOUR AND r.hour < b.as_of), 0) AS events_last_1h,
                 coalesce(sum(r.n_moments) FILTER (r.hour >= b.as_of - INTERVAL 6 HOUR AND r.hour < b.as_of), 0) AS events_last_6h
          FROM b LEFT JOIN acc_armed r ON r.object_id = b.object_id AND r.gallery = b.gallery AND r.section = b.section AND r.hour >= b.as_of - INTERVAL 24 HOUR AND r.hour < b.as_of + INTERVAL 24 HOUR GROUP BY 1, 2, 3, 4),
    a AS (SELECT b.object_id, b.gallery, b.section, b.as_of, coalesce(sum(r.n_moments) FILTER (r.hour >= b.as_of - INTERVAL 1 HOUR), 0) AS alarms_last_1h, coalesce(sum(r.n_moments), 0) AS alarms_last_6h
          FROM b LEFT JOIN acc_alarm r ON r.object_id = b.object_id AND r.gallery = b.gallery AND r.section = b.section AND r.hour >= b.as_of - INTERVAL 6 HOUR AND r.hour < b.as_of GROUP BY 1, 2, 3, 4)
    SELECT b.object_id, b.gallery, b.section, b.as_of, b.n_alarms_365d, CASE WHEN c.nxt > 0 THEN 1 ELSE 0 END AS label, CASE WHEN c.prv > 0 THEN 1 ELSE 0 END AS naive, events_last_1h, events_last_6h, alarms_last_1h, alarms_last_6h,
           CASE WHEN b.object_id IN (SELECT object_id FROM win) THEN CAST(EXISTS (SELECT 1 FROM win w WHERE w.object_id = b.object_id AND w.t_from <= b.as_of AND w.t_to > b.as_of) AS INT) END AS is_disarmed_at_t,
           coalesce(date_diff('hour', la.hour, b.as_of), 24 * (unit_age_days + 1) + as_of_hour) AS hours_since_last_alarm_t, coalesce(date_diff('hour', le.hour, b.as_of), 24 * (unit_age_days + 1) + as_of_hour) AS hours_since_last_event_t
    FROM b JOIN c USING ({K}, as_of) JOIN a USING ({K}, as_of) JOIN acc_unit u USING ({K})
    ASOF LEFT JOIN acc_alarm la ON la.object_id = b.object_id AND la.gallery = b.gallery AND la.section = b.section AND la.hour < b.as_of
    ASOF LEFT JOIN acc_armed le ON le.object_id = b.object_id AND le.gallery = b.gallery AND le.section = b.section AND le.hour < b.as_of
    WHERE b.as_of + INTERVAL 24 HOUR <= u.hour_to + INTERVAL 1 HOUR AND NOT EXISTS (SELECT 1 FROM unk x WHERE x.object_id = b.object_id AND x.t_from < b.as_of + INTERVAL 24 HOUR AND x.t_to > b.as_of)"""


@query("access_rolling", "object_id:i gallery:i section:i as_of:t n_alarms_365d:i label:i naive:i events_last_1h:i events_last_6h:i alarms_last_1h:i alarms_last_6h:i is_disarmed_at_t:i hours_since_last_alarm_t:i hours_since_last_event_t:i", ROLL_ACC_SQL)
def _(t):
    return access.access_rolling(access_inputs(t))


# --- flood panel ----------------------------------------------------------------------

P = "object_id, gallery, picket"


def flood_inputs(t, hours=None):
    chan = t.journal.groupBy("channel_id", "object_id", "complex_id", "gallery", "picket").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    pumps = (stored(iv.pump_hours(t.pump_rows)) if hours is None else hours).join(
        chan.select("channel_id", "object_id", "complex_id", "gallery", F.when(F.col("channel_id") % 11 != 0, F.col("picket")).alias("picket")), "channel_id")
    unit = chan.groupBy("object_id", "gallery", "picket").agg(
        F.min("lo").cast("timestamp").alias("hour_from"), shift(F.max("hi").cast("timestamp"), 23 * 3600).alias("hour_to"))
    meta = chan.groupBy("object_id", "gallery", "picket").agg(F.count_if(F.col("channel_id") % 11 != 0).alias("n_pumps"), F.count(F.lit(1)).alias("n_flood_sensors"))
    sig = lambda kind: t.journal.filter(F.col("event_type") == kind).groupBy("object_id", "gallery", "picket", "hour").agg(F.count(F.lit(1)).alias("n_moments"))
    return flood.FloodInputs(
        unit=unit, alarm=sig("error"), check_signal=sig("click"), pump=pumps, unit_meta=meta,
        object_complex=t.journal.select("object_id", "complex_id").distinct(), weather=t.weather_hour, calendar=t.cal)


FL_UNIT_SQL = f"SELECT {P}, CAST(min(day) AS TIMESTAMP) AS hour_from, CAST(max(day) AS TIMESTAMP) + INTERVAL 23 HOUR AS hour_to, count(DISTINCT CASE WHEN channel_id % 11 <> 0 THEN channel_id END) AS n_pumps, count(DISTINCT channel_id) AS n_flood_sensors FROM journal GROUP BY ALL"
FL_PUMP_SQL = f"SELECT p.*, c.object_id, c.complex_id, c.gallery, CASE WHEN channel_id % 11 <> 0 THEN c.picket END AS picket FROM ({PUMP_HOUR_SQL}) p JOIN (SELECT DISTINCT channel_id, object_id, complex_id, gallery, picket FROM journal) c USING (channel_id)"


def hrs(c: str, n: int, part: str = P) -> str:
    return f"coalesce(sum({c}) OVER (PARTITION BY {part} ORDER BY hour ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0)"


FL_OWN = {
    **{f"pump_changes_{n}h:i": hrs("chg", n) for n in (1, 6, 24)}, **{f"pump_blink_hours_{n}h:i": hrs("blink", n) for n in (24, 168)},
    "pump_on_share_24h:d": f"{hrs('on_min', 24)} / (60.0 * 24 * greatest(n_pumps, 1))", "pump_on_share_168h:d": f"{hrs('on_min', 168)} / (60.0 * 168 * greatest(n_pumps, 1))",
    "pump_on_growth_24_720:d": f"({hrs('on_min', 24)} / 24.0) / greatest({hrs('on_min', 720)} / 720.0, 0.1)", **{f"pump_unavailable_{n}h:i": hrs("unavail", n) for n in (24, 168)},
    **{f"pump_all_running_{n}h:i": hrs("allp", n) for n in (24, 168)}, **{f"evt_hours_{n}h:i": hrs("had_evt", n) for n in (24, 168, 720, 2160, 8760)}, "evt_moments_168h:i": hrs("m_evt", 168),
    "evt_hours_since_last:i": f"coalesce(date_diff('hour', max(CASE WHEN had_evt = 1 THEN hour END) OVER (PARTITION BY {P} ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), hour), date_diff('hour', hour_from, hour) + 1)",
    "unit_age_days:i": "date_diff('day', hour_from, hour)", "recent_evt_hours_6h:i": hrs("had_evt", 6), "recent_evt_hours_12h:i": hrs("had_evt", 12), "recent_check_hours_24h:i": hrs("had_check", 24),
    "recent_pump_on_share_6h:d": f"{hrs('on_min', 6)} / (60.0 * 6 * greatest(n_pumps, 1))", "check_hours_168h:i": hrs("had_check", 168), "check_hours_720h:i": hrs("had_check", 720),
}
FL_RING = {"events_24h": ("m_evt", 24), "events_168h": ("m_evt", 168), "pump_changes_24h": ("chg", 24), "pump_blink_24h": ("blink", 24), "pump_unavailable_24h": ("unavail", 24), "pump_all_running_24h": ("allp", 24), "pump_on_minutes_24h": ("on_min", 24)}
FL_CX = {"events_24h": ("m_evt", 24), "events_168h": ("m_evt", 168), "pump_blink_24h": ("blink", 24), "pump_unavailable_24h": ("unavail", 24), "pump_all_running_168h": ("allp", 168)}
FL_MEASURES = "m_evt chg blink on_min unavail allp".split()


def group_sql(key: str, source: str) -> str:
    cols = ", ".join(f"{hrs(m, n, key)} AS {m}_{n}" for m, n in {*FL_RING.values(), *FL_CX.values()})
    return f"""SELECT {key}, hour, {cols} FROM (SELECT g.{key}, g.hour, {', '.join(f'coalesce({m}, 0) AS {m}' for m in FL_MEASURES)} FROM (SELECT {key}, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour
        FROM (SELECT {key}, min(hour_from) AS lo, max(hour_to) AS hi FROM un GROUP BY 1)) g LEFT JOIN {source} s ON s.{key} = g.{key} AND s.hour = g.hour)"""


FLOOD_SPEC = " ".join(FL_OWN) + " " + " ".join(f"obj_{n}:{'d' if 'minutes' in n else 'i'}" for n in FL_RING) + " " + " ".join(f"cx_{n}:i" for n in FL_CX)
FLOOD_SPEC += " unit_pumps:i unit_flood_sensors:i weather_precip_24h:d weather_precip_72h:d weather_precip_168h:d weather_rain_72h:d weather_snowfall_72h:d weather_temp_mean_24h:d weather_temp_max_72h:d weather_snow_depth_cm:d weather_melt_72h_cm:d"
FLOOD_SPEC += " cal_hour:i cal_season:i cal_month:i cal_day_of_year:i cal_day_of_week:i cal_is_day_off:i cal_is_holiday:i cal_day_off_chain:i"
FLOOD_SQL = f"""
    WITH un AS (SELECT u.*, oc.complex_id FROM ({FL_UNIT_SQL}) u JOIN (SELECT DISTINCT object_id, complex_id FROM journal) oc USING (object_id)), pmp AS ({FL_PUMP_SQL}),
    alarm AS (SELECT {P}, hour, count(*) AS m_evt FROM journal WHERE event_type = 'error' GROUP BY ALL), chk AS (SELECT DISTINCT {P}, hour FROM journal WHERE event_type = 'click'),
    uh AS (SELECT g.*, coalesce(a.m_evt, 0) AS m_evt, CASE WHEN a.m_evt IS NULL THEN 0 ELSE 1 END AS had_evt, CASE WHEN c.hour IS NULL THEN 0 ELSE 1 END AS had_check, coalesce(p.chg, 0) AS chg, coalesce(p.blink, 0) AS blink, coalesce(p.on_min, 0) AS on_min,
                  coalesce(p.unavail, 0) AS unavail, coalesce(p.allp, 0) AS allp
           FROM (SELECT {P}, complex_id, hour_from, hour_to, n_pumps, n_flood_sensors, unnest(generate_series(hour_from, hour_to, INTERVAL 1 HOUR)) AS hour FROM un) g LEFT JOIN alarm a USING ({P}, hour) LEFT JOIN chk c USING ({P}, hour)
           LEFT JOIN (SELECT {P}, hour, sum(n_changes) AS chg, count(*) FILTER (n_changes > 1) AS blink, sum(on_minutes) AS on_min, sum(n_unavail) AS unavail, sum(n_all_pumps) AS allp FROM pmp WHERE picket IS NOT NULL GROUP BY ALL) p USING ({P}, hour)),
    own AS (SELECT {P}, complex_id, hour, hour_to, n_pumps AS unit_pumps, n_flood_sensors AS unit_flood_sensors, {', '.join(f"{v} AS {n.split(':')[0]}" for n, v in FL_OWN.items())}, {', '.join(f'{hrs(m, n)} AS own_{m}_{n}' for m, n in FL_RING.values())},
             sum(had_evt) OVER (PARTITION BY {P} ORDER BY hour ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS nxt FROM uh),
    oraw AS (SELECT object_id, complex_id, hour, {', '.join(f'sum({m}) AS {m}' for m in FL_MEASURES)} FROM (
       SELECT object_id, complex_id, hour, m_evt, 0 AS chg, 0 AS blink, 0 AS on_min, 0 AS unavail, 0 AS allp FROM uh WHERE had_evt = 1
       UNION ALL SELECT object_id, complex_id, hour, 0, n_changes, CASE WHEN n_changes > 1 THEN 1 ELSE 0 END, on_minutes, n_unavail, n_all_pumps FROM pmp) GROUP BY 1, 2, 3),
    craw AS (SELECT complex_id, hour, {', '.join(f'sum({m}) AS {m}' for m in FL_MEASURES)} FROM oraw GROUP BY 1, 2),
    o AS ({group_sql('object_id', 'oraw')}), c AS ({group_sql('complex_id', 'craw')}),
    w AS (SELECT hour, {', '.join(f'sum(precip) OVER (ORDER BY hour ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS p{n}' for n in (24, 72, 168))}, sum(rain) OVER w72 AS r72, sum(snowfall) OVER w72 AS s72, avg(temp) OVER w24 AS t24, max(temp) OVER w72 AS t72,
            lag(snow_depth, 1) OVER (ORDER BY hour) AS now, lag(snow_depth, 72) OVER (ORDER BY hour) AS ago FROM weather_hour
            WINDOW w24 AS (ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), w72 AS (ORDER BY hour ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING))
    SELECT own.*, CASE WHEN nxt > 0 THEN 1 ELSE 0 END AS label, CASE WHEN evt_hours_24h > 0 THEN 1 ELSE 0 END AS naive,
           {', '.join(f'coalesce(o.{m}_{n}, 0) - own_{m}_{n} AS obj_{k}' for k, (m, n) in FL_RING.items())}, {', '.join(f'coalesce(c.{m}_{n}, 0) - coalesce(o.{m}_{n}, 0) AS cx_{k}' for k, (m, n) in FL_CX.items())},
           coalesce(p24, 0) AS weather_precip_24h, coalesce(p72, 0) AS weather_precip_72h, coalesce(p168, 0) AS weather_precip_168h, coalesce(r72, 0) AS weather_rain_72h, coalesce(s72, 0) AS weather_snowfall_72h, t24 AS weather_temp_mean_24h, t72 AS weather_temp_max_72h,
           coalesce(now, 0) * 100 AS weather_snow_depth_cm, greatest(0, coalesce(ago, 0) - coalesce(now, 0)) * 100 AS weather_melt_72h_cm, hour(own.hour) AS cal_hour, season AS cal_season, month AS cal_month, day_of_year AS cal_day_of_year, day_of_week AS cal_day_of_week,
           is_day_off AS cal_is_day_off, is_holiday AS cal_is_holiday, day_off_chain AS cal_day_off_chain
    FROM own LEFT JOIN o ON o.object_id = own.object_id AND o.hour = own.hour LEFT JOIN c ON c.complex_id = own.complex_id AND c.hour = own.hour LEFT JOIN w ON w.hour = own.hour JOIN cal ON cal.day = CAST(own.hour AS DATE)
    WHERE own.hour + INTERVAL 23 HOUR <= own.hour_to"""


@query("flood_hourly", f"object_id:i gallery:i picket:i hour:t label:i naive:i {FLOOD_SPEC}", FLOOD_SQL)
def _(t):
    return flood.flood_hourly(flood_inputs(t), 1.0)


@query("level_minus_level", "object_id:i gallery:i picket:i hour:t obj_events_24h:i cx_events_24h:i obj_pump_on_minutes_24h:d", FLOOD_SQL)
def _(t):
    return flood.flood_hourly(flood_inputs(t), 1.0)


@query("weather_windows", "hour:t weather_precip_72h:d weather_temp_max_72h:d weather_melt_72h_cm:d", """
    SELECT hour, coalesce(sum(precip) OVER w, 0) AS weather_precip_72h, max(temp) OVER w AS weather_temp_max_72h, greatest(0, coalesce(lag(snow_depth, 72) OVER (ORDER BY hour), 0) - coalesce(lag(snow_depth) OVER (ORDER BY hour), 0)) * 100 AS weather_melt_72h_cm
    FROM weather_hour WINDOW w AS (ORDER BY hour ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING)""")
def _(t):
    return flood.weather_rolled(t.weather_hour)


# --- vectors of one run -----------------------------------------------------------------

RUN = "2024-01-28 21:00:00"  # midnight of the network's clock
RUN_EVENTS = """
    SELECT channel_id % 60 AS facility_id, channel_id AS sensor_id, ts, CASE event_type WHEN 'error' THEN 'DOOR_OPEN' WHEN 'click' THEN 'MOTION' WHEN 'view' THEN 'SECURITY_ARMED' WHEN 'signup' THEN 'SECURITY_DISARMED' END AS code
    FROM journal WHERE event_type <> 'purchase'"""


def run_events(t, codes):
    code = F.lit(None).cast("string")
    for kind, c in codes.items():
        code = F.when(F.col("event_type") == kind, c).otherwise(code)
    return t.journal.select((F.col("channel_id") % 60).alias("facility_id"), F.col("channel_id").alias("sensor_id"), code.alias("code"), "ts").filter("code IS NOT NULL")


def run_units(t, modulo=60):
    ids = t.journal.select((F.col("channel_id") % modulo).alias("facility_id")).distinct()
    return ids.select("facility_id", (F.col("facility_id") % 10).alias("collector"), (F.col("facility_id") % 10 % 3).alias("district"))


A = "TIMESTAMP '2024-01-29 00:00:00'"
ACC_VECTOR_SQL = f"""
    WITH e AS (SELECT * FROM ({RUN_EVENTS}) WHERE ts < {A}), f AS (SELECT DISTINCT channel_id % 60 AS facility_id, channel_id % 60 % 10 AS collector FROM journal),
    g AS (SELECT DISTINCT facility_id, ts, code FROM e WHERE code LIKE 'SEC%'), st AS (SELECT *, lead(ts) OVER (PARTITION BY facility_id ORDER BY ts, code) AS nxt, lag(ts) OVER (PARTITION BY facility_id ORDER BY ts, code) AS bef
        FROM (SELECT *, lag(code) OVER (PARTITION BY facility_id ORDER BY ts, code) AS prev FROM g) WHERE prev IS NULL OR prev <> code),
    w AS (SELECT facility_id, ts AS a, nxt AS b FROM st WHERE code = 'SECURITY_DISARMED'),
    m AS (SELECT DISTINCT facility_id, sensor_id, ts, code FROM e WHERE code IN ('DOOR_OPEN', 'MOTION')),
    ar AS (SELECT *, sum(nw) OVER (PARTITION BY facility_id ORDER BY ts, sensor_id ROWS UNBOUNDED PRECEDING) AS inc FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY facility_id ORDER BY ts, sensor_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nw
        FROM m WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.facility_id = m.facility_id AND m.ts >= w.a AND (w.b IS NULL OR m.ts < w.b)))),
    ct AS (SELECT channel_id % 60 AS facility_id, count(DISTINCT channel_id) AS n FROM journal WHERE channel_id % 2 = 0 GROUP BY 1),
    ok AS (SELECT facility_id, inc FROM ar LEFT JOIN ct USING (facility_id) GROUP BY 1, 2 HAVING bool_or(code = 'DOOR_OPEN') OR count(DISTINCT CASE WHEN code = 'MOTION' THEN sensor_id END) >= 2 OR coalesce(max(n), 0) < 2),
    x AS (SELECT m.facility_id, m.ts, ok.inc IS NOT NULL AS ev, floor((epoch({A}) - epoch(m.ts) - 0.000001) / 86400) AS d FROM m LEFT JOIN ar ON ar.facility_id = m.facility_id AND ar.sensor_id = m.sensor_id AND ar.ts = m.ts AND ar.code = m.code
          LEFT JOIN ok ON ok.facility_id = ar.facility_id AND ok.inc = ar.inc),
    lf AS (SELECT f.*, least(coalesce((SELECT min(ts) FROM e WHERE e.facility_id = f.facility_id), {A}), {A}) AS life FROM f)
    SELECT lf.facility_id, floor((epoch({A}) - epoch(life)) / 86400) AS unit_age_days, (SELECT count(*) FROM x WHERE x.facility_id = lf.facility_id AND d < 7) AS n_alarms_7d, (SELECT count(*) FROM x WHERE x.facility_id = lf.facility_id AND d < 7 AND ev) AS n_armed_7d,
           (SELECT count(*) FROM x WHERE x.facility_id = lf.facility_id AND d < 90 AND ev) AS n_armed_90d, (SELECT count(DISTINCT d) FROM x WHERE x.facility_id = lf.facility_id AND d < 7) / 7.0 AS alarm_day_share_7d,
           (SELECT count(DISTINCT d) FROM x WHERE x.facility_id = lf.facility_id AND d < 365) / 365.0 AS alarm_day_share_365d, (SELECT count(DISTINCT d) FROM x WHERE x.facility_id = lf.facility_id AND d < 30 AND ev) / 30.0 AS armed_day_share_30d,
           coalesce((SELECT min(d) + 1 FROM x WHERE x.facility_id = lf.facility_id), floor((epoch({A}) - epoch(life)) / 86400) + 1) AS days_since_last_alarm, coalesce((SELECT min(d) + 1 FROM x WHERE x.facility_id = lf.facility_id AND ev), floor((epoch({A}) - epoch(life)) / 86400) + 1) AS days_since_last_armed,
           coalesce((SELECT date_diff('hour', max(ts), {A}) FROM x WHERE x.facility_id = lf.facility_id AND ev), 24 * (floor((epoch({A}) - epoch(life)) / 86400) + 1)) AS hours_since_last_armed,
           CASE WHEN EXISTS (SELECT 1 FROM x WHERE x.facility_id = lf.facility_id AND d = 6 AND ev) THEN 1 ELSE 0 END AS armed_same_weekday_1w,
           (SELECT count(*) FROM x JOIN f USING (facility_id) WHERE f.collector = lf.collector AND d < 1) AS obj_alarms_1d, (SELECT count(DISTINCT (facility_id, d)) FROM x JOIN f USING (facility_id) WHERE f.collector = lf.collector AND d < 7) AS obj_units_alarmed_7d,
           coalesce((SELECT sum(greatest(0, epoch(least(coalesce(b, {A}), {A})) - epoch(greatest(a, {A} - INTERVAL 7 DAY)))) / 3600 FROM w WHERE w.facility_id = lf.facility_id), 0) AS disarm_hours_7d,
           (SELECT date_diff('hour', max(ts), {A}) FROM st WHERE st.facility_id = lf.facility_id AND (code = 'SECURITY_DISARMED' OR bef IS NOT NULL)) AS hours_since_guard_change,
           (SELECT count(DISTINCT sensor_id) FROM e WHERE e.facility_id = lf.facility_id AND code IN ('DOOR_OPEN', 'MOTION')) AS n_channels,
           (SELECT count(DISTINCT (facility_id, d)) FROM x WHERE d < 7 AND ev) / (SELECT sum((SELECT count(*) FROM (SELECT unnest(generate_series(0, 6)) AS k) WHERE l2.life < {A} - k * INTERVAL 1 DAY)) FROM lf l2) AS net_event_share_7d,
           (SELECT count(*) FROM x JOIN f USING (facility_id) WHERE f.collector = lf.collector AND d < 7) AS obj_alarms_7d,
           coalesce((SELECT date_diff('hour', max(ts), {A}) FROM x WHERE x.facility_id = lf.facility_id), 24 * (floor((epoch({A}) - epoch(life)) / 86400) + 1)) AS hours_since_last_alarm,
           coalesce((SELECT sum(greatest(0, epoch(least(coalesce(b, {A}), {A})) - epoch(greatest(a, {A} - INTERVAL 30 DAY)))) / 3600 FROM w WHERE w.facility_id = lf.facility_id), 0) / 720.0 AS disarm_share_30d,
           (SELECT count(DISTINCT facility_id) FROM x WHERE d < 1 AND ev) / (SELECT count(*) FROM lf l2 WHERE l2.life < {A}) AS net_event_share_1d, CAST(NULL AS DOUBLE) AS date_event_share_prev_years,
           28 + 1 AS day_of_month, 0 AS day_of_week, 29 AS day_of_year, 5 AS week_of_year, 0 AS is_day_off, 0 AS day_off_chain
    FROM lf"""


@query("access_vector", "facility_id:i unit_age_days:i n_alarms_7d:i n_armed_7d:i n_armed_90d:i alarm_day_share_7d:d alarm_day_share_365d:d armed_day_share_30d:d days_since_last_alarm:i days_since_last_armed:i hours_since_last_armed:i armed_same_weekday_1w:i obj_alarms_1d:i obj_units_alarmed_7d:i disarm_hours_7d:d hours_since_guard_change:i n_channels:i net_event_share_7d:d obj_alarms_7d:i hours_since_last_alarm:i disarm_share_30d:d net_event_share_1d:d date_event_share_prev_years:d day_of_month:i day_of_week:i day_of_year:i week_of_year:i is_day_off:i day_off_chain:i", ACC_VECTOR_SQL)
def _(t):
    events = run_events(t, {"error": "DOOR_OPEN", "click": "MOTION", "view": "SECURITY_ARMED", "signup": "SECURITY_DISARMED"})
    sensors = t.journal.filter("channel_id % 2 = 0").select((F.col("channel_id") % 60).alias("facility_id"), F.col("channel_id").alias("sensor_id")).distinct().withColumn("sensor_type", F.lit("CONTACT"))
    return vectors.access_vector(events, run_units(t).withColumn("born", F.lit(None).cast("timestamp")), sensors, "2024-01-29 00:00:00")


NAMED = ("hours_since_guard_change", "disarm_hours_7d", "unit_age_days")


@query("access_vector_named", "facility_id:i hours_since_guard_change:i disarm_hours_7d:d unit_age_days:i", f"SELECT facility_id, {', '.join(NAMED)} FROM ({ACC_VECTOR_SQL})")
def _(t):
    """What a model of three features asks for: no moments, no objects, no network are made."""
    events = run_events(t, {"error": "DOOR_OPEN", "click": "MOTION", "view": "SECURITY_ARMED", "signup": "SECURITY_DISARMED"})
    units = run_units(t).withColumn("born", F.lit(None).cast("timestamp"))
    return vectors.access_vector(events, units, t.spark.createDataFrame([], "facility_id long, sensor_id long, sensor_type string"), "2024-01-29 00:00:00", NAMED)


WORK_SQL = f"""
    SELECT facility_id, CASE WHEN a < 24 AND a < lim THEN 'Выезд группы реагирования' WHEN l < 24 AND l < lim THEN 'Осмотр люка и запорного механизма' WHEN g > 168 AND g < lim THEN 'Проверка СКУД' ELSE 'Замена замка' END AS work_type
    FROM (SELECT facility_id, hours_since_last_armed AS a, days_since_last_alarm * 20 AS l, hours_since_guard_change * 12 AS g, 24 * (unit_age_days + 1) AS lim FROM ({ACC_VECTOR_SQL}))"""


@query("access_work_type", "facility_id:i work_type:s", WORK_SQL)
def _(t):
    events = run_events(t, {"error": "DOOR_OPEN", "click": "MOTION", "view": "SECURITY_ARMED", "signup": "SECURITY_DISARMED"})
    sensors = t.journal.filter("channel_id % 2 = 0").select((F.col("channel_id") % 60).alias("facility_id"), F.col("channel_id").alias("sensor_id")).distinct().withColumn("sensor_type", F.lit("CONTACT"))
    v = vectors.access_vector(events, run_units(t).withColumn("born", F.lit(None).cast("timestamp")), sensors, "2024-01-29 00:00:00")
    v = v.withColumn("hours_since_last_alarm", F.col("days_since_last_alarm") * 20).withColumn("hours_since_guard_change", F.col("hours_since_guard_change") * 12)
    return v.select("facility_id", vectors.access_work_type().alias("work_type"))


@query("flood_work_type", "work_type:s n:i", f"""
    SELECT CASE WHEN evt_hours_24h > 0 THEN 'Откачка воды' WHEN pump_blink_hours_24h > 0 OR pump_unavailable_24h > 0 THEN 'Проверка приямка и насоса' ELSE 'Гидроизоляция' END AS work_type, count(*) AS n
    FROM ({FLOOD_SQL}) WHERE hour(hour) = 0 GROUP BY 1""")
def _(t):
    rows = flood.midnight_rows(flood.flood_hourly(flood_inputs(t), 1.0))
    return rows.groupBy(vectors.flood_work_type().alias("work_type")).agg(F.count(F.lit(1)).alias("n"))


FLOOD_CODES = {"error": "FLOODED", "click": "PUMP_UNAVAILABLE", "view": "PUMP_OFF", "purchase": "PUMP_ON", "signup": "PUMP_ALL_RUNNING"}
R = f"TIMESTAMP '{RUN}'"
FL_VECTOR_SQL = f"""
    WITH e AS (SELECT channel_id % 60 AS facility_id, channel_id AS sensor_id, ts, event_type FROM journal WHERE ts < {R}), f AS (SELECT DISTINCT channel_id % 60 AS facility_id, channel_id % 60 % 10 AS collector, channel_id % 60 % 10 % 3 AS district FROM journal),
    l AS (SELECT *, date_trunc('hour', ts) AS h, (facility_id + day(CAST(ts + INTERVAL 3 HOUR AS DATE))) % 3 <> 0 AS water FROM e WHERE event_type = 'error' AND (facility_id + day(CAST(ts + INTERVAL 3 HOUR AS DATE))) % 5 <> 0),
    iv AS (SELECT facility_id, ts AS a, least(coalesce(nxt, ts + INTERVAL 24 HOUR), ts + INTERVAL 24 HOUR) AS b FROM (SELECT *, lead(ts) OVER (PARTITION BY facility_id, sensor_id ORDER BY ts, k) AS nxt FROM (SELECT DISTINCT facility_id, sensor_id, ts, CASE event_type WHEN 'view' THEN 'PUMP_OFF' ELSE 'PUMP_ON' END AS k
        FROM e WHERE event_type IN ('view', 'purchase') AND ts >= {R} - INTERVAL 744 HOUR)) WHERE k = 'PUMP_ON'),
    bl AS (SELECT facility_id, sensor_id, date_trunc('hour', ts) AS h FROM e WHERE event_type IN ('view', 'purchase') AND ts >= {R} - INTERVAL 168 HOUR GROUP BY 1, 2, 3 HAVING count(*) > 14),
    u AS (SELECT f.*, (SELECT count(DISTINCT h) FROM l WHERE l.facility_id = f.facility_id AND water AND ts >= {R} - INTERVAL 24 HOUR) AS evt_hours_24h, (SELECT count(DISTINCT h) FROM l WHERE l.facility_id = f.facility_id AND water) AS evt_hours_8760h,
        (SELECT count(DISTINCT h) FROM l WHERE l.facility_id = f.facility_id AND NOT water AND ts >= {R} - INTERVAL 168 HOUR) AS check_hours_168h, (SELECT count(DISTINCT (sensor_id, ts)) FROM l WHERE l.facility_id = f.facility_id AND water AND ts >= {R} - INTERVAL 24 HOUR) AS m24,
        (SELECT count(DISTINCT (sensor_id, ts)) FROM l WHERE l.facility_id = f.facility_id AND water AND ts >= {R} - INTERVAL 168 HOUR) AS m168, (SELECT count(*) FROM e WHERE e.facility_id = f.facility_id AND event_type IN ('view', 'purchase') AND ts >= {R} - INTERVAL 24 HOUR) AS c24,
        (SELECT count(DISTINCT (sensor_id, ts)) FROM e WHERE e.facility_id = f.facility_id AND event_type = 'click' AND ts >= {R} - INTERVAL 168 HOUR) AS u168, (SELECT count(DISTINCT (sensor_id, ts)) FROM e WHERE e.facility_id = f.facility_id AND event_type = 'signup' AND ts >= {R} - INTERVAL 168 HOUR) AS a168,
        coalesce((SELECT sum(greatest(0, epoch(least(b, {R})) - epoch(greatest(a, {R} - INTERVAL 24 HOUR)))) / 60 FROM iv WHERE iv.facility_id = f.facility_id), 0) AS on24, coalesce((SELECT sum(greatest(0, epoch(least(b, {R})) - epoch(greatest(a, {R} - INTERVAL 720 HOUR)))) / 60 FROM iv WHERE iv.facility_id = f.facility_id), 0) AS on720,
        (SELECT count(*) FROM bl WHERE bl.facility_id = f.facility_id) AS blink168, (SELECT count(DISTINCT channel_id) FROM journal WHERE channel_id % 60 = f.facility_id) AS pumps,
        (SELECT max(ts) FROM l WHERE l.facility_id = f.facility_id AND water) AS lastw, (SELECT min(ts) FROM e WHERE e.facility_id = f.facility_id) AS firstw FROM f)
    SELECT facility_id, c24 AS pump_changes_24h, blink168 AS pump_blink_hours_168h, on24 / (60.0 * 24 * greatest(pumps, 1)) AS pump_on_share_24h, (on24 / 24.0) / greatest(on720 / 720.0, 0.1) AS pump_on_growth_24_720, u168 AS pump_unavailable_168h, a168 AS pump_all_running_168h,
        evt_hours_24h, evt_hours_8760h, m168 AS evt_moments_168h, coalesce(floor((epoch({R}) - epoch(date_trunc('hour', lastw))) / 3600), floor((epoch({R}) - epoch(date_trunc('hour', firstw))) / 3600) + 1) AS evt_hours_since_last,
        (SELECT sum(m24) FROM u o WHERE o.collector = u.collector) - m24 AS obj_events_24h, (SELECT sum(on24) FROM u o WHERE o.collector = u.collector) - on24 AS obj_pump_on_minutes_24h,
        (SELECT sum(m168) FROM u o WHERE o.district = u.district) - (SELECT sum(m168) FROM u o WHERE o.collector = u.collector) AS cx_events_168h, pumps AS unit_pumps, check_hours_168h,
        date_diff('day', date_trunc('hour', firstw) + INTERVAL 3 HOUR, DATE '2024-01-29') AS unit_age_days,
        (SELECT coalesce(sum(precip), 0) FROM weather_hour WHERE hour < {R} AND hour >= {R} - INTERVAL 72 HOUR) AS weather_precip_72h, (SELECT avg(temp) FROM weather_hour WHERE hour < {R} AND hour >= {R} - INTERVAL 24 HOUR) AS weather_temp_mean_24h,
        (SELECT greatest(0, coalesce(max(snow_depth) FILTER (hour = {R} - INTERVAL 72 HOUR), 0) - coalesce(max(snow_depth) FILTER (hour = {R} - INTERVAL 1 HOUR), 0)) * 100 FROM weather_hour) AS weather_melt_72h_cm, 1 AS cal_month, 0 AS cal_day_of_week
    FROM u"""


@query("flood_vector", "facility_id:i pump_changes_24h:i pump_blink_hours_168h:i pump_on_share_24h:d pump_on_growth_24_720:d pump_unavailable_168h:i pump_all_running_168h:i evt_hours_24h:i evt_hours_8760h:i evt_moments_168h:i evt_hours_since_last:i obj_events_24h:i obj_pump_on_minutes_24h:d cx_events_168h:i unit_pumps:i check_hours_168h:i unit_age_days:i weather_precip_72h:d weather_temp_mean_24h:d weather_melt_72h_cm:d cal_month:i cal_day_of_week:i", FL_VECTOR_SQL)
def _(t):
    events = run_events(t, FLOOD_CODES)
    sensors = events.select("facility_id", "sensor_id").distinct().withColumn("sensor_type", F.lit("PUMP"))
    day = F.to_date(shift("ts", 3 * 3600))
    k = F.col("facility_id") + F.dayofmonth("day")
    water = t.journal.select((F.col("channel_id") % 60).alias("facility_id"), day.alias("day")).distinct().filter(k % 5 != 0).withColumn("is_water", k % 3 != 0)
    return vectors.flood_vector(events, run_units(t), sensors, water, t.weather_hour, "2024-01-29 10:00:00")


EVT_CHAR = "SELECT unit_id, day, CAST(day AS TIMESTAMP) + (unit_id % 24) * INTERVAL 1 HOUR + (m * 7) * INTERVAL 1 MINUTE AS moment FROM unit_event WHERE ev = 1"


@query("event_character", "unit_id:i moment:t char_burstiness:d char_memory:d char_rayleigh:d char_hour_cos:d char_hour_sin:d char_hour_entropy:d", f"""
    WITH f AS (SELECT *, lag(g) OVER (PARTITION BY unit_id ORDER BY moment) AS pg FROM (SELECT *, epoch(moment - lag(moment) OVER (PARTITION BY unit_id ORDER BY moment)) / 86400.0 AS g, hour(moment) + minute(moment) / 60.0 AS h FROM ({EVT_CHAR}))),
    c AS (SELECT f.unit_id, f.moment, count(*) AS n, count(p.g) AS ng, avg(p.g) AS mu, count(p.pg) AS np, avg(p.g * p.pg) AS xy, avg(CASE WHEN p.pg IS NOT NULL THEN p.g END) AS y1, avg(p.pg) AS x1, avg(CASE WHEN p.pg IS NOT NULL THEN p.g * p.g END) AS y2, avg(p.pg * p.pg) AS x2, sum(coalesce(p.g, 0) * coalesce(p.g, 0)) AS g2, sum(cos(2 * {math.pi} * p.h / 24)) AS cs, sum(sin(2 * {math.pi} * p.h / 24)) AS sn,
                 {', '.join(f'count(*) FILTER (floor(p.h / 4) = {i}) AS b{i}' for i in range(6))} FROM f JOIN f p ON p.unit_id = f.unit_id AND p.moment <= f.moment GROUP BY 1, 2)
    SELECT unit_id, moment, CASE WHEN ng >= 2 THEN (sd - mu) / (sd + mu) END AS char_burstiness, CASE WHEN np >= 3 AND (x2 - x1 * x1) * (y2 - y1 * y1) > 0 THEN (xy - x1 * y1) / sqrt((x2 - x1 * x1) * (y2 - y1 * y1)) END AS char_memory,
           sqrt(cs * cs + sn * sn) / n AS char_rayleigh, cs / n AS char_hour_cos, sn / n AS char_hour_sin, -({' + '.join(f'CASE WHEN b{i} > 0 THEN (b{i} / n) * ln(b{i} / n) ELSE 0 END' for i in range(6))}) AS char_hour_entropy
    FROM (SELECT *, sqrt(greatest(g2 / greatest(ng, 1) - mu * mu, 0)) AS sd FROM c)""")
def _(t):
    from undercroft.plans.hypotheses import event_character

    return event_character(char_events(t), ("unit_id",))


def char_events(t):
    at = F.timestamp_micros(F.unix_micros(F.col("day").cast("timestamp")) + (F.col("unit_id") % 24 * 3600 + F.col("m") * 420) * 1_000_000)
    return t.unit_event.filter("ev = 1").select("unit_id", "day", at.alias("moment"))


@query("merge_asof_character", "unit_id:i day:D last:t", f"""
    SELECT d.unit_id, d.day, e.moment AS last FROM (SELECT unit_id, day FROM unit_event) d ASOF LEFT JOIN ({EVT_CHAR}) e ON e.unit_id = d.unit_id AND e.moment < d.day""")
def _(t):
    from undercroft.operators.ordered import asof_last

    days = t.unit_event.select("unit_id", "day").withColumn("at", F.col("day").cast("timestamp"))
    return asof_last(days, char_events(t), ("unit_id",), "at", "moment", {"last": F.col("moment")})


@query("kp_features", "day:D space_kp_max_1d:d space_kp_mean_1d:d space_storm_1d:d space_kp_max_3d:d", """
    WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, max(o_custkey % 9) AS mx, avg(o_custkey % 9) AS mean FROM orders GROUP BY 1)
    SELECT day, lag(mx) OVER w AS space_kp_max_1d, lag(mean) OVER w AS space_kp_mean_1d, CASE WHEN lag(mx) OVER w >= 5 THEN 1 ELSE 0 END AS space_storm_1d,
           CASE WHEN count(*) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3 THEN max(mx) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS space_kp_max_3d FROM d WINDOW w AS (ORDER BY day)""")
def _(t):
    from undercroft.plans.hypotheses import kp_features

    return kp_features(t.orders.select(F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 9).cast("double").alias("kp")))


@query("hypothesis_features", "unit_id:i day:D hawkes_tau7:d char_rayleigh:d space_kp_max_1d:d moon_cos:d", f"""
    WITH kp AS (SELECT CAST(o_orderdate AS DATE) AS day, max(o_custkey % 9) AS mx FROM orders GROUP BY 1), sp AS (SELECT day, lag(mx) OVER (ORDER BY day) AS space_kp_max_1d FROM kp),
    ch AS (SELECT f.unit_id, f.moment, sqrt(pow(sum(cos(2 * {math.pi} * p.h / 24)), 2) + pow(sum(sin(2 * {math.pi} * p.h / 24)), 2)) / count(*) AS r FROM (SELECT *, hour(moment) + minute(moment) / 60.0 AS h FROM ({EVT_CHAR})) f
           JOIN (SELECT *, hour(moment) + minute(moment) / 60.0 AS h FROM ({EVT_CHAR})) p ON p.unit_id = f.unit_id AND p.moment <= f.moment GROUP BY 1, 2),
    hk AS (SELECT d.unit_id, d.day, coalesce(sum(exp(-date_diff('day', e.day, d.day) / 7.0)), 0) AS h FROM (SELECT unit_id, day FROM ({DENSE_SQL})) d LEFT JOIN (SELECT unit_id, day FROM unit_event WHERE ev = 1) e ON e.unit_id = d.unit_id AND e.day < d.day GROUP BY 1, 2)
    SELECT hk.unit_id, hk.day, hk.h AS hawkes_tau7, ch.r AS char_rayleigh, sp.space_kp_max_1d, cos(2 * {math.pi} * (x - floor(x))) AS moon_cos
    FROM (SELECT *, epoch(CAST(day AS TIMESTAMP) - TIMESTAMP '2000-01-06 18:14:00') / 86400.0 / 29.530588853 AS x FROM hk) hk LEFT JOIN sp ON sp.day = hk.day ASOF LEFT JOIN ch ON ch.unit_id = hk.unit_id AND ch.moment < hk.day""")
def _(t):
    from undercroft.plans.hypotheses import add_hypotheses

    kp = t.orders.select(F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 9).cast("double").alias("kp"))
    panel = dense(t).select("unit_id", "day", F.col("ev").alias("label"))
    return add_hypotheses(panel, ("unit_id",), char_events(t).drop("day"), kp, taus=(7,))
