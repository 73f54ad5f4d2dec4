"""Label statistics, rhythm, lifts, curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from undercroft.operators import targets as tg
from undercroft.operators.grids import dense_grid
from undercroft.queries.base import query
from undercroft.session import stored

UNIT = ("unit_id",)
UNITS_SQL = "SELECT unit_id, object_id, CAST(min(day) AS TIMESTAMP) AS hour_from, CAST(max(day) AS TIMESTAMP) + INTERVAL 23 HOUR AS hour_to FROM unit_event GROUP BY 1, 2"
ALARM_SQL = "SELECT DISTINCT channel_id AS unit_id, object_id, hour FROM long_rows WHERE l_quantity >= 42"
LIFE_SQL = f"""
    SELECT unit_id, object_id, day, is_day_off FROM (SELECT unit_id, object_id, CAST(unnest(generate_series(date_trunc('day', hour_from), date_trunc('day', hour_to), INTERVAL 1 DAY)) AS DATE) AS day FROM ({UNITS_SQL}))
    JOIN cal USING (day)"""


def units(t):
    return t.unit_event.groupBy("unit_id", "object_id").agg(
        F.min("day").cast("timestamp").alias("hour_from"),
        (F.max("day").cast("timestamp") + F.expr("INTERVAL 23 HOURS")).alias("hour_to"))


def alarm(t):
    rows = t.long_rows.filter("l_quantity >= 42")
    return rows.select(F.col("channel_id").alias("unit_id"), "object_id", "hour").distinct()


def life(t):
    return tg.life_days(units(t), ("unit_id", "object_id"), t.cal)


@query("target_stats_hourly", "cells:i positive:i predicted:i hit:i base_pct:d naive_precision_pct:d naive_recall_pct:d", f"""
    WITH p AS (SELECT DISTINCT unit_id, hour - i * INTERVAL 1 HOUR AS hour FROM ({ALARM_SQL}) CROSS JOIN (SELECT unnest(generate_series(1, 24)) AS i)),
    r AS (SELECT DISTINCT unit_id, hour + i * INTERVAL 1 HOUR AS hour FROM ({ALARM_SQL}) CROSS JOIN (SELECT unnest(generate_series(0, 23)) AS i)),
    pa AS (SELECT p.* FROM p JOIN ({UNITS_SQL}) u USING (unit_id) WHERE hour BETWEEN hour_from AND hour_to),
    ra AS (SELECT r.* FROM r JOIN ({UNITS_SQL}) u USING (unit_id) WHERE hour BETWEEN hour_from AND hour_to)
    SELECT cells, positive, predicted, hit, round(100.0 * positive / cells, 3) AS base_pct, round(100.0 * hit / predicted, 3) AS naive_precision_pct, round(100.0 * hit / positive, 3) AS naive_recall_pct
    FROM (SELECT (SELECT sum(date_diff('hour', hour_from, hour_to) + 1) FROM ({UNITS_SQL})) AS cells, (SELECT count(*) FROM pa) AS positive, (SELECT count(*) FROM ra) AS predicted,
                 (SELECT count(*) FROM (SELECT * FROM pa INTERSECT SELECT * FROM ra)) AS hit)""")
def _(t):
    return tg.target_stats_hourly(alarm(t), units(t), UNIT, 24)


@query("target_stats_daily", "cells:i positive:i repeated:i base_pct:d naive_precision_pct:d", f"""
    WITH e AS (SELECT DISTINCT unit_id, CAST(hour AS DATE) AS day FROM ({ALARM_SQL}))
    SELECT cells, positive, repeated, round(100.0 * positive / cells, 3) AS base_pct, round(100.0 * repeated / positive, 3) AS naive_precision_pct
    FROM (SELECT (SELECT sum(date_diff('day', hour_from, hour_to) + 1) FROM ({UNITS_SQL})) AS cells, (SELECT count(*) FROM e) AS positive,
                 (SELECT count(*) FROM e a WHERE EXISTS (SELECT 1 FROM e b WHERE b.unit_id = a.unit_id AND b.day = CAST(a.day + INTERVAL 1 DAY AS DATE))) AS repeated)""")
def _(t):
    return tg.target_stats_daily(alarm(t), units(t), UNIT)


SHARE_SQL = """
    SELECT g, n AS unit_days, round(100.0 * n / sum(n) OVER (), 1) AS share_pct FROM (SELECT {g} AS g, count(DISTINCT (unit_id, CAST(hour AS DATE))) AS n FROM ({src}) GROUP BY 1)"""


@query("share_by_value", "g:s unit_days:i share_pct:d", SHARE_SQL.format(
    g="l_returnflag", src="SELECT channel_id AS unit_id, hour, l_returnflag FROM long_rows WHERE l_quantity >= 42"))
def _(t):
    rows = t.long_rows.filter("l_quantity >= 42").withColumnRenamed("channel_id", "unit_id")
    return tg.share_by(rows, UNIT, "l_returnflag", "g")


@query("share_by_month", "g:i unit_days:i share_pct:d", SHARE_SQL.format(g="month(hour)", src=ALARM_SQL))
def _(t):
    return tg.share_by(alarm(t), UNIT, F.month("hour"), "g")


@query("top_object", "object_id:i unit_days:i share_pct:d", f"""
    SELECT object_id, n AS unit_days, round(100.0 * n / t, 1) AS share_pct FROM (SELECT object_id, count(*) AS n, sum(count(*)) OVER () AS t
      FROM (SELECT DISTINCT unit_id, object_id, CAST(hour AS DATE) AS day FROM ({ALARM_SQL})) GROUP BY object_id) ORDER BY n DESC, object_id LIMIT 1""")
def _(t):
    return tg.top_object(alarm(t), ("unit_id", "object_id"))


SPLITS = (("train", "1900-01-01", "1999-07-01"), ("valid", "1999-07-01", "2000-07-01"), ("test", "2000-07-01", "2100-01-01"))


@query("share_by_split", "split:s unit_days:i positive_days:i base_pct:d", f"""
    SELECT split, unit_days, positive_days, round(100.0 * positive_days / unit_days, 3) AS base_pct FROM (
      SELECT s.split, (SELECT sum(greatest(0, date_diff('day', greatest(CAST(hour_from AS DATE), s.lo), least(CAST(hour_to AS DATE), s.hi - 1)) + 1)) FROM ({UNITS_SQL})) AS unit_days,
             (SELECT count(DISTINCT (unit_id, CAST(hour AS DATE))) FROM ({ALARM_SQL}) WHERE hour >= s.lo AND hour < s.hi) AS positive_days
      FROM (SELECT 'train' AS split, DATE '1900-01-01' AS lo, DATE '1999-07-01' AS hi UNION ALL SELECT 'valid', DATE '1999-07-01', DATE '2000-07-01' UNION ALL SELECT 'test', DATE '2000-07-01', DATE '2100-01-01') s)""")
def _(t):
    return tg.share_by_split(alarm(t), units(t), UNIT, SPLITS)


@query("cover_lift", "obs_n:i obs_hit:i exp_n:i exp_hit:i observed_pct:d expected_pct:d lift:d", f"""
    WITH tgt AS (SELECT DISTINCT object_id, day FROM unit_event WHERE ev = 1), ab AS (SELECT DISTINCT object_id, day FROM long_rows WHERE l_quantity = 33),
    cov AS (SELECT DISTINCT object_id, CAST(day + i * INTERVAL 1 DAY AS DATE) AS day FROM ab CROSS JOIN (SELECT unnest(generate_series(-1, 1)) AS i)),
    alive AS (SELECT DISTINCT object_id, day FROM ({LIFE_SQL}) WHERE object_id IN (SELECT object_id FROM tgt))
    SELECT obs_n, obs_hit, exp_n, exp_hit, round(100.0 * obs_hit / obs_n, 2) AS observed_pct, round(100.0 * exp_hit / exp_n, 2) AS expected_pct,
           round((CAST(obs_hit AS DOUBLE) / obs_n) / (CAST(exp_hit AS DOUBLE) / exp_n), 2) AS lift
    FROM (SELECT (SELECT count(*) FROM tgt) AS obs_n, (SELECT count(*) FROM tgt JOIN cov USING (object_id, day)) AS obs_hit, (SELECT count(*) FROM alive) AS exp_n,
                 (SELECT count(*) FROM alive JOIN cov USING (object_id, day)) AS exp_hit)""")
def _(t):
    return tg.cover_lift(t.unit_event.filter("ev = 1"), t.long_rows.filter("l_quantity = 33"), life(t))


@query("label_version_stats", "version:s period:s unit_days:i events:i base:d naive_precision:d naive_recall:d week_rhythm:d", f"""
    WITH sig AS (SELECT channel_id AS unit_id, day, 1 AS raw, CASE WHEN is_day_off = 1 OR hour(hour) < 8 OR hour(hour) >= 16 THEN 1 ELSE 0 END AS off_window,
                        CASE WHEN is_day_off = 1 OR hour(hour) < 6 OR hour(hour) >= 22 THEN 1 ELSE 0 END AS off_hours FROM long_rows JOIN cal USING (day)),
    panel AS (SELECT l.unit_id, l.day, l.is_day_off, coalesce(max(raw), 0) AS raw, coalesce(max(off_window), 0) AS off_window, coalesce(max(off_hours), 0) AS off_hours
              FROM ({LIFE_SQL}) l LEFT JOIN sig USING (unit_id, day) GROUP BY 1, 2, 3),
    v AS (SELECT 'raw' AS version, unit_id, day, is_day_off, raw AS ev, 24.0 AS hw, 24.0 AS ho FROM panel UNION ALL SELECT 'off_window', unit_id, day, is_day_off, off_window, 16.0, 24.0 FROM panel
          UNION ALL SELECT 'off_hours', unit_id, day, is_day_off, off_hours, 8.0, 24.0 FROM panel),
    a AS (SELECT *, CASE WHEN lag(ev) OVER (PARTITION BY version, unit_id ORDER BY day) = 1 THEN 1 ELSE 0 END AS alert, CASE WHEN day < DATE '2000-07-01' THEN CAST(year(day) AS VARCHAR) ELSE 'holdout' END AS period FROM v)
    SELECT version, period, count(*) AS unit_days, sum(ev) AS events, round(sum(ev) / count(*), 6) AS base, CASE WHEN sum(alert) > 0 THEN round(sum(alert * ev) / sum(alert), 4) END AS naive_precision,
           CASE WHEN sum(ev) > 0 THEN round(sum(alert * ev) / sum(ev), 4) END AS naive_recall,
           CASE WHEN sum(ev) FILTER (is_day_off = 1) > 0 THEN round((sum(ev) FILTER (is_day_off = 0) / count(*) FILTER (is_day_off = 0) / max(hw)) / (sum(ev) FILTER (is_day_off = 1) / count(*) FILTER (is_day_off = 1) / max(ho)), 3) END AS week_rhythm
    FROM a GROUP BY version, period""")
def _(t):
    h = F.hour("hour")
    off = F.col("is_day_off") == 1
    sig = t.long_rows.withColumnRenamed("channel_id", "unit_id").join(F.broadcast(t.cal.select("day", "is_day_off")), "day").select(
        "unit_id", "day", F.lit(1).alias("raw"), (off | (h < 8) | (h >= 16)).cast("int").alias("off_window"),
        (off | (h < 6) | (h >= 22)).cast("int").alias("off_hours"))
    grid = life(t).drop("object_id")
    return tg.label_version_stats(sig, grid, UNIT, {"raw": (24, 24), "off_window": (16, 24), "off_hours": (8, 24)}, "2000-07-01")


@query("week_ratio", "work_rate:d off_rate:d ratio:d", f"""
    SELECT w AS work_rate, o AS off_rate, w / o AS ratio FROM (SELECT avg(CASE WHEN is_day_off = 0 THEN e END) AS w, avg(CASE WHEN is_day_off = 1 THEN e END) AS o
      FROM (SELECT l.is_day_off, CASE WHEN x.unit_id IS NULL THEN 0 ELSE 1 END AS e FROM ({LIFE_SQL}) l LEFT JOIN (SELECT unit_id, day FROM unit_event WHERE ev = 1) x USING (unit_id, day)))""")
def _(t):
    return tg.week_ratio(t.unit_event.filter("ev = 1"), life(t), UNIT)


WET_SQL = """
    SELECT day, coalesce(sum(precip_mm) OVER w >= 40 OR (sum(melt) OVER w >= 60 AND max(temp_max) OVER w > 25), false) AS wet
    FROM (SELECT *, greatest(0, lag(snow_cm) OVER (ORDER BY day) - snow_cm) AS melt FROM weather_daily) WINDOW w AS (ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""


def wet_days(t):
    from pyspark.sql import Window

    order = Window.orderBy("day")
    w = order.rowsBetween(-2, 0)
    d = t.weather_daily.withColumn("melt", F.greatest(F.lit(0.0), F.lag("snow_cm").over(order) - F.col("snow_cm")))
    wet = (F.sum("precip_mm").over(w) >= 40) | ((F.sum("melt").over(w) >= 60) & (F.max("temp_max").over(w) > 25))
    return d.select("day", F.coalesce(wet, F.lit(False)).alias("wet"))


HOURS_SQL = """
    SELECT channel_id AS unit_id, object_id, hour, day, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS from_sensor, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS from_pump,
           bool_or(is_day_off = 0 AND hour(hour) >= 8 AND hour(hour) < 16) AS in_work, bool_or(hour(hour) >= 22 OR hour(hour) < 6) AS at_night, bool_or(is_day_off = 1) AS day_off
    FROM long_rows JOIN cal USING (day) WHERE l_quantity >= 30 GROUP BY 1, 2, 3, 4"""
EP_SQL = f"""
    WITH d AS (SELECT unit_id, object_id, day, count(*) AS hrs, bool_and(in_work) AS work_only, max(from_sensor) AS any_sensor, max(from_pump) AS any_pump FROM ({HOURS_SQL}) GROUP BY 1, 2, 3)
    SELECT d.*, EXISTS (SELECT 1 FROM d n WHERE n.unit_id = d.unit_id AND abs(date_diff('day', n.day, d.day)) = 1) AS adjacent,
           EXISTS (SELECT 1 FROM d n WHERE n.object_id = d.object_id AND n.day = d.day AND n.unit_id <> d.unit_id) AS neighbour, CAST(hrs AS DOUBLE) / (1 + unit_id % 3) AS pump_ratio, hrs > 1 AND unit_id % 3 = 0 AS pump_busy FROM d"""
CRITERIA_SQL = (("C0_all", "TRUE", 24, 24), ("C1_off_window", "NOT in_work", 16, 24), ("C2_no_short_single", "NOT (work_only AND hrs <= 1 AND NOT adjacent)", 24, 24),
                ("C3_long", "hrs >= 2", 24, 24), ("C4_adjacent", "adjacent", 24, 24), ("C5_off_or_long", "NOT in_work OR hrs >= 3 OR adjacent", 24, 24),
                ("C6_confirmed", "neighbour OR (any_sensor = 1 AND any_pump = 1) OR pump_busy", 24, 24),
                ("C7_off_or_confirmed", "NOT in_work OR neighbour OR (any_sensor = 1 AND any_pump = 1) OR pump_busy", 24, 24),
                ("C8_off_and_long", "NOT in_work AND (hrs >= 2 OR adjacent)", 16, 24), ("C9_night", "at_night", 8, 8), ("C10_off_pump", "NOT in_work AND from_pump = 1", 16, 24))
SCREEN_SQL = " UNION ALL ".join(f"""
    SELECT '{n}' AS criterion, s.n AS positive_unit_days, s.tr AS positive_unit_days_train, round(s.top / s.n, 3) AS top_object_share, round(w / r, 3) AS workday_to_day_off,
           round((s.wet / l.wet) / (s.dry / l.dry), 3) AS weather_lift, round(s.pump, 2) AS pump_vs_normal, round(s.adj / s.n, 3) AS adjacent_share, round(h.h816 / (h.hw + h.ho), 3) AS share_8_16,
           CAST(s.tr >= 1000 AND s.top / s.n <= 0.5 AS INT) AS passes_volume, CAST(w / r BETWEEN 1 / 1.5 AND 1.5 AS INT) AS passes_week, CAST((s.wet / l.wet) / (s.dry / l.dry) > 1 AS INT) AS passes_weather
    FROM (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (day < DATE '1999-07-01') AS DOUBLE) AS tr, (SELECT CAST(max(k) AS DOUBLE) FROM (SELECT count(*) AS k FROM (SELECT DISTINCT unit_id, object_id, day FROM crit WHERE {c}) GROUP BY object_id)) AS top,
                 CAST(count(*) FILTER (wet) AS DOUBLE) AS wet, CAST(count(*) FILTER (NOT wet) AS DOUBLE) AS dry, avg(pump_ratio) AS pump, CAST(count(*) FILTER (adjacent) AS DOUBLE) AS adj
          FROM (SELECT DISTINCT unit_id, object_id, day, pump_ratio, adjacent, wet FROM crit WHERE {c})) s
    CROSS JOIN (SELECT CAST(count(*) FILTER (NOT day_off) AS DOUBLE) AS hw, CAST(count(*) FILTER (day_off) AS DOUBLE) AS ho, count(*) FILTER (hour(hour) >= 8 AND hour(hour) < 16) AS h816 FROM crit WHERE {c}) h
    CROSS JOIN lif l CROSS JOIN LATERAL (SELECT h.hw / (l.lw * {a}) AS w, h.ho / (l.lo * {b}) AS r)""" for n, c, a, b in CRITERIA_SQL)
CRIT_WITH = f"""
    WITH wet AS ({WET_SQL}), crit AS (SELECT h.*, e.hrs, e.work_only, e.any_sensor, e.any_pump, e.adjacent, e.neighbour, e.pump_ratio, e.pump_busy, wet.wet
      FROM ({HOURS_SQL}) h JOIN ({EP_SQL}) e USING (unit_id, object_id, day) LEFT JOIN wet ON wet.day = h.day),
    lif AS (SELECT count(*) FILTER (is_day_off = 0) AS lw, count(*) FILTER (is_day_off = 1) AS lo, count(*) FILTER (wet) AS wet, count(*) FILTER (NOT wet) AS dry FROM ({LIFE_SQL}) LEFT JOIN wet USING (day))"""


def criteria():
    f = F.col
    off, confirmed = ~f("in_work"), f("neighbour") | ((f("any_sensor") == 1) & (f("any_pump") == 1)) | f("pump_busy")
    return {
        "C0_all": (F.lit(True), 24, 24), "C1_off_window": (off, 16, 24),
        "C2_no_short_single": (~(f("work_only") & (f("hrs") <= 1) & ~f("adjacent")), 24, 24), "C3_long": (f("hrs") >= 2, 24, 24),
        "C4_adjacent": (f("adjacent"), 24, 24), "C5_off_or_long": (off | (f("hrs") >= 3) | f("adjacent"), 24, 24),
        "C6_confirmed": (confirmed, 24, 24), "C7_off_or_confirmed": (off | confirmed, 24, 24),
        "C8_off_and_long": (off & ((f("hrs") >= 2) | f("adjacent")), 16, 24), "C9_night": (f("at_night"), 8, 8),
        "C10_off_pump": (off & (f("from_pump") == 1), 16, 24)}


def screen(t):
    h = F.hour("hour")
    rows = t.long_rows.filter("l_quantity >= 30").join(F.broadcast(t.cal.select("day", "is_day_off")), "day")
    hours = rows.groupBy(F.col("channel_id").alias("unit_id"), "object_id", "hour", "day").agg(
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("from_sensor"), F.max((F.col("l_returnflag") == "A").cast("int")).alias("from_pump"),
        F.bool_or((F.col("is_day_off") == 0) & (h >= 8) & (h < 16)).alias("in_work"), F.bool_or((h >= 22) | (h < 6)).alias("at_night"),
        F.bool_or(F.col("is_day_off") == 1).alias("day_off"))
    hours = stored(hours)
    d = hours.groupBy("unit_id", "object_id", "day").agg(
        F.count(F.lit(1)).alias("hrs"), F.bool_and("in_work").alias("work_only"), F.max("from_sensor").alias("any_sensor"), F.max("from_pump").alias("any_pump"))
    from pyspark.sql import Window

    w = Window.partitionBy("unit_id").orderBy("day")
    per_object = d.groupBy("object_id", "day").agg(F.count(F.lit(1)).alias("_units"))
    ep = d.withColumn("adjacent", F.coalesce(F.datediff("day", F.lag("day").over(w)) == 1, F.lit(False))
                      | F.coalesce(F.datediff(F.lead("day").over(w), "day") == 1, F.lit(False))).join(per_object, ["object_id", "day"])
    ep = ep.withColumn("neighbour", F.col("_units") > 1).withColumn("pump_ratio", F.col("hrs") / (1 + F.col("unit_id") % 3)).withColumn(
        "pump_busy", (F.col("hrs") > 1) & (F.col("unit_id") % 3 == 0)).drop("_units")
    lives = life(t).select("unit_id", "object_id", "day", (F.col("is_day_off") == 1).alias("day_off"))
    return tg.criteria_screen(hours, ep, lives, wet_days(t), ("unit_id", "object_id"), criteria(), "1999-07-01")


@query("criteria_screen", "criterion:s positive_unit_days:i positive_unit_days_train:i top_object_share:d workday_to_day_off:d weather_lift:d pump_vs_normal:d adjacent_share:d share_8_16:d passes_volume:b passes_week:b passes_weather:b",
       f"SELECT * FROM ({CRIT_WITH} {SCREEN_SQL})")
def _(t):
    return screen(t)


@query("choose_criterion", "criterion:s", f"""
    SELECT max_by(criterion, (positive_unit_days, criterion)) AS criterion FROM (SELECT *, max(weather_lift) OVER () AS best FROM ({CRIT_WITH} {SCREEN_SQL}) WHERE passes_volume = 1 AND passes_week = 1 AND passes_weather = 1)
    WHERE weather_lift >= best * 0.95""")
def _(t):
    return tg.choose_criterion(screen(t))


@query("scenario_lift", "subset:s signal:s rows:i events_ahead:i event_ahead_pct:d lift:d", """
    WITH s AS (SELECT 'all' AS subset, * FROM scored UNION ALL SELECT 'no_event_yesterday', * FROM scored WHERE naive = 0),
    x AS (SELECT subset, 'late' AS signal, y FROM s WHERE since <= 5 UNION ALL SELECT subset, 'young', y FROM s WHERE age < 365 UNION ALL SELECT subset, 'high', y FROM s WHERE p >= 0.7)
    SELECT subset, signal, count(*) AS rows, sum(y) AS events_ahead, round(100.0 * sum(y) / count(*), 3) AS event_ahead_pct, round((sum(y) / count(*)) / any_value(base), 2) AS lift
    FROM x JOIN (SELECT subset, sum(y) / count(*) AS base FROM s GROUP BY subset) USING (subset) GROUP BY subset, signal""")
def _(t):
    panel = t.scored.withColumnRenamed("y", "label")
    return tg.scenario_lift(panel, {"late": F.col("since") <= 5, "young": F.col("age") < 365, "high": F.col("p") >= 0.7})


def ages(t):
    chan = t.long_rows.groupBy("channel_id", "object_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    ev = t.long_rows.filter("l_quantity >= 40").select("channel_id", "object_id", "day").distinct()
    return chan, ev


CURVE_SQL = """
    WITH RECURSIVE life AS (SELECT channel_id, min(day) AS born, max(day) AS dead FROM long_rows GROUP BY 1 HAVING min(day) >= DATE '1995-01-05'),
    b AS (SELECT * FROM (VALUES (0, 7), (8, 14), (15, 30), (31, 60), (61, 90), (91, 180), (181, 365), (366, 100000)) v(lo, hi)),
    expo AS (SELECT lo, hi, sum(greatest(0, least(hi, date_diff('day', born, dead)) - lo + 1)) AS exposure FROM life CROSS JOIN b GROUP BY 1, 2),
    ev AS (SELECT lo, count(*) AS k FROM (SELECT DISTINCT channel_id, day FROM long_rows WHERE l_quantity >= 40) e JOIN life USING (channel_id) JOIN b ON date_diff('day', born, e.day) BETWEEN lo AND hi GROUP BY 1),
    r AS (SELECT lo, hi, coalesce(k, 0) AS events, exposure, coalesce(k, 0) / exposure AS rate, CAST(coalesce(k, 0) AS DOUBLE) AS k FROM expo LEFT JOIN ev USING (lo)),
    q(lo, side, n, target, a, b, step) AS (
      SELECT lo, 'low', CAST(k AS BIGINT) - 1, 0.975::DOUBLE, 0.0::DOUBLE, k + 10 * sqrt(k + 1) + 20, 0 FROM r WHERE k BETWEEN 1 AND 1000
      UNION ALL SELECT lo, 'high', CAST(k AS BIGINT), 0.025::DOUBLE, 0.0::DOUBLE, k + 10 * sqrt(k + 1) + 20, 0 FROM r WHERE k <= 1000
      UNION ALL SELECT lo, side, n, target, CASE WHEN p > target THEN (a + b) / 2 ELSE a END, CASE WHEN p > target THEN b ELSE (a + b) / 2 END, step + 1
      FROM (SELECT *, (SELECT sum(exp(i * ln((a + b) / 2) - (a + b) / 2 - lgamma(i + 1))) FROM unnest(range(0, n + 1)) AS u(i)) AS p FROM q WHERE step < 60)),
    e AS (SELECT lo, max(a) FILTER (side = 'low') AS lo_mean, max(a) FILTER (side = 'high') AS hi_mean FROM q WHERE step = 60 GROUP BY lo),
    c AS (SELECT r.*, CASE WHEN k = 0 THEN 0 WHEN k <= 1000 THEN lo_mean ELSE k * pow(1 - 1 / (9 * k) - 1.959963984540054 / (3 * sqrt(k)), 3) END / exposure AS ci_low,
                 CASE WHEN k <= 1000 THEN hi_mean ELSE (k + 1) * pow(1 - 1 / (9 * (k + 1)) + 1.959963984540054 / (3 * sqrt(k + 1)), 3) END / exposure AS ci_high, (SELECT max_by(rate, lo) FROM r) AS mature_rate FROM r LEFT JOIN e USING (lo))"""


@query("burn_in_curve", "lo:i hi:i events:i exposure:i rate:d ci_low:d ci_high:d ratio_to_mature:d", f"""
    {CURVE_SQL} SELECT lo, hi, events, exposure, rate, ci_low, ci_high, round(rate / mature_rate, 2) AS ratio_to_mature FROM c""")
def _(t):
    return tg.burn_in_curve(*ages(t), "channel_id", "1995-01-05")


@query("burn_in_days", "burn_in_days:i", f"""
    {CURVE_SQL} SELECT min(lo) AS burn_in_days FROM c WHERE lo < 366 AND NOT EXISTS (SELECT 1 FROM c d WHERE d.lo >= c.lo AND d.lo < 366 AND d.ci_low > 1.02 * d.mature_rate)""")
def _(t):
    return tg.burn_in_days(tg.burn_in_curve(*ages(t), "channel_id", "1995-01-05"), 1.02)


WINDOW_SQL = "SELECT o_custkey % 10 AS object_id, min(CAST(o_orderdate AS DATE)) + 400 AS \"start\", min(CAST(o_orderdate AS DATE)) + 460 AS \"end\" FROM orders GROUP BY 1"


def plan_windows(t):
    d = F.min(F.to_date("o_orderdate"))
    return t.orders.groupBy((F.col("o_custkey") % 10).alias("object_id")).agg(F.date_add(d, 400).alias("start"), F.date_add(d, 460).alias("end"))


@query("schedule_check", "object_id:i per_day_before:d per_day_inside:d inside_to_before:d high_after:i", f"""
    SELECT object_id, round(b / 60.0, 1) AS per_day_before, round(i / 61.0, 1) AS per_day_inside, CASE WHEN b > 0 THEN round((i / 61.0) / (b / 60.0), 3) END AS inside_to_before, high_after FROM (
      SELECT w.object_id, count(*) FILTER (day < "start") AS b, count(*) FILTER (day BETWEEN "start" AND "end") AS i, count(*) FILTER (day > "end" AND l_quantity >= 1) AS high_after
      FROM ({WINDOW_SQL}) w JOIN long_rows r ON r.object_id = w.object_id AND day BETWEEN "start" - 60 AND "end" + 14 GROUP BY 1)""")
def _(t):
    return tg.schedule_check(t.long_rows.withColumn("v", F.col("l_quantity")), plan_windows(t))


@query("schedule_months_check", "object_id:i share_in:d share_out:d lift:d", """
    SELECT object_id, round(i, 4) AS share_in, round(o, 4) AS share_out, round(round(i, 4) / round(o, 4), 2) AS lift FROM (
      SELECT p.object_id, avg(CASE WHEN h.day IS NULL THEN 0 ELSE 1 END) FILTER (month(c.day) IN (p.object_id % 12 + 1, 7)) AS i, avg(CASE WHEN h.day IS NULL THEN 0 ELSE 1 END) FILTER (month(c.day) NOT IN (p.object_id % 12 + 1, 7)) AS o
      FROM (SELECT DISTINCT object_id FROM long_rows) p CROSS JOIN (SELECT day FROM cal WHERE is_day_off = 0) c
      LEFT JOIN (SELECT DISTINCT object_id, day FROM long_rows WHERE l_quantity >= 25) h ON h.object_id = p.object_id AND h.day = c.day GROUP BY 1)""")
def _(t):
    plan = t.long_rows.select("object_id").distinct().withColumn("months", F.array((F.col("object_id") % 12 + 1).cast("int"), F.lit(7)))
    work = t.cal.filter("is_day_off = 0")
    return tg.schedule_months_check(t.long_rows.filter("l_quantity >= 25"), plan, work)


@query("window_check_share", "in_window:b events:i share:d", f"""
    SELECT CAST(EXISTS (SELECT 1 FROM ({WINDOW_SQL}) w WHERE w.object_id = e.object_id AND e.day BETWEEN w."start" AND w."end") AS INT) AS in_window, count(*) AS events, round(avg(CASE WHEN ev = 0 THEN 1 ELSE 0 END), 3) AS share
    FROM unit_event e GROUP BY 1""")
def _(t):
    return tg.window_share(t.unit_event.withColumn("check", F.col("ev") == 0), plan_windows(t), "check")


@query("not_in_maintenance", "object_id:i n:i", f"""
    SELECT object_id, count(*) AS n FROM unit_event e WHERE NOT EXISTS (SELECT 1 FROM ({WINDOW_SQL}) w WHERE w.object_id = e.object_id AND e.day BETWEEN w."start" AND w."end" + 14) GROUP BY object_id""")
def _(t):
    return tg.not_in_windows(t.unit_event, plan_windows(t), extra_days=14).groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))


@query("gas_object_days", "n:i", f"""
    SELECT count(*) AS n FROM (SELECT DISTINCT object_id, day FROM long_rows JOIN cal USING (day) WHERE l_quantity BETWEEN 35 AND 100 AND (is_day_off = 1 OR hour(hour) < 8 OR hour(hour) >= 16)) g
    WHERE NOT EXISTS (SELECT 1 FROM ({WINDOW_SQL}) w WHERE w.object_id = g.object_id AND g.day BETWEEN w."start" AND w."end" + 14)""")
def _(t):
    h = F.hour("hour")
    rows = t.long_rows.filter("l_quantity BETWEEN 35 AND 100").join(F.broadcast(t.cal.select("day", "is_day_off")), "day")
    days = rows.filter((F.col("is_day_off") == 1) | (h < 8) | (h >= 16)).select("object_id", "day").distinct()
    return tg.not_in_windows(days, plan_windows(t), extra_days=14).agg(F.count(F.lit(1)).alias("n"))


@query("quiet_rate", "rate:d n:i", "SELECT avg(y) AS rate, count(*) AS n FROM scored WHERE naive = 0 AND day < DATE '2000-07-01'")
def _(t):
    return t.scored.filter("naive = 0 AND day < DATE '2000-07-01'").agg(F.avg("y").alias("rate"), F.count(F.lit(1)).alias("n"))


@query("stratified_examples", "level:s prediction_id:i", """
    SELECT level, prediction_id FROM (SELECT level, prediction_id, row_number() OVER (PARTITION BY level ORDER BY md5(concat('0|', prediction_id)), prediction_id) AS r FROM card) WHERE r <= 5""")
def _(t):
    return tg.stratified_examples(t.card.select("level", "prediction_id"), "level", ("prediction_id",), 5)


@query("dense_grid", "unit_id:i n:i first:D last:D", f"SELECT unit_id, count(*) AS n, min(day) AS first, max(day) AS last FROM ({LIFE_SQL}) GROUP BY unit_id")
def _(t):
    return dense_grid(units(t), UNIT).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))
