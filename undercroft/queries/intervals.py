"""State changes, intervals, as-of look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from undercroft.functions.clock import boundary_diff
from undercroft.operators import intervals as iv
from undercroft.operators.ordered import asof_last, prefix_sums
from undercroft.plans import access, flood
from undercroft.queries.base import query
from undercroft.queries.journal import WINDOWS_SQL
from undercroft.session import stored

AT = "2024-01-29 12:00:00"
ACC_WINDOWS_SQL = WINDOWS_SQL.replace("FROM guard)", "FROM acc_guard)")


def acc_windows(t):
    return stored(iv.disarm_windows(t.acc_guard))


@query("state_changes", "object_id:i ts:t value:s", """
    SELECT object_id, ts, value FROM (SELECT *, lag(value) OVER (PARTITION BY object_id ORDER BY ts, value) AS prev FROM guard) WHERE prev IS NULL OR prev <> value""")
def _(t):
    return iv.state_changes(t.guard, ("object_id",))


@query("disarm_windows", "object_id:i t_from:t t_to:t open_end:b", WINDOWS_SQL.replace("nxt IS NULL AS open_end", "CAST(nxt IS NULL AS INT) AS open_end"))
def _(t):
    return iv.disarm_windows(t.guard)


@query("disarm_windows_open", "object_id:i t_from:t t_to:t", """
    SELECT object_id, ts AS t_from, nxt AS t_to FROM (SELECT *, lead(ts) OVER (PARTITION BY object_id ORDER BY ts, value) AS nxt
      FROM (SELECT *, lag(value) OVER (PARTITION BY object_id ORDER BY ts, value) AS prev FROM guard) WHERE prev IS NULL OR prev <> value) WHERE value = 'off'""")
def _(t):
    return iv.disarm_windows(t.guard, open_forever=True)


UNKNOWN_SQL = """
    SELECT object_id, t_from, t_to FROM (SELECT object_id, lag(ts) OVER (PARTITION BY object_id ORDER BY ts) AS t_from, ts AS t_to FROM acc_guard) WHERE date_diff('hour', t_from, t_to) > 120
    UNION ALL SELECT object_id, max(ts), TIMESTAMP '2001-09-01' FROM acc_guard GROUP BY object_id HAVING date_diff('hour', max(ts), TIMESTAMP '2001-09-01') > 120"""


def unknown(t):
    return stored(iv.guard_unknown(t.acc_guard, "2001-09-01", silence_hours=120))


@query("guard_unknown", "object_id:i t_from:t t_to:t", UNKNOWN_SQL)
def _(t):
    return iv.guard_unknown(t.acc_guard, "2001-09-01", silence_hours=120)


CUT_DAY_SQL = f"""
    SELECT object_id, day, sum(date_diff('minute', a, b)) / 60.0 AS disarm_hours
    FROM (SELECT object_id, CAST(d AS DATE) AS day, greatest(t_from, d) AS a, least(t_to, d + INTERVAL 1 DAY) AS b
          FROM (SELECT object_id, t_from, t_to, unnest(generate_series(date_trunc('day', t_from), date_trunc('day', t_to), INTERVAL 1 DAY)) AS d
                FROM ({ACC_WINDOWS_SQL}) WHERE t_to > t_from)) WHERE b > a GROUP BY object_id, day"""


@query("cut_interval_by_day", "object_id:i day:D disarm_hours:d", CUT_DAY_SQL)
def _(t):
    return iv.disarm_hours_by_day(iv.disarm_windows(t.acc_guard))


@query("disarm_hours", "object_id:i h24:d h168:d", f"""
    SELECT object_id, sum(greatest(0, epoch(least(t_to, TIMESTAMP '{AT}')) - epoch(greatest(t_from, TIMESTAMP '2024-01-28 12:00:00')))) / 3600.0 AS h24,
           sum(greatest(0, epoch(least(t_to, TIMESTAMP '{AT}')) - epoch(greatest(t_from, TIMESTAMP '2024-01-22 12:00:00')))) / 3600.0 AS h168
    FROM ({WINDOWS_SQL.replace('coalesce(nxt, seen)', "coalesce(nxt, TIMESTAMP '2100-01-01')")}) GROUP BY object_id""")
def _(t):
    windows = iv.disarm_windows(t.guard, open_forever=True)
    return iv.overlap_hours(windows, ("object_id",), F.lit(AT).cast("timestamp"), {"h24": 24, "h168": 168})


ON_SQL = """
    SELECT channel_id, ts AS a, least(coalesce(nxt, ts {open}), ts + INTERVAL 24 HOUR) AS b
    FROM (SELECT channel_id, ts, value, lead(ts) OVER (PARTITION BY channel_id ORDER BY ts, value) AS nxt
          FROM (SELECT DISTINCT channel_id, ts, value FROM pump_rows WHERE value IN ('on', 'off') {where})) WHERE value = 'on'"""


@query("on_minutes", "channel_id:i m24:d m720:d", f"""
    SELECT channel_id, sum(greatest(0, epoch(least(b, TIMESTAMP '{AT}')) - epoch(greatest(a, TIMESTAMP '{AT}' - INTERVAL 24 HOUR)))) / 60.0 AS m24,
           sum(greatest(0, epoch(least(b, TIMESTAMP '{AT}')) - epoch(greatest(a, TIMESTAMP '{AT}' - INTERVAL 720 HOUR)))) / 60.0 AS m720
    FROM ({ON_SQL.format(open="+ INTERVAL 24 HOUR", where=f"AND ts < TIMESTAMP '{AT}'")}) GROUP BY channel_id""")
def _(t):
    now = F.lit(AT).cast("timestamp")
    rows = t.pump_rows.filter(F.col("value").isin("on", "off") & (F.col("ts") < now))
    spans = iv.on_intervals(rows, ("channel_id",), open_hours=24)
    got = iv.overlap_hours(spans, ("channel_id",), now, {"m24": 24, "m720": 720}, "a", "b")
    return got.select("channel_id", (F.col("m24") * 60).alias("m24"), (F.col("m720") * 60).alias("m720"))


CHANGES_SQL = """
    SELECT channel_id, date_trunc('hour', ts) AS hour, count(*) AS n_changes
    FROM (SELECT *, lag(value) OVER (PARTITION BY channel_id ORDER BY ts, value) AS prev FROM (SELECT DISTINCT channel_id, ts, value FROM pump_rows WHERE value IN ('on', 'off')))
    WHERE prev <> value GROUP BY 1, 2"""
ON_HOUR_SQL = f"""
    SELECT channel_id, hour, sum(date_diff('second', a, b)) / 60.0 AS on_minutes
    FROM (SELECT channel_id, h AS hour, greatest(a, h) AS a, least(b, h + INTERVAL 1 HOUR) AS b
          FROM (SELECT *, unnest(generate_series(date_trunc('hour', a), date_trunc('hour', b), INTERVAL 1 HOUR)) AS h FROM ({ON_SQL.format(open='', where='')}) WHERE b > a))
    WHERE b > a GROUP BY 1, 2"""
ALARM_HOUR_SQL = """
    SELECT channel_id, hour, count(DISTINCT ts) FILTER (value = 'unavailable') AS n_unavail, count(DISTINCT ts) FILTER (value = 'all_running') AS n_all_pumps,
           count(DISTINCT ts) FILTER (value = 'flooded') AS n_flooded
    FROM pump_rows WHERE alarm AND value IN ('unavailable', 'all_running', 'flooded') GROUP BY 1, 2"""
PUMP_HOUR_SQL = f"""
    SELECT channel_id, hour, coalesce(n_changes, 0) AS n_changes, coalesce(on_minutes, 0) AS on_minutes, coalesce(n_unavail, 0) AS n_unavail,
           coalesce(n_all_pumps, 0) AS n_all_pumps, coalesce(n_flooded, 0) AS n_flooded
    FROM ({CHANGES_SQL}) c FULL JOIN ({ON_HOUR_SQL}) m USING (channel_id, hour) FULL JOIN ({ALARM_HOUR_SQL}) a USING (channel_id, hour)"""


@query("pump_hourly", "channel_id:i hour:t n_changes:i on_minutes:d n_unavail:i n_all_pumps:i n_flooded:i", PUMP_HOUR_SQL)
def _(t):
    return iv.pump_hours(t.pump_rows)


@query("cut_interval_by_hour", "channel_id:i hour:t on_minutes:d", ON_HOUR_SQL)
def _(t):
    spans = iv.on_intervals(t.pump_rows.filter("value IN ('on', 'off')"), ("channel_id",))
    return iv.cut(spans, ("channel_id",), "a", "b", "hour", "hour").groupBy("channel_id", "hour").agg(
        (F.sum(boundary_diff("second", "a", "b")) / 60.0).alias("on_minutes"))


@query("blink_threshold", "quantile:d", f"""
    SELECT quantile_cont(CAST(n_changes AS DOUBLE), 0.99) AS quantile FROM ({PUMP_HOUR_SQL}) p
    WHERE hour < TIMESTAMP '2024-01-20' AND n_changes > 0 AND NOT EXISTS (
      SELECT 1 FROM ({PUMP_HOUR_SQL}) b WHERE (b.n_unavail > 1 OR b.n_flooded > 1) AND b.channel_id = p.channel_id AND CAST(b.hour AS DATE) = CAST(p.hour AS DATE))""")
def _(t):
    hours = stored(iv.pump_hours(t.pump_rows))
    worse = hours.withColumn("n_unavail", F.greatest(F.col("n_unavail") - 1, F.lit(0))).withColumn(
        "n_flooded", F.greatest(F.col("n_flooded") - 1, F.lit(0)))
    return flood.blink_threshold(worse, "2024-01-20")


@query("state_share_by_hour", "object_id:i hour:t share:d", f"""
    SELECT g.object_id, g.hour, coalesce(sum(CASE WHEN s.a IS NOT NULL THEN greatest(0, epoch(least(b, g.hour + INTERVAL 1 HOUR)) - epoch(greatest(a, g.hour))) END) / 3600.0, 0) AS share
    FROM (SELECT object_id, unnest(generate_series(TIMESTAMP '2024-01-26 12:00:00', TIMESTAMP '2024-01-29 11:00:00', INTERVAL 1 HOUR)) AS hour FROM (SELECT DISTINCT object_id FROM guard)) g
    LEFT JOIN (SELECT object_id, ts AS a, coalesce(lead(ts) OVER (PARTITION BY object_id ORDER BY ts, value), TIMESTAMP '{AT}') AS b, value FROM guard WHERE ts < TIMESTAMP '{AT}') s
      ON s.object_id = g.object_id AND s.value = 'on' AND s.b > g.hour AND s.a < g.hour + INTERVAL 1 HOUR
    GROUP BY g.object_id, g.hour""")
def _(t):
    return iv.state_share_by_hour(t.guard, ("object_id",), F.lit(AT).cast("timestamp"), 72, "on")


POINTS_SQL = "SELECT DISTINCT object_id, day FROM long_rows"


def points(t):
    rows = t.long_rows.select("object_id", "day").distinct()
    return rows.withColumn("at", F.col("day").cast("timestamp"))


@query("is_open_at", "object_id:i day:D open:i", f"""
    SELECT p.object_id, p.day, CASE WHEN p.object_id IN (SELECT object_id FROM ({ACC_WINDOWS_SQL})) THEN
      CAST(EXISTS (SELECT 1 FROM ({ACC_WINDOWS_SQL}) w WHERE w.object_id = p.object_id AND w.t_from <= p.day AND w.t_to > p.day) AS INT) END AS open FROM ({POINTS_SQL}) p""")
def _(t):
    return iv.is_open_at(points(t), acc_windows(t), ("object_id",), "at", "open")


@query("guard_mode_known", "object_id:i day:D", f"""
    SELECT p.* FROM ({POINTS_SQL}) p WHERE NOT EXISTS (SELECT 1 FROM ({UNKNOWN_SQL}) u WHERE u.object_id = p.object_id AND u.t_from < p.day + INTERVAL 1 DAY AND u.t_to > p.day)""")
def _(t):
    days = points(t)
    return days.join(access.unknown_days(days, unknown(t)), ["object_id", "day"], "left_anti")


@query("asof_last_guard_change", "object_id:i day:D is_disarmed_at_0:i hours:i", f"""
    WITH change AS (SELECT object_id, t_from AS ts FROM ({ACC_WINDOWS_SQL}) UNION SELECT object_id, t_to FROM ({ACC_WINDOWS_SQL}) WHERE NOT open_end)
    SELECT p.object_id, p.day, CASE WHEN p.object_id IN (SELECT object_id FROM change) THEN
             CAST(EXISTS (SELECT 1 FROM ({ACC_WINDOWS_SQL}) w WHERE w.object_id = p.object_id AND w.t_from <= p.day AND w.t_to > p.day) AS INT) END AS is_disarmed_at_0,
           date_diff('hour', c.ts, CAST(p.day AS TIMESTAMP)) AS hours
    FROM ({POINTS_SQL}) p ASOF LEFT JOIN change c ON c.object_id = p.object_id AND c.ts < p.day""")
def _(t):
    return access.guard_days(points(t), acc_windows(t)).withColumnRenamed("hours_since_guard_change", "hours")


@query("asof_last_alarm", "event_id:i last_error:i last_click:i", """
    SELECT v.event_id, e.event_id AS last_error, c.event_id AS last_click FROM (SELECT * FROM journal WHERE event_type = 'view') v
    ASOF LEFT JOIN (SELECT object_id, ts, max(event_id) AS event_id FROM journal WHERE event_type = 'error' GROUP BY 1, 2) e ON e.object_id = v.object_id AND e.ts < v.ts
    ASOF LEFT JOIN (SELECT object_id, ts, max(event_id) AS event_id FROM journal WHERE event_type = 'click' GROUP BY 1, 2) c ON c.object_id = v.object_id AND c.ts < v.ts""")
def _(t):
    views = t.journal.filter("event_type = 'view'").select("event_id", "object_id", "ts")
    pick = lambda kind: t.journal.filter(F.col("event_type") == kind).select("object_id", "ts", F.col("event_id").alias("e"))
    one = asof_last(views, pick("error"), ("object_id",), "ts", "ts", {"last_error": F.col("e")}, tiebreak=("e",))
    return asof_last(one, pick("click"), ("object_id",), "ts", "ts", {"last_click": F.col("e")}, tiebreak=("e",))


@query("asof_next_event", "event_id:i next_error:t", """
    SELECT v.event_id, min(e.ts) AS next_error FROM (SELECT * FROM journal WHERE event_type = 'view') v
    LEFT JOIN (SELECT object_id, ts FROM journal WHERE event_type = 'error') e ON e.object_id = v.object_id AND e.ts > v.ts GROUP BY v.event_id""")
def _(t):
    views = t.journal.filter("event_type = 'view'").select("event_id", "object_id", "ts")
    errors = t.journal.filter("event_type = 'error'").select("object_id", "ts")
    return asof_last(views, errors, ("object_id",), "ts", "ts", {"next_error": F.col("ts")}, forward=True)


@query("look_back_windows", "event_id:i n_6h:i n_24h:i sum_24h:d ahead_24h:i", """
    SELECT v.event_id, count(*) FILTER (e.ts >= v.ts - INTERVAL 6 HOUR AND e.ts < v.ts) AS n_6h, count(*) FILTER (e.ts >= v.ts - INTERVAL 24 HOUR AND e.ts < v.ts) AS n_24h,
           coalesce(sum(e.value) FILTER (e.ts >= v.ts - INTERVAL 24 HOUR AND e.ts < v.ts), 0) AS sum_24h, count(*) FILTER (e.ts >= v.ts AND e.ts < v.ts + INTERVAL 24 HOUR) AS ahead_24h
    FROM (SELECT * FROM journal WHERE event_type = 'view') v LEFT JOIN (SELECT * FROM journal WHERE event_type = 'error') e ON e.object_id = v.object_id GROUP BY v.event_id""")
def _(t):
    from undercroft.functions.clock import shift

    views = t.journal.filter("event_type = 'view'").select("event_id", "object_id", "ts")
    errors = t.journal.filter("event_type = 'error'")
    c = prefix_sums(views, errors, ("object_id",), "ts",
                    {"now": F.col("ts"), "b6": shift("ts", -6 * 3600), "b24": shift("ts", -86400), "a24": shift("ts", 86400)},
                    {"n": F.lit(1), "v": F.col("value")}, ("event_id",))
    return c.select("event_id", (F.col("n_now") - F.col("n_b6")).alias("n_6h"), (F.col("n_now") - F.col("n_b24")).alias("n_24h"),
                    (F.col("v_now") - F.col("v_b24")).alias("sum_24h"), (F.col("n_a24") - F.col("n_now")).alias("ahead_24h"))
