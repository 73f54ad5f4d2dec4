"""Neighbours in time and space."""

from __future__ import annotations

from pyspark.sql import functions as F

from undercroft.operators import neighbours as nb
from undercroft.operators.sessions import episodes_per_day
from undercroft.plans import fire, fire_rules
from undercroft.queries.base import query
from undercroft.queries.journal import EVENT_SQL, flagged
from undercroft.session import stored

NB_SQL = """
    SELECT a.*, (SELECT count(DISTINCT (r.gallery, r.picket)) FROM fire_signal r WHERE r.object_id = a.object_id AND (r.gallery <> a.gallery OR r.picket <> a.picket)
        AND r.day = a.day AND r.ts BETWEEN a.ts - INTERVAL {m} MINUTE AND a.ts + INTERVAL {m} MINUTE) AS nb FROM fire_signal a"""


@query("burst_neighbours", "event_id:i nb:i", f"SELECT event_id, nb FROM ({NB_SQL.format(m=60)})")
def _(t):
    return nb.burst_neighbours(t.fire_signal)


@query("burst_neighbours_wide", "event_id:i nb:i burst:b", f"SELECT event_id, nb, CAST(nb > 2 AS INT) AS burst FROM ({NB_SQL.format(m=360)})")
def _(t):
    return nb.burst_neighbours(t.fire_signal, minutes=360).withColumn("burst", F.col("nb") > 2)


@query("spread_neighbours", "event_id:i near:i", """
    SELECT event_id, (SELECT count(*) FROM fire_signal r WHERE r.object_id = a.object_id AND r.gallery = a.gallery AND r.picket <> a.picket AND abs(r.picket - a.picket) <= 5
        AND r.ts BETWEEN a.ts - INTERVAL 30 MINUTE AND a.ts + INTERVAL 30 MINUTE) AS near FROM fire_signal a""")
def _(t):
    return nb.rows_nearby(t.fire_signal, t.fire_signal, ("object_id", "gallery"), "picket", "ts", 5, 30, "near", own_picket=False)


@query("independent_heat", "event_id:i heat:i", """
    SELECT event_id, (SELECT count(*) FROM fire_signal r WHERE r.stype <> 'smoke' AND r.object_id = a.object_id AND r.gallery = a.gallery AND abs(r.picket - a.picket) <= 5
        AND r.ts BETWEEN a.ts - INTERVAL 60 MINUTE AND a.ts + INTERVAL 60 MINUTE) AS heat FROM fire_signal a WHERE stype = 'smoke'""")
def _(t):
    smoke, warm = t.fire_signal.filter("stype = 'smoke'"), t.fire_signal.filter("stype <> 'smoke'")
    return nb.rows_nearby(smoke, warm, ("object_id", "gallery"), "picket", "ts", 5, 60, "heat", own_picket=True)


@query("power_off_near", "event_id:i off:i", """
    SELECT event_id, (SELECT count(*) FROM journal p WHERE p.event_type = 'signup' AND p.complex_id = a.complex_id AND p.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR) AS off
    FROM fire_signal a WHERE stype = 'smoke'""")
def _(t):
    off = t.journal.filter("event_type = 'signup'").select("complex_id", "ts")
    return nb.near_in_time(t.fire_signal.filter("stype = 'smoke'"), off, ("complex_id",), "ts", "ts", 3600, "off")


@query("round_within_1h", "object_id:i gallery:i picket:i day:D others:i", """
    SELECT f.object_id, f.gallery, f.picket, f.day, (SELECT count(DISTINCT (r.gallery, r.picket)) FROM fire_signal r WHERE r.object_id = f.object_id AND (r.gallery <> f.gallery OR r.picket <> f.picket)
        AND r.ts BETWEEN f.first_ts - INTERVAL 1 HOUR AND f.first_ts + INTERVAL 1 HOUR) AS others
    FROM (SELECT object_id, gallery, picket, day, min(ts) AS first_ts FROM fire_signal GROUP BY 1, 2, 3, 4) f""")
def _(t):
    times = episodes_per_day(t.fire_signal, ("object_id", "gallery", "picket"))
    return nb.distinct_neighbours(times, t.fire_signal, ("object_id",), ("gallery", "picket"), "first_ts", "ts", 3600, "others")


@query("contact_then_motion", "object_id:i gallery:i section:i ts:t completed_ts:t", f"""
    SELECT c.object_id, c.gallery, c.section, c.ts, min(m.ts) AS completed_ts FROM ({EVENT_SQL}) c JOIN ({EVENT_SQL}) m
      ON m.object_id = c.object_id AND m.gallery = c.gallery AND m.section = c.section AND m.kind = 'motion' AND m.ts > c.ts AND m.ts <= c.ts + INTERVAL 30 MINUTE
    WHERE c.kind = 'contact' GROUP BY c.object_id, c.gallery, c.section, c.ts""")
def _(t):
    return nb.contact_then_motion(stored(flagged(t)), ("object_id", "gallery", "section"))


@query("line_neighbours_sections", "object_id:i section:i day:D ev:i m:i", """
    SELECT a.object_id, a.section, a.day, sum(b.ev) AS ev, sum(b.m) AS m FROM (SELECT object_id, unit_id AS section, day, ev, m FROM unit_event) a
    JOIN (SELECT object_id, unit_id AS section, day, ev, m FROM unit_event) b ON b.object_id = a.object_id AND b.day = a.day AND abs(b.section - a.section) IN (10, 20) GROUP BY 1, 2, 3""")
def _(t):
    days = t.unit_event.withColumnRenamed("unit_id", "section")
    near = nb.line_neighbours(days, ("object_id",), "section", (-20, -10, 10, 20), {"ev_n": "ev", "m_n": "m"})
    return days.select("object_id", "section", "day").join(near, ["object_id", "section", "day"]).select(
        "object_id", "section", "day", F.col("ev_n").alias("ev"), F.col("m_n").alias("m"))


@query("line_neighbours_pickets", "object_id:i gallery:i picket:i day:D l_ev:i", """
    WITH d AS (SELECT object_id, gallery, picket, day, max(CASE WHEN stype = 'smoke' THEN 1 ELSE 0 END) AS ev FROM fire_signal GROUP BY 1, 2, 3, 4)
    SELECT a.object_id, a.gallery, a.picket, a.day, sum(b.ev) AS l_ev FROM d a JOIN d b ON b.object_id = a.object_id AND b.gallery = a.gallery AND b.day = a.day
      AND b.picket <> a.picket AND abs(b.picket - a.picket) <= 5 AND b.ev = 1 GROUP BY 1, 2, 3, 4""")
def _(t):
    days = t.fire_signal.groupBy("object_id", "gallery", "picket", "day").agg(F.max((F.col("stype") == "smoke").cast("int")).alias("ev"))
    near = nb.line_neighbours(days, ("object_id", "gallery"), "picket", [d for d in range(-5, 6) if d], {"l_ev": "ev"})
    return days.join(near, ["object_id", "gallery", "picket", "day"])


@query("smoke_pairs", "object_id:i gallery:i a:i b:i", """
    SELECT a.object_id, a.gallery, a.cid AS a, b.cid AS b FROM channels a JOIN channels b ON a.object_id = b.object_id AND a.gallery = b.gallery AND a.cid < b.cid AND a.picket <> b.picket
      AND abs((a.picket * 10 + a.cid % 7) - (b.picket * 10 + b.cid % 7)) <= 50 WHERE a.stype = 'Датчик дыма' AND b.stype = 'Датчик дыма'""")
def _(t):
    s = t.channels.filter("stype = 'Датчик дыма'").withColumn("chain", (F.col("picket") * 10 + F.col("cid") % 7).cast("double"))
    return nb.smoke_pairs(s, ("object_id", "gallery"))


@query("unique_count_match", "n:i object_id:i plan_object:i", """
    SELECT n, object_id, plan_object FROM (SELECT n, min(k) AS object_id FROM (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1) GROUP BY n HAVING count(*) = 1)
    JOIN (SELECT n, min(k) AS plan_object FROM (SELECT o_custkey AS k, CAST(sum(o_totalprice / 10000) AS BIGINT) AS n FROM orders GROUP BY 1) GROUP BY n HAVING count(*) = 1) USING (n)""")
def _(t):
    ours = t.events.groupBy(F.col("user_id").alias("object_id")).agg(F.count(F.lit(1)).alias("n"))
    plan = t.orders.groupBy(F.col("o_custkey").alias("plan_object")).agg(F.round(F.sum(F.col("o_totalprice") / 10000)).cast("bigint").alias("n"))
    return nb.unique_count_match(ours, plan)


LOOP_SQL = """
    WITH chan AS (SELECT DISTINCT user_id AS channel_id, user_id % 40 AS unit, user_id % 6 AS device, CAST(floor(user_id / 6) AS BIGINT) AS address FROM events),
    ev AS (SELECT DISTINCT user_id AS channel_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error'),
    pairs AS (SELECT DISTINCT a.unit, b.channel_id FROM chan a JOIN chan b ON a.device = b.device AND abs(a.address - b.address) <= 3 AND b.unit <> a.unit),
    near AS (SELECT unit, e.day FROM pairs JOIN ev e USING (channel_id)),
    spread AS (SELECT unit, day AS src, CAST(unnest(generate_series(CAST(day AS TIMESTAMP) + INTERVAL 1 DAY, CAST(day AS TIMESTAMP) + INTERVAL 7 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM near),
    l AS (SELECT unit, day, count(*) FILTER (date_diff('day', src, day) = 1) AS loop_events_1d, count(*) AS loop_events_7d FROM spread GROUP BY 1, 2),
    dev AS (SELECT u.unit, CAST(e.day + INTERVAL 1 DAY AS DATE) AS day, sum(n) AS loop_device_1d FROM (SELECT DISTINCT unit, device FROM chan) u
            JOIN (SELECT device, day, count(*) AS n FROM ev JOIN chan USING (channel_id) GROUP BY 1, 2) e USING (device) GROUP BY 1, 2)
    SELECT unit, day, coalesce(loop_events_1d, 0) AS loop_events_1d, coalesce(loop_events_7d, 0) AS loop_events_7d, coalesce(loop_device_1d, 0) AS loop_device_1d FROM l FULL JOIN dev USING (unit, day)"""


@query("loop_neighbours", "unit:i day:D loop_events_1d:i loop_events_7d:i loop_device_1d:i", LOOP_SQL)
def _(t):
    u = F.col("user_id")
    chan = t.events.select(u.alias("channel_id"), (u % 40).alias("unit"), (u % 6).alias("device"), F.floor(u / 6).alias("address")).distinct()
    ev = t.events.filter("event_type = 'error'").select(u.alias("channel_id"), F.to_date("ts").alias("day")).distinct()
    return nb.loop_neighbours(chan, ev)


GRAPH_EV = "SELECT DISTINCT unit_id AS uid, complex_id, day FROM unit_event WHERE ev = 1"
EDGE_SQL = f"""
    SELECT p.k, p.v, p.u, p.n / (s.n + 5) AS w FROM (
      SELECT k.k, a.uid AS v, b.uid AS u, CAST(count(*) AS DOUBLE) AS n FROM ({GRAPH_EV}) a JOIN ({GRAPH_EV}) b ON b.complex_id = a.complex_id AND b.uid <> a.uid AND b.day = CAST(a.day + INTERVAL 1 DAY AS DATE)
      JOIN (SELECT 0 AS k UNION ALL SELECT 1996 UNION ALL SELECT 1997 UNION ALL SELECT 1998) k ON k.k <> year(a.day)
      WHERE a.day < DATE '1999-01-01' AND b.day < DATE '1999-01-01' GROUP BY 1, 2, 3) p
    JOIN (SELECT k.k, uid AS v, count(*) AS n FROM ({GRAPH_EV}) JOIN (SELECT 0 AS k UNION ALL SELECT 1996 UNION ALL SELECT 1997 UNION ALL SELECT 1998) k ON k.k <> year(day)
          WHERE day < DATE '1999-01-01' GROUP BY 1, 2) s ON s.k = p.k AND s.v = p.v"""


def graph_events(t):
    return t.unit_event.filter("ev = 1").select(F.col("unit_id").alias("uid"), "complex_id", "day").distinct()


@query("learned_graph_edges", "k:i v:i u:i w:d", EDGE_SQL)
def _(t):
    return nb.learned_edges(graph_events(t), "1999-01-01", (1996, 1997, 1998))


@query("graph_features", "uid:i day:D graph_1d:d graph_3d:d graph_max_1d:d", f"""
    SELECT r.uid, r.day, coalesce(sum(w) FILTER (lag = 1), 0) AS graph_1d, coalesce(sum(w * exp(-(lag - 1) / 1.5)), 0) AS graph_3d, coalesce(max(w) FILTER (lag = 1), 0) AS graph_max_1d
    FROM (SELECT uid, day, CASE WHEN day < DATE '1999-01-01' AND year(day) BETWEEN 1996 AND 1998 THEN year(day) ELSE 0 END AS k FROM ({GRAPH_EV})) r
    LEFT JOIN (SELECT g.u, g.k, g.w, e.day AS ev_day FROM ({EDGE_SQL}) g JOIN ({GRAPH_EV}) e ON e.uid = g.v) h
      ON h.u = r.uid AND h.k = r.k AND date_diff('day', h.ev_day, r.day) BETWEEN 1 AND 3
    CROSS JOIN LATERAL (SELECT date_diff('day', h.ev_day, r.day) AS lag) GROUP BY r.uid, r.day""")
def _(t):
    ev = graph_events(t)
    edges = nb.learned_edges(ev, "1999-01-01", (1996, 1997, 1998))
    k = F.when((F.col("day") < "1999-01-01") & F.year("day").between(1996, 1998), F.year("day")).otherwise(0)
    return nb.graph_features(ev.select("uid", "day", k.alias("k")), edges, ev)


@query("walk_gap", "object_id:i day:D units_same_day:i walk_gap_minutes:d", """
    SELECT object_id, day, count(*) AS units_same_day, coalesce(median(step), 1440) AS walk_gap_minutes
    FROM (SELECT *, date_diff('minute', lag(first_ts) OVER (PARTITION BY object_id, day ORDER BY first_ts), first_ts) AS step
          FROM (SELECT object_id, gallery, picket, day, min(ts) AS first_ts FROM fire_signal GROUP BY 1, 2, 3, 4)) GROUP BY object_id, day""")
def _(t):
    times = episodes_per_day(t.fire_signal, ("object_id", "gallery", "picket"))
    return nb.walk_gap(times.withColumn("unit", F.concat_ws("|", "gallery", "picket")))


@query("walk_days", "object_id:i day:D", f"SELECT DISTINCT object_id, day FROM ({NB_SQL.format(m=360)}) WHERE nb > 2")
def _(t):
    return fire_rules.walk_days(nb.burst_neighbours(t.fire_signal, minutes=360))


@query("alive_units", "object_id:i day:D units_alive:i", """
    SELECT d.object_id, d.day, count(u.unit_id) AS units_alive FROM (SELECT DISTINCT object_id, day FROM unit_event WHERE ev = 1) d
    LEFT JOIN (SELECT unit_id, object_id, min(day) AS lo, max(day) - CAST(unit_id AS INT) * 3 AS hi FROM unit_event GROUP BY 1, 2) u ON u.object_id = d.object_id AND d.day BETWEEN u.lo AND u.hi GROUP BY 1, 2""")
def _(t):
    units = t.unit_event.groupBy("unit_id", "object_id").agg(
        F.min("day").alias("hour_from"), F.date_sub(F.max("day"), (F.first("unit_id") * 3).cast("int")).alias("hour_to"))
    return fire.alive_units(units, t.unit_event.filter("ev = 1"))


@query("label_window", "event_id:i n:i", """
    SELECT v.event_id, count(e.ts) AS n FROM (SELECT * FROM journal WHERE event_type = 'view') v
    LEFT JOIN (SELECT object_id, ts FROM journal WHERE event_type = 'error') e ON e.object_id = v.object_id AND e.ts > v.ts AND e.ts <= v.ts + INTERVAL 24 HOUR GROUP BY v.event_id""")
def _(t):
    from undercroft.functions.clock import shift

    views = t.journal.filter("event_type = 'view'").select("event_id", "object_id", "ts").withColumn("end", shift("ts", 86400))
    errors = t.journal.filter("event_type = 'error'").select("object_id", F.col("ts").alias("e"))
    return nb.signals_within(views, errors, ("object_id",), "ts", "end", "e", "n")
