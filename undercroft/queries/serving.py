"""Read queries over cards, orders, facilities and live signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from undercroft.operators.neighbours import burst_neighbours
from undercroft.plans import serving as sv
from undercroft.queries.base import query
from undercroft.queries.neighbours import NB_SQL

FIN = "('DECIDED', 'CLOSED_CONFIRMED', 'CLOSED_NOT_CONFIRMED')"
SEV = "CASE level WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 0 END"
AT = "2024-01-29 12:00:00"


@query("journal", "prediction_id:i facility_id:i level:s status:s", f"""
    SELECT prediction_id, facility_id, level, status FROM card JOIN facility USING (facility_id) WHERE direction IN ('FIRE_RISK', 'FLOOD_RISK') AND level IN ('HIGH', 'CRITICAL') AND district = 7
      AND computed_at >= TIMESTAMP '1996-01-01' AND computed_at < TIMESTAMP '2000-01-01' ORDER BY CASE WHEN status IN {FIN} THEN 1 ELSE 0 END, {SEV} DESC, computed_at DESC, prediction_id LIMIT 20 OFFSET 20""")
def _(t):
    rows = sv.journal_filter(t.card, t.facility, directions=("FIRE_RISK", "FLOOD_RISK"), levels=("HIGH", "CRITICAL"), district=7, first="1996-01-01", last="1999-12-31")
    return sv.journal(rows, page=2, size=20)


@query("journal_sorted", "prediction_id:i probability:d", f"""
    SELECT prediction_id, probability FROM card JOIN facility USING (facility_id) WHERE assignee = 'user1' AND status IN ('NEW', 'IN_REVIEW') ORDER BY CASE WHEN status IN {FIN} THEN 1 ELSE 0 END, probability, computed_at DESC, prediction_id LIMIT 50""")
def _(t):
    rows = sv.journal_filter(t.card, t.facility, statuses=("NEW", "IN_REVIEW"), assignee="user1")
    return sv.journal(rows, sort=sv.SortBy("probability"), size=50)


@query("journal_total", "total:i", "SELECT count(*) AS total FROM card JOIN facility USING (facility_id) WHERE district = 7 AND status = 'NEW'")
def _(t):
    return sv.journal_filter(t.card, t.facility, statuses=("NEW",), district=7).agg(F.count(F.lit(1)).alias("total"))


@query("scope_filter", "prediction_id:i", "SELECT prediction_id FROM card JOIN facility USING (facility_id) WHERE collector = 11")
def _(t):
    return sv.scope_filter(t.card.join(t.facility, "facility_id"), sv.Scope("COMPLEX", 11))


@query("scope_filter_semi", "status:s n:i", "SELECT status, count(*) AS n FROM card WHERE facility_id IN (SELECT facility_id FROM facility WHERE district = 3) GROUP BY status")
def _(t):
    return sv.scoped_by_facility(t.card, t.facility, sv.Scope("DISTRICT", 3)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("card_order_links", "prediction_id:i order_id:i order_status:s facility_order_id:i", """
    SELECT c.prediction_id, o.order_id, o.status AS order_status, CASE WHEN o.order_id IS NULL THEN (SELECT arg_max(w.order_id, (w.created_at, w.order_id)) FROM work_order w WHERE w.facility_id = c.facility_id AND w.direction = c.direction
        AND w.prediction_id <> c.prediction_id AND w.status = 'AUTO_CREATED') END AS facility_order_id FROM card c LEFT JOIN work_order o ON o.prediction_id = c.prediction_id""")
def _(t):
    return sv.order_links(t.card, t.work_order)


@query("prediction_timeseries", "facility_id:i metric:s n:i first:t last:t", """
    SELECT object_id AS facility_id, event_type AS metric, count(*) AS n, min(ts) AS first, max(ts) AS last FROM journal GROUP BY 1, 2""")
def _(t):
    points = sv.timeseries(t.journal.select(F.col("object_id").alias("facility_id"), F.col("event_type").alias("metric"), "ts", "value"))
    return points.groupBy("facility_id", "metric").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("top_risks", "prediction_id:i level:s", f"SELECT prediction_id, level FROM card WHERE status NOT IN {FIN} ORDER BY {SEV} DESC, computed_at DESC, prediction_id LIMIT 10")
def _(t):
    return sv.top_risks(t.card)


@query("dashboard_summary", "counter:s key:s n:i", f"""
    WITH reg AS (SELECT 'level' AS counter, unnest(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL']) AS key UNION ALL SELECT 'direction', unnest(['SENSOR_FAILURE', 'FIRE_RISK', 'UNAUTHORIZED_ACCESS', 'FLOOD_RISK'])
      UNION ALL SELECT 'status', unnest(['NEW', 'IN_REVIEW', 'DECIDED', 'ORDER_OPEN', 'CLOSED_CONFIRMED', 'CLOSED_NOT_CONFIRMED']) UNION ALL SELECT 'order_status', unnest(['AUTO_CREATED', 'CONFIRMED', 'IN_PROGRESS', 'REJECTED', 'CLOSED_CONFIRMED', 'CLOSED_NOT_CONFIRMED']) UNION ALL SELECT 'total', 'all'),
    f AS (SELECT 'level' AS counter, coalesce(dispatcher_level, level) AS key, count(*) AS n FROM card WHERE status NOT IN {FIN} GROUP BY 2 UNION ALL SELECT 'direction', direction, count(*) FROM card GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM card GROUP BY 2
      UNION ALL SELECT 'order_status', status, count(*) FROM work_order GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM card)
    SELECT counter, key, coalesce(n, 0) AS n FROM reg FULL JOIN f USING (counter, key)""")
def _(t):
    return sv.summary(t.card, t.work_order)


@query("map_points", "facility_id:i prediction_id:i probability:d lon:i lat:i", """
    SELECT facility_id, arg_max(prediction_id, (probability, -prediction_id)) AS prediction_id, max(probability) AS probability, any_value(lon) AS lon, any_value(lat) AS lat
    FROM card JOIN facility USING (facility_id) WHERE direction = 'FIRE_RISK' AND lon BETWEEN -50 AND 120 AND lat BETWEEN -40 AND 60 GROUP BY facility_id""")
def _(t):
    return sv.map_points(t.card, t.facility, directions=("FIRE_RISK",), box=sv.Box(-50, -40, 120, 60))


@query("map_lines", "collector:i n:i", "SELECT collector, count(*) AS n FROM facility WHERE district = 5 GROUP BY collector")
def _(t):
    lines = t.facility.groupBy("collector", "district").agg(F.count(F.lit(1)).alias("n"))
    return sv.map_lines(lines, sv.Scope("DISTRICT", 5)).groupBy("collector").agg(F.sum("n").alias("n"))


@query("orders_page", "order_id:i due_at:t", "SELECT order_id, due_at FROM work_order WHERE status = 'AUTO_CREATED' AND due_at < TIMESTAMP '1999-07-01' ORDER BY due_at, order_id LIMIT 25 OFFSET 25")
def _(t):
    return sv.orders_page(t.work_order, ("AUTO_CREATED",), "1999-06-30", page=2, size=25)


@query("alerts", "level:s n:i newest_at:t", "SELECT level, count(*) AS n, max(computed_at) AS newest_at FROM card WHERE level = 'CRITICAL' AND status = 'NEW' GROUP BY level")
def _(t):
    return sv.alerts(t.card)


METRIC_SQL = "SELECT direction, max(computed_at) AS evaluated_at, round(avg(probability), 6) AS precision FROM card WHERE direction <> 'FIRE_RISK' GROUP BY direction, year(computed_at)"


@query("model_metrics", "position:i direction:s precision:d note:s", f"""
    WITH reg AS (SELECT 0 AS position, 'SENSOR_FAILURE' AS direction, '' AS note UNION ALL SELECT 1, 'FIRE_RISK', 'expert_rules' UNION ALL SELECT 2, 'UNAUTHORIZED_ACCESS', '' UNION ALL SELECT 3, 'FLOOD_RISK', '')
    SELECT position, direction, precision, note FROM reg LEFT JOIN (SELECT direction, arg_max(precision, evaluated_at) AS precision FROM ({METRIC_SQL}) GROUP BY 1) m USING (direction) WHERE precision IS NOT NULL OR note <> ''""")
def _(t):
    return sv.model_metrics(metrics(t))


def metrics(t):
    return t.card.filter("direction <> 'FIRE_RISK'").groupBy("direction", F.year("computed_at").alias("_y")).agg(
        F.max("computed_at").alias("evaluated_at"), F.round(F.avg("probability"), 6).alias("precision")).drop("_y")


@query("publish_metric", "direction:s precision:d", f"""
    SELECT direction, arg_max(precision, evaluated_at) AS precision FROM ({METRIC_SQL}) WHERE direction <> 'FLOOD_RISK' GROUP BY 1 UNION ALL SELECT 'FLOOD_RISK', round(avg(probability), 6) FROM card WHERE direction = 'FLOOD_RISK'""")
def _(t):
    stored = sv.latest_per_key(metrics(t), ("direction",), "evaluated_at")
    fresh = t.card.filter("direction = 'FLOOD_RISK'").groupBy("direction").agg(F.max("computed_at").alias("evaluated_at"), F.round(F.avg("probability"), 6).alias("precision"))
    return sv.publish_metric(stored, fresh.select(*stored.columns))


RUNS_SQL = """
    SELECT o_orderkey AS run_id, CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 24) * INTERVAL 1 HOUR + (o_orderkey % 60) * INTERVAL 1 MINUTE + (o_custkey % 60) * INTERVAL 1 SECOND AS started_at,
           CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 24) * INTERVAL 1 HOUR + (o_orderkey % 60 + 1) * INTERVAL 1 MINUTE + (o_custkey % 60) * INTERVAL 1 SECOND AS finished_at, o_custkey AS duration_ms,
           CASE WHEN o_orderstatus = 'F' THEN 'RUNNING' ELSE 'DONE' END AS status, o_orderkey % 3 AS stream_events, o_custkey * 10 AS stream_lag_ms FROM orders"""


def runs(t):
    return t.spark.sql(RUNS_SQL.replace("FROM orders", "FROM {o}"), o=t.orders)


@query("run_health", "last_run_at:t last_run_ms:i max_compute_ms:i min_horizon_hours:i stream_lag_ms:i stream_events:i", f"""
    WITH r AS ({RUNS_SQL}), l AS (SELECT finished_at AS at, duration_ms FROM r WHERE status = 'DONE' ORDER BY started_at DESC LIMIT 1),
    s AS (SELECT r.stream_lag_ms, r.stream_events FROM r JOIN l ON r.started_at >= l.at - INTERVAL 1 HOUR WHERE status = 'DONE' AND stream_events > 0 ORDER BY started_at DESC LIMIT 1)
    SELECT l.at AS last_run_at, duration_ms AS last_run_ms, (SELECT coalesce(max(compute_ms), 0) FROM card WHERE computed_at >= l.at - INTERVAL 24 HOUR) AS max_compute_ms, (SELECT coalesce(min(horizon_hours), 0) FROM card WHERE computed_at >= l.at - INTERVAL 24 HOUR) AS min_horizon_hours,
      (SELECT stream_lag_ms FROM s) AS stream_lag_ms, coalesce((SELECT stream_events FROM s), 0) AS stream_events FROM l""")
def _(t):
    return sv.run_health(runs(t), t.card)


SIG_SQL = "SELECT channel_id % 60 AS facility_id, channel_id AS sensor_id, ts FROM fire_signal"


def signals(t):
    return t.fire_signal.select((F.col("channel_id") % 60).alias("facility_id"), F.col("channel_id").alias("sensor_id"), "ts")


@query("sensor_table", "facility_id:i sensor_id:i signals:i last:t bucket_0:i bucket_5:i", f"""
    SELECT s.facility_id, s.sensor_id, count(e.ts) AS signals, max(e.ts) AS last, count(*) FILTER (e.ts > TIMESTAMP '{AT}' - INTERVAL 24 HOUR AND e.ts <= TIMESTAMP '{AT}' - INTERVAL 20 HOUR) AS bucket_0, count(*) FILTER (e.ts > TIMESTAMP '{AT}' - INTERVAL 4 HOUR) AS bucket_5
    FROM (SELECT DISTINCT facility_id, sensor_id FROM ({SIG_SQL})) s LEFT JOIN ({SIG_SQL}) e ON e.sensor_id = s.sensor_id AND e.ts >= TIMESTAMP '{AT}' - INTERVAL 24 HOUR AND e.ts < TIMESTAMP '{AT}' GROUP BY 1, 2""")
def _(t):
    return sv.sensor_table(signals(t).select("facility_id", "sensor_id").distinct(), signals(t), AT)


@query("hourly_temperature_ffill", "facility_id:i hour:t v:d", f"""
    WITH r AS (SELECT channel_id % 60 AS facility_id, channel_id % 60 % 10 AS col, hour AS h, value FROM journal WHERE event_type = 'purchase' AND channel_id % 60 % 4 <> 0 AND ts >= TIMESTAMP '{AT}' - INTERVAL 8 DAY AND ts < TIMESTAMP '{AT}'),
    u AS (SELECT DISTINCT channel_id % 60 AS facility_id, channel_id % 60 % 10 AS col FROM journal), k AS (SELECT facility_id, h, max(value) AS v FROM r GROUP BY 1, 2
      UNION ALL SELECT u.facility_id, h, max(value) FROM u JOIN r ON r.col = u.col WHERE u.facility_id NOT IN (SELECT facility_id FROM r) GROUP BY 1, 2),
    g AS (SELECT facility_id, unnest(generate_series(TIMESTAMP '{AT}' - INTERVAL 24 HOUR, TIMESTAMP '{AT}' - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS hour FROM (SELECT DISTINCT facility_id FROM k))
    SELECT g.facility_id, g.hour, k.v FROM g ASOF JOIN k ON k.facility_id = g.facility_id AND k.h <= g.hour""")
def _(t):
    readings = t.journal.filter("event_type = 'purchase' AND channel_id % 60 % 4 <> 0").select(
        (F.col("channel_id") % 60).alias("facility_id"), (F.col("channel_id") % 60 % 10).alias("collector"), "ts", "value")
    units = t.journal.select((F.col("channel_id") % 60).alias("facility_id"), (F.col("channel_id") % 60 % 10).alias("collector")).distinct()
    return sv.hourly_temperature(units, readings, AT)


@query("hourly_signal_counts", "facility_id:i bin:i n:i", f"""
    SELECT u.facility_id, b.bin, count(e.ts) AS n FROM (SELECT DISTINCT facility_id FROM ({SIG_SQL})) u CROSS JOIN (SELECT unnest(generate_series(0, 23)) AS bin) b
    LEFT JOIN ({SIG_SQL}) e ON e.facility_id = u.facility_id AND e.ts >= TIMESTAMP '{AT}' - INTERVAL 24 HOUR + b.bin * INTERVAL 1 HOUR AND e.ts < TIMESTAMP '{AT}' - INTERVAL 24 HOUR + (b.bin + 1) * INTERVAL 1 HOUR GROUP BY 1, 2""")
def _(t):
    return sv.hourly_signal_counts(signals(t).select("facility_id").distinct(), signals(t), AT)


@query("timeline", "facility_id:i sensor_id:i ts:t burst:b", f"""
    SELECT channel_id % 10 AS facility_id, channel_id AS sensor_id, ts, CAST(nb > 2 AS INT) AS burst FROM ({NB_SQL.format(m=60)}) WHERE channel_id % 10 = 7 AND ts >= TIMESTAMP '{AT}' - INTERVAL 24 HOUR AND ts < TIMESTAMP '{AT}' ORDER BY ts DESC, channel_id LIMIT 40""")
def _(t):
    marked = burst_neighbours(t.fire_signal).select((F.col("channel_id") % 10).alias("facility_id"), F.col("channel_id").alias("sensor_id"), "ts", "nb")
    return sv.timeline(marked, 7, AT)


@query("daily_counts_zero_filled", "facility_id:i i:i n:i", f"""
    SELECT u.facility_id, d.i, count(e.ts) AS n FROM (SELECT DISTINCT facility_id FROM ({SIG_SQL})) u CROSS JOIN (SELECT unnest(generate_series(0, 9)) AS i) d
    LEFT JOIN ({SIG_SQL}) e ON e.facility_id = u.facility_id AND e.ts < TIMESTAMP '{AT}' AND e.ts >= TIMESTAMP '2024-01-19 21:00:00' + d.i * INTERVAL 1 DAY AND e.ts < TIMESTAMP '2024-01-19 21:00:00' + (d.i + 1) * INTERVAL 1 DAY GROUP BY 1, 2""")
def _(t):
    return sv.daily_counts(signals(t), signals(t), AT, days=10)


@query("first_non_empty_series", "unit_id:i day:D v:i", """
    WITH s AS (SELECT unit_id, day, CASE WHEN unit_id % 4 = 0 THEN 0 ELSE m END AS v FROM unit_event), f AS (SELECT day, sum(m) AS v FROM unit_event GROUP BY day)
    SELECT * FROM s WHERE unit_id IN (SELECT unit_id FROM s GROUP BY 1 HAVING max(v) <> 0) UNION ALL SELECT u.unit_id, f.day, f.v FROM (SELECT unit_id FROM s GROUP BY 1 HAVING max(v) = 0) u CROSS JOIN f""")
def _(t):
    from undercroft.operators.grids import first_non_empty

    rows = t.unit_event
    own = rows.select("unit_id", "day", F.when(F.col("unit_id") % 4 == 0, 0).otherwise(F.col("m")).alias("v"))
    return first_non_empty(own, rows.groupBy("day").agg(F.sum("m").alias("v")), ("unit_id",))


@query("eligible_units", "facility_id:i", """
    SELECT facility_id FROM (SELECT DISTINCT channel_id % 60 AS facility_id FROM journal) u WHERE facility_id % 3 <> 1 AND (EXISTS (SELECT 1 FROM journal j WHERE j.channel_id % 60 = u.facility_id AND j.channel_id % 7 = 0) OR EXISTS (SELECT 1 FROM journal j WHERE j.channel_id % 60 = u.facility_id AND j.event_type = 'error' AND j.value > 150))""")
def _(t):
    f = (F.col("channel_id") % 60).alias("facility_id")
    kind = t.journal.select(f).distinct().withColumn("kind", F.when(F.col("facility_id") % 3 == 1, "object").otherwise("section"))
    sensors = t.journal.filter("channel_id % 7 = 0").select(f, F.lit("CONTACT").alias("sensor_type"))
    events = t.journal.filter("event_type = 'error' AND value > 150").select(f, F.lit("DOOR_OPEN").alias("code"))
    return sv.eligible_units(kind, sensors, events, ("CONTACT",), ("DOOR_OPEN",), only_kind="section")
