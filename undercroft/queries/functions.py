"""Scalar operators on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from undercroft.functions import calendar as cal
from undercroft.functions import cards as cd
from undercroft.functions import clock as ck
from undercroft.functions import mapping as mp
from undercroft.operators import journal as jr
from undercroft.operators.neighbours import nearest_district
from undercroft.queries.base import query

PLACE_SQL = r"'ПК\s?(\d+)(?:\s?[Гг]\s?(\d+)\s?ПК\s?(\d+))?(?:\s?\+\s?(\d+(?:[.,]\d+)?))?'"


@query("parse_place", "cid:i picket:i offset_m:d gallery:i", f"""
    SELECT cid, CASE WHEN g <> '' THEN CAST(nullif(gp, '') AS INT) ELSE CAST(nullif(p, '') AS INT) END AS picket,
           CASE WHEN p = '' THEN NULL WHEN g <> '' THEN 0.0 ELSE coalesce(CAST(replace(nullif(o, ''), ',', '.') AS DOUBLE), 0.0) END AS offset_m,
           CASE WHEN p = '' THEN NULL ELSE coalesce(CAST(nullif(g, '') AS INT), -1) END AS gallery
    FROM (SELECT cid, regexp_extract(name, {PLACE_SQL}, 1) AS p, regexp_extract(name, {PLACE_SQL}, 2) AS g,
                 regexp_extract(name, {PLACE_SQL}, 3) AS gp, regexp_extract(name, {PLACE_SQL}, 4) AS o FROM channel_name)""")
def _(t):
    return mp.with_place(t.channel_name)


@query("chainage_m", "cid:i chainage:d", f"""
    SELECT cid, CASE WHEN g <> '' THEN CAST(gp AS DOUBLE) * 10 ELSE CAST(p AS DOUBLE) * 10 + coalesce(CAST(replace(nullif(o, ''), ',', '.') AS DOUBLE), 0) END AS chainage
    FROM (SELECT cid, regexp_extract(name, {PLACE_SQL}, 1) AS p, regexp_extract(name, {PLACE_SQL}, 2) AS g,
                 regexp_extract(name, {PLACE_SQL}, 3) AS gp, regexp_extract(name, {PLACE_SQL}, 4) AS o FROM channel_name) WHERE p <> ''""")
def _(t):
    return mp.with_place(t.channel_name).filter("picket IS NOT NULL").select(
        "cid", mp.chainage_m("picket", "offset_m").alias("chainage"))


CODE_SQL = """
    CASE WHEN stype = 'КД Дверь' AND value = 'Не замкнут' AND flag THEN 'DOOR_OPEN'
         WHEN stype = 'Датчик движения' AND value = 'Обнаружено движение' AND flag THEN 'MOTION'
         WHEN stype = 'Состояние охраны' AND value = 'На охране' THEN 'SECURITY_ARMED'
         WHEN stype = 'Состояние охраны' AND value = 'Снято с охраны' THEN 'SECURITY_DISARMED'
         WHEN stype = 'Состояние насоса' AND value = 'Затоплен' AND flag THEN 'FLOODED'
         WHEN stype = 'Датчик затопления' AND value = 'Не замкнут' AND flag THEN 'FLOOD_SENSOR_OPEN'
         WHEN stype = 'Состояние насоса' AND value = 'Включен' THEN 'PUMP_ON'
         WHEN stype = 'Состояние насоса' AND value = 'Выключен' THEN 'PUMP_OFF'
         WHEN stype = 'Состояние насоса' AND value IN ('Обесточен', 'Неисправен', 'Отключено устройство') THEN 'PUMP_UNAVAILABLE'
         WHEN stype = 'Датчик дыма' AND value = 'Обнаружен дым' AND flag THEN 'SMOKE_DETECTED' END"""
FLAG_SQL = "SELECT *, lower(trim(alarm)) IN ('t', 'true', '1', 'да') AS flag FROM raw_journal"


@query("event_code", "event_id:i code:s", f"SELECT event_id, {CODE_SQL} AS code FROM ({FLAG_SQL})")
def _(t):
    return t.raw_journal.withColumn("alarm", mp.alarm_flag("alarm")).select("event_id", mp.event_code().alias("code"))


@query("event_code_counts", "stype:s code:s n:i", f"""
    SELECT stype, code, count(*) AS n FROM (SELECT stype, {CODE_SQL} AS code FROM ({FLAG_SQL})) WHERE code IS NOT NULL GROUP BY stype, code""")
def _(t):
    rows = t.raw_journal.withColumn("alarm", mp.alarm_flag("alarm")).select("stype", mp.event_code().alias("code"))
    return rows.filter("code IS NOT NULL").groupBy("stype", "code").agg(F.count(F.lit(1)).alias("n"))


@query("reading_value", "event_id:i metric:s number:d", """
    SELECT event_id, metric, CASE WHEN v BETWEEN lo AND hi AND v NOT IN (327.68, -100, 255) THEN v END AS number
    FROM (SELECT event_id, TRY_CAST(replace(value, ',', '.') AS DOUBLE) AS v,
                 CASE stype WHEN 'Датчик температуры' THEN 'temperature_c' ELSE 'methane_pct' END AS metric,
                 CASE stype WHEN 'Датчик температуры' THEN -60 ELSE 0 END AS lo, CASE stype WHEN 'Датчик температуры' THEN 150 ELSE 100 END AS hi
          FROM raw_journal WHERE stype IN ('Датчик температуры', 'Газовый датчик'))""")
def _(t):
    return t.raw_journal.filter(mp.metric().isNotNull()).select(
        "event_id", mp.metric().alias("metric"), mp.reading_value().alias("number"))


@query("alarm_flag", "event_id:i flag:b", f"SELECT event_id, CAST(flag AS INT) AS flag FROM ({FLAG_SQL})")
def _(t):
    return t.raw_journal.select("event_id", mp.alarm_flag("alarm").alias("flag"))


@query("local_time", "event_id:i local_ts:t local_day:D midnight:t", """
    SELECT event_id, ts + INTERVAL 3 HOUR AS local_ts, CAST(ts + INTERVAL 3 HOUR AS DATE) AS local_day,
           date_trunc('day', ts + INTERVAL 3 HOUR) - INTERVAL 3 HOUR AS midnight FROM journal""")
def _(t):
    return t.journal.select("event_id", ck.local_ts("ts").alias("local_ts"), ck.local_day("ts").alias("local_day"),
                            ck.local_midnight("ts").alias("midnight"))


@query("off_hours", "event_id:i off:b work:b night:b", """
    SELECT event_id, CAST(is_day_off = 1 OR hour(ts) < 6 OR hour(ts) >= 22 AS INT) AS off,
           CAST(is_day_off = 0 AND hour(ts) >= 8 AND hour(ts) < 16 AS INT) AS work, CAST(hour(ts) < 6 OR hour(ts) >= 22 AS INT) AS night
    FROM journal JOIN cal USING (day)""")
def _(t):
    return t.journal.join(F.broadcast(t.cal.select("day", "is_day_off")), "day").select(
        "event_id", ck.off_hours("ts", "is_day_off").alias("off"), ck.work_hours("ts", "is_day_off").alias("work"),
        ck.night("ts").alias("night"))


CAL_COLUMNS = ("is_holiday", "is_weekend", "is_school_vacation", "is_day_off", "day_of_week", "month", "quarter", "season",
               "day_of_month", "week_of_year", "day_of_year")


@query("calendar", "day:D " + " ".join(f"{c}:i" for c in CAL_COLUMNS) + " n_rows:i", f"""
    SELECT day, {', '.join(CAL_COLUMNS)}, n_rows FROM (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n_rows FROM lineitem GROUP BY 1)
    JOIN cal USING (day)""")
def _(t):
    days = t.lineitem.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("n_rows"))
    return days.join(t.cal, "day")


@query("day_off_chain", "day:D chain:i is_long_weekend:i run_chain:i", """
    SELECT day, day_off_chain AS chain, CASE WHEN day_off_chain >= 3 THEN 1 ELSE 0 END AS is_long_weekend, least(day_off_chain, 20) AS run_chain
    FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) JOIN cal USING (day)""")
def _(t):
    from undercroft.plans.vectors import day_off_run

    days = t.orders.select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.join(t.cal, "day").select(
        "day", F.col("day_off_chain").alias("chain"), "is_long_weekend",
        F.when(cal.is_day_off("day"), day_off_run(F.col("day"))).otherwise(0).alias("run_chain"))


@query("fireworks_day", "day:D fireworks:b", """
    SELECT day, CAST(month(day) * 100 + day(day) IN (1231, 101, 223, 509, 612, 1104)
           OR (month(day) = 9 AND isodow(day) = 6 AND day(day) <= 7) AS INT) AS fireworks
    FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)""")
def _(t):
    return t.orders.select(F.to_date("o_orderdate").alias("day")).distinct().select(
        "day", cal.is_fireworks_day("day").alias("fireworks"))


@query("moon_phase", "day:D moon_cos:d moon_sin:d", """
    SELECT day, cos(phase) AS moon_cos, sin(phase) AS moon_sin
    FROM (SELECT day, 2 * pi() * ((d / 29.530588853) - floor(d / 29.530588853)) AS phase
          FROM (SELECT day, epoch(CAST(day AS TIMESTAMP) - TIMESTAMP '2000-01-06 18:14:00') / 86400.0 AS d
                FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)))""")
def _(t):
    from undercroft.plans.hypotheses import moon_features

    return moon_features(t.orders.select(F.to_date("o_orderdate").alias("day")).distinct())


@query("unit_id", "cid:i unit:s", """
    SELECT cid, CASE WHEN cid % 5 = 0 THEN concat('O-', object_id)
                ELSE concat(CASE WHEN cid % 2 = 0 THEN 'S-' ELSE 'P-' END, object_id, '-', CASE WHEN gallery = -1 THEN '' ELSE concat('G', gallery, '-') END, picket) END AS unit
    FROM channels""")
def _(t):
    kind = F.when(F.col("cid") % 5 == 0, "object").when(F.col("cid") % 2 == 0, "section").otherwise("picket")
    return t.channels.select("cid", mp.unit_id(kind, "object_id", "gallery", "picket").alias("unit"))


@query("sensor_id_fanout", "cid:i facility_id:s sensor_id:s", """
    SELECT cid, facility_id, CASE WHEN count(*) OVER (PARTITION BY cid) > 1 THEN concat('C', cid, '-', facility_id) ELSE concat('C', cid) END AS sensor_id
    FROM (SELECT DISTINCT l_suppkey AS cid, concat('S-', l_partkey % 3 * (l_suppkey % 2)) AS facility_id FROM lineitem)""")
def _(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("cid"), F.concat(
        F.lit("S-"), (F.col("l_partkey") % 3 * (F.col("l_suppkey") % 2)).cast("string")).alias("facility_id")).distinct()
    return jr.sensors_of_units(rows)


@query("shift_whole_weeks", "event_id:i days:i shifted:t", """
    SELECT event_id, CAST(floor(epoch(TIMESTAMP '2026-03-03 10:00:00' - TIMESTAMP '2024-01-01') / 604800) * 7 AS INT) AS days,
           ts + CAST(floor(epoch(TIMESTAMP '2026-03-03 10:00:00' - TIMESTAMP '2024-01-01') / 604800) * 7 AS INT) * INTERVAL 1 DAY AS shifted FROM journal""")
def _(t):
    days = ck.whole_weeks_shift(F.lit("2026-03-03 10:00:00").cast("timestamp"), F.lit("2024-01-01").cast("timestamp"))
    return t.journal.withColumn("days", days).select("event_id", "days", ck.shift_days("ts", "days").alias("shifted"))


@query("point_on_polyline", "facility_id:i lon:d lat:d", """
    SELECT facility_id, CASE WHEN pos < 1 THEN lon + 3 * pos ELSE lon + 3 - 4 * (pos - 1) END AS lon,
           CASE WHEN pos < 1 THEN lat + 2 * pos ELSE lat + 2 + 4 * (pos - 1) END AS lat
    FROM (SELECT *, greatest(0.0, least(1.0, (facility_id % 13) / 10.0 - 0.1)) * 2 AS pos FROM facility)""")
def _(t):
    p = lambda x, y: F.struct((F.col("lon") + x).cast("double").alias("lon"), (F.col("lat") + y).cast("double").alias("lat"))
    line = F.array(p(0, 0), p(3, 2), p(-1, 6))
    at = cd.point_on_polyline(line, (F.col("facility_id") % 13) / 10.0 - 0.1)
    return t.facility.select("facility_id", at.alias("p")).select("facility_id", "p.lon", "p.lat")


DISTRICTS = (("NORTH", ((-180.0, 60.0), (0.0, 70.0), (180.0, 60.0))), ("SOUTH", ((-180.0, -60.0), (0.0, -70.0), (180.0, -60.0))),
             ("CENTRE", ((-60.0, 0.0), (60.0, 5.0))))


@query("nearest_district", "facility_id:i district:s", """
    SELECT facility_id, min_by(code, d * 10 + CASE code WHEN 'CENTRE' THEN 0.0 WHEN 'NORTH' THEN 0.0000001 ELSE 0.0000002 END) AS district
    FROM (SELECT facility_id, code, (x - lon) * (x - lon) + (y - lat) * (y - lat) AS d
          FROM facility JOIN (
            SELECT 'NORTH' AS code, -180 + 360 * s AS x, CASE WHEN s < 0.5 THEN 60 + 20 * s ELSE 70 - 20 * (s - 0.5) END AS y FROM (SELECT unnest(generate_series(0, 200)) / 200.0 AS s)
            UNION ALL SELECT 'SOUTH', -180 + 360 * s, CASE WHEN s < 0.5 THEN -60 - 20 * s ELSE -70 + 20 * (s - 0.5) END FROM (SELECT unnest(generate_series(0, 200)) / 200.0 AS s)
            UNION ALL SELECT 'CENTRE', -60 + 120 * s, 5 * s FROM (SELECT unnest(generate_series(0, 200)) / 200.0 AS s)) m ON true)
    GROUP BY facility_id""")
def _(t):
    here = F.struct(F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    return nearest_district(t.facility.select("facility_id", F.array(here).alias("line")), DISTRICTS)


@query("level_for", "prediction_id:i level:s level_order:i", """
    SELECT prediction_id, level, CASE level WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END AS level_order
    FROM (SELECT prediction_id, CASE direction
        WHEN 'FLOOD_RISK' THEN CASE WHEN p >= 0.3 THEN 'CRITICAL' WHEN p >= 0.092818 THEN 'HIGH' WHEN p >= 0.011471 THEN 'MEDIUM' ELSE 'LOW' END
        WHEN 'UNAUTHORIZED_ACCESS' THEN CASE WHEN p >= 0.3 THEN 'CRITICAL' WHEN p >= 0.140342 THEN 'HIGH' WHEN p >= 0.008183 THEN 'MEDIUM' ELSE 'LOW' END
        ELSE CASE WHEN p >= 0.78 THEN 'CRITICAL' WHEN p >= 0.55 THEN 'HIGH' WHEN p >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END END AS level
      FROM (SELECT prediction_id, direction, probability / 2 AS p FROM card WHERE direction <> 'FIRE_RISK' UNION ALL
            SELECT prediction_id, direction, probability FROM card WHERE direction = 'FIRE_RISK'))""")
def _(t):
    p = F.when(F.col("direction") == "FIRE_RISK", F.col("probability")).otherwise(F.col("probability") / 2)
    return t.card.select("prediction_id", cd.level_for(p, "direction").alias("level")).withColumn(
        "level_order", cd.level_order("level"))


@query("level_for_run_bands", "prediction_id:i level:s", """
    SELECT prediction_id, CASE WHEN probability >= 0.9 THEN 'CRITICAL' WHEN probability >= 0.7 THEN 'HIGH' WHEN probability >= 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM card""")
def _(t):
    from undercroft.operators.cards import assign_levels

    return assign_levels(t.card.drop("level"), (("MEDIUM", 0.2), ("HIGH", 0.7), ("CRITICAL", 0.9)))


@query("level_order", "level:s level_order:i n:i", """
    SELECT level, CASE level WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 0 END AS level_order, n
    FROM (SELECT coalesce(dispatcher_level, CASE WHEN prediction_id % 19 = 0 THEN 'OTHER' ELSE level END) AS level, count(*) AS n FROM card GROUP BY 1)""")
def _(t):
    named = F.coalesce("dispatcher_level", F.when(F.col("prediction_id") % 19 == 0, "OTHER").otherwise(F.col("level")))
    return t.card.groupBy(named.alias("level")).agg(F.count(F.lit(1)).alias("n")).withColumn("level_order", cd.level_order("level"))


@query("shap_weight", "event_id:i weight:d", "SELECT event_id, (exp(2 * x) - 1) / (exp(2 * x) + 1) AS weight FROM (SELECT event_id, (value - 60) / 40 / 2 AS x FROM events)")
def _(t):
    return t.events.select("event_id", cd.shap_weight((F.col("value") - 60) / 40).alias("weight"))


FACTOR_SQL = """
    SELECT l_orderkey AS card, l_partkey AS name, (l_quantity - 25) * l_discount / 8 AS contribution, l_linenumber FROM lineitem"""


@query("factors_filter", "card:i name:i line:i weight:d position:i", f"""
    SELECT card, name, l_linenumber AS line, weight, position
    FROM (SELECT *, row_number() OVER (PARTITION BY card ORDER BY abs(contribution) DESC, name, l_linenumber) AS position
          FROM (SELECT *, round((exp(contribution) - 1) / (exp(contribution) + 1), 6) AS weight
                FROM (SELECT card, name, min(l_linenumber) AS l_linenumber, sum(contribution) AS contribution FROM ({FACTOR_SQL}) GROUP BY card, name)))
    WHERE position <= 3 OR abs(weight) >= 0.02""")
def _(t):
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("card"), F.col("l_partkey").alias("name")).agg(
        F.min("l_linenumber").alias("line"), F.sum((F.col("l_quantity") - 25) * F.col("l_discount") / 8).alias("contribution"))
    return cd.factors_filter(rows, ("card",))


@query("relative_summary", "prediction_id:i summary:s", """
    SELECT prediction_id, CASE WHEN n < 2 THEN NULL WHEN r >= 1.25 THEN concat('Риск в ', CASE WHEN shown = floor(shown) THEN CAST(CAST(shown AS BIGINT) AS VARCHAR)
             ELSE replace(printf('%.1f', shown), '.', ',') END, CASE WHEN shown <> floor(shown) THEN ' раза' WHEN CAST(shown AS BIGINT) % 10 IN (2, 3, 4) AND CAST(shown AS BIGINT) % 100 NOT IN (12, 13, 14) THEN ' раза' ELSE ' раз' END, ' выше среднего по сети')
             WHEN r <= 0.8 THEN 'Риск ниже среднего по сети' ELSE 'Риск на уровне среднего по сети' END AS summary
    FROM (SELECT *, CASE WHEN r >= 10 THEN round_even(r, 0) ELSE round_even(r, 1) END AS shown
          FROM (SELECT prediction_id, probability * probability * probability / avg(probability * probability * probability) OVER (PARTITION BY direction, bucket) AS r,
                       count(*) OVER (PARTITION BY direction, bucket) AS n FROM card WHERE probability > 0))""")
def _(t):
    cards = t.card.filter("probability > 0").withColumn("probability", F.col("probability") * F.col("probability") * F.col("probability"))
    return cd.relative_summary(cards, ("direction", "bucket"))


@query("rate_from_nested_windows", "unit_id:i hours_back:d rate:d", """
    SELECT unit_id, hours_back, round_even(greatest(0.0, v) / days, 3) AS rate FROM (
      SELECT unit_id, 96.0 AS hours_back, CAST(w7 - w1 AS DOUBLE) AS v, 6.0 AS days FROM (SELECT unit_id, sum(m) AS w7, sum(CASE WHEN ev = 1 THEN m ELSE 0 END) AS w1 FROM unit_event GROUP BY unit_id)
      UNION ALL SELECT unit_id, 12.0, CAST(w1 AS DOUBLE), 1.0 FROM (SELECT unit_id, sum(CASE WHEN ev = 1 THEN m ELSE 0 END) AS w1 FROM unit_event GROUP BY unit_id))""")
def _(t):
    c = t.unit_event.groupBy("unit_id").agg(F.sum("m").alias("w7"), F.sum(F.when(F.col("ev") == 1, F.col("m")).otherwise(0)).alias("w1"))
    return c.select("unit_id", F.explode(cd.nested_rates(((168, "w7"), (24, "w1")))).alias("r")).select("unit_id", "r.*")


@query("hours_back", "order_id:i hours:d", """
    SELECT o_orderkey AS order_id, CASE WHEN o_custkey % 300 >= 24 * (o_orderkey % 12 + 1) THEN NULL ELSE o_custkey % 300 END AS hours FROM orders""")
def _(t):
    return t.orders.select(F.col("o_orderkey").alias("order_id"), cd.hours_back(F.col("o_custkey") % 300, F.col("o_orderkey") % 12).alias("hours"))


@query("json_feature", "event_id:i k:d missing:d", """
    SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k, 0.0 AS missing FROM events""")
def _(t):
    return t.events.select("event_id", cd.json_feature("props", "k").alias("k"), cd.json_feature("props", "zz").alias("missing"))


@query("tolerant_blocks", "event_id:i n:i type:s title:s data:s", """
    SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'factors' END AS type,
           CASE WHEN event_id % 5 = 0 THEN NULL ELSE '' END AS title, CASE WHEN event_id % 5 = 0 THEN NULL ELSE '{"v":1}' END AS data FROM events""")
def _(t):
    text = F.when(F.col("event_id") % 5 == 0, F.lit('{"not": "a list"}')).otherwise(
        F.lit('[{"type":"factors","data":{"v":1}}, 7, "text", {"title":"second"}]'))
    b = t.events.select("event_id", cd.tolerant_blocks(text).alias("b"))
    return b.select("event_id", F.size("b").alias("n"), F.get("b", F.lit(0))["type"].alias("type"),
                    F.get("b", F.lit(0))["title"].alias("title"), F.get("b", F.lit(0))["data"].alias("data"))


@query("audit_row", "entity_type:s entity_id:s action_code:s actor:s payload:s", """
    SELECT 'order' AS entity_type, CAST(order_id AS VARCHAR) AS entity_id, 'relink' AS action_code, 'pipeline' AS actor,
           concat('{"status":"', status, '"}') AS payload FROM work_order""")
def _(t):
    return t.work_order.select(cd.audit_row("order", "order_id", F.lit("relink"), F.lit("pipeline"), F.struct("status")).alias("r")).select("r.*")


@query("boundary_diff", "event_id:i minutes:i hours:i days:i", """
    SELECT event_id, date_diff('minute', a, ts) AS minutes, date_diff('hour', a, ts) AS hours, date_diff('day', a, ts) AS days
    FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY channel_id ORDER BY ts, event_id) AS a FROM journal) WHERE a IS NOT NULL""")
def _(t):
    from undercroft.operators.ordered import neighbour_row

    rows = neighbour_row(t.journal.select("event_id", "channel_id", "ts"), ["channel_id"], "ts", ["event_id"], {"a": F.col("ts")})
    return rows.filter("a IS NOT NULL").select("event_id", *[ck.boundary_diff(u, "a", "ts").alias(f"{u}s") for u in ("minute", "hour", "day")])
