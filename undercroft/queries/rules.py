"""Event-day features, water labels, fire facts and rules, the fire panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from undercroft import config
from undercroft.functions.clock import shift
from undercroft.functions.mapping import decimal
from undercroft.operators import intervals as iv
from undercroft.operators import labels as lb
from undercroft.operators import targets as tg
from undercroft.operators.neighbours import burst_neighbours
from undercroft.plans import fire, fire_rules
from undercroft.queries.base import query
from undercroft.queries.intervals import PUMP_HOUR_SQL
from undercroft.queries.neighbours import NB_SQL
from undercroft.session import scratch_path, stored
from undercroft.sources.stores import relabel_stored, write_labels

K = ("object_id", "gallery", "picket")
P = "object_id, gallery, picket"
SMOKE = "smoke"

# --- water event days -----------------------------------------------------------------

PDAY = f"SELECT {P}, CAST(hour AS DATE) AS day, sum(on_minutes) AS on_min, sum(n_changes) AS chg, sum(n_all_pumps) AS allp, sum(n_unavail) AS unavail FROM ph GROUP BY ALL"
WATER_SQL = f"""
    WITH ph AS (SELECT p.*, c.object_id, c.gallery, c.picket FROM ({PUMP_HOUR_SQL}) p JOIN (SELECT DISTINCT channel_id, object_id, gallery, picket FROM journal) c USING (channel_id)),
    pd AS ({PDAY}), nm AS (SELECT {P}, avg(on_min) AS mo, avg(chg) AS mc FROM pd WHERE day < DATE '2024-01-20' GROUP BY ALL),
    wx AS (SELECT day, sum(pr) OVER w AS p3, sum(melt) OVER w AS m3 FROM (SELECT CAST(hour AS DATE) AS day, sum(precip) AS pr, CAST(count(*) AS DOUBLE) / 7 AS melt FROM weather_hour GROUP BY 1) WINDOW w AS (ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
    sg AS (SELECT * FROM journal WHERE event_type IN ('error', 'click')),
    tm AS (SELECT {P}, day, min(ts) AS first_ts, date_diff('minute', min(ts), max(ts)) AS span, 1 + count(*) FILTER (gap > 30) AS n_ep FROM (SELECT *, date_diff('minute', lag(ts) OVER (PARTITION BY {P}, day ORDER BY ts), ts) AS gap FROM sg) GROUP BY ALL),
    d AS (SELECT {P}, day, count(DISTINCT hour) AS n_hours, count(*) AS n_moments, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS has_sensor, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS has_pump,
                 max(CASE WHEN hour(hour) >= 22 OR hour(hour) < 6 OR is_day_off = 1 THEN 1 ELSE 0 END) AS labeled FROM sg JOIN cal USING (day) GROUP BY ALL)
    SELECT d.object_id, d.gallery, d.picket, d.day, labeled, n_hours, n_moments, has_sensor, has_pump, coalesce(pd.on_min, 0) / greatest(coalesce(mo, 0), 1) AS pump_on_ratio, coalesce(pd.chg, 0) / greatest(coalesce(mc, 0), 1) AS pump_changes_ratio,
        coalesce(allp, 0) AS pump_all_running, coalesce(unavail, 0) AS pump_unavailable, (SELECT count(*) - 1 FROM d o WHERE o.object_id = d.object_id AND o.day = d.day) AS neighbour_units,
        CAST(EXISTS (SELECT 1 FROM d y WHERE y.object_id = d.object_id AND y.gallery = d.gallery AND y.picket = d.picket AND y.day = d.day - 1) AS INT) AS signal_yesterday, coalesce(p3, 0) AS precip_3d_mm, coalesce(m3, 0) AS melt_3d_cm,
        coalesce((SELECT sum(on_minutes) FROM ph WHERE ph.object_id = d.object_id AND ph.gallery = d.gallery AND ph.picket = d.picket AND ph.hour >= date_trunc('hour', first_ts) - INTERVAL 2 HOUR AND ph.hour < date_trunc('hour', first_ts)), 0) / greatest(coalesce(mo, 0) / 12, 1) AS pump_on_before_2h_ratio,
        coalesce((SELECT sum(on_minutes) FROM ph WHERE ph.object_id = d.object_id AND ph.gallery = d.gallery AND ph.picket = d.picket AND ph.hour >= date_trunc('hour', first_ts) AND ph.hour < date_trunc('hour', first_ts) + INTERVAL 2 HOUR), 0) / greatest(coalesce(mo, 0) / 12, 1) AS pump_on_after_2h_ratio,
        span AS span_minutes, n_ep AS n_episodes, (SELECT count(DISTINCT (r.gallery, r.picket)) FROM sg r WHERE r.object_id = d.object_id AND (r.gallery <> d.gallery OR r.picket <> d.picket) AND r.ts BETWEEN first_ts - INTERVAL 1 HOUR AND first_ts + INTERVAL 1 HOUR) AS other_units_within_1h
    FROM d JOIN tm USING ({P}, day) LEFT JOIN pd USING ({P}, day) LEFT JOIN nm USING ({P}) LEFT JOIN wx ON wx.day = d.day"""
WATER_SPEC = "object_id:i gallery:i picket:i day:D labeled:i n_hours:i n_moments:i has_sensor:i has_pump:i pump_on_ratio:d pump_changes_ratio:d pump_all_running:i pump_unavailable:i neighbour_units:i signal_yesterday:i precip_3d_mm:d melt_3d_cm:d pump_on_before_2h_ratio:d pump_on_after_2h_ratio:d span_minutes:i n_episodes:i other_units_within_1h:i"


def water_days(t, norm_days=None):
    signals = t.journal.filter("event_type IN ('error', 'click')")
    kind = lambda k: (F.col("event_type") == k).cast("int")
    hours = signals.groupBy(*K, "hour").agg(F.count(F.lit(1)).alias("n_moments"), F.max(kind("error")).alias("from_sensor"), F.max(kind("click")).alias("from_pump"))
    places = t.journal.select("channel_id", *K).distinct()
    pumps = stored(iv.pump_hours(t.pump_rows).join(places, "channel_id"))
    weather = t.weather_hour.groupBy(F.to_date("hour").alias("day")).agg(F.sum("precip").alias("precip_mm"), (F.count(F.lit(1)) / 7).alias("melt_cm"))
    return lb.water_event_features(hours, signals, pumps, weather, t.cal, "2024-01-20", norm_days=norm_days)


@query("water_event_features", WATER_SPEC, WATER_SQL)
def _(t):
    return water_days(t)


NORM_SQL = f"nm AS (SELECT {P}, avg(on_min) AS mo, avg(chg) AS mc FROM pd WHERE day < DATE '2024-01-20' GROUP BY ALL),"
OWN_NORM_SQL = "nm AS (SELECT d.object_id, d.gallery, d.picket, d.day, avg(pd.on_min) AS mo, avg(pd.chg) AS mc FROM d JOIN pd ON pd.object_id = d.object_id AND pd.gallery = d.gallery AND pd.picket = d.picket AND pd.day < d.day AND pd.day >= d.day - 365 GROUP BY ALL)"


@query("water_event_features_own_norm", WATER_SPEC, WATER_SQL.replace(NORM_SQL, "").replace("FROM sg JOIN cal USING (day) GROUP BY ALL)", f"FROM sg JOIN cal USING (day) GROUP BY ALL), {OWN_NORM_SQL}").replace(f"LEFT JOIN nm USING ({P})", f"LEFT JOIN nm USING ({P}, day)"))
def _(t):
    return water_days(t, norm_days=365)


@query("water_label_rule", "object_id:i gallery:i picket:i day:D is_labelled:b is_water:b p_water:d", f"""
    SELECT object_id, gallery, picket, day, labeled AS is_labelled, CASE WHEN labeled = 1 OR p >= 0.6 THEN 1 ELSE 0 END AS is_water, CASE WHEN labeled = 1 THEN 1.0 ELSE p END AS p_water
    FROM (SELECT *, CASE WHEN n_moments % 4 <> 0 THEN least(n_hours / 3.0, 1.0) END AS p FROM ({WATER_SQL}))""")
def _(t):
    p = F.when(F.col("n_moments") % 4 != 0, F.least(F.col("n_hours") / 3.0, F.lit(1.0)))
    days = water_days(t).withColumn("night", F.col("labeled") == 1).withColumn("day_off", F.lit(False)).withColumn("p_water", p)
    return lb.water_label_rule(days, 0.6)


RELABEL_SQL = """
    SELECT unit_id, day, CASE WHEN day >= DATE '2000-06-29' AND day < DATE '2000-07-10' THEN 1 - ev ELSE ev END AS ev FROM unit_event WHERE day < DATE '2000-07-10'"""


@query("incremental_relabel", "unit_id:i day:D ev:i", RELABEL_SQL)
def _(t):
    stored = t.unit_event.filter("day < DATE '2000-07-01'").select("unit_id", "day", "ev")
    return lb.relabel(stored, t.unit_event.withColumn("ev", 1 - F.col("ev")), "2000-07-10")


@query("incremental_relabel_stored", "unit_id:i day:D ev:i", RELABEL_SQL)
def _(t):
    path = scratch_path(t.spark, "labels")
    write_labels(t.unit_event.filter("day < DATE '2000-07-01'").select("unit_id", "day", "ev"), path)
    relabel_stored(t.spark, path, t.unit_event.select("unit_id", "day", (1 - F.col("ev")).alias("ev")), "2000-07-10")
    return t.spark.read.parquet(path)


@query("label_acceptance", "volume:i week_ratio:d kept_known:d passes_volume:b passes_week:b passes_known:b", """
    WITH g AS (SELECT unit_id, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT unit_id, min(day) AS lo, max(day) AS hi FROM unit_event GROUP BY 1)),
    s AS (SELECT unit_id, day, y AS labeled, y = 1 OR p >= 0.8 AS "real" FROM scored WHERE day < DATE '2000-07-01')
    SELECT v AS volume, r AS week_ratio, k AS kept_known, CAST(v >= 1000 AS INT) AS passes_volume, CAST(r BETWEEN 1 / 1.5 AND 1.5 AS INT) AS passes_week, CAST(k >= 0.8 AS INT) AS passes_known FROM (
      SELECT (SELECT count(*) FROM s WHERE "real") AS v, (SELECT avg(CASE WHEN "real" THEN 1 ELSE 0 END) FROM s WHERE labeled = 1 AND day >= DATE '1999-07-01') AS k,
             (SELECT avg(CASE WHEN s.day IS NULL THEN 0 ELSE 1 END) FILTER (is_day_off = 0) / avg(CASE WHEN s.day IS NULL THEN 0 ELSE 1 END) FILTER (is_day_off = 1) FROM g JOIN cal USING (day) LEFT JOIN (SELECT * FROM s WHERE "real") s USING (unit_id, day) WHERE g.day < DATE '2000-07-01') AS r)""")
def _(t):
    from undercroft.queries.targets import life

    marked = t.scored.withColumn("labeled", F.col("y")).withColumn("real", (F.col("y") == 1) | (F.col("p") >= 0.8))
    return lb.label_acceptance(marked, life(t), ("unit_id",), "2000-07-01", ("1999-07-01", "2000-07-01"))


# --- fire event days and facts ----------------------------------------------------------


def fire_days(t):
    signals = t.fire_signal
    faults = t.journal.filter("event_type = 'signup'").groupBy(*K, "day").agg(F.count(F.lit(1)).alias("n"))
    units = t.journal.groupBy(*K).agg(F.min("day").alias("hour_from"), F.max("day").alias("hour_to"))
    alive = fire.alive_units(units, signals)
    return lb.fire_event_features(signals, faults, alive, t.cal, {"smoke": "smoke", "heat": "heat", "temp": "none"})


@query("fire_event_features", "object_id:i gallery:i picket:i day:D labeled:i n_moments:i n_hours:i n_channels:i has_smoke:i has_heat:i has_temp:i span_minutes:i n_episodes:i object_units_share:d other_units_within_1h_share:d walk_gap_minutes:d faults_same_day:i signal_yesterday:i", f"""
    WITH tm AS (SELECT {P}, day, min(ts) AS first_ts, date_diff('minute', min(ts), max(ts)) AS span, 1 + count(*) FILTER (gap > 30) AS n_ep, count(*) AS n_moments, count(DISTINCT hour(ts)) AS n_hours, count(DISTINCT channel_id) AS n_channels,
        max(CASE WHEN stype = 'smoke' THEN 1 ELSE 0 END) AS has_smoke, max(CASE WHEN stype = 'heat' THEN 1 ELSE 0 END) AS has_heat, max(CASE WHEN hour(ts) >= 22 OR hour(ts) < 6 OR is_day_off = 1 THEN 1 ELSE 0 END) AS labeled
        FROM (SELECT f.*, is_day_off, date_diff('minute', lag(ts) OVER (PARTITION BY {P}, f.day ORDER BY ts), ts) AS gap FROM fire_signal f JOIN cal ON cal.day = f.day) GROUP BY ALL),
    wk AS (SELECT object_id, day, count(*) AS n, coalesce(median(step), 1440) AS gap FROM (SELECT *, date_diff('minute', lag(first_ts) OVER (PARTITION BY object_id, day ORDER BY first_ts), first_ts) AS step FROM tm) GROUP BY 1, 2),
    un AS (SELECT {P}, min(day) AS lo, max(day) AS hi FROM journal GROUP BY ALL)
    SELECT tm.object_id, tm.gallery, tm.picket, tm.day, labeled, n_moments, n_hours, n_channels, has_smoke, has_heat, 0 AS has_temp, span AS span_minutes, n_ep AS n_episodes, (wk.n - 1) / greatest(alive, 1) AS object_units_share,
        (SELECT count(DISTINCT (r.gallery, r.picket)) FROM fire_signal r WHERE r.object_id = tm.object_id AND (r.gallery <> tm.gallery OR r.picket <> tm.picket) AND r.ts BETWEEN first_ts - INTERVAL 1 HOUR AND first_ts + INTERVAL 1 HOUR) / greatest(alive, 1) AS other_units_within_1h_share,
        wk.gap AS walk_gap_minutes, (SELECT count(*) FROM journal j WHERE j.event_type = 'signup' AND j.object_id = tm.object_id AND j.gallery = tm.gallery AND j.picket = tm.picket AND j.day = tm.day) AS faults_same_day,
        CAST(EXISTS (SELECT 1 FROM tm y WHERE y.object_id = tm.object_id AND y.gallery = tm.gallery AND y.picket = tm.picket AND y.day = tm.day - 1) AS INT) AS signal_yesterday
    FROM tm JOIN wk USING (object_id, day) CROSS JOIN LATERAL (SELECT count(*) AS alive FROM un WHERE un.object_id = tm.object_id AND tm.day BETWEEN un.lo AND un.hi)""")
def _(t):
    return fire_days(t)


EVENT_DAY_SQL = f"""
    SELECT {P}, day, count(*) FILTER (nb <= 2) AS m_ev, count(*) FILTER (nb > 2) AS m_chk, date_diff('minute', max(ts) FILTER (nb <= 2), CAST(day AS TIMESTAMP) + INTERVAL 1 DAY) AS ev_to_midnight, count(DISTINCT channel_id) FILTER (nb <= 2) AS ev_channels
    FROM ({NB_SQL.format(m=60)}) GROUP BY {P}, day"""


@query("event_day", "object_id:i gallery:i picket:i day:D m_ev:i m_chk:i ev_to_midnight:i ev_channels:i", EVENT_DAY_SQL)
def _(t):
    return fire.event_day(t.fire_signal, ts="ts")


FACT_SQL = f"""
    WITH s AS (SELECT a.*, CASE WHEN a.stype = 'smoke' THEN 1 ELSE 0 END AS sm,
        (SELECT count(*) FROM fire_signal r WHERE r.object_id = a.object_id AND r.gallery = a.gallery AND r.picket <> a.picket AND abs(r.picket - a.picket) <= 5 AND r.ts BETWEEN a.ts - INTERVAL 30 MINUTE AND a.ts + INTERVAL 30 MINUTE) AS near30,
        (SELECT count(*) FROM fire_signal r WHERE a.stype = 'smoke' AND r.stype <> 'smoke' AND r.object_id = a.object_id AND r.gallery = a.gallery AND abs(r.picket - a.picket) <= 5 AND r.ts BETWEEN a.ts - INTERVAL 60 MINUTE AND a.ts + INTERVAL 60 MINUTE) AS heat60
        FROM ({NB_SQL.format(m=180)}) a),
    born AS (SELECT channel_id, object_id, min(day) AS born FROM journal GROUP BY 1, 2), ob AS (SELECT object_id, min(born) AS born FROM born GROUP BY 1),
    tmp AS (SELECT object_id, hour, max(value) AS v FROM journal WHERE event_type = 'purchase' GROUP BY 1, 2),
    tn AS (SELECT a.object_id, a.hour, a.v - (SELECT median(b.v) FROM tmp b WHERE b.object_id = a.object_id AND b.hour >= a.hour - INTERVAL 30 DAY AND b.hour <= a.hour - INTERVAL 1 HOUR) AS rise FROM tmp a),
    off AS (SELECT DISTINCT complex_id, hour FROM journal WHERE event_type = 'signup' AND event_id % 9 = 0),
    ep AS (SELECT s.object_id, s.complex_id, s.gallery, s.picket, s.day, min(ts) FILTER (nb <= 2) AS m, bool_or(nb <= 2) AS signal, bool_and(nb > 2) AS burst_only, bool_or(nb <= 2 AND sm = 1) AS smoke, bool_or(nb <= 2 AND near30 > 0) AS spread, bool_or(nb <= 2 AND heat60 > 0) AS heat_independent,
        bool_or(nb <= 2 AND (is_day_off = 1 OR hour(ts) < 6 OR hour(ts) >= 22)) AS off_hours, max(date_diff('day', b.born, s.day)) FILTER (nb <= 2) AS sensor_age FROM s JOIN cal ON cal.day = s.day JOIN born b ON b.channel_id = s.channel_id GROUP BY 1, 2, 3, 4, 5),
    f AS (SELECT ep.*, EXISTS (SELECT 1 FROM s w WHERE w.nb > 2 AND w.object_id = ep.object_id AND w.day = ep.day) AS walk, date_diff('day', ob.born, ep.day) AS object_age, ob.born >= DATE '2024-01-02' AS known,
        coalesce((SELECT max(rise) FROM tn WHERE tn.object_id = ep.object_id AND tn.hour BETWEEN date_trunc('hour', m) - INTERVAL 2 HOUR AND date_trunc('hour', m) + INTERVAL 2 HOUR), 0) AS rise,
        EXISTS (SELECT 1 FROM off WHERE off.complex_id = ep.complex_id AND off.hour BETWEEN date_trunc('hour', m) - INTERVAL 1 HOUR AND date_trunc('hour', m) + INTERVAL 1 HOUR) AS off FROM ep JOIN ob ON ob.object_id = ep.object_id),
    g AS (SELECT object_id, gallery, picket, day, m, signal, burst_only, smoke, spread, heat_independent, CASE WHEN signal THEN rise ELSE 0 END AS temp_rise_c, off_hours AND NOT walk AS off_hours_no_walk, off AND signal AS power_off,
        signal AND coalesce(sensor_age, 0) < 15 AS sensor_cooling, known AND object_age < 180 AS object_cooling, CASE WHEN signal AND coalesce(sensor_age, 0) < 15 THEN 15 - coalesce(sensor_age, 0) WHEN known AND object_age < 180 THEN 180 - object_age ELSE 0 END AS cooling_days_left FROM f)"""
FACT_SPEC = "object_id:i gallery:i picket:i day:D m:t signal:b burst_only:b smoke:b spread:b heat_independent:b temp_rise_c:d off_hours_no_walk:b power_off:b sensor_cooling:b object_cooling:b cooling_days_left:i"
INTS = "object_id, gallery, picket, day, m, CAST(signal AS INT) AS signal, CAST(burst_only AS INT) AS burst_only, CAST(smoke AS INT) AS smoke, CAST(spread AS INT) AS spread, CAST(heat_independent AS INT) AS heat_independent, temp_rise_c, CAST(off_hours_no_walk AS INT) AS off_hours_no_walk, CAST(power_off AS INT) AS power_off, CAST(sensor_cooling AS INT) AS sensor_cooling, CAST(object_cooling AS INT) AS object_cooling, cooling_days_left"


MAINTENANCE_SQL = 'SELECT object_id, DATE \'2024-01-08\' + CAST(object_id % 5 AS INT) AS "start", DATE \'2024-01-10\' + CAST(object_id % 5 AS INT) AS "end" FROM (SELECT DISTINCT object_id FROM journal) o WHERE object_id % 4 = 3'


def facts(t, gas=None, maintenance=None):
    births = t.journal.groupBy("channel_id", "object_id").agg(F.min("day").alias("born"))
    temps = t.journal.filter("event_type = 'purchase'").groupBy("object_id", "hour").agg(F.max("value").alias("v"))
    off = t.journal.filter("event_type = 'signup' AND event_id % 9 = 0").select("complex_id", "hour").distinct()
    return fire_rules.fire_facts(t.fire_signal, births, temps, off, t.journal.select("object_id", "complex_id").distinct(), t.cal, SMOKE, "2024-01-02", minutes=180, gas=gas, maintenance=maintenance)


@query("fire_facts", f"{FACT_SPEC} gas_pct:d gas_off_hours:b", f"""
    {FACT_SQL}, gr AS (SELECT object_id % 3 AS complex_id, r.day AS gas_day, v, ts, is_day_off = 1 OR hour(ts) < 8 OR hour(ts) >= 16 AS off
        FROM (SELECT *, TRY_CAST(replace(value, ',', '.') AS DOUBLE) AS v FROM raw_journal WHERE stype = '{config.GAS_TYPE}') r JOIN cal ON cal.day = r.day
        WHERE v BETWEEN 0 AND 100 AND NOT EXISTS (SELECT 1 FROM ({MAINTENANCE_SQL}) w WHERE w.object_id = r.object_id AND r.day BETWEEN w."start" AND w."end")),
    gt AS (SELECT complex_id, gas_day, max(v) AS top, arg_max(off, (v, ts)) AS top_off FROM gr GROUP BY 1, 2)
    SELECT {INTS}, coalesce(top, 0) AS gas_pct, CAST(coalesce(top_off, false) AS INT) AS gas_off_hours FROM g LEFT JOIN gt ON gt.complex_id = g.object_id % 3 AND gt.gas_day = g.day""")
def _(t):
    gas = t.raw_journal.filter(F.col("stype") == config.GAS_TYPE).select("object_id", "ts", decimal("value").alias("v"))
    first = F.lit("2024-01-08").cast("date")
    shifted = (F.col("object_id") % 5).cast("int")
    maintenance = t.journal.filter("object_id % 4 = 3").select(
        "object_id", F.date_add(first, shifted).alias("start"), F.date_add(first, shifted + 2).alias("end")).distinct()
    return facts(t, gas, maintenance)


LEVEL_SQL = f"""
    {FACT_SQL}, h AS (SELECT *, CASE WHEN signal THEN CAST(spread AS INT) + CAST(heat_independent AS INT) + CAST(temp_rise_c >= 10 AS INT) + CAST(off_hours_no_walk AS INT) ELSE 0 END AS signs, (smoke AND heat_independent) OR (spread AND (heat_independent OR temp_rise_c >= 10)) AS worst FROM g),
    l AS (SELECT *, CASE WHEN NOT signal THEN 1 WHEN worst THEN 4 ELSE greatest(1, CASE WHEN spread OR signs >= 3 THEN 3 WHEN off_hours_no_walk THEN 2 ELSE 1 END - CASE WHEN sensor_cooling OR object_cooling THEN 1 ELSE 0 END) END AS lv FROM h)"""


@query("fire_level", "object_id:i gallery:i picket:i day:D level:s signs:i tag:s", f"""
    {LEVEL_SQL} SELECT object_id, gallery, picket, day, CASE lv WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' ELSE 'CRITICAL' END AS level, signs,
      CASE WHEN NOT signal AND burst_only THEN 'обход' WHEN NOT signal THEN '' WHEN worst THEN 'признаки пожара' ELSE 'одиночный сигнал' END AS tag FROM l""")
def _(t):
    return fire_rules.grade(facts(t))


@query("next_day_rate", "level:s n:i rate:d", f"""
    {LEVEL_SQL} SELECT CASE lv WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' ELSE 'CRITICAL' END AS level, count(*) AS n, sum(CASE WHEN NOT signal THEN 0.000372 WHEN lv = 1 THEN 0.0957 WHEN lv = 2 THEN 0.1558 WHEN lv = 3 THEN 0.1304 ELSE 0.1165 END) / count(*) AS rate FROM l GROUP BY lv""")
def _(t):
    return fire_rules.grade(facts(t)).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.avg(fire_rules.next_day_rate()).alias("rate"))


@query("expert_load", "level:s period:s episodes:i next_day_rate:d per_year:d per_day:d", f"""
    {LEVEL_SQL}, e AS (SELECT l.*, CASE WHEN day < DATE '2024-01-20' THEN 'calibration' ELSE 'holdout' END AS period, CAST(EXISTS (SELECT 1 FROM g n WHERE n.object_id = l.object_id AND n.gallery = l.gallery AND n.picket = l.picket AND n.day = l.day + 1 AND n.signal) AS INT) AS nx FROM l WHERE signal OR lv = 4)
    SELECT CASE lv WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' ELSE 'CRITICAL' END AS level, period, count(*) AS episodes, round(avg(nx), 4) AS next_day_rate, round(count(*) / CASE period WHEN 'calibration' THEN 19 ELSE 11 END * 365, 1) AS per_year,
      round(count(*) / CASE period WHEN 'calibration' THEN 19 ELSE 11 END, 3) AS per_day FROM e GROUP BY lv, period""")
def _(t):
    graded = stored(fire_rules.grade(facts(t)))
    nxt = graded.filter("signal").select(*K, F.date_sub("day", 1).alias("day"), F.lit(1).alias("next_label"))
    episodes = graded.join(nxt, [*K, "day"], "left").fillna(0, ["next_label"])
    return tg.expert_load(episodes, "2024-01-20", "2024-01-01", "2024-01-31")


@query("suggest_work_type", "work_type:s n:i", f"""
    {FACT_SQL} SELECT CASE WHEN heat_independent OR temp_rise_c >= 10 THEN 'Тепловизионное обследование' WHEN spread THEN 'Осмотр камеры и кабельных линий' ELSE 'Осмотр и чистка извещателя' END AS work_type, count(*) AS n FROM g GROUP BY 1""")
def _(t):
    return facts(t).groupBy(fire_rules.work_type().alias("work_type")).agg(F.count(F.lit(1)).alias("n"))


RUN = "2024-01-29 12:00:00"


def run_signals(t):
    return t.fire_signal.select(
        (F.col("channel_id") % 60).alias("facility_id"), F.col("channel_id").alias("sensor_id"), F.when(F.col("stype") == "smoke", "SMOKE_DETECTED").otherwise("HEAT_OPEN").alias("kind"), "ts")


@query("fire_vector", "facility_id:i signal:b burst_only:b smoke:b spread:b heat_independent:b off_hours_no_walk:b power_off:b signals_24h:i burst_signals_24h:i hours_since_signal:d bucket_first:i bucket_last:i gas_pct:d temp_rise_c:d sensor_cooling:b", f"""
    WITH s AS (SELECT channel_id % 60 AS m, channel_id % 60 % 10 AS col, channel_id % 60 % 10 % 3 AS dis, channel_id % 60 // 10 * 30.0 AS ch, channel_id AS sensor, stype, ts, day FROM fire_signal WHERE ts >= TIMESTAMP '2024-01-28 11:00:00' AND ts < TIMESTAMP '{RUN}'),
    x AS (SELECT a.*, (SELECT count(DISTINCT r.m) FROM s r WHERE r.col = a.col AND r.m <> a.m AND r.day = a.day AND r.ts BETWEEN a.ts - INTERVAL 60 MINUTE AND a.ts + INTERVAL 60 MINUTE) AS nb,
        EXISTS (SELECT 1 FROM s r WHERE r.col = a.col AND r.m <> a.m AND r.day = a.day AND abs(r.ch - a.ch) <= 50 AND r.ts BETWEEN a.ts - INTERVAL 30 MINUTE AND a.ts + INTERVAL 30 MINUTE) AS near,
        EXISTS (SELECT 1 FROM s r WHERE a.stype = 'smoke' AND r.stype <> 'smoke' AND r.sensor <> a.sensor AND r.col = a.col AND r.ts BETWEEN a.ts - INTERVAL 60 MINUTE AND a.ts + INTERVAL 60 MINUTE) AS heat FROM s a),
    f AS (SELECT DISTINCT channel_id % 60 AS facility_id, channel_id % 60 % 10 AS col, channel_id % 60 % 10 % 3 AS dis FROM journal),
    o AS (SELECT m, count(*) AS n, count(*) FILTER (nb > 2) AS nb, max(ts) AS last, min(ts) FILTER (nb <= 2) AS first, bool_or(nb <= 2) AS signal, bool_or(nb <= 2 AND stype = 'smoke') AS smoke, bool_or(nb <= 2 AND near) AS spread, bool_or(nb <= 2 AND heat) AS heat,
        bool_or(nb <= 2 AND (is_day_off = 1 OR hour(ts) < 6 OR hour(ts) >= 22) AND NOT EXISTS (SELECT 1 FROM x w WHERE w.nb > 2 AND w.col = x.col AND w.day = x.day)) AS night,
        count(*) FILTER (ts < TIMESTAMP '2024-01-28 16:00:00' AND ts > TIMESTAMP '2024-01-28 12:00:00') AS bf, count(*) FILTER (ts > TIMESTAMP '2024-01-29 08:00:00') AS bl,
        bool_and((SELECT min(j.day) FROM journal j WHERE j.channel_id = x.sensor) > DATE '2024-01-14') FILTER (nb <= 2) AS young FROM x JOIN cal ON cal.day = x.day WHERE ts >= TIMESTAMP '2024-01-28 12:00:00' GROUP BY m),
    rd AS (SELECT channel_id % 60 % 10 AS col, channel_id % 60 % 10 % 3 AS dis, hour, max(value) AS v FROM journal WHERE event_type = 'purchase' GROUP BY 1, 2, 3)
    SELECT facility_id, CAST(coalesce(signal, false) AS INT) AS signal, CAST(NOT coalesce(signal, false) AND coalesce(n, 0) > 0 AS INT) AS burst_only, CAST(coalesce(smoke, false) AS INT) AS smoke, CAST(coalesce(spread, false) AS INT) AS spread, CAST(coalesce(heat, false) AS INT) AS heat_independent,
        CAST(coalesce(night, false) AS INT) AS off_hours_no_walk, CAST(coalesce(signal, false) AND EXISTS (SELECT 1 FROM journal j WHERE j.event_type = 'signup' AND j.event_id % 9 = 0 AND j.ts <= TIMESTAMP '{RUN}' AND j.channel_id % 60 % 10 % 3 = f.dis AND j.ts BETWEEN first - INTERVAL 60 MINUTE AND first + INTERVAL 60 MINUTE) AS INT) AS power_off,
        coalesce(n, 0) AS signals_24h, coalesce(o.nb, 0) AS burst_signals_24h, coalesce(round_even((epoch(TIMESTAMP '{RUN}') - epoch(last)) / 3600, 2), 24) AS hours_since_signal, coalesce(bf, 0) AS bucket_first, coalesce(bl, 0) AS bucket_last,
        coalesce((SELECT max(v) FROM rd WHERE rd.dis = f.dis AND v <= 100 AND hour >= TIMESTAMP '2024-01-28 12:00:00' AND hour < TIMESTAMP '{RUN}' AND NOT (col = 3 AND CAST(hour AS DATE) BETWEEN DATE '2024-01-28' AND DATE '2024-01-28')), 0) AS gas_pct,
        greatest(0, coalesce((SELECT max(v) FROM rd WHERE rd.col = f.col AND hour >= first - INTERVAL 2 HOUR AND hour < least(first + INTERVAL 2 HOUR, TIMESTAMP '{RUN}')) - (SELECT median(v) FROM rd WHERE rd.col = f.col AND hour >= first - INTERVAL 30 DAY AND hour < first - INTERVAL 2 HOUR), 0)) AS temp_rise_c,
        CAST(coalesce(signal AND young, false) AS INT) AS sensor_cooling
    FROM f LEFT JOIN o ON o.m = f.facility_id""")
def _(t):
    ids = t.journal.select((F.col("channel_id") % 60).alias("facility_id"), F.col("channel_id").alias("sensor_id"), "day")
    units = ids.select("facility_id").distinct().withColumn("collector", F.col("facility_id") % 10).withColumn("district", F.col("collector") % 3)
    places = units.select(F.col("facility_id").alias("member"), "collector", F.lit(-1).alias("gallery"), (F.floor(F.col("facility_id") / 10) * 30.0).alias("chainage"))
    sensors = ids.groupBy("sensor_id").agg(F.min("day").alias("installed"))
    hours = t.journal.filter("event_type = 'purchase'").groupBy((F.col("channel_id") % 60 % 10).alias("collector"), F.col("hour").alias("ts")).agg(F.max("value").alias("value"))
    hours = hours.withColumn("district", F.col("collector") % 3)
    readings = hours.withColumn("metric", F.lit("temperature_c")).unionByName(hours.withColumn("metric", F.lit("methane_pct")))
    off = t.journal.filter("event_type = 'signup' AND event_id % 9 = 0").select((F.col("channel_id") % 60 % 10 % 3).alias("district"), "ts")
    collectors = units.select("collector").distinct().withColumn("commissioning_until", F.lit(None).cast("date")).withColumn("first_installed", F.lit("2020-01-01").cast("date"))
    maintenance = units.filter("collector = 3").select(F.col("collector").alias("object_id"), F.lit("2024-01-28").cast("date").alias("start"), F.lit("2024-01-28").cast("date").alias("end")).distinct()
    v = fire_rules.fire_vector(run_signals(t), units, units.select("facility_id", F.col("facility_id").alias("member")), places, sensors, readings, off, collectors, maintenance, t.cal, RUN)
    return v.withColumnRenamed("signals_bucket_0", "bucket_first").withColumnRenamed("signals_bucket_5", "bucket_last")


@query("focus_sensor", "facility_id:i focus:i", f"""
    WITH b AS (SELECT channel_id % 60 AS facility_id, channel_id, ts, nb FROM ({NB_SQL.format(m=180)})), c AS (SELECT facility_id, channel_id, count(*) AS n, min(ts) FILTER (nb <= 2) AS f, min(ts) AS seen FROM b GROUP BY 1, 2)
    SELECT facility_id, coalesce(arg_min(channel_id, (f, channel_id)) FILTER (f IS NOT NULL), arg_max(channel_id, (n, -epoch(seen)))) AS focus FROM c GROUP BY 1""")
def _(t):
    marked = burst_neighbours(t.fire_signal, minutes=180).select((F.col("channel_id") % 60).alias("facility_id"), F.col("channel_id").alias("sensor_id"), "ts", "nb")
    return fire_rules.focus_sensor(marked)


@query("signal_buckets", "facility_id:i bucket_0:i bucket_3:i bucket_5:i", f"""
    SELECT channel_id % 60 AS facility_id, count(*) FILTER (ts > TIMESTAMP '{RUN}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{RUN}' - INTERVAL 20 HOUR) AS bucket_0, count(*) FILTER (ts > TIMESTAMP '{RUN}' - INTERVAL 12 HOUR AND ts <= TIMESTAMP '{RUN}' - INTERVAL 8 HOUR) AS bucket_3,
      count(*) FILTER (ts > TIMESTAMP '{RUN}' - INTERVAL 4 HOUR AND ts <= TIMESTAMP '{RUN}') AS bucket_5 FROM fire_signal WHERE ts <= TIMESTAMP '{RUN}' GROUP BY 1""")
def _(t):
    own = run_signals(t).filter(F.col("ts") <= F.lit(RUN).cast("timestamp"))
    return fire_rules.signal_buckets(own, ("facility_id",), RUN)


# --- fire panel -----------------------------------------------------------------------


def fire_inputs(t):
    signals = t.long_rows.filter("l_quantity >= 10")
    stype = F.when(F.col("l_returnflag") == "R", "Датчик дыма").when(F.col("l_returnflag") == "A", "Тепловой датчик").otherwise("Датчик температуры")
    alarm = signals.select(*K, "moment", F.col("l_partkey").alias("channel_id"), stype.alias("stype"))
    unit = t.long_rows.groupBy(*K).agg(
        F.min("day").cast("timestamp").alias("hour_from"), shift(F.max("day").cast("timestamp"), 82800).alias("hour_to"),
        F.countDistinct("l_linenumber").alias("n_smoke"), F.max("l_linenumber").alias("n_temp"), F.min("l_linenumber").alias("n_heat"))
    per = lambda cond: t.long_rows.filter(cond)
    fault = per("l_discount >= 0.09").groupBy(*K, "day").agg(F.count(F.lit(1)).alias("n"))
    temp = per("l_linenumber = 1").groupBy(*K, "day").agg(F.max("l_quantity").alias("t_max"), F.avg("l_quantity").alias("t_mean"))
    objtemp = per("l_linenumber = 1").groupBy("object_id", "day").agg(F.max("l_quantity").alias("obj_t_max"))
    n = lambda c: F.count_if(F.expr(c))
    cx = per("l_linenumber <= 4").groupBy("complex_id", "day").agg(
        F.max(F.col("l_quantity") / 25).alias("gas_max"), F.avg(F.col("l_quantity") / 25).alias("gas_mean"), n("l_quantity < 10").alias("gas_mid"), n("l_quantity >= 25").alias("gas_ge1"),
        n("l_quantity >= 45").alias("gas_ge1_off"), n("l_returnflag = 'A'").alias("phase_off"), n("l_returnflag = 'N'").alias("fan_off"), n("l_discount > 0.05").alias("talk"), n("l_linenumber = 2").alias("door"))
    wx = t.weather_daily
    day = lambda **c: wx.select("day", *[F.expr(v).alias(k) for k, v in c.items()])
    return fire.FireInputs(
        unit=unit, alarm=alarm, fault=fault, temp=temp, objtemp=objtemp, cxday=cx, object_complex=t.long_rows.select("object_id", "complex_id").distinct(),
        weather=day(temp_mean="temp_mean", temp_max="temp_max", precip_mm="precip_mm"),
        humidity=day(rh_mean="precip_mm + 50", rh_max="precip_mm + 60", dew_mean="temp_mean - 2", pressure_change="temp_mean - temp_max"),
        external=day(wind_mean="snow_cm / 10", gust_max="snow_cm", cloud_mean="precip_mm * 2", soil_temp="temp_mean / 2", pm25_mean="snow_cm / 4", pm25_max="snow_cm / 2", pm10_mean="snow_cm", co_max="snow_cm * 3", fireworks="CAST(dayofmonth(day) = 9 AS INT)"),
        calendar=t.cal)


def fr(fn: str, c: str, n: int) -> str:
    return f"{fn}({c}) OVER (PARTITION BY {P} ORDER BY day RANGE BETWEEN INTERVAL {n} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"


def fs(c: str, n: int) -> str:
    return f"coalesce({fr('sum', c, n)}, 0)"


UB = f"OVER (PARTITION BY {P} ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def sc(flag: str) -> str:
    return f"least(coalesce(date_diff('day', max(CASE WHEN {flag} > 0 THEN day END) {UB}, day), 3650), 3650)"


FIRE_COLUMNS = {
    **{f"evt_days_{n}d:i": fs("ev", n) for n in (1, 7, 30, 90, 365)}, "evt_moments_30d:i": fs("m_ev", 30), "evt_days_since:i": sc("ev"), "evt_days_all:i": f"coalesce(sum(ev) {UB}, 0)", **{f"line_events_{n}d:i": fs("l_ev", n) for n in (1, 7, 30)},
    "obj_walk_days_since:i": sc("o_walk"), "obj_walks_365d:i": fs("o_walk", 365), "obj_walk_phase:d": f"{sc('o_walk')} * {fs('o_walk', 365)} / 365.0", **{f"chk_days_{n}d:i": fs("chk", n) for n in (30, 365)}, "chk_days_since:i": sc("chk"),
    **{f"obj_events_{n}d:i": fs("n_ev", n) for n in (1, 7, 30)}, "obj_check_share_1d:d": fs("n_chk_share", 1), "obj_checks_30d:i": fs("n_chk", 30), "obj_temp_max_1d:d": fr("max", "obj_t_max", 1), "obj_temp_rise:d": f"{fr('max', 'obj_t_max', 1)} - {fr('avg', 'obj_t_max', 30)}",
    "tmp_max_1d:d": fr("max", "t_max", 1), "tmp_mean_1d:d": fr("avg", "t_mean", 1), "tmp_mean_7d:d": fr("avg", "t_mean", 7), "tmp_delta_30d:d": f"{fr('avg', 't_mean', 1)} - {fr('avg', 't_mean', 30)}", "tmp_max_rise:d": f"{fr('max', 't_max', 1)} - {fr('max', 't_max', 30)}",
    "gas_max_1d:d": fr("max", "gas_max", 1), "gas_max_7d:d": fr("max", "gas_max", 7), "gas_mean_30d:d": fr("avg", "gas_mean", 30), "gas_mid_7d:i": fs("gas_mid", 7), "gas_ge1_30d:i": fs("gas_ge1", 30), "gas_ge1_off_365d:i": fs("gas_ge1_off", 365), "gas_days_since_ge1:i": sc("gas_ge1"),
    **{f"hw_faults_{n}d:i": fs("faults", n) for n in (1, 7, 30)}, **{f"{p}_{c}_{n}d:i": fs(c, n) for p, c in (("pwr", "phase_off"), ("pwr", "fan_off"), ("ppl", "talk"), ("ppl", "door")) for n in (1, 7)},
    "rec_to_midnight_1d:i": f"coalesce({fr('min', 'tm', 1)}, 1440)", "rec_channels_1d:i": f"coalesce({fr('max', 'chn', 1)}, 0)", "rec_repeats_365d:i": fs("rep", 365), "rec_repeats_all:i": f"coalesce(sum(rep) {UB}, 0)", "rec_moments_1d:i": fs("m_ev", 1),
    **{f"rec_{k}_1d:i": f"coalesce({fr('max', k, 1)}, 0)" for k in ("smoke", "heat", "temp")},
}
FIRE_SPEC = " ".join(FIRE_COLUMNS) + " unit_age_days:i unit_smoke:i unit_temp:i unit_heat:i geo_position:d geo_to_edge:i geo_object_units:i wx_temp_mean_1d:d wx_temp_max_7d:d wx_rh_mean_7d:d wx_pm25_max_7d:d cond_dew_minus_unit:d cond_outside_minus_object:d cal_fireworks:i cal_fireworks_1d:i week_day_of_week:i week_is_day_off:i cal_season:i cal_day_of_year:i"
FIRE_SQL = f"""
    WITH un AS (SELECT {P}, complex_id, min(day) AS lo, max(day) AS hi, count(DISTINCT l_linenumber) AS n_smoke, max(l_linenumber) AS n_temp, min(l_linenumber) AS n_heat FROM long_rows GROUP BY ALL),
    al AS (SELECT {P}, moment, l_partkey AS ch, l_returnflag AS rf FROM long_rows WHERE l_quantity >= 10),
    nb AS (SELECT a.*, (SELECT count(DISTINCT (r.gallery, r.picket)) FROM al r WHERE r.object_id = a.object_id AND (r.gallery <> a.gallery OR r.picket <> a.picket) AND CAST(r.moment AS DATE) = CAST(a.moment AS DATE) AND r.moment BETWEEN a.moment - INTERVAL 60 MINUTE AND a.moment + INTERVAL 60 MINUTE) AS n FROM al a),
    ad AS (SELECT {P}, CAST(moment AS DATE) AS day, count(*) FILTER (n <= 2) AS m_ev, count(*) FILTER (n > 2) AS m_chk, date_diff('minute', max(moment) FILTER (n <= 2), CAST(CAST(moment AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY) AS tm, count(DISTINCT ch) FILTER (n <= 2) AS chn,
        max(CASE WHEN rf = 'R' THEN 1 ELSE 0 END) FILTER (n <= 2) AS smoke, max(CASE WHEN rf = 'A' THEN 1 ELSE 0 END) FILTER (n <= 2) AS heat, max(CASE WHEN rf = 'N' THEN 1 ELSE 0 END) FILTER (n <= 2) AS temp FROM nb GROUP BY {P}, CAST(moment AS DATE)),
    g AS (SELECT {P}, complex_id, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM un),
    ud AS (SELECT g.*, coalesce(m_ev, 0) AS m_ev, CASE WHEN m_ev > 0 THEN 1 ELSE 0 END AS ev, CASE WHEN m_chk > 0 THEN 1 ELSE 0 END AS chk, tm, chn, smoke, heat, temp, coalesce(f.n, 0) AS faults, t_max, t_mean FROM g LEFT JOIN ad USING ({P}, day)
        LEFT JOIN (SELECT {P}, day, count(*) AS n FROM long_rows WHERE l_discount >= 0.09 GROUP BY ALL) f USING ({P}, day) LEFT JOIN (SELECT {P}, day, max(l_quantity) AS t_max, avg(l_quantity) AS t_mean FROM long_rows WHERE l_linenumber = 1 GROUP BY ALL) t USING ({P}, day)),
    od AS (SELECT object_id, day, sum(ev) AS o_ev, sum(chk) AS o_chk, count(*) AS o_n FROM ud GROUP BY 1, 2),
    ln AS (SELECT a.object_id, a.gallery, a.picket, a.day, sum(b.ev) AS l_ev FROM ud a JOIN ud b ON b.object_id = a.object_id AND b.gallery = a.gallery AND b.day = a.day AND b.picket <> a.picket AND abs(b.picket - a.picket) <= 5 AND b.ev = 1 GROUP BY ALL),
    cx AS (SELECT complex_id, day, max(l_quantity / 25) AS gas_max, avg(l_quantity / 25) AS gas_mean, count(*) FILTER (l_quantity < 10) AS gas_mid, count(*) FILTER (l_quantity >= 25) AS gas_ge1, count(*) FILTER (l_quantity >= 45) AS gas_ge1_off, count(*) FILTER (l_returnflag = 'A') AS phase_off,
        count(*) FILTER (l_returnflag = 'N') AS fan_off, count(*) FILTER (l_discount > 0.05) AS talk, count(*) FILTER (l_linenumber = 2) AS door FROM long_rows WHERE l_linenumber <= 4 GROUP BY 1, 2),
    d AS (SELECT ud.*, od.o_ev - ev AS n_ev, od.o_chk - chk AS n_chk, CASE WHEN o_chk > 0 THEN 1 ELSE 0 END AS o_walk, (od.o_chk - chk) / greatest(o_n - 1, 1) AS n_chk_share, coalesce(l_ev, 0) AS l_ev, obj_t_max, gas_max, gas_mean, {', '.join(f'coalesce({c}, 0) AS {c}' for c in fire.COMPLEX_COUNTS)},
        ev * coalesce(lag(ev) OVER (PARTITION BY {', '.join('ud.' + k for k in K)} ORDER BY ud.day), 0) AS rep FROM ud JOIN od USING (object_id, day) LEFT JOIN ln USING ({P}, day)
        LEFT JOIN (SELECT object_id, day, max(l_quantity) AS obj_t_max FROM long_rows WHERE l_linenumber = 1 GROUP BY 1, 2) ot USING (object_id, day) LEFT JOIN cx ON cx.complex_id = ud.complex_id AND cx.day = ud.day),
    wx AS (SELECT day, lag(temp_mean) OVER w AS wx_temp_mean_1d, max(temp_max) OVER w7 AS wx_temp_max_7d, avg(precip_mm + 50) OVER w7 AS wx_rh_mean_7d, max(snow_cm / 2) OVER w7 AS wx_pm25_max_7d, lag(temp_mean - 2) OVER w AS dew, CASE WHEN day(day) = 9 THEN 1 ELSE 0 END AS cal_fireworks,
        lag(CASE WHEN day(day) = 9 THEN 1 ELSE 0 END) OVER w AS cal_fireworks_1d FROM weather_daily WINDOW w AS (ORDER BY day), w7 AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
    r AS (SELECT {P}, day, ev AS label, {', '.join(f"{v} AS {n.split(':')[0]}" for n, v in FIRE_COLUMNS.items())} FROM d)
    SELECT r.*, CASE WHEN evt_days_1d > 0 THEN 1 ELSE 0 END AS naive, date_diff('day', un.lo, r.day) AS unit_age_days, n_smoke AS unit_smoke, n_temp AS unit_temp, n_heat AS unit_heat, (r.picket - pmin) / greatest(pmax - pmin, 1) AS geo_position, least(r.picket - pmin, pmax - r.picket) AS geo_to_edge, gn AS geo_object_units,
        wx_temp_mean_1d, wx_temp_max_7d, wx_rh_mean_7d, wx_pm25_max_7d, dew - tmp_mean_1d AS cond_dew_minus_unit, wx_temp_mean_1d - obj_temp_max_1d AS cond_outside_minus_object, cal_fireworks, cal_fireworks_1d, day_of_week AS week_day_of_week, is_day_off AS week_is_day_off, season AS cal_season, day_of_year AS cal_day_of_year
    FROM r LEFT JOIN un USING ({P}) LEFT JOIN (SELECT object_id, gallery, min(picket) AS pmin, max(picket) AS pmax, count(*) AS gn FROM un GROUP BY 1, 2) gg USING (object_id, gallery) LEFT JOIN wx ON wx.day = r.day LEFT JOIN cal ON cal.day = r.day WHERE r.day > un.lo"""


@query("fire_daily", f"object_id:i gallery:i picket:i day:D label:i naive:i {FIRE_SPEC}", FIRE_SQL)
def _(t):
    return fire.fire_daily(fire_inputs(t))


@query("gas_daily", "object_id:i day:D gas_max:d gas_mean:d gas_mid:i gas_ge1:i gas_ge1_off:i", """
    SELECT object_id, day, max(v) AS gas_max, avg(v) AS gas_mean, count(*) FILTER (v >= 0.1 AND v < 1) AS gas_mid, count(*) FILTER (v >= 1) AS gas_ge1, count(*) FILTER (v >= 1 AND (is_day_off = 1 OR hour(ts) < 8 OR hour(ts) >= 16)) AS gas_ge1_off
    FROM (SELECT *, TRY_CAST(replace(value, ',', '.') AS DOUBLE) AS v FROM raw_journal WHERE stype = 'Газовый датчик') JOIN cal USING (day) WHERE v BETWEEN 0 AND 100 GROUP BY object_id, day""")
def _(t):
    return fire.gas_days(t.raw_journal.filter("stype = 'Газовый датчик'"), t.cal)


@query("temp_daily", "object_id:i day:D t_max:d t_mean:d", """
    SELECT object_id, day, max(v) AS t_max, avg(v) AS t_mean FROM (SELECT *, TRY_CAST(replace(value, ',', '.') AS DOUBLE) AS v FROM raw_journal WHERE stype = 'Датчик температуры') WHERE v BETWEEN -40 AND 125 GROUP BY object_id, day""")
def _(t):
    return fire.temperature_days(t.raw_journal.filter("stype = 'Датчик температуры'"), ("object_id",))


@query("complex_daily", "complex_id:i day:D phase_off:i fan_off:i gas_max:d gas_mean:d gas_ge1:i", """
    WITH s AS (SELECT complex_id, day, count(*) FILTER (event_type = 'signup') AS phase_off, count(*) FILTER (event_type = 'click') AS fan_off FROM journal WHERE event_type IN ('signup', 'click') GROUP BY 1, 2),
    g AS (SELECT object_id % 3 AS complex_id, day, max(gm) AS gas_max, avg(ga) AS gas_mean, sum(g1) AS gas_ge1 FROM (SELECT object_id, day, max(v) AS gm, avg(v) AS ga, count(*) FILTER (v >= 1) AS g1
        FROM (SELECT *, TRY_CAST(replace(value, ',', '.') AS DOUBLE) AS v FROM raw_journal WHERE stype = 'Газовый датчик') WHERE v BETWEEN 0 AND 100 GROUP BY 1, 2) GROUP BY 1, 2)
    SELECT complex_id, day, phase_off, fan_off, gas_max, gas_mean, gas_ge1 FROM s FULL JOIN g USING (complex_id, day)""")
def _(t):
    kind = lambda k: (F.col("event_type") == k).cast("int")
    states = t.journal.filter("event_type IN ('signup', 'click')").select(
        "object_id", "day", kind("signup").alias("phase_off"), kind("click").alias("fan_off"), F.lit(0).alias("talk"), F.lit(0).alias("door"))
    gas = fire.gas_days(t.raw_journal.filter("stype = 'Газовый датчик'"), t.cal)
    return fire.complex_days(states, gas, t.journal.select("object_id", "complex_id").distinct())
