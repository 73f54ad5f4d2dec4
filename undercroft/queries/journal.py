"""Filters, moments, roll-ups, lives, sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from undercroft import config
from undercroft.operators import journal as jr
from undercroft.operators import sessions as se
from undercroft.operators.intervals import disarm_windows
from undercroft.queries.base import query
from undercroft.session import stored

SECTION = ("object_id", "gallery", "section")
PICKET = ("object_id", "gallery", "picket")


@query("exclude_artifact", "channel_id:i n:i", """
    SELECT channel_id, count(*) AS n FROM long_rows WHERE NOT (object_id = 3 AND year(day) IN (1997, 1998)) GROUP BY channel_id""")
def _(t):
    return jr.exclude_artifact(t.long_rows, artifact=3, years=(1997, 1998)).groupBy("channel_id").agg(F.count(F.lit(1)).alias("n"))


@query("commissioning", "channel_id:i ready_day:D", """
    SELECT channel_id, greatest(CASE WHEN o <= DATE '1995-02-05' THEN DATE '1900-01-01' ELSE CAST(o + INTERVAL 270 DAY AS DATE) END,
                                CASE WHEN c <= DATE '1995-02-05' THEN DATE '1900-01-01' ELSE CAST(c + INTERVAL 30 DAY AS DATE) END) AS ready_day
    FROM (SELECT channel_id, min(day) AS c, min(min(day)) OVER (PARTITION BY object_id) AS o FROM long_rows GROUP BY channel_id, object_id)""")
def _(t):
    return jr.commissioning(t.long_rows, dump_start="1995-02-05")


@query("exclude_commissioning", "object_id:i n:i", """
    SELECT object_id, count(*) AS n FROM long_rows JOIN (
      SELECT channel_id, greatest(CASE WHEN o <= DATE '1995-01-02' THEN DATE '1900-01-01' ELSE CAST(o + INTERVAL 270 DAY AS DATE) END,
                                  CASE WHEN c <= DATE '1995-01-02' THEN DATE '1900-01-01' ELSE CAST(c + INTERVAL 30 DAY AS DATE) END) AS ready_day
      FROM (SELECT channel_id, min(day) AS c, min(min(day)) OVER (PARTITION BY object_id) AS o FROM long_rows GROUP BY channel_id, object_id)) r USING (channel_id)
    WHERE day >= ready_day GROUP BY object_id""")
def _(t):
    ready = jr.commissioning(t.long_rows, dump_start="1995-01-02")
    return jr.exclude_commissioning(t.long_rows, ready).groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))


@query("pair_filter", "object_id:i n:i", """
    SELECT object_id, count(*) AS n FROM raw_journal WHERE (stype = 'Состояние насоса' AND value = 'Затоплен')
      OR (stype = 'Датчик затопления' AND value = 'Не замкнут') OR (stype = 'Состояние насоса' AND value = 'Работают все насосы в АНС') GROUP BY object_id""")
def _(t):
    return t.raw_journal.filter(jr.pair_filter(config.FLOOD_PAIRS)).groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))


@query("failure_values", "stype:s n:i", """
    SELECT stype, count(*) AS n FROM raw_journal WHERE value IN ('Неисправен', 'Обесточен', 'Питание от батарей', 'Батарея разряжена',
      'Много неисправных устройств', 'Отключено устройство', 'Не определено') GROUP BY stype""")
def _(t):
    return t.raw_journal.filter(F.col("value").isin(*config.FAILURE_VALUES)).groupBy("stype").agg(F.count(F.lit(1)).alias("n"))


@query("journal_with_channels", "stype:s day:D n:i", """
    SELECT stype, day, count(*) AS n FROM long_rows JOIN channels ON cid = l_partkey WHERE stype <> 'Датчик дыма' GROUP BY stype, day""")
def _(t):
    # The dictionary side is left to the optimizer: it is broadcast only when its statistics are small.
    joined = t.long_rows.join(t.channels.select(F.col("cid").alias("l_partkey"), "stype"), "l_partkey")
    return joined.filter("stype <> 'Датчик дыма'").groupBy("stype", "day").agg(F.count(F.lit(1)).alias("n"))


@query("moments", "channel_id:i ts:t n_rows:i", """
    SELECT channel_id, ts, count(*) AS n_rows FROM journal WHERE event_type IN ('error', 'click') GROUP BY channel_id, ts""")
def _(t):
    return jr.moments(t.journal.filter("event_type IN ('error', 'click')"), ())


ROLLUP_SQL = """
    SELECT {k}, date_trunc('hour', {ts}) AS hour, count(*) AS n_alarms, count(DISTINCT (channel_id, {ts})) AS n_moments,
           count(DISTINCT channel_id) AS n_channels FROM {src} GROUP BY {k}, date_trunc('hour', {ts})"""


@query("hourly_rollup", "object_id:i gallery:i section:i hour:t n_alarms:i n_moments:i n_channels:i",
       ROLLUP_SQL.format(k="object_id, gallery, section", ts="ts", src="journal WHERE event_type IN ('error', 'click')"))
def _(t):
    m = jr.moments(t.journal.filter("event_type IN ('error', 'click')"), SECTION)
    return jr.hourly_rollup(m, SECTION)


@query("hourly_rollup_by_value", "object_id:i gallery:i picket:i value:s hour:t n_alarms:i n_moments:i n_channels:i",
       ROLLUP_SQL.format(k="object_id, gallery, picket, value", ts="ts", src="pump_rows WHERE alarm AND value IN ('flooded', 'all_running')"))
def _(t):
    rows = t.pump_rows.filter("alarm AND value IN ('flooded', 'all_running')")
    return jr.hourly_rollup(jr.moments(rows, (*PICKET, "value")), (*PICKET, "value"))


@query("unit_life", "object_id:i gallery:i picket:i hour_from:t hour_to:t n_channels:i", """
    SELECT object_id, gallery, picket, CAST(min(lo) AS TIMESTAMP) AS hour_from, CAST(max(hi) AS TIMESTAMP) + INTERVAL 23 HOUR AS hour_to, count(*) AS n_channels
    FROM (SELECT DISTINCT object_id, gallery, picket, channel_id FROM long_rows WHERE l_returnflag = 'R' AND l_quantity >= 49) JOIN
         (SELECT channel_id, min(day) AS lo, max(day) AS hi FROM long_rows GROUP BY channel_id) USING (channel_id) GROUP BY object_id, gallery, picket""")
def _(t):
    access = t.long_rows.filter("l_returnflag = 'R' AND l_quantity >= 49").select(*PICKET, "channel_id")
    return jr.unit_life(t.long_rows, access, PICKET)


@query("section_passport", "object_id:i gallery:i section:i is_branch:i no_entry:i n_pickets:i n_contact:i n_motion:i n_emergency_exit:i n_hatch:i n_vent_shaft:i", """
    SELECT c.object_id, c.gallery, CAST(floor(c.picket / 4) AS BIGINT) AS section, CAST(c.gallery <> -1 AS INT) AS is_branch, CAST(floor(c.picket / 4) >= 1000 AS INT) AS no_entry,
           count(DISTINCT c.picket) AS n_pickets, count(DISTINCT CASE WHEN stype IN ('КД АВ', 'КД Дверь', 'КД Люк', '9-секционный люк', 'Стекло') THEN cid END) AS n_contact,
           count(DISTINCT CASE WHEN stype = 'Датчик движения' THEN cid END) AS n_motion, count(DISTINCT CASE WHEN stype = 'КД АВ' THEN cid END) AS n_emergency_exit,
           count(DISTINCT CASE WHEN stype IN ('КД Люк', '9-секционный люк') THEN cid END) AS n_hatch, count(DISTINCT CASE WHEN name ILIKE '%ВШ%' THEN cid END) AS n_vent_shaft
    FROM channels c GROUP BY c.object_id, c.gallery, floor(c.picket / 4)""")
def _(t):
    sections = t.channels.select("object_id", "gallery", "picket", F.floor(F.col("picket") / 4).alias("section")).distinct()
    return jr.section_passport(sections, t.channels)


@query("faults_daily", "object_id:i gallery:i section:i day:D n_fault:i n_fault_channels:i", "SELECT * FROM acc_fault")
def _(t):
    return jr.fault_days(t.long_rows.filter("l_returnflag = 'N' AND l_quantity >= 40"), SECTION)


@query("live_channel_dictionary", "cid:i picket:i gallery:i", """
    SELECT cid, picket, gallery FROM channels WHERE cid IN (SELECT l_partkey FROM long_rows WHERE NOT (object_id = 3 AND year(day) BETWEEN 1995 AND 2000) AND l_quantity >= 48)""")
def _(t):
    rows = t.long_rows.filter("l_quantity >= 48").withColumn("channel_id", F.col("l_partkey"))
    return jr.live_channels(t.channels, rows, artifact=3, years=tuple(range(1995, 2001)))


@query("lost_without_picket", "value:s total:i lost:i", """
    SELECT value, count(*) AS total, sum(CASE WHEN channel_id % 11 = 0 THEN 1 ELSE 0 END) AS lost FROM pump_rows WHERE alarm GROUP BY value""")
def _(t):
    rows = t.pump_rows.filter("alarm").withColumn("picket", F.when(F.col("channel_id") % 11 != 0, F.col("picket")))
    return jr.lost_without_picket(rows)


NODE_SQL = """
    SELECT object_id, gallery, node, min(picket) AS pk_from, max(picket) AS pk_to
    FROM (SELECT *, sum(b) OVER (PARTITION BY object_id, gallery ORDER BY picket ROWS UNBOUNDED PRECEDING) AS node
          FROM (SELECT *, CASE WHEN picket - lag(picket) OVER (PARTITION BY object_id, gallery ORDER BY picket) <= 3 THEN 0 ELSE 1 END AS b
                FROM (SELECT DISTINCT object_id, gallery, picket FROM channels
                      WHERE (stype IN ('КД АВ', 'КД Люк', '9-секционный люк') OR name ILIKE '%ВШ%'
                         OR (stype = 'КД Дверь' AND NOT (name ILIKE '%отс%' OR name ILIKE '%шкаф%' OR name ILIKE '%щ%'))) AND picket % 12 < 3 AND object_id < 9)))
    GROUP BY object_id, gallery, node"""


def entries(t):
    return t.channels.filter(jr.is_entry() & (F.col("picket") % 12 < 3) & (F.col("object_id") < 9))


@query("entry_nodes", "object_id:i gallery:i node:i pk_from:i pk_to:i", NODE_SQL)
def _(t):
    return jr.entry_nodes(entries(t))


@query("nearest_entry_node", "object_id:i gallery:i picket:i section:i entry_dist:i", f"""
    SELECT object_id, gallery, picket, arg_min(node, dist * 1000 + node) AS section, min(dist) AS entry_dist
    FROM (SELECT p.*, n.node, CASE WHEN p.picket < n.pk_from THEN n.pk_from - p.picket WHEN p.picket > n.pk_to THEN p.picket - n.pk_to ELSE 0 END AS dist
          FROM (SELECT DISTINCT object_id, gallery, picket FROM channels) p JOIN ({NODE_SQL}) n USING (object_id, gallery)) GROUP BY object_id, gallery, picket
    UNION ALL SELECT object_id, gallery, picket, 1000 + floor(picket / 15), NULL FROM (SELECT DISTINCT object_id, gallery, picket FROM channels) p
    WHERE NOT EXISTS (SELECT 1 FROM ({NODE_SQL}) n WHERE n.object_id = p.object_id AND n.gallery = p.gallery)""")
def _(t):
    return jr.section_map(t.channels, jr.entry_nodes(entries(t)))


@query("lines_without_nodes", "object_id:i gallery:i n:i", f"""
    SELECT object_id, gallery, count(DISTINCT picket) AS n FROM channels c
    WHERE NOT EXISTS (SELECT 1 FROM ({NODE_SQL}) n WHERE n.object_id = c.object_id AND n.gallery = c.gallery) GROUP BY object_id, gallery""")
def _(t):
    nodes = jr.entry_nodes(entries(t)).select("object_id", "gallery").distinct()
    return t.channels.join(nodes, ["object_id", "gallery"], "left_anti").groupBy("object_id", "gallery").agg(
        F.countDistinct("picket").alias("n"))


@query("channel_to_section", "cid:i section:i", """
    SELECT c.cid, s.section FROM channels c JOIN (SELECT DISTINCT object_id, gallery, picket, floor(picket / 5) AS section FROM channels WHERE picket % 3 <> 0) s
      USING (object_id, gallery, picket)""")
def _(t):
    sections = t.channels.filter("picket % 3 <> 0").select(
        *PICKET, F.floor(F.col("picket") / 5).alias("section")).distinct()
    return t.channels.join(sections, list(PICKET)).select("cid", "section")


@query("guard_fanout", "cid:i object_id:i gallery:i section:i", """
    SELECT g.cid, g.object_id, s.gallery, s.section FROM (SELECT cid, object_id FROM channels WHERE stype = 'КД Дверь') g
    JOIN (SELECT DISTINCT object_id, gallery, section FROM journal) s USING (object_id)""")
def _(t):
    guard = t.channels.filter("stype = 'КД Дверь'").select("cid", "object_id")
    return jr.object_channel_fanout(guard, t.journal.select(*SECTION))


@query("parent_child", "facility_id:i member:i", """
    SELECT u.facility_id, coalesce(c.child, u.facility_id) AS member FROM (SELECT facility_id FROM facility WHERE facility_id % 5 = 0) u
    LEFT JOIN (SELECT facility_id AS child, facility_id - facility_id % 5 AS parent FROM facility WHERE facility_id % 5 <> 0 AND facility_id % 3 = 0) c ON c.parent = u.facility_id""")
def _(t):
    kids = t.facility.filter("facility_id % 5 <> 0 AND facility_id % 3 = 0").select(
        F.col("facility_id").alias("child"), (F.col("facility_id") - F.col("facility_id") % 5).alias("parent"))
    return jr.parent_child(t.facility.filter("facility_id % 5 = 0"), kids)


@query("sections_without_channels", "object_id:i gallery:i section:i", """
    SELECT DISTINCT object_id, gallery, section FROM journal j WHERE NOT EXISTS (
      SELECT 1 FROM moment m WHERE m.object_id = j.object_id AND m.gallery = j.gallery AND m.section = j.section AND m.kind = 'motion' AND m.n_rows > 0 AND m.channel_id % 4 = 1)""")
def _(t):
    busy = t.moment.filter("kind = 'motion' AND n_rows > 0 AND channel_id % 4 = 1").select(*SECTION)
    return t.journal.select(*SECTION).distinct().join(busy, list(SECTION), "left_anti")


@query("section_birth", "facility_id:i born:D", """
    SELECT object_id AS facility_id, min(greatest(first_day, ready)) AS born FROM (
      SELECT channel_id, object_id, min(day) AS first_day, CASE WHEN min(day) <= DATE '1995-01-20' THEN DATE '1900-01-01' ELSE CAST(min(day) + INTERVAL 30 DAY AS DATE) END AS ready
      FROM long_rows WHERE channel_id % 3 <> 0 GROUP BY channel_id, object_id) GROUP BY object_id""")
def _(t):
    rows = t.long_rows.filter("channel_id % 3 <> 0")
    ready = jr.commissioning(rows, dump_start="1995-01-20", object_days=-100000)
    links = rows.select("channel_id", F.col("object_id").alias("facility_id")).distinct()
    return jr.section_birth(links, ready.drop("object_id"))


@query("channel_day_check", "channels:i channel_days:i event_days:i repeated:i", """
    SELECT (SELECT count(DISTINCT channel_id) FROM (SELECT * FROM long_rows WHERE l_quantity >= 44)) AS channels,
           (SELECT sum(d) FROM (SELECT date_diff('day', min(day), max(day)) + 1 AS d FROM long_rows WHERE channel_id IN (SELECT channel_id FROM long_rows WHERE l_quantity >= 44) GROUP BY channel_id)) AS channel_days,
           (SELECT count(*) FROM (SELECT DISTINCT channel_id, day FROM long_rows WHERE l_quantity >= 44)) AS event_days,
           (SELECT count(*) FROM (SELECT DISTINCT channel_id, day FROM long_rows WHERE l_quantity >= 44) a JOIN (SELECT DISTINCT channel_id, day FROM long_rows WHERE l_quantity >= 44) b
              ON a.channel_id = b.channel_id AND b.day = CAST(a.day + INTERVAL 1 DAY AS DATE)) AS repeated""")
def _(t):
    return jr.channel_day_check(t.long_rows.filter("l_quantity >= 44"), t.long_rows)


@query("choose_week", "week:t score:d fire:i flood:i access:i", """
    SELECT date_trunc('week', ts) AS week, ln(1 + count(*) FILTER (event_type = 'error')) + ln(1 + count(*) FILTER (event_type = 'view')) + ln(1 + count(*) FILTER (event_type = 'click')) AS score,
           count(*) FILTER (event_type = 'error') AS fire, count(*) FILTER (event_type = 'view') AS flood, count(*) FILTER (event_type = 'click') AS access
    FROM journal WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-25' GROUP BY 1
    HAVING count(*) FILTER (event_type = 'error') > 0 AND count(*) FILTER (event_type = 'view') > 0 AND count(*) FILTER (event_type = 'click') > 0
    ORDER BY score DESC, week LIMIT 1""")
def _(t):
    return jr.choose_week(t.journal, {"fire": ("error",), "flood": ("view",), "access": ("click",)}, "2024-01-02", "2024-01-25", code="event_type")


# --- incidents ---------------------------------------------------------------------

WINDOWS_SQL = """
    SELECT object_id, ts AS t_from, coalesce(nxt, seen) AS t_to, nxt IS NULL AS open_end
    FROM (SELECT *, lead(ts) OVER (PARTITION BY object_id ORDER BY ts, value) AS nxt, max(seen0) OVER (PARTITION BY object_id) AS seen
          FROM (SELECT *, lag(value) OVER (PARTITION BY object_id ORDER BY ts, value) AS prev, max(ts) OVER (PARTITION BY object_id) AS seen0 FROM guard)
          WHERE prev IS NULL OR prev <> value) WHERE value = 'off'"""
FLAGGED_SQL = f"""
    SELECT m.*, EXISTS (SELECT 1 FROM ({WINDOWS_SQL}) w WHERE w.object_id = m.object_id AND m.ts >= w.t_from AND m.ts < w.t_to) AS off_guard FROM moment m"""
ARMED_SQL = f"""
    SELECT *, sum(is_new) OVER (PARTITION BY object_id, gallery, section ORDER BY ts, channel_id ROWS UNBOUNDED PRECEDING) AS incident
    FROM (SELECT *, CASE WHEN date_diff('minute', lag(ts) OVER (PARTITION BY object_id, gallery, section ORDER BY ts, channel_id), ts) <= 30 THEN 0 ELSE 1 END AS is_new
          FROM ({FLAGGED_SQL}) WHERE NOT off_guard)"""
VALID_SQL = f"""
    SELECT object_id, gallery, section, incident, min(ts) AS started, max(ts) AS ended, count(*) AS n_moments
    FROM ({ARMED_SQL}) JOIN section_contacts USING (object_id, gallery, section) GROUP BY object_id, gallery, section, incident
    HAVING bool_or(kind = 'contact') OR count(DISTINCT CASE WHEN kind = 'motion' THEN channel_id END) >= 2 OR min(entry_dist) <= 6 OR coalesce(max(n_contact), 0) < 2"""


def windows(t):
    return stored(disarm_windows(t.guard))


def moments_with_contacts(t):
    return t.moment.join(t.section_contacts, list(SECTION), "left")


@query("moment_in_disarm_window", "object_id:i channel_id:i ts:t kind:s off_guard:b", f"SELECT object_id, channel_id, ts, kind, CAST(off_guard AS INT) AS off_guard FROM ({FLAGGED_SQL})")
def _(t):
    return se.off_guard(t.moment, windows(t))


@query("access_incident", "object_id:i gallery:i section:i incident:i started:t ended:t n_moments:i", f"""
    SELECT object_id, gallery, section, incident, min(ts) AS started, max(ts) AS ended, count(*) AS n_moments FROM ({ARMED_SQL}) GROUP BY object_id, gallery, section, incident""")
def _(t):
    armed = stored(se.off_guard(moments_with_contacts(t), windows(t)).filter("NOT off_guard"))
    return se.incident_facts(se.incidents(armed, SECTION), SECTION)


@query("access_incident_exact", "object_id:i gallery:i section:i incident:i started:t n_moments:i", f"""
    SELECT object_id, gallery, section, incident, min(ts) AS started, count(*) AS n_moments FROM (
      SELECT *, sum(is_new) OVER (PARTITION BY object_id, gallery, section ORDER BY ts, channel_id ROWS UNBOUNDED PRECEDING) AS incident
      FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY object_id, gallery, section ORDER BY ts, channel_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS is_new
            FROM ({FLAGGED_SQL}) WHERE NOT off_guard)) GROUP BY object_id, gallery, section, incident""")
def _(t):
    armed = stored(se.off_guard(moments_with_contacts(t), windows(t)).filter("NOT off_guard"))
    return se.incident_facts(se.incidents(armed, SECTION, exact=True), SECTION)


@query("valid_incident", "object_id:i gallery:i section:i incident:i started:t ended:t n_moments:i", VALID_SQL)
def _(t):
    armed = stored(se.off_guard(moments_with_contacts(t), windows(t)).filter("NOT off_guard"))
    return se.incident_facts(se.incidents(armed, SECTION), SECTION).filter(se.is_valid())


EVENT_SQL = f"""
    SELECT f.object_id, f.gallery, f.section, f.channel_id, f.ts, f.kind, f.n_rows, f.off_guard, v.incident IS NOT NULL AS event
    FROM ({FLAGGED_SQL}) f LEFT JOIN ({ARMED_SQL}) a ON a.channel_id = f.channel_id AND a.ts = f.ts AND a.kind = f.kind
    LEFT JOIN ({VALID_SQL}) v ON v.object_id = a.object_id AND v.gallery = a.gallery AND v.section = a.section AND v.incident = a.incident"""


def flagged(t):
    return se.flag_events(moments_with_contacts(t), windows(t), SECTION)


@query("flag_events", "channel_id:i ts:t kind:s off_guard:b event:b", f"SELECT channel_id, ts, kind, CAST(off_guard AS INT) AS off_guard, CAST(event AS INT) AS event FROM ({EVENT_SQL})")
def _(t):
    return flagged(t)


@query("armed_hourly_rollup", "object_id:i gallery:i section:i hour:t n_alarms:i n_moments:i n_channels:i", f"""
    SELECT object_id, gallery, section, date_trunc('hour', ts) AS hour, sum(n_rows) AS n_alarms, count(*) AS n_moments, count(DISTINCT channel_id) AS n_channels
    FROM ({EVENT_SQL}) WHERE event GROUP BY 1, 2, 3, 4""")
def _(t):
    return jr.hourly_rollup(flagged(t).filter("event"), SECTION)


@query("episodes_per_day", "object_id:i gallery:i picket:i day:D first_ts:t span_minutes:i n_episodes:i", """
    SELECT object_id, gallery, picket, day, min(ts) AS first_ts, date_diff('minute', min(ts), max(ts)) AS span_minutes, 1 + count(*) FILTER (gap > 30) AS n_episodes
    FROM (SELECT *, date_diff('minute', lag(ts) OVER (PARTITION BY object_id, gallery, picket, day ORDER BY ts), ts) AS gap FROM fire_signal) GROUP BY object_id, gallery, picket, day""")
def _(t):
    return se.episodes_per_day(t.fire_signal, PICKET)


@query("dataset_stats", "moments:i off_guard:i events:i armed_not_event:i windows:i seconds_off:i", f"""
    SELECT count(*) AS moments, count(*) FILTER (off_guard) AS off_guard, count(*) FILTER (event) AS events, count(*) FILTER (NOT off_guard AND NOT event) AS armed_not_event,
           (SELECT count(*) FROM ({WINDOWS_SQL})) AS windows, (SELECT sum(date_diff('second', t_from, t_to)) FROM ({WINDOWS_SQL})) AS seconds_off FROM ({EVENT_SQL})""")
def _(t):
    from undercroft.functions.clock import boundary_diff

    counts = flagged(t).agg(
        F.count(F.lit(1)).alias("moments"), F.count_if("off_guard").alias("off_guard"), F.count_if("event").alias("events"),
        F.count_if(~F.col("off_guard") & ~F.col("event")).alias("armed_not_event"))
    w = windows(t).agg(F.count(F.lit(1)).alias("windows"), F.sum(boundary_diff("second", "t_from", "t_to")).alias("seconds_off"))
    return jr.side_by_side(counts, w)
