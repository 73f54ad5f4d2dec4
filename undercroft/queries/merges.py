"""Card and order merges, upserts, action replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from undercroft.operators import actions as ac
from undercroft.operators import cards as cm
from undercroft.operators import orders as om
from undercroft.queries.base import query
from undercroft.session import scratch_path
from undercroft.sources import stores as st
from undercroft.sources import writers as wr

AT = "2001-08-02 09:00:00"
FIN = "('DECIDED', 'CLOSED_CONFIRMED', 'CLOSED_NOT_CONFIRMED')"
CARD_SQL = "SELECT CAST(prediction_id AS VARCHAR) AS prediction_id, facility_id, direction, bucket, status, assignee, CASE WHEN prediction_id % 17 = 0 THEN 'AGREED' END AS verdict, probability, level, computed_at, 0 AS run_id FROM card"
FORE_SQL = f"""
    SELECT facility_id, direction, CASE facility_id % 4 WHEN 0 THEN max(bucket) WHEN 1 THEN max(bucket) - INTERVAL 1 DAY WHEN 2 THEN min(bucket) ELSE TIMESTAMP '2001-08-02' END AS bucket, TIMESTAMP '{AT}' AS computed_at,
      CASE WHEN facility_id % 3 = 0 THEN TIMESTAMP '{AT}' - INTERVAL 1 HOUR WHEN facility_id % 3 = 1 THEN TIMESTAMP '1995-01-01' END AS event_at, CAST(facility_id % 100 AS DOUBLE) / 100 AS probability FROM card WHERE facility_id % 5 <> 4 GROUP BY facility_id, direction
    UNION ALL SELECT facility_id + 1000000, 'COLD_RISK', TIMESTAMP '2001-08-02', TIMESTAMP '{AT}', NULL, 0.9 FROM facility WHERE facility_id % 7 = 0"""


def stored_cards(t):
    return t.spark.sql(CARD_SQL.replace("VARCHAR", "STRING").replace("FROM card", "FROM {c}"), c=t.card).withColumn("run_id", F.lit(0).cast("long"))


def forecasts(t):
    text = FORE_SQL.replace("FROM card", "FROM {c}").replace("FROM facility", "FROM {f}")
    return cm.assign_levels(t.spark.sql(text, c=t.card, f=t.facility)).withColumn("run_id", F.lit(7).cast("long"))


PLAN_SQL = f"""
    WITH c AS ({CARD_SQL}), f AS ({FORE_SQL}),
    j AS (SELECT f.*, (SELECT count(*) FROM c WHERE c.facility_id = f.facility_id AND c.direction = f.direction AND c.status IN ('IN_REVIEW', 'ORDER_OPEN')) AS busy,
      (SELECT arg_max(prediction_id, (bucket, prediction_id)) FROM c WHERE c.facility_id = f.facility_id AND c.direction = f.direction AND status = 'NEW' AND assignee IS NULL AND verdict IS NULL) AS open_id,
      (SELECT max(bucket) FROM c WHERE c.facility_id = f.facility_id AND c.direction = f.direction AND status = 'NEW' AND assignee IS NULL AND verdict IS NULL) AS open_bucket,
      (SELECT max(prediction_id) FROM c WHERE c.facility_id = f.facility_id AND c.direction = f.direction AND c.bucket = f.bucket) AS same_id,
      (SELECT arg_max(prediction_id, (bucket, prediction_id)) FROM c WHERE c.facility_id = f.facility_id AND c.direction = f.direction AND c.bucket >= f.bucket) AS late_id,
      (SELECT max(bucket) FROM c WHERE c.facility_id = f.facility_id AND c.direction = f.direction AND c.bucket >= f.bucket) AS late_bucket FROM f),
    k AS (SELECT j.*, l.status AS late_status, l.computed_at AS late_at FROM j LEFT JOIN c l ON l.prediction_id = j.late_id),
    p AS (SELECT facility_id, direction, probability, event_at, CASE WHEN busy > 0 THEN CASE WHEN same_id IS NOT NULL THEN 'refresh' ELSE 'none' END WHEN open_id IS NOT NULL THEN 'follow' WHEN late_id IS NULL THEN 'insert'
        WHEN late_status NOT IN {FIN} THEN 'refresh' WHEN event_at > late_at THEN 'insert' ELSE 'none' END AS action,
      CASE WHEN busy > 0 THEN same_id WHEN open_id IS NOT NULL THEN open_id WHEN late_status NOT IN {FIN} THEN late_id END AS target_id,
      CASE WHEN busy > 0 THEN bucket WHEN open_id IS NOT NULL THEN CASE WHEN same_id <> open_id THEN open_bucket ELSE bucket END WHEN late_id IS NULL THEN bucket WHEN late_status NOT IN {FIN} THEN late_bucket WHEN event_at > late_at THEN TIMESTAMP '{AT}' ELSE late_bucket END AS bucket, open_bucket FROM k)
    SELECT facility_id, direction, probability, action, target_id, bucket, CASE WHEN action = 'follow' AND bucket <> open_bucket OR action = 'insert' THEN 1 ELSE 0 END AS is_new FROM p"""


@query("merge_plan", "facility_id:i direction:s action:s target_id:s bucket:t is_new:b", PLAN_SQL)
def _(t):
    return cm.merge_plan(stored_cards(t), forecasts(t))


MERGED_SPEC = "prediction_id:s facility_id:i direction:s bucket:t status:s probability:d level:s computed_at:t run_id:i is_new:b"
MERGED_SQL = f"""
    WITH p AS ({PLAN_SQL}), q AS (SELECT *, CASE direction WHEN 'FLOOD_RISK' THEN CASE WHEN probability >= 0.3 THEN 'CRITICAL' WHEN probability >= 0.092818 THEN 'HIGH' WHEN probability >= 0.011471 THEN 'MEDIUM' ELSE 'LOW' END
       WHEN 'UNAUTHORIZED_ACCESS' THEN CASE WHEN probability >= 0.3 THEN 'CRITICAL' WHEN probability >= 0.140342 THEN 'HIGH' WHEN probability >= 0.008183 THEN 'MEDIUM' ELSE 'LOW' END
       ELSE CASE WHEN probability >= 0.78 THEN 'CRITICAL' WHEN probability >= 0.55 THEN 'HIGH' WHEN probability >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END END AS lv FROM p)
    SELECT c.prediction_id, c.facility_id, c.direction, CASE WHEN q.action = 'follow' THEN q.bucket ELSE c.bucket END AS bucket, c.status, CASE WHEN q.action = 'follow' THEN q.probability ELSE c.probability END AS probability, CASE WHEN q.action = 'follow' THEN q.lv ELSE c.level END AS level,
      CASE WHEN q.action = 'follow' OR q.action = 'refresh' AND c.status NOT IN {FIN} THEN TIMESTAMP '{AT}' ELSE c.computed_at END AS computed_at, CASE WHEN q.action = 'follow' THEN 7 ELSE 0 END AS run_id, CASE WHEN q.action = 'follow' THEN q.is_new ELSE 0 END AS is_new
    FROM ({CARD_SQL}) c LEFT JOIN q ON q.target_id = c.prediction_id AND q.action IN ('follow', 'refresh')
    UNION ALL SELECT concat(direction, '-', facility_id, '-', CAST(epoch(bucket) AS BIGINT)), facility_id, direction, bucket, 'NEW', probability, lv, TIMESTAMP '{AT}', 7, 1 FROM q WHERE action = 'insert'"""


@query("merge_cards", MERGED_SPEC, MERGED_SQL)
def _(t):
    return cm.merge_cards(stored_cards(t), forecasts(t))


@query("merge_cards_stored", MERGED_SPEC.replace(" is_new:b", ""), f"SELECT * EXCLUDE (is_new) FROM ({MERGED_SQL})")
def _(t):
    path = scratch_path(t.spark, "cards")
    st.write_cards(stored_cards(t), path)
    st.merge_stored(t.spark, path, forecasts(t))
    return st.read_cards(t.spark, path)


#: Cards after a first run, then the plan of the same forecasts over them.
AGAIN_SQL = f"""
    WITH p AS ({PLAN_SQL}),
    a AS (SELECT c.prediction_id, c.facility_id, c.direction, CASE WHEN p.action = 'follow' THEN p.bucket ELSE c.bucket END AS bucket, c.status, c.assignee, c.verdict,
            CASE WHEN p.action = 'follow' OR p.action = 'refresh' AND c.status NOT IN {FIN} THEN TIMESTAMP '{AT}' ELSE c.computed_at END AS computed_at
          FROM ({CARD_SQL}) c LEFT JOIN p ON p.target_id = c.prediction_id AND p.action IN ('follow', 'refresh')
          UNION ALL SELECT concat(direction, '-', facility_id, '-', CAST(epoch(bucket) AS BIGINT)), facility_id, direction, bucket, 'NEW', NULL, NULL, TIMESTAMP '{AT}' FROM p WHERE action = 'insert')
    SELECT coalesce(sum(is_new), 0) AS changed FROM ({PLAN_SQL.replace(CARD_SQL, "SELECT * FROM a")})"""


@query("merge_cards_rerun", "changed:i", AGAIN_SQL)
def _(t):
    first = cm.merge_cards(stored_cards(t), forecasts(t)).drop("is_new")
    again = cm.merge_cards(first, forecasts(t))
    return again.agg(F.count_if("is_new").alias("changed"))


@query("set_difference_busy", "facility_id:i direction:s", f"""
    SELECT facility_id, direction FROM ({FORE_SQL}) f WHERE NOT EXISTS (SELECT 1 FROM card c WHERE c.facility_id = f.facility_id AND c.direction = f.direction AND c.status IN ('IN_REVIEW', 'ORDER_OPEN'))""")
def _(t):
    return cm.without_busy(forecasts(t), t.card)


@query("refresh_taken", "prediction_id:i n:i first_title:s computed_at:t", f"""
    SELECT prediction_id, CASE WHEN status NOT IN {FIN} AND prediction_id % 2 = 0 THEN 3 ELSE 2 END AS n, CASE WHEN status NOT IN {FIN} AND prediction_id % 2 = 0 THEN 'fresh series' ELSE 'old series' END AS first_title,
      CASE WHEN status NOT IN {FIN} AND prediction_id % 2 = 0 THEN TIMESTAMP '{AT}' ELSE computed_at END AS computed_at FROM card""")
def _(t):
    block = lambda kind, title: F.struct(F.lit(kind).alias("type"), F.lit(title).alias("title"), F.lit("{}").alias("data"))
    cards = t.card.withColumn("blocks", F.array(block("timeseries", "old series"), block("factors", "why")))
    live = t.card.filter("prediction_id % 2 = 0").select("prediction_id", F.array(
        block("timeseries", "fresh series"), block("factors", "why"), block("keyvalue", "freshness")).alias("live_blocks"))
    out = cm.refresh_taken(cards, live, AT)
    return out.select("prediction_id", F.size("blocks").alias("n"), F.get("blocks", F.lit(0))["title"].alias("first_title"), "computed_at")


@query("stale_refresh", "prediction_id:i", f"SELECT prediction_id FROM card WHERE bucket = TIMESTAMP '1998-06-09' AND computed_at <= TIMESTAMP '1998-06-09 11:55:00' AND status NOT IN {FIN}")
def _(t):
    return cm.stale_refresh(t.card, "1998-06-09 12:00:00")


@query("done_today", "direction:s done:b", "SELECT direction, CAST(bool_or(CASE direction WHEN 'FIRE_RISK' THEN computed_at >= TIMESTAMP '2001-08-01' ELSE bucket = TIMESTAMP '2001-08-01' END) AS INT) AS done FROM card GROUP BY direction")
def _(t):
    return cm.done_today(t.card, "2001-08-01 12:00:00")


@query("suppressed_level", "facility_id:i direction:s muted:i", """
    SELECT facility_id, direction, max(CASE level WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END) AS muted FROM card WHERE suppress_until > TIMESTAMP '1999-01-01' GROUP BY 1, 2""")
def _(t):
    return cm.suppressed_level(t.card, "1999-01-01 00:00:00")


@query("run_report", "prediction_count:i cards:i order_count:i duration_ms:i", """
    SELECT (SELECT count(*) FROM card WHERE status = 'NEW') AS prediction_count, (SELECT count(*) FROM card) AS cards, (SELECT count(*) FROM work_order) AS order_count, 90500 AS duration_ms""")
def _(t):
    merged = t.card.withColumn("is_new", F.col("status") == "NEW")
    return cm.run_report(merged, t.work_order, "2024-01-01 00:00:00", "2024-01-01 00:01:30.5")


@query("stream_lag", "stream_events:i stream_lag_ms:i", """
    SELECT count(*) AS stream_events, CAST(max(epoch(TIMESTAMP '2024-01-15 12:01:00') - epoch(ts)) * 1000 AS BIGINT) AS stream_lag_ms FROM journal WHERE ts + INTERVAL 20 SECOND > TIMESTAMP '2024-01-15 06:00:00' AND ts + INTERVAL 20 SECOND <= TIMESTAMP '2024-01-15 12:00:00'""")
def _(t):
    events = t.journal.select(F.col("ts").alias("occurred_at"), (F.col("ts") + F.expr("INTERVAL 20 SECONDS")).alias("received_at"))
    return cm.stream_lag(events, "2024-01-15 06:00:00", "2024-01-15 12:00:00", "2024-01-15 12:01:00")


# --- orders ----------------------------------------------------------------------------

CAND_SQL = "SELECT max(prediction_id) AS prediction_id, facility_id, direction, arg_max(level, prediction_id) AS level, arg_max(horizon_hours, prediction_id) AS horizon_hours, arg_max(computed_at, prediction_id) AS computed_at FROM card GROUP BY facility_id, direction"
ORD_SQL = f"SELECT c.*, (SELECT arg_max(order_id, (created_at, order_id)) FROM work_order o WHERE o.facility_id = c.facility_id AND o.direction = c.direction AND o.status = 'AUTO_CREATED') AS auto_id FROM ({CAND_SQL}) c"
DUE_SQL = "CASE direction WHEN 'FIRE_RISK' THEN computed_at + horizon_hours * INTERVAL 30 MINUTE ELSE date_trunc('day', computed_at + INTERVAL 3 HOUR) - INTERVAL 3 HOUR + INTERVAL 1 DAY END"


def candidates(t):
    last = F.max_by(F.struct("level", "horizon_hours", "computed_at"), "prediction_id").alias("l")
    return t.card.groupBy("facility_id", "direction").agg(F.max("prediction_id").alias("prediction_id"), last).select(
        "prediction_id", "facility_id", "direction", "l.*")


@query("follow_orders", "order_id:i prediction_id:i status:s due_at:t", f"""
    SELECT o.order_id, CASE WHEN c.level IN ('HIGH', 'CRITICAL') THEN c.prediction_id ELSE o.prediction_id END AS prediction_id, CASE WHEN c.auto_id IS NOT NULL AND c.level NOT IN ('HIGH', 'CRITICAL') THEN 'REJECTED' ELSE o.status END AS status,
      CASE WHEN c.level IN ('HIGH', 'CRITICAL') THEN c.due ELSE o.due_at END AS due_at FROM work_order o LEFT JOIN (SELECT *, {DUE_SQL} AS due FROM ({ORD_SQL})) c ON c.auto_id = o.order_id""")
def _(t):
    return om.follow_orders(t.work_order, candidates(t))


@query("follow_log", "entity_id:s action_code:s", f"""
    SELECT CAST(auto_id AS VARCHAR) AS entity_id, CASE WHEN level IN ('HIGH', 'CRITICAL') THEN 'relink' ELSE 'auto_reject' END AS action_code FROM ({ORD_SQL}) c JOIN work_order o ON o.order_id = c.auto_id WHERE level NOT IN ('HIGH', 'CRITICAL') OR o.prediction_id <> c.prediction_id""")
def _(t):
    return om.follow_log(t.work_order, candidates(t))


@query("create_orders", "number:s prediction_id:i direction:s due_at:t status:s", f"""
    SELECT concat('2001-', CASE WHEN n + 41 < 10000 THEN lpad(CAST(n + 41 AS VARCHAR), 4, '0') ELSE CAST(n + 41 AS VARCHAR) END) AS number, prediction_id, direction, due AS due_at, 'AUTO_CREATED' AS status FROM (
      SELECT *, {DUE_SQL} AS due, row_number() OVER (ORDER BY facility_id, direction, prediction_id) AS n FROM ({ORD_SQL}) c WHERE auto_id IS NULL AND level IN ('HIGH', 'CRITICAL')
        AND CASE level WHEN 'HIGH' THEN 3 ELSE 4 END > coalesce((SELECT max(CASE s.level WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END) FROM card s WHERE s.facility_id = c.facility_id AND s.direction = c.direction AND s.suppress_until > c.computed_at), 0))""")
def _(t):
    return om.create_orders(t.work_order, candidates(t), t.card, 2001, 41)


# --- upserts ---------------------------------------------------------------------------


@query("upsert_replace", "day:D precip_mm:d temp_mean:d", """
    SELECT day, CASE WHEN day >= DATE '2001-01-01' THEN precip_mm + 1 ELSE precip_mm END AS precip_mm, CASE WHEN day >= DATE '2001-01-01' THEN temp_mean - 1 ELSE temp_mean END AS temp_mean FROM weather_daily""")
def _(t):
    stored = t.weather_daily.filter("day < DATE '2001-06-01'").select("day", "precip_mm", "temp_mean")
    fresh = t.weather_daily.filter("day >= DATE '2001-01-01'")
    old = fresh.select("day", (F.col("precip_mm") * 0).alias("precip_mm"), (F.col("temp_mean") * 0).alias("temp_mean"), F.lit(1).alias("version"))
    new = fresh.select("day", (F.col("precip_mm") + 1).alias("precip_mm"), (F.col("temp_mean") - 1).alias("temp_mean"), F.lit(2).alias("version"))
    return wr.upsert_replace(stored, old.unionByName(new), ("day",))


@query("upsert_greatest", "channel_id:i hour:t value:d", "SELECT channel_id, hour, max(value) AS value FROM journal WHERE event_type IN ('purchase', 'view') GROUP BY 1, 2")
def _(t):
    half = lambda kind: t.journal.filter(F.col("event_type") == kind).groupBy("channel_id", "hour").agg(F.max("value").alias("value"))
    return wr.upsert_greatest(half("purchase"), half("view"), ("channel_id", "hour"))


# --- action log ------------------------------------------------------------------------

VERBS = ("take", "decide", "assign", "close", "release", "reject")


def action_log(t):
    verb = F.element_at(F.array(*[F.lit(v) for v in VERBS]), (F.col("l_partkey") % 6 + 1).cast("int"))
    level = F.when(F.col("l_quantity") >= 25, "HIGH").otherwise("LOW")
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("prediction_id"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_linenumber").alias("seq"), verb.alias("action"), level.alias("level"),
        (F.col("l_discount") > 0.05).alias("fact"), (F.col("l_tax") > 0.06).alias("busy"), F.col("l_partkey"))
    return rows.withColumn("event", ac.event_of())


def moves_sql() -> str:
    """Allowed moves of the joint state as rows."""
    rows = [(e, c, o, *to) for e in ac.EVENTS for c in ac.CARD for o in ac.ORDER if (to := ac.step(e, c, o))]
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


LOG_SQL = """
    SELECT l_orderkey AS prediction_id, CAST(l_shipdate AS TIMESTAMP) AS ts, l_linenumber AS seq, l_partkey, CASE l_partkey % 6 WHEN 0 THEN 'take' WHEN 2 THEN 'assign' WHEN 4 THEN 'release' WHEN 5 THEN 'reject'
           WHEN 3 THEN CASE WHEN l_discount > 0.05 THEN 'close_yes' ELSE 'close_no' END ELSE CASE WHEN l_quantity >= 25 THEN CASE WHEN l_tax > 0.06 THEN 'decide_busy' ELSE 'decide_order' END ELSE 'decide_close' END END AS event FROM lineitem"""


@query("replay_actions", "prediction_id:i card_status:s order_status:s applied:i ignored:i", f"""
    WITH RECURSIVE log AS (SELECT prediction_id, event, row_number() OVER (PARTITION BY prediction_id ORDER BY ts, seq, l_partkey, event) AS n FROM ({LOG_SQL})),
    moves AS (SELECT * FROM (VALUES {moves_sql()}) AS v(event, c, o, c2, o2)),
    run(prediction_id, n, c, o, applied) AS (
      SELECT DISTINCT prediction_id, CAST(0 AS BIGINT), 'NEW', 'NONE', 0 FROM log
      UNION ALL SELECT r.prediction_id, l.n, coalesce(m.c2, r.c), coalesce(m.o2, r.o), r.applied + CASE WHEN m.c2 IS NULL THEN 0 ELSE 1 END
      FROM run r JOIN log l ON l.prediction_id = r.prediction_id AND l.n = r.n + 1 LEFT JOIN moves m ON m.event = l.event AND m.c = r.c AND m.o = r.o)
    SELECT prediction_id, arg_max(c, n) AS card_status, arg_max(o, n) AS order_status, max(applied) AS applied, max(n) - max(applied) AS ignored FROM run GROUP BY prediction_id""")
def _(t):
    log = action_log(t).select("prediction_id", "ts", "seq", "l_partkey", "event")
    start = t.card.select("prediction_id", F.lit("NEW").alias("card_status"), F.lit("NONE").alias("order_status"))
    replayed = ac.replay(log, start, tiebreak=("seq", "l_partkey"))
    return ac.final_states(replayed, tiebreak=("seq", "l_partkey"))


# --- one run over all directions -----------------------------------------------------------

RUN_AT = "2001-08-02 09:00:00"


def run_predictors():
    """Scores by rule of the unit's number: enough to drive every branch of a run."""
    from undercroft.plans.run import Predictor, Predictors

    def score(step):
        return lambda units, at: units.select("facility_id", (F.col("facility_id") * step % 100 / 100).alias("probability"), F.lit(None).cast("timestamp").alias("event_at"))

    out = Predictors()
    out.add("FLOOD_RISK", Predictor(score(37), applies=lambda units, at: units.filter("facility_id % 3 <> 0"), features=("facility_id",)))
    out.add("UNAUTHORIZED_ACCESS", Predictor(score(53)))
    out.add("FIRE_RISK", Predictor(score(71), bands=lambda rows, at: (("MEDIUM", 0.25), ("HIGH", 0.5), ("CRITICAL", 0.75))))
    return out


def run_tables(t):
    cards = stored_cards(t).withColumn("facility_id", F.col("facility_id").cast("long"))
    orders = t.work_order.withColumn("order_id", F.col("order_id").cast("string")).withColumn("prediction_id", F.col("prediction_id").cast("string"))
    return t.facility.select("facility_id"), cards, orders


RUN_FORE_SQL = f"""
    SELECT facility_id, direction, TIMESTAMP '2001-08-02' AS bucket, TIMESTAMP '{RUN_AT}' AS computed_at, CAST(NULL AS TIMESTAMP) AS event_at, CAST(facility_id * step % 100 AS DOUBLE) / 100 AS probability
    FROM facility CROSS JOIN (VALUES ('FLOOD_RISK', 37), ('UNAUTHORIZED_ACCESS', 53), ('FIRE_RISK', 71)) AS d(direction, step) WHERE direction <> 'FLOOD_RISK' OR facility_id % 3 <> 0"""


@query("direction_run", "direction:s new_cards:i", f"""
    SELECT direction, coalesce(sum(n), 0) AS new_cards FROM (SELECT direction, is_new AS n FROM ({PLAN_SQL.replace(FORE_SQL, RUN_FORE_SQL)}) UNION ALL SELECT direction, 0 FROM card) GROUP BY direction""")
def _(t):
    from undercroft.plans.run import run_directions

    return run_directions(run_predictors(), *run_tables(t), RUN_AT, 7)["report"]


@query("direction_run_again", "new_cards:i new_orders:i", "SELECT 0 AS new_cards, 0 AS new_orders")
def _(t):
    from undercroft.plans.run import run_directions

    units, cards, orders = run_tables(t)
    first = run_directions(run_predictors(), units, cards, orders, RUN_AT, 7)
    again = run_directions(run_predictors(), units, first["cards"], first["orders"], RUN_AT, 7, 10_000)
    return again["report"].agg(F.sum("new_cards").alias("new_cards"), F.sum("new_orders").alias("new_orders"))


def hooked_predictors():
    """A direction of the stream with every hook, a daily one without."""
    from undercroft.plans.cadence import moved_since
    from undercroft.plans.run import Predictor, Predictors

    def scores(units, at):
        return units.select("facility_id", (F.col("facility_id") * 71 % 100 / 100).alias("probability"))

    hours = lambda at, n: F.lit(at).cast("timestamp") - F.make_dt_interval(hours=(F.col("facility_id") % n).cast("int"))
    out = Predictors()
    out.add("FLOOD_RISK", Predictor(scores, applies=lambda units, at: units.filter("facility_id % 3 <> 0")))
    out.add("FIRE_RISK", Predictor(
        scores, level=lambda at: F.when(F.col("facility_id") % 5 == 0, "CRITICAL").otherwise("MEDIUM"),
        incident=lambda at: F.when(F.col("facility_id") % 4 > 0, hours(at, 20)), last_event=lambda at: hours(at, 7),
        summary=lambda at: F.concat(F.lit("сигналов "), (F.col("facility_id") % 9).cast("string")), candidates=moved_since))
    return out


HOOK_SQL = f"""
    SELECT facility_id, 'FLOOD_RISK' AS direction, TIMESTAMP '{RUN_AT}' AS computed_at, TIMESTAMP '2001-08-02' AS bucket, CAST(NULL AS TIMESTAMP) AS event_at, CASE WHEN facility_id * 71 % 100 >= 30 THEN 'CRITICAL' WHEN facility_id * 71 % 100 / 100.0 >= 0.092818 THEN 'HIGH' WHEN facility_id * 71 % 100 / 100.0 >= 0.011471 THEN 'MEDIUM' ELSE 'LOW' END AS level, CAST(NULL AS VARCHAR) AS summary FROM facility WHERE facility_id % 3 <> 0
    UNION ALL SELECT facility_id, 'FIRE_RISK', TIMESTAMP '{RUN_AT}', CASE WHEN facility_id % 4 = 0 THEN TIMESTAMP '2001-08-02' ELSE TIMESTAMP '{RUN_AT}' - to_hours(facility_id % 20) END, TIMESTAMP '{RUN_AT}' - to_hours(facility_id % 7), CASE WHEN facility_id % 5 = 0 THEN 'CRITICAL' ELSE 'MEDIUM' END, concat('сигналов ', facility_id % 9) FROM facility"""


@query("direction_run_forecasts", "facility_id:i direction:s computed_at:t bucket:t event_at:t level:s summary:s", HOOK_SQL)
def _(t):
    from undercroft.plans.run import run_directions

    return run_directions(hooked_predictors(), *run_tables(t), RUN_AT, 7)["forecasts"]


RUN_CARDS_SQL = f"""
    WITH p AS ({PLAN_SQL.replace(FORE_SQL, RUN_FORE_SQL)}), b AS (SELECT * FROM (VALUES ('FLOOD_RISK', 0.011471, 0.092818, 0.3), ('UNAUTHORIZED_ACCESS', 0.008183, 0.140342, 0.3), ('FIRE_RISK', 0.25, 0.5, 0.75)) AS v(direction, m, h, c)),
    q AS (SELECT p.*, CASE WHEN probability >= c THEN 'CRITICAL' WHEN probability >= h THEN 'HIGH' WHEN probability >= m THEN 'MEDIUM' ELSE 'LOW' END AS lv FROM p JOIN b USING (direction))
    SELECT c.prediction_id, c.facility_id, c.direction, CASE WHEN q.action = 'follow' THEN q.bucket ELSE c.bucket END AS bucket, c.status, CASE WHEN q.action = 'follow' THEN q.probability ELSE c.probability END AS probability, CASE WHEN q.action = 'follow' THEN q.lv ELSE c.level END AS level,
      CASE WHEN q.action = 'follow' OR q.action = 'refresh' AND c.status NOT IN {FIN} THEN TIMESTAMP '{RUN_AT}' ELSE c.computed_at END AS computed_at, CASE WHEN q.action = 'follow' THEN 7 ELSE 0 END AS run_id
    FROM ({CARD_SQL}) c LEFT JOIN q ON q.target_id = c.prediction_id AND q.action IN ('follow', 'refresh')
    UNION ALL SELECT concat(direction, '-', facility_id, '-', CAST(epoch(bucket) AS BIGINT)), facility_id, direction, bucket, 'NEW', probability, lv, TIMESTAMP '{RUN_AT}', 7 FROM q WHERE action = 'insert'"""


@query("direction_run_cards", "prediction_id:s facility_id:i direction:s bucket:t status:s probability:d level:s computed_at:t run_id:i", RUN_CARDS_SQL)
def _(t):
    from undercroft.plans.run import run_directions

    return run_directions(run_predictors(), *run_tables(t), RUN_AT, 7)["cards"]


#: Quarters of two days in which batches arrive.
ARRIVALS = ("2024-01-10 00:00:00", "2024-01-10 06:00:00", "2024-01-10 12:00:00", "2024-01-11 00:00:00")
CADENCE_SQL = f"""
    WITH e AS (SELECT channel_id % 100 AS f, ts, {" ".join(["CASE", *[f"WHEN ts >= TIMESTAMP '{at}' AND ts < TIMESTAMP '{at}' + INTERVAL 6 HOUR THEN {k}" for k, at in enumerate(ARRIVALS)], "END"])} AS k FROM journal),
    m AS (SELECT k, max(max(ts)) OVER (ORDER BY k) AS moment FROM e WHERE k IS NOT NULL GROUP BY k), u AS (SELECT DISTINCT channel_id % 100 AS f FROM journal)
    SELECT 'FIRE_RISK' AS direction, k AS run_id, moment AS "at", 1 AS "full", (SELECT count(*) FROM u) AS scored FROM m WHERE k IN (0, 3)
    UNION ALL SELECT 'FLOOD_RISK', k, moment, 1, (SELECT count(*) FROM u WHERE f % 3 <> 0) FROM m WHERE k IN (0, 3)
    UNION ALL SELECT 'FIRE_RISK', m.k, m.moment, 0, (SELECT count(DISTINCT f) FROM e WHERE e.k <= m.k AND (ts > p.moment AND ts <= m.moment OR ts > p.moment - INTERVAL 24 HOUR AND ts <= m.moment - INTERVAL 24 HOUR)) FROM m JOIN m p ON p.k = m.k - 1 WHERE m.k IN (1, 2)"""


@query("cadence_runs", "direction:s run_id:i at:t full:b scored:i", CADENCE_SQL)
def _(t):
    """Batches of a stream over two days: the second and third of a day score only units with new events, and no daily direction."""
    from undercroft.plans.cadence import serve, served
    from undercroft.session import scratch_path

    path, source = scratch_path(t.spark, "cadence"), scratch_path(t.spark, "cadence-events")
    rows = t.journal.select((F.col("channel_id") % 100).alias("facility_id"), "ts")
    for at in ARRIVALS:
        start = F.lit(at).cast("timestamp")
        rows.filter((F.col("ts") >= start) & (F.col("ts") < start + F.expr("INTERVAL 6 HOURS"))).coalesce(1).write.mode("append").parquet(source)
    stream = t.spark.readStream.schema("facility_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    _, cards, orders = run_tables(t)
    serve(stream, hooked_predictors(), rows.select("facility_id").distinct(), cards.filter("false"), orders.filter("false"), path, f"{path}-state", every=None).awaitTermination()
    return served(t.spark, path, "runs")
