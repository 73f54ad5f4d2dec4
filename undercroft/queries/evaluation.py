"""Scores, thresholds, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from undercroft import config
from undercroft.operators import budget as bg
from undercroft.operators import evaluate as ev
from undercroft.operators.ordered import exact_quantile
from undercroft.queries.base import query

KEYS = ("unit_id", "day")
RANK_SQL = """
    SELECT *, row_number() OVER (ORDER BY p DESC, unit_id, day) AS rn, sum(y) OVER (ORDER BY p DESC, unit_id, day ROWS UNBOUNDED PRECEDING) AS tp, sum(y) OVER () AS pos, count(*) OVER () AS n FROM scored"""


def order(t):
    return ev.score_order(t.scored, KEYS)


@query("rule_point", "precision:d recall:d alerts:i hits:i", """
    SELECT round(h / a, 6) AS precision, round(h / s, 6) AS recall, a AS alerts, h AS hits FROM (SELECT sum(naive) AS a, sum(naive * y) AS h, sum(y) AS s FROM scored)""")
def _(t):
    return ev.rule_point(t.scored, F.col("naive") == 1)


@query("blend_levels", "medium:d high:d critical:d", """
    SELECT round(avg(y), 6) AS medium, 0.55 AS high, (SELECT min(s) FROM (VALUES (0.3), (0.4), (0.5), (0.6), (0.8)) AS v(s) WHERE s > 0.55) AS critical FROM scored""")
def _(t):
    return ev.level_bounds(t.scored, 0.55)


@query("rule_point_by_year", "year:i precision:d recall:d alerts:i hits:i", """
    SELECT year, round(h / a, 6) AS precision, CASE WHEN s > 0 THEN round(h / s, 6) ELSE 0 END AS recall, a AS alerts, h AS hits FROM (
      SELECT year(day) AS year, sum(CASE WHEN p >= 0.6 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN p >= 0.6 THEN y ELSE 0 END) AS h, sum(y) AS s FROM scored GROUP BY 1)""")
def _(t):
    return ev.rule_point(t.scored.withColumn("year", F.year("day")), F.col("p") >= 0.6, ["year"])


@query("pr_auc", "pr_auc:d", f"SELECT sum(CASE WHEN y = 1 THEN CAST(tp AS DOUBLE) / rn END) / max(pos) AS pr_auc FROM ({RANK_SQL})")
def _(t):
    return ev.pr_auc(t.scored, KEYS)


@query("pr_auc_by_year", "year:i pr_auc:d", """
    SELECT year, sum(CASE WHEN y = 1 THEN CAST(tp AS DOUBLE) / rn END) / sum(y) AS pr_auc FROM (
      SELECT year(day) AS year, y, row_number() OVER (PARTITION BY year(day) ORDER BY p DESC, unit_id, day) AS rn,
             sum(y) OVER (PARTITION BY year(day) ORDER BY p DESC, unit_id, day ROWS UNBOUNDED PRECEDING) AS tp FROM scored) GROUP BY year""")
def _(t):
    return ev.pr_auc(t.scored.withColumn("year", F.year("day")), KEYS, ["year"])


@query("top_k", "precision:d recall:d alerts:i hits:i threshold:d", f"""
    SELECT round(sum(y) / 1000, 6) AS precision, round(sum(y) / max(pos), 6) AS recall, count(*) AS alerts, sum(y) AS hits, round(min(p), 6) AS threshold FROM ({RANK_SQL}) WHERE rn <= 1000""")
def _(t):
    return ev.top_k(order(t), 1000)


@query("at_recall", "precision:d recall:d alerts:i hits:i threshold:d", f"""
    WITH r AS ({RANK_SQL}) SELECT round(sum(y) / count(*), 6) AS precision, round(sum(y) / max(pos), 6) AS recall, count(*) AS alerts, sum(y) AS hits, round(min(p), 6) AS threshold
    FROM r WHERE rn <= (SELECT min(rn) FROM r WHERE tp >= 0.4 * pos)""")
def _(t):
    return ev.at_recall(order(t), 0.4)


@query("threshold_for_alerts", "threshold:d", f"SELECT min(p) AS threshold FROM ({RANK_SQL}) WHERE rn <= 2500")
def _(t):
    return ev.threshold_for_alerts(order(t), 2500)


@query("threshold_for_recall", "threshold:d", f"WITH r AS ({RANK_SQL}) SELECT min(p) AS threshold FROM r WHERE rn <= (SELECT min(rn) FROM r WHERE tp >= 0.55 * pos)")
def _(t):
    return ev.threshold_for_recall(order(t), 0.55)


@query("lift_curve", "share:d rows:i precision:d captured:d lift:d", f"""
    WITH r AS ({RANK_SQL}), s AS (SELECT unnest([0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5]) AS share)
    SELECT share, rn AS rows, round(tp / rn, 6) AS precision, round(tp / pos, 6) AS captured, round((tp / rn) / (pos / n), 3) AS lift FROM s JOIN r ON rn = greatest(1, round_even(share * n, 0))""")
def _(t):
    return ev.lift_curve(order(t))


@query("alerts_per_day_curve", "alerts_per_day:i precision:d recall:d alerts:i hits:i", f"""
    SELECT k AS alerts_per_day, round(sum(y) FILTER (rn <= k * 365) / count(*) FILTER (rn <= k * 365), 6) AS precision, round(sum(y) FILTER (rn <= k * 365) / max(pos), 6) AS recall,
           count(*) FILTER (rn <= k * 365) AS alerts, sum(y) FILTER (rn <= k * 365) AS hits FROM ({RANK_SQL}) CROSS JOIN (SELECT unnest([2, 5, 10, 20, 50]) AS k) GROUP BY k""")
def _(t):
    return ev.alerts_per_day_curve(order(t), (2, 5, 10, 20, 50), 365)


TWO_SQL = """
    SELECT {g}, count(*) AS rows, sum(y) AS events, CASE WHEN sum(f) > 0 THEN round(sum(f * y) / sum(f), 6) ELSE 0 END AS model_precision, CASE WHEN sum(y) > 0 THEN round(sum(f * y) / sum(y), 6) ELSE 0 END AS model_recall,
           CASE WHEN sum(naive) > 0 THEN round(sum(naive * y) / sum(naive), 6) ELSE 0 END AS naive_precision, CASE WHEN sum(y) > 0 THEN round(sum(naive * y) / sum(y), 6) ELSE 0 END AS naive_recall
    FROM (SELECT *, CASE WHEN p >= 0.7 THEN 1 ELSE 0 END AS f, {e} AS {g} FROM scored) GROUP BY {g}"""
TWO = "rows:i events:i model_precision:d model_recall:d naive_precision:d naive_recall:d"


@query("by_recency", "grp:s " + TWO, TWO_SQL.format(g="grp", e="CASE WHEN since = 1 THEN 'last_day' WHEN since <= 7 THEN '2_7' WHEN since <= 30 THEN '8_30' ELSE 'over_30' END"))
def _(t):
    return ev.by_recency(t.scored, 0.7)


@query("by_season", "season:i " + TWO, TWO_SQL.format(g="season", e="(month(day) % 12) // 3"))
def _(t):
    return ev.by_season(t.scored, 0.7)


FOLDS = (("1998-01-01", "1999-01-01"), ("1999-01-01", "2000-01-01"), ("2000-01-01", "2001-01-01"))


@query("expanding_folds", "fold:s part:s n:i first:D last:D", """
    SELECT fold, part, count(*) AS n, min(day) AS first, max(day) AS last FROM (
      SELECT f.fold, day, CASE WHEN day >= f.lo AND day < f.hi THEN 'valid' WHEN day < f.lo AND day >= f.lo - 180 THEN 'stop' WHEN day < f.lo AND day >= f.lo - 730 THEN 'train' END AS part
      FROM scored CROSS JOIN (SELECT '1998-01-01' AS fold, DATE '1998-01-01' AS lo, DATE '1999-01-01' AS hi UNION ALL SELECT '1999-01-01', DATE '1999-01-01', DATE '2000-01-01' UNION ALL SELECT '2000-01-01', DATE '2000-01-01', DATE '2001-01-01') f)
    WHERE part IS NOT NULL GROUP BY fold, part""")
def _(t):
    tagged = ev.expanding_folds(t.scored, FOLDS, window_days=730, stop_days=180)
    return tagged.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


@query("paired_gain", "pairs:i mean_gain:d se:d gain_over_2se:b", """
    SELECT count(*) AS pairs, round(avg(d), 6) AS mean_gain, round(stddev_samp(d) / sqrt(count(*)), 6) AS se, CAST(avg(d) > 2 * stddev_samp(d) / sqrt(count(*)) AS INT) AS gain_over_2se
    FROM (SELECT year(day) AS fold, object_id AS seed, avg(p) - avg(naive) AS d FROM scored GROUP BY 1, 2)""")
def _(t):
    runs = t.scored.groupBy(F.year("day").alias("fold"), F.col("object_id").alias("seed")).agg(F.avg("p").alias("b"), F.avg("naive").alias("a"))
    return ev.paired_gain(runs.withColumnRenamed("a", "pr_auc"), runs.withColumnRenamed("b", "pr_auc"))


@query("showcase", "events:i cards:i warned:i warned_naive_missed:i naive_cards:i naive_warned:i naive_warned_model_missed:i", """
    SELECT sum(y) AS events, count(*) FILTER (p >= 0.7) AS cards, count(*) FILTER (p >= 0.7 AND y = 1) AS warned, count(*) FILTER (p >= 0.7 AND y = 1 AND naive = 0) AS warned_naive_missed,
           sum(naive) AS naive_cards, count(*) FILTER (naive = 1 AND y = 1) AS naive_warned, count(*) FILTER (naive = 1 AND y = 1 AND p < 0.7) AS naive_warned_model_missed FROM scored""")
def _(t):
    return ev.showcase(t.scored, 0.7)


@query("showcase_events", "unit_id:i day:D p:d", "SELECT unit_id, day, p FROM scored WHERE y = 1 AND naive = 0 AND p >= 0.5 ORDER BY p DESC, unit_id, day LIMIT 12")
def _(t):
    return ev.showcase_events(t.scored, 0.5, KEYS, 12)


POINT_SQL = "round(sum(y) / count(*), 6) AS {p}_precision, round(sum(y) / max(pos), 6) AS {p}_recall, count(*) AS {p}_alerts, sum(y) AS {p}_hits, round(min(p), 6) AS {p}_threshold"
POINT_SPEC = " ".join(f"{p}_{c}:{k}" for p in ("recall", "alerts") for c, k in (("precision", "d"), ("recall", "d"), ("alerts", "i"), ("hits", "i"), ("threshold", "d")))


@query("score_card", f"events:i base:d pr_auc:d precision:d recall:d alerts:i hits:i {POINT_SPEC}", f"""
    WITH r AS ({RANK_SQL}), c AS (SELECT max(pos) AS events, round(max(pos) / max(n), 6) AS base, sum(CASE WHEN y = 1 THEN CAST(tp AS DOUBLE) / rn END) / max(pos) AS pr_auc, round(sum(naive * y) / sum(naive), 6) AS precision,
           round(sum(naive * y) / max(pos), 6) AS recall, sum(naive) AS alerts, sum(naive * y) AS hits FROM r),
    a AS (SELECT {POINT_SQL.format(p="recall")} FROM r WHERE rn <= (SELECT min(rn) FROM r WHERE tp >= (SELECT hits FROM c))),
    b AS (SELECT {POINT_SQL.format(p="alerts")} FROM r WHERE rn <= (SELECT alerts FROM c))
    SELECT * FROM c CROSS JOIN a CROSS JOIN b""")
def _(t):
    return ev.score_card(t.scored, KEYS)


@query("exact_quantile", "object_id:i quantile:d", "SELECT object_id, quantile_cont(p, 0.2) AS quantile FROM scored GROUP BY object_id")
def _(t):
    return exact_quantile(t.scored, "p", 0.2, ("object_id",))


@query("day_budget", "unit_id:i day:D flag:i", """
    SELECT unit_id, day, CASE WHEN rn <= k THEN 1 ELSE 0 END AS flag FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY p DESC, unit_id) AS rn, sum(naive) OVER (PARTITION BY day) AS k FROM scored)""")
def _(t):
    return bg.day_budget(t.scored, ("unit_id",))


ROLL_SQL = """
    WITH d AS (SELECT DISTINCT day FROM {src}), w AS (SELECT d.day, s.p, s.naive FROM d JOIN {src} s ON s.day > d.day - {n} AND s.day <= d.day),
    b AS (SELECT day, sum(naive) AS budget FROM w GROUP BY day), r AS (SELECT w.day, w.p, row_number() OVER (PARTITION BY w.day ORDER BY w.p DESC) AS rn, count(*) OVER (PARTITION BY w.day) AS n FROM w),
    t AS (SELECT r.day, r.p AS threshold FROM r JOIN b USING (day) WHERE b.budget > 0 AND r.rn = least(b.budget, r.n))
    SELECT s.unit_id, s.day, CASE WHEN s.p >= t.threshold THEN 1 ELSE 0 END AS flag FROM {src} s LEFT JOIN t USING (day)"""


@query("rolling_budget_7", "unit_id:i day:D flag:i", ROLL_SQL.format(n=7, src="scored"))
def _(t):
    return bg.rolling_budget(t.scored, 7)


@query("rolling_budget_30", "unit_id:i day:D flag:i", ROLL_SQL.format(n=30, src="scored"))
def _(t):
    return bg.rolling_budget(t.scored, 30)


@query("hybrid_young_rule", "unit_id:i day:D flag:i", f"""
    SELECT unit_id, day, naive AS flag FROM scored WHERE age < 365 UNION ALL SELECT * FROM ({ROLL_SQL.format(n=7, src="(SELECT * FROM scored WHERE age >= 365)")})""")
def _(t):
    return bg.hybrid_young_rule(t.scored, 7)


@query("exclude_commissioning_object", "kind:s precision:d recall:d alerts:i hits:i", """
    SELECT kind, round(h / a, 6) AS precision, round(h / s, 6) AS recall, a AS alerts, h AS hits FROM (
      SELECT kind, sum(f) AS a, sum(f * y) AS h, sum(y) AS s FROM (SELECT 'rule' AS kind, naive AS f, y FROM scored WHERE object_id <> 2 UNION ALL SELECT 'model', CASE WHEN p >= 0.7 THEN 1 ELSE 0 END, y FROM scored WHERE object_id <> 2) GROUP BY kind)""")
def _(t):
    kept = t.scored.filter("object_id <> 2")
    rule = ev.rule_point(kept, F.col("naive") == 1).withColumn("kind", F.lit("rule"))
    return rule.unionByName(ev.rule_point(kept, F.col("p") >= 0.7).withColumn("kind", F.lit("model")))


@query("budget_bands", "budget:i medium:d high:d critical:d", """
    WITH l AS (SELECT facility_id, CAST(computed_at AS DATE) AS d, arg_max(probability, (computed_at, probability)) AS p, arg_max(evt_hours_24h, (computed_at, probability)) AS naive FROM card
               WHERE direction = 'FLOOD_RISK' AND computed_at >= TIMESTAMP '1998-05-11' AND computed_at <= TIMESTAMP '1998-06-09 06:00:00' GROUP BY 1, 2)
    SELECT b AS budget, least(0.011471, p) AS medium, p AS high, greatest(0.3, p) AS critical FROM (SELECT p, row_number() OVER (ORDER BY p DESC) AS rn, sum(CASE WHEN naive > 3 THEN 1 ELSE 0 END) OVER () AS b FROM l) WHERE rn = b""")
def _(t):
    cards = t.card.filter("direction = 'FLOOD_RISK'").select("facility_id", "computed_at", "probability", F.when(F.col("evt_hours_24h") > 3, 1).otherwise(0).alias("naive"))
    return bg.budget_bands(cards, F.lit("1998-06-09 06:00:00").cast("timestamp"), config.DIRECTION["FLOOD_RISK"].bands)


@query("rank_levels", "facility_id:i prediction_id:i level:s", """
    SELECT facility_id, prediction_id, CASE WHEN rn <= c THEN 'CRITICAL' WHEN rn <= c + h THEN 'HIGH' WHEN rn <= c + h + m THEN 'MEDIUM' ELSE 'LOW' END AS level
    FROM (SELECT *, greatest(1, round_even(n * 0.02, 0)) AS c, greatest(2, round_even(n * 0.06, 0)) AS h, greatest(3, round_even(n * 0.17, 0)) AS m FROM (
      SELECT *, row_number() OVER (PARTITION BY direction, year(bucket) ORDER BY probability DESC, prediction_id) AS rn, count(*) OVER (PARTITION BY direction, year(bucket)) AS n FROM card))""")
def _(t):
    return bg.rank_levels(t.card.drop("level").withColumn("run", F.year("bucket")), ("direction", "run"), key="prediction_id")
