"""Operators whose cost a row must not grow with the rows around it: right rows, and no plan step that does."""

import datetime as dt
import random

from pyspark.sql import functions as F

from undercroft.operators import cards as cm
from undercroft.operators import grids as gr
from undercroft.operators import journal as jr
from undercroft.operators import models as md
from undercroft.operators import neighbours as nb
from undercroft.operators import ordered as o
from undercroft.operators import targets as tg
from undercroft.plans import access

DAY = dt.date(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_section_map_reads_ahead_without_open_frames(spark):
    rnd = random.Random(3)
    pickets = [(1, -1, p) for p in rnd.sample(range(300), 150)] + [(2, 0, p) for p in range(40)]
    nodes, at = [], 5
    while at < 280:
        nodes.append((1, -1, len(nodes) + 1, at, at + rnd.randint(0, 3)))
        at += rnd.randint(8, 30)
    got = jr.section_map(spark.createDataFrame(pickets, "object_id long, gallery long, picket long"),
                         spark.createDataFrame(nodes, "object_id long, gallery long, node long, pk_from long, pk_to long"))
    assert "unboundedfollowing" not in plan(got)
    for r in got.collect():
        near = [(max(lo - r.picket, r.picket - hi, 0), n) for ob, g, n, lo, hi in nodes if (ob, g) == (r.object_id, r.gallery)]
        assert (r.entry_dist, r.section) == (min(near) if near else (None, 1000 + r.picket // 15))


def test_nearest_district_samples_its_registry_once(spark):
    districts = (("B", ((0.0, 0.0), (10.0, 0.0))), ("A", ((0.0, 5.0), (5.0, 9.0), (10.0, 5.0))), ("C", ((0.0, 0.0), (10.0, 0.0))))
    rows = [(i, [(float(x), float(y))]) for i, (x, y) in enumerate([(1, 1), (5, 8), (9, 2), (0, 2), (40, 40), (5, 2)])]
    rows += [(20, None), (21, [(None, 1.0)]), (22, [(float("nan"), 1.0)]), (23, [(9.0, 9.0), (3.0, 0.5), (0.0, 9.0)])]
    lines = spark.createDataFrame(rows, "id long, line array<struct<lon:double,lat:double>>")
    got = nb.nearest_district(lines, districts, samples=11)
    assert "polyline" not in plan(got) and "from_json" not in plan(got) and "jsontostructs" not in plan(got)
    got = {r.id: r.district for r in got.collect()}
    assert got == {0: "B", 1: "A", 2: "B", 3: "B", 4: "A", 5: "B", 20: "A", 21: "A", 22: "A", 23: "B"}


def test_state_runs_read_ahead_without_open_frames(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("hhhx"), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randint(0, 9000)), rnd.choice(["off", "on"])) for _ in range(300)]
    got = o.state_runs(spark.createDataFrame(rows, "k string, ts timestamp, value string"), ["k"], "ts", "value", "next")
    assert "unboundedfollowing" not in plan(got)
    expected = []
    for k in "hx":
        seen = sorted({r[1:] for r in rows if r[0] == k})
        starts = [r for i, r in enumerate(seen) if i == 0 or seen[i - 1][1] != r[1]]
        expected += [(k, ts, v, nxt) for (ts, v), nxt in zip(starts, [s[0] for s in starts[1:]] + [None])]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_rolling_top_and_mean(spark):
    rnd = random.Random(7)
    values = [rnd.choice([None, 0, 0, rnd.randint(1, 99)]) for _ in range(500)]
    df = spark.createDataFrame([(1, DAY + dt.timedelta(days=i), v, v is not None) for i, v in enumerate(values)], "k long, day date, v long, has boolean")
    w = gr.Rolling(("k",))
    rows = df.withColumn("one", F.col("has").cast("int"))
    for n in (1, 2, 7, 8, 9, 30, 365):
        rows = w.top(rows, "v", n, f"t{n}")
    got = w.cumulate(rows.withColumn("z", F.coalesce("v", F.lit(0))), "z", "one").select("*", w.mean_of("z", "one", 365).alias("mean")).orderBy("day").collect()
    for i, r in enumerate(got):
        for n in (1, 2, 7, 8, 9, 30, 365):
            past = [v for v in values[max(0, i - n):i] if v is not None]
            assert r[f"t{n}"] == max(past, default=None)
        past = [v for v in values[max(0, i - 365):i] if v is not None]
        assert (r["mean"] is None and not past) or abs(r["mean"] - sum(past) / len(past)) < 1e-9


def test_fanout_of_one_object_is_many_tasks(spark):
    channels = spark.createDataFrame([(c, 1) for c in range(20)] + [(30, None), (31, 2)], "cid long, object_id long")
    sections = spark.createDataFrame([(1, -1, s % 40) for s in range(80)] + [(1, -1, None), (None, -1, 1)], "object_id long, gallery long, section long")
    got = jr.object_channel_fanout(channels, sections)
    assert got.columns == ["object_id", "cid", "gallery", "section"]
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=str) == sorted([(1, c, -1, s) for c in range(20) for s in [*range(40), None]], key=str)
    used = got.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(used) > 10 and max(r["count"] for r in used) < len(rows) / 4


def test_points_of_a_day_meet_no_sweep(spark):
    hour = lambda d, h: dt.datetime(2024, 1, d, h)
    key = "object_id long, gallery long, section long"
    armed, alarm = [(1, -1, 1, hour(3, 5), 2), (1, -1, 1, hour(4, 12), 1)], [(1, -1, 1, hour(3, 5), 3), (1, -1, 1, hour(3, 11), 4)]
    t = access.AccessInputs(*[None] * 9)
    t.armed, t.alarm = (spark.createDataFrame(x, f"{key}, hour timestamp, n_moments long") for x in (armed, alarm))
    got = access.seen_at(t, (0, 12))
    assert "window" not in plan(got)
    got = {r.day.day: [tuple(s) for s in r._seen] for r in got.collect()}
    assert got == {
        2: [(0, 0, 0, 0, 0, 0, None, None), (1, 0, 0, 0, 0, 0, None, None)],
        3: [(1, 0, 0, 0, 0, 0, None, None), (0, 1, 4, 4, 0, 0, hour(3, 11), hour(3, 5))],
        4: [(1, 1, 0, 0, 0, 0, None, None), (1, 0, 0, 0, 0, 0, None, None)],
        5: [(0, 1, 0, 0, 0, 0, None, None), (0, 1, 0, 0, 0, 0, None, None)]}


def test_quantile_ranks_equal_values_once(spark, monkeypatch):
    ranked, sizes = o.ranked, []
    monkeypatch.setattr(o, "ranked", lambda df, *a, **k: sizes.append(df.count()) or ranked(df, *a, **k))
    rows = [("a", float(i % 5)) for i in range(1000)] + [("b", 3.0), ("b", 4.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.quantile for r in o.exact_quantile(df, "v", 0.3, ["g"]).collect()}
    assert sizes == [7] and abs(got["a"] - 1.0) < 1e-9 and abs(got["b"] - 3.3) < 1e-9
    assert abs(o.exact_quantile(df, "v", 0.2).first()[0] - 1.0) < 0.01


def test_bit_strings_are_no_lists(spark):
    rnd = random.Random(11)
    flags = {k: [rnd.choice(c) for _ in range(200)] for k, c in ((1, [0, 0, 0, 1]), (2, [0, 1, None]), (3, [0]), (4, [1]))}
    df = spark.createDataFrame([(k, DAY + dt.timedelta(days=i), v) for k, f in flags.items() for i, v in enumerate(f)], "k long, day date, ev int")
    for window in (1, 5, 64, 100):
        got = md.lz_complexity(df, ("k",), "ev", window)
        assert "collect_list" not in plan(got) and got.columns == ["k", "day", "ev", "lz_complexity"]
        for r in got.collect():
            i = (r.day - DAY).days
            assert r.lz_complexity == md.phrase_count("".join(str(v) for v in flags[r.k][max(0, i - window):i] if v is not None))


def test_equal_training_rows_are_folded(spark):
    rnd = random.Random(13)
    rows = [(rnd.randint(0, 2), rnd.choice([None, 1.0]), int(rnd.random() < 0.3), rnd.choice([0.5, 1.0])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a int, b double, y int, w double")
    got = md.folded(df, ("a", "b"), "y", "w").collect()
    assert len(got) == 12 and sum(r["_rows"] for r in got) == 3000 and abs(sum(r["_w"] for r in got) - sum(r[3] for r in rows)) < 1e-6
    seen, fit = [], md.Pipeline.fit
    try:
        md.Pipeline.fit = lambda self, frame: seen.append(frame.agg(F.count("*"), F.sum("_w")).first()) or fit(self, frame)
        model = md.fit_trees(df, ("a", "b"), "y", rounds=2)
    finally:
        md.Pipeline.fit = fit
    assert seen[0][0] == 12 * md.COPIES and abs(seen[0][1] - 3000) < 1e-6
    share = {k: [r[2] for r in rows if r[0] == k] for k in range(3)}
    for r in md.score_trees(model, df).select("a", "p").distinct().collect():
        assert abs(r.p - sum(share[r.a]) / len(share[r.a])) < 0.3


def test_months_fit_what_was_before_them(spark):
    rnd = random.Random(17)
    days = [DAY + dt.timedelta(days=i) for i in range(100)]
    panel = spark.createDataFrame([(u, d, (u + d.day) % 4, int((u + d.day) % 4 == 0), rnd.randint(0, 1)) for u in range(20) for d in days],
                                  "unit long, day date, f int, label int, naive int")
    weights, fit = {}, md.fit_folded

    def note(rows, *args, **options):
        got = rows.agg(F.sum("_rows").alias("n"), F.sum("_w").alias("w")).first()
        weights[got.n] = got.w
        return fit(rows, *args, **options)

    try:
        md.fit_folded = note
        out = md.monthly_retrain(panel, ("f",), ("unit", "day"), ("2024-02-01", "2024-04-01"), rounds=2).collect()
    finally:
        md.fit_folded = fit
    assert sorted(weights) == [31 * 20, 91 * 20] and len(out) == (29 + 9) * 20
    for n, start in ((31, dt.date(2024, 2, 1)), (91, dt.date(2024, 4, 1))):
        assert abs(weights[n * 20] - 20 * sum(0.5 ** ((start - d).days / 365) for d in days[:n])) < 1e-6
    assert {(r.month, r.day.month) for r in out} == {("2024-02-01", 2), ("2024-04-01", 4)}


def test_next_sums_are_differences(spark):
    rnd = random.Random(19)
    values = [rnd.randint(0, 1) for _ in range(60)]
    df = spark.createDataFrame([(1, DAY + dt.timedelta(days=i), v) for i, v in enumerate(values)], "k long, day date, v long")
    w = gr.Rolling(("k",))
    got = w.cumulate(df, "v").select("day", w.next_sum("v", 24).alias("s"), w.next_rows(24).alias("n"))
    assert "24 following" not in plan(got)
    for i, r in enumerate(got.orderBy("day").collect()):
        assert (r.s, r.n) == (sum(values[i:i + 24]), len(values[i:i + 24]))


def above_windows(df):
    """The physical plan down to the first window on the way to the rows."""
    return df._jdf.queryExecution().executedPlan().toString().split("Window [")[0]


def test_wide_panels_are_not_shuffled_after_their_windows(spark, tmp_path):
    from undercroft.queries.base import REGISTRY, Tables
    from undercroft.queries.load import load_all

    load_all()
    i, at = F.col("id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 977)
    spark.range(400).select(
        i.alias("l_orderkey"), (i % 13).alias("l_partkey"), (i % 23).alias("l_suppkey"), (i % 7 + 1).alias("l_linenumber"), (i % 50 + 1.0).alias("l_quantity"),
        (i % 11 / 100).alias("l_discount"), F.element_at(F.array(*map(F.lit, "RAN")), (i % 3 + 1).cast("int")).alias("l_returnflag"),
        F.date_add(F.lit(DAY), (i % 90).cast("int")).alias("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(100).select(
        i.alias("o_orderkey"), (i % 17).alias("o_custkey"), F.date_add(F.lit(DAY), (i % 90).cast("int")).alias("o_orderdate"),
        F.element_at(F.array(*map(F.lit, "OFP")), (i % 3 + 1).cast("int")).alias("o_orderstatus")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(300).select(
        i.alias("event_id"), (i % 37).alias("user_id"), at.alias("ts"), (i % 9 * 1.5).alias("value"),
        F.element_at(F.array(*map(F.lit, ("error", "click", "view", "signup", "purchase"))), (i % 5 + 1).cast("int")).alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    t = Tables(spark, str(tmp_path))
    for name in ("access_daily", "flood_hourly"):
        assert "hashpartitioning" not in above_windows(REGISTRY[name].build(t)).lower(), name


def test_character_is_read_by_month(spark):
    from undercroft.plans import hypotheses as hy

    at = lambda d, h: dt.datetime(2024, 1, 1, h) + dt.timedelta(days=d)
    days = spark.createDataFrame([(1, DAY + dt.timedelta(days=i)) for i in range(70)], "k long, day date")
    marks = {0: 5, 30: 0, 31: 7, 45: 23}
    character = spark.createDataFrame([(1, at(d, h), *[float(d)] * 6) for d, h in marks.items()], "k long, moment timestamp, " + ", ".join(f"{c} double" for c in hy.CHARACTER))
    got = hy.add_character(days, character, ("k",))
    assert "month" in plan(got)
    for r in got.collect():
        past = [float(d) for d, h in marks.items() if at(d, h) < dt.datetime.combine(r.day, dt.time())]
        assert r.char_memory == (past[-1] if past else None)


def test_criteria_screen_holds_no_table_of_unit_days_by_criterion(spark):
    rnd = random.Random(8)
    stamp = lambda d, h: dt.datetime(2024, 1, 1 + d, h)
    hours = [(rnd.randrange(5), rnd.randrange(2), d, h, rnd.random() < 0.4, rnd.choice([True, False, None]))
             for d, h in ((rnd.randrange(9), rnd.randrange(24)) for _ in range(300))]
    places = sorted({(u, ob, d) for u, ob, d, *_ in hours})
    # Some unit-days stand twice, with other facts.
    days = [(*p, rnd.choice([None, 0.5, 1.5, 2.5]), rnd.choice([True, False, None])) for p in places + places[::4]]
    wet = [(d, d % 2 == 0) for d in range(8)] + [(3, True)]
    life = [(u, ob, d, d % 7 > 4) for u in range(5) for ob in range(2) for d in range(9)]
    date = lambda d: DAY + dt.timedelta(d)
    tests = {"all": F.lit(True), "off": ~F.col("busy"), "near": F.col("adjacent"), "both": ~F.col("busy") & (F.col("pump_ratio") > 1)}
    met = {"all": lambda b, p, a: True, "off": lambda b, p, a: b is False, "near": lambda b, p, a: a is True, "both": lambda b, p, a: b is False and p is not None and p > 1}
    got = tg.criteria_screen(
        spark.createDataFrame([(u, ob, date(d), stamp(d, h), off, b) for u, ob, d, h, off, b in hours], "unit_id int, object_id int, day date, hour timestamp, day_off boolean, busy boolean"),
        spark.createDataFrame([(u, ob, date(d), p, a) for u, ob, d, p, a in days], "unit_id int, object_id int, day date, pump_ratio double, adjacent boolean"),
        spark.createDataFrame([(u, ob, date(d), off) for u, ob, d, off in life], "unit_id int, object_id int, day date, day_off boolean"),
        spark.createDataFrame([(date(d), w) for d, w in wet], "day date, wet boolean"),
        ("unit_id", "object_id"), {n: (c, 24, 24) for n, c in tests.items()}, "2024-01-05")
    assert not any("aggregate [criterion" in line and "unit_id" in line for line in plan(got).splitlines())
    found = {r.criterion: r for r in got.collect()}
    for name, meets in met.items():
        n = train = adj = near = h816 = 0
        pumps, tops = [], {}
        for u, ob, d in places:
            hits = [(h, p, a) for hu, ho, hd, h, _, b in hours if (hu, ho, hd) == (u, ob, d)
                    for p, a in [x[3:] for x in days if x[:3] == (u, ob, d)] if meets(b, p, a)]
            if not hits:
                continue
            times = max(1, sum(w[0] == d for w in wet))
            n, train, tops[ob] = n + times, train + times * (d < 4), tops.get(ob, 0) + times
            pumps += [max(p for _, p, _ in hits if p is not None)] * times if any(p is not None for _, p, _ in hits) else []
            adj += times * any(a for _, _, a in hits)
            near, h816 = near + times * len(hits), h816 + times * sum(8 <= h < 16 for h, _, _ in hits)
        r = found[name]
        assert (r.positive_unit_days, r.positive_unit_days_train) == (n, train)
        for have, want in ((r.top_object_share, max(tops.values()) / n), (r.adjacent_share, adj / n), (r.share_8_16, h816 / near)):
            assert abs(have - want) < 0.00051
        assert abs(r.pump_vs_normal - sum(pumps) / len(pumps)) < 0.0051


def test_merge_deals_cards_by_their_number(spark, monkeypatch):
    at = dt.datetime(2024, 2, 1, 9)
    rows = [(f"p{i % 290}", i % 40 or None, ("FIRE_RISK", "FLOOD_RISK")[i % 2], at - dt.timedelta(days=i % 5), ("NEW", "IN_REVIEW", "CLOSED_CONFIRMED")[i % 7 % 3],
             None, None, 0.1, "LOW", at - dt.timedelta(days=1), 0) for i in range(300)]
    stored = spark.createDataFrame(rows, "prediction_id string, facility_id int, direction string, bucket timestamp, status string, assignee string, verdict string, probability double, level string, computed_at timestamp, run_id int")
    fresh = spark.createDataFrame([(f, d, at, at, None, 0.5, "HIGH", 7) for f in range(50) for d in ("FIRE_RISK", "FLOOD_RISK")],
                                  "facility_id int, direction string, bucket timestamp, computed_at timestamp, event_at timestamp, probability double, level string, run_id int")
    want = sorted(map(repr, cm.merge_cards(stored, fresh).collect()))
    monkeypatch.setattr(cm, "CARDS_A_PART", 5)
    got = cm.merge_cards(stored, fresh)
    assert sum(", 60" in line for line in plan(got).splitlines() if "repartition" in line) >= 4
    assert sorted(map(repr, got.collect())) == want


def test_line_neighbours_are_not_spread_over_pickets(spark):
    rnd = random.Random(24)
    start = dt.datetime(2024, 1, 1)

    def some():
        at = start + dt.timedelta(seconds=rnd.choice([0, 1800, 3600, 21600]) * rnd.randint(0, 9), microseconds=rnd.choice([0, 0, 1]))
        return rnd.choice([1, 1, None, 2]), rnd.choice([-1, 0]), rnd.choice([None, *range(-70, -55), *range(0, 8), *range(55, 65)]), at, rnd.choice(["smoke", "heat", None])

    rows = [(i, *some()) for i in range(350)]
    rows += [(400 + i, *rows[i][1:]) for i in range(40)] + [(500, 1, -1, 3, None, "heat")]
    df = spark.createDataFrame(rows, "id long, object_id long, gallery long, picket long, ts timestamp, stype string")
    line, warm = ("object_id", "gallery"), F.col("stype") != "smoke"
    one = nb.rows_nearby(df, df.filter(warm), line, "picket", "ts", 5, 60, "heat", own_picket=True)
    assert "window" not in plan(one)  # a sweep over every picket in reach
    both = nb.nearby_counts(df, df, line, "picket", "ts", 5, {"near": (30, False, F.lit(True)), "heat": (60, True, warm)}, size=20)
    assert both.columns == [*df.columns, "near", "heat"]
    known = [r for r in rows if None not in r[1:5]]

    def around(r, minutes, own, kinds):
        return sum(x[1:3] == r[1:3] and abs(x[3] - r[3]) <= 5 and (own or x[3] != r[3]) and x[5] in kinds
                   and abs(x[4] - r[4]) <= dt.timedelta(minutes=minutes) for x in known)

    heat = {r[0]: around(r, 60, True, {"heat"}) for r in known}
    assert {r.id: r.heat for r in one.collect()} == heat
    near = {r[0]: around(r, 30, False, {"smoke", "heat", None}) for r in known}
    assert {r.id: (r.near, r.heat) for r in both.collect()} == {i: (near[i], heat[i]) for i in near}
    assert max(heat.values()) > 3 and max(near.values()) > 3
    assert nb.rows_nearby(df.limit(0), df, line, "picket", "ts", 5, 30, "near", own_picket=False).count() == 0
