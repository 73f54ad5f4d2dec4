"""Queries that once did part of their job, on rows made here."""

import datetime as dt
from types import SimpleNamespace

from pyspark.sql import Window
from pyspark.sql import functions as F

from undercroft.functions.calendar import calendar
from undercroft.operators import grids
from undercroft.plans import access, fire_rules
from undercroft.queries import learning
from undercroft.queries.base import REGISTRY
from undercroft.queries.load import load_all

load_all()


def test_guard_channels_of_every_number_are_spread(spark):
    channels = spark.createDataFrame([(7, 1, "КД Дверь"), (49, 1, "КД Дверь"), (60, 2, "КД Дверь"), (61, 1, "КД Люк")], "cid long, object_id long, stype string")
    journal = spark.createDataFrame([(1, -1, 4), (1, -1, 4), (1, 0, 5), (2, -1, 6)], "object_id long, gallery long, section long")
    got = REGISTRY["guard_fanout"].build(SimpleNamespace(channels=channels, journal=journal))
    assert sorted((r.cid, r.object_id, r.gallery, r.section) for r in got.collect()) == [(7, 1, -1, 4), (7, 1, 0, 5), (49, 1, -1, 4), (49, 1, 0, 5), (60, 2, -1, 6)]


def test_facts_hold_the_gas_of_the_complex(spark):
    at = lambda d, h: dt.datetime(2024, 3, d, h)
    day = lambda d: dt.date(2024, 3, d)
    f = spark.createDataFrame
    signals = f([(10 * o, o, -1, 5, at(d, 11), "smoke") for o in (1, 2, 4) for d in (5, 6)], "channel_id long, object_id long, gallery long, picket long, ts timestamp, stype string")
    births = f([(10 * o, o, day(1)) for o in (1, 2, 4)], "channel_id long, object_id long, born date")
    complexes = f([(1, 1), (2, 1), (3, 1), (4, 2)], "object_id long, complex_id long")
    empty = lambda schema: f([], schema)
    # Objects 2 and 3 have the sensors of complex 1; 3 is in maintenance on the 6th.  101 is no share, a null no reading.
    gas = f([(2, at(5, 9), 3.0), (2, at(5, 20), 7.0), (3, at(5, 10), 101.0), (3, at(5, 10), None), (2, at(6, 10), 2.0), (3, at(6, 21), 30.0), (4, at(4, 9), 9.0)], "object_id long, ts timestamp, v double")
    windows = f([(3, day(6), day(6))], "object_id long, start date, end date")

    def facts(**more):
        out = fire_rules.fire_facts(signals, births, empty("object_id long, hour timestamp, v double"), empty("complex_id long, hour timestamp"),
                                    complexes, calendar(spark, "2024-01-01", "2024-12-31"), "smoke", "2024-01-01", **more)
        graded = fire_rules.grade(out).collect()
        return {(r.object_id, r.day.day): (r.gas_pct, r.gas_off_hours, r.level) for r in graded}

    got = facts(gas=gas, maintenance=windows)
    assert got == {(1, 5): (7.0, True, "CRITICAL"), (2, 5): (7.0, True, "CRITICAL"), (1, 6): (2.0, False, "LOW"), (2, 6): (2.0, False, "LOW"),
                   (4, 5): (0.0, False, "LOW"), (4, 6): (0.0, False, "LOW")}
    assert facts(gas=gas)[1, 6][:2] == (30.0, True) and set(v[:2] for v in facts().values()) == {(0.0, False)}


def test_query_of_fire_facts_reads_gas():
    assert {"gas_pct", "gas_off_hours"} <= {c for c, _ in REGISTRY["fire_facts"].columns}


def test_labels_are_boosted_to_the_end(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(learning.lb, "pu_label", lambda *args, **more: asked.append(more["rounds"]))
    learning.pu_rows(SimpleNamespace(unit_event=spark.createDataFrame([(1, 1, dt.date(2000, 1, 1), 1)], "unit_id long, object_id long, day date, m long")))
    assert asked == [300]


def test_months_are_boosted_to_the_end(spark, monkeypatch):
    asked = []
    days = spark.createDataFrame([(dt.date(2000, 7, 1), 0.5)], "day date, p double")
    monkeypatch.setattr(learning, "panel", lambda t: days)
    monkeypatch.setattr(learning, "stored", lambda df: df)
    monkeypatch.setattr(learning.md, "monthly_retrain", lambda p, *args, **more: asked.append(more["rounds"]) or p)
    REGISTRY["monthly_retrain"].build(None)
    assert asked == [335]


def test_ladder_climbs_every_rung_and_boosts_until_the_loss_stands(spark, monkeypatch):
    md, asked, fit = learning.md, [], learning.md.fit_folded

    def short(rows, names, **more):
        asked.append((len(names), more["rounds"], more["stop"]))
        return fit(rows, names, **more | {"rounds": 2})

    days = spark.sql("SELECT unit_id, day, CAST(dayofmonth(day) % 5 = 0 AS INT) AS label, unit_id AS evt_s7, dayofmonth(day) % 5 AS evt_s30, 1 AS evt_since, month(day) AS cal_month"
                     " FROM (SELECT id AS unit_id, explode(sequence(DATE '1998-06-01', DATE '2000-12-31')) AS day FROM range(2))")
    monkeypatch.setattr(learning, "panel", lambda t: days)
    monkeypatch.setattr(md, "fit_folded", short)
    got = REGISTRY["feature_selection_ladder"].build(None).collect()
    assert sorted(asked) == [(k, 2000, "_stop") for k in (1, 2, 3, 4) for _ in range(2)]
    assert [r.k for r in got] == [1, 2, 3, 4] and [r.chosen for r in got] == [True, False, False, False] and got[0].features == "evt_s30"


def test_filled_grid_shuffles_no_row_of_the_grid(spark):
    at = lambda m, d: dt.datetime(2024, m, d)
    units = spark.createDataFrame([(1, -1, at(1, 1), at(12, 31)), (2, None, at(1, 1), at(1, 3)), (3, -1, at(2, 1), at(2, 1))], "object_id long, gallery long, hour_from timestamp, hour_to timestamp")
    day = lambda m, d: dt.date(2024, m, d)
    facts = spark.createDataFrame([(1, -1, day(1, 2), 5, None), (1, -1, day(1, 2), None, 7), (1, -1, dt.date(2023, 12, 31), 9, 9), (2, None, day(1, 2), 4, 4), (8, -1, day(1, 2), 3, 3)],
                                  "object_id long, gallery long, day date, a long, b long")
    got = grids.filled_grid(units, ("object_id", "gallery"), facts).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("object_id", "gallery").orderBy("day")))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    rows = got.collect()
    assert len(rows) == 366 + 3 + 1 and [(r.object_id, r.day, r.a, r.b) for r in rows if r.a or r.b] == [(1, day(1, 2), 5, 7)]
    lived = grids.in_life(facts, units, ("object_id", "gallery")).collect()
    assert [(r.object_id, r.day, r.a, r.b) for r in sorted(lived, key=lambda r: str(r.a))] == [(1, day(1, 2), 5, None), (1, day(1, 2), None, 7)]
    alive = grids.units_by_day(units.withColumn("complex_id", F.lit(1)), ("complex_id",), "n").filter("day IN (DATE '2024-01-02', DATE '2024-02-01', DATE '2024-12-31')").collect()
    assert sorted((r.day, r.n) for r in alive) == [(day(1, 2), 2), (day(2, 1), 2), (day(12, 31), 1)]


def test_panels_of_sections_store_days_with_facts_only(spark, monkeypatch):
    """Two sections live ten days, one has one alarm: the tables between the jobs hold its day and object-days, never the grid."""
    f, key = spark.createDataFrame, "object_id long, gallery long, section long"
    at = lambda d, h=0: dt.datetime(2024, 3, d, h)
    roll = f"{key}, hour timestamp, n_alarms long, n_moments long, n_channels long"
    rows = f([(1, -1, 2, at(4, 5), 3, 2, 1)], roll)
    tables = access.AccessInputs(
        unit=f([(1, -1, s, at(1), at(10, 23), 4) for s in (2, 3, 9)], f"{key}, hour_from timestamp, hour_to timestamp, n_channels int"), alarm=rows, armed=rows,
        disarm_window=f([], "object_id long, t_from timestamp, t_to timestamp, open_end boolean"), guard_unknown=f([], "object_id long, t_from timestamp, t_to timestamp"),
        fault_day=f([(1, -1, 2, dt.date(2024, 4, 1), 2, 1)], f"{key}, day date, n_fault long, n_fault_channels long"), access_chain=f([], f"{key}, completed_ts timestamp"),
        section_info=f([(1, -1, s, 0, 0, 3, 2, 1, 0, 1, 0) for s in (2, 3, 9)], f"{key}, " + ", ".join(f"{c} long" for c in access.PASSPORT)), calendar=calendar(spark, "2024-01-01", "2024-12-31"))
    kept, store = [], access.stored
    monkeypatch.setattr(access, "stored", lambda df: (out := store(df), kept.append((set(access.KEY) <= set(df.columns), out.count())))[0])
    panel = {(r.section, r.day.day): r for r in access.access_daily(tables).collect()}
    assert len(panel) == 30 and panel[2, 4].label == 1 and panel[2, 5].naive == 1 and panel[3, 5].nb_events_1d == 1 and panel[9, 5].nb_events_7d == 0
    assert (panel[9, 5].obj_alarms_1d, panel[9, 5].obj_units_alarmed_7d, panel[9, 5].net_event_share_1d) == (2, 1, 1 / 3)
    points = {(r.section, r.as_of): r for r in access.access_rolling(tables).collect()}
    assert len(points) == 3 * (9 * 4 + 1) and points[2, at(4, 6)].events_last_1h == 2 and points[2, at(3, 6)].label == 1 and points[3, at(4, 6)].events_last_1h == 0
    assert [n for wide, n in kept if wide] == [1, 1] and max(n for _, n in kept) <= 10
