"""Parsing, mapping, expert rules, sessions, orders, action replay by hand."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from undercroft import config
from undercroft.functions import cards as cd
from undercroft.functions import mapping as mp
from undercroft.operators import actions as ac
from undercroft.operators import cards as cm
from undercroft.operators import intervals as iv
from undercroft.operators import orders as om
from undercroft.operators import sessions as se
from undercroft.operators.evaluate import level_bounds, model_columns
from undercroft.operators.models import phrase_count
from undercroft.plans import fire_rules, serving

T = dt.datetime(2024, 3, 5, 10, 0, 0)


def test_place_forms(spark):
    names = {"ТД ПК87": (87, 0.0, -1), "ДД ПК1+0,5": (1, 0.5, -1), "ТД ПК290-292": (290, 0.0, -1), "Темп. ВШ ПК88,5": (88, 0.0, -1),
             "Темп. ПК399 Г0ПК5": (5, 0.0, 0), "Насос 3": None, None: None}
    df = spark.createDataFrame([(n,) for n in names], "name string").select("name", mp.parse_place("name").alias("p"))
    for r in df.collect():
        assert (tuple(r.p) if r.p else None) == names[r.name]


def test_event_codes_and_numbers(spark):
    cases = [("КД Люк", "Не замкнут", True, "DOOR_OPEN"), ("КД Люк", "Не замкнут", False, None), ("Датчик затопления", "Не замкнут", True, "FLOOD_SENSOR_OPEN"),
             ("Состояние насоса", "Включен", False, "PUMP_ON"), ("Тепловой датчик", "Не замкнут", True, "HEAT_OPEN"), (None, "Включен", True, None), ("Стекло", None, True, None)]
    df = spark.createDataFrame([c[:3] for c in cases], "stype string, value string, alarm boolean").select(mp.event_code().alias("c"))
    assert [r.c for r in df.collect()] == [c[3] for c in cases]
    numbers = [("Датчик температуры", "21,5", 21.5), ("Датчик температуры", "327,68", None), ("Датчик температуры", "-100", None), ("Датчик температуры", "NaN", None),
               ("Газовый датчик", "101", None), ("Газовый датчик", "0,2", 0.2), ("КД Люк", "5", None), ("Газовый датчик", "нет", None)]
    df = spark.createDataFrame([n[:2] for n in numbers], "stype string, value string").select(mp.reading_value().alias("v"))
    assert [r.v for r in df.collect()] == [n[2] for n in numbers]


@pytest.mark.parametrize("given, level", [
    ({}, "LOW"), ({"burst_only": True}, "LOW"), ({"signal": True}, "LOW"), ({"signal": True, "off_hours_no_walk": True}, "MEDIUM"), ({"signal": True, "spread": True}, "HIGH"),
    ({"signal": True, "smoke": True, "heat_independent": True}, "CRITICAL"), ({"signal": True, "spread": True, "temp_rise_c": 12.0}, "CRITICAL"),
    ({"signal": True, "heat_independent": True, "temp_rise_c": 11.0, "off_hours_no_walk": True}, "HIGH"), ({"gas_pct": 5.0}, "CRITICAL"),
    ({"signal": True, "gas_pct": 1.5, "gas_off_hours": True}, "MEDIUM"), ({"signal": True, "spread": True, "gas_pct": 1.5, "gas_off_hours": True}, "HIGH"),
    ({"signal": True, "spread": True, "sensor_cooling": True, "cooling_days_left": 3}, "MEDIUM"),
    ({"signal": True, "smoke": True, "heat_independent": True, "sensor_cooling": True}, "CRITICAL")])
def test_fire_levels(spark, given, level):
    flags = ("signal", "burst_only", "smoke", "heat_independent", "spread", "off_hours_no_walk", "power_off", "gas_off_hours", "sensor_cooling", "object_cooling")
    row = {**dict.fromkeys(flags, False), "temp_rise_c": 0.0, "gas_pct": 0.0, "cooling_days_left": 0, **given}
    schema = ", ".join(f"{k} {'boolean' if k in flags else 'int' if k == 'cooling_days_left' else 'double'}" for k in row)
    assert fire_rules.grade(spark.createDataFrame([tuple(row.values())], schema)).first().level == level


def moments(spark, rows, n_contact=2):
    data = [(1, -1, 1, c, T + dt.timedelta(minutes=m), kind, dist, n_contact) for c, m, kind, dist in rows]
    return spark.createDataFrame(data, "object_id long, gallery long, section long, channel_id long, ts timestamp, kind string, entry_dist long, n_contact long")


def test_incident_rules(spark):
    key = ("object_id", "gallery", "section")
    away = spark.createDataFrame([(1, T + dt.timedelta(minutes=200), T + dt.timedelta(minutes=230))], "object_id long, t_from timestamp, t_to timestamp")

    def events(rows, **kw):
        return sorted(r.channel_id for r in se.flag_events(moments(spark, rows, **kw), away, key).filter("event").collect())

    assert events([(7, 0, "motion", 20)]) == []                                # one motion far from entries, contacts exist
    assert events([(7, 0, "motion", 20)], n_contact=1) == [7]                  # the section lacks contacts
    assert events([(7, 0, "motion", 6)]) == [7]                                # by the entry
    assert events([(7, 0, "motion", 20), (8, 20, "motion", 20)]) == [7, 8]     # two channels in one incident
    assert events([(7, 0, "motion", 20), (8, 31, "motion", 20)]) == []         # two incidents
    assert events([(7, 0, "contact", 20), (8, 20, "motion", 20)]) == [7, 8]
    assert events([(7, 210, "contact", 20), (8, 230, "contact", 20)]) == [8]   # off guard: [from, to)


def test_windows_and_open_end(spark):
    rows = [(1, T, "on"), (1, T + dt.timedelta(hours=1), "off"), (1, T + dt.timedelta(hours=2), "off"), (1, T + dt.timedelta(days=3), "on"), (1, T + dt.timedelta(days=4), "off"), (1, T + dt.timedelta(days=5), "off")]
    guard = spark.createDataFrame(rows, "object_id long, ts timestamp, value string")
    got = sorted((r.t_from, r.t_to, r.open_end) for r in iv.disarm_windows(guard).collect())
    assert got == [(T + dt.timedelta(hours=1), T + dt.timedelta(days=3), False), (T + dt.timedelta(days=4), T + dt.timedelta(days=5), True)]
    hours = iv.disarm_hours_by_day(iv.disarm_windows(guard)).agg(F.sum("disarm_hours")).first()[0]
    assert hours == 71 + 24


CARDS = "prediction_id string, facility_id long, direction string, bucket timestamp, status string, assignee string, verdict string, probability double, level string, computed_at timestamp, run_id long"
FORE = "facility_id long, direction string, bucket timestamp, probability double, computed_at timestamp, event_at timestamp, run_id long"


def card(pid, fac, day, status, assignee=None, verdict=None):
    return (pid, fac, "FLOOD_RISK", dt.datetime(2024, 3, day), status, assignee, verdict, 0.2, "HIGH", dt.datetime(2024, 3, day, 1), 1)


def test_card_lifecycle(spark):
    cards = spark.createDataFrame([
        card("free", 1, 4, "NEW"), card("busy", 2, 5, "IN_REVIEW", "u"), card("done", 3, 5, "DECIDED", "u", "AGREED"), card("again", 4, 5, "CLOSED_CONFIRMED", "u", "AGREED"), card("taken", 5, 5, "NEW", "u")], CARDS)
    day, now = dt.datetime(2024, 3, 5), dt.datetime(2024, 3, 5, 12)
    fore = cm.assign_levels(spark.createDataFrame([(f, "FLOOD_RISK", day, 0.5, now, dt.datetime(2024, 3, 5, 6) if f == 4 else None, 9) for f in range(1, 7)], FORE))
    merged = cm.merge_cards(cards, fore)
    out = {r.prediction_id: r for r in merged.collect()}
    assert (out["free"].bucket, out["free"].level, out["free"].run_id, out["free"].is_new) == (day, "CRITICAL", 9, True)
    assert (out["busy"].probability, out["busy"].computed_at, out["busy"].is_new) == (0.2, now, False)
    assert (out["done"].computed_at, out["done"].run_id) == (dt.datetime(2024, 3, 5, 1), 1)
    assert out["taken"].probability == 0.2 and out["taken"].computed_at == now
    fresh = {r.facility_id: r.bucket for r in merged.collect() if r.is_new and r.prediction_id not in ("free",)}
    assert fresh == {4: now, 6: day}
    again = cm.merge_cards(merged.drop("is_new"), fore)
    assert again.count() == merged.count() and again.filter("is_new").count() == 0


def test_orders_follow_and_create(spark):
    now = dt.datetime(2024, 3, 5, 9)
    orders = spark.createDataFrame([("o1", "p0", 1, "FLOOD_RISK", "AUTO_CREATED", now, now), ("o2", "p2", 2, "FLOOD_RISK", "AUTO_CREATED", now, now), ("o3", "p3", 3, "FLOOD_RISK", "IN_PROGRESS", now, now)],
                                   "order_id string, prediction_id string, facility_id long, direction string, status string, created_at timestamp, due_at timestamp")
    cand = spark.createDataFrame([(f"c{i}", i, "FLOOD_RISK", lv, 24, now) for i, lv in ((1, "HIGH"), (2, "LOW"), (3, "HIGH"), (4, "HIGH"), (5, "HIGH"), (6, "CRITICAL"), (7, "LOW"))],
                                 "prediction_id string, facility_id long, direction string, level string, horizon_hours int, computed_at timestamp")
    cards = spark.createDataFrame([(f, "FLOOD_RISK", "HIGH", now + dt.timedelta(days=1)) for f in (5, 6)], "facility_id long, direction string, level string, suppress_until timestamp")
    moved = {r.order_id: r for r in om.follow_orders(orders, cand).collect()}
    assert (moved["o1"].prediction_id, moved["o1"].due_at) == ("c1", dt.datetime(2024, 3, 5, 21))
    assert moved["o2"].status == "REJECTED" and moved["o3"].status == "IN_PROGRESS"
    made = om.create_orders(orders, cand, cards, 2024, 7).orderBy("number").collect()
    assert [(r.facility_id, r.number) for r in made] == [(4, "2024-0008"), (6, "2024-0009")]  # 5 is muted at HIGH, 6 grew past it


def test_replay_against_a_loop(spark):
    rnd = random.Random(11)
    log, want = [], {}
    for p in range(12):
        state, applied, ignored = ("NEW", "NONE"), 0, 0
        for i in range(rnd.randint(1, 60)):
            e = rnd.choice(ac.EVENTS)
            log.append((p, T + dt.timedelta(hours=i), i, e))
            nxt = ac.step(e, *state)
            applied, ignored, state = applied + (nxt is not None), ignored + (nxt is None), nxt or state
        want[p] = (*state, applied, ignored)
    df = spark.createDataFrame(log, "prediction_id long, ts timestamp, seq int, event string")
    start = spark.createDataFrame([(p, "NEW", "NONE") for p in range(12)], "prediction_id long, card_status string, order_status string")
    got = {r.prediction_id: (r.card_status, r.order_status, r.applied, r.ignored) for r in ac.final_states(ac.replay(df, start)).collect()}
    assert got == want


def test_blocks_and_texts(spark):
    df = spark.createDataFrame([('[{"type":"a","title":"x"}, 5, null, {"data":[1]}]',), ("no json",), (None,)], "raw string").select(cd.tolerant_blocks("raw").alias("b"))
    assert [[(b.type, b.title) for b in r.b] for r in df.collect()] == [[("a", "x"), ("unknown", "")], [], []]
    texts = spark.createDataFrame([(2.0,), (5.0,), (1.5,), (12.0,), (22.0,)], "r double").select(cd.times_text("r").alias("t"))
    assert [r.t for r in texts.collect()] == ["в 2 раза", "в 5 раз", "в 1,5 раза", "в 12 раз", "в 22 раза"]


def test_small_rules(spark):
    with pytest.raises(ValueError):
        serving.SortBy("secret")
    assert config.DIRECTION["SENSOR_FAILURE"].work_types[0] == "Диагностика датчика"
    assert phrase_count("0" * 20) == 0 and phrase_count("0001101001000101") == 6
    naive = lambda b, at=0, n=0: n if at >= len(b) else naive(b, next((at + s for s in range(1, len(b) - at + 1) if b[at:at + s] not in b[:at + s - 1]), len(b)), n + 1)
    for k in range(1, 900):
        assert phrase_count(f"{k:010b}") == naive(f"{k:010b}")
    scored = spark.createDataFrame([(1,)] + [(0,)] * 99, "y int")
    assert tuple(level_bounds(scored, 0.35).first()) == (0.01, 0.35, 0.4)
    with pytest.raises(Exception, match="rise"):
        level_bounds(scored, 0.001).collect()
    assert serving.one_page(spark.range(1200).orderBy("id"), 0, 9999).count() == 500
    with pytest.raises(ValueError):
        model_columns(["cal_day_of_week", "evt_a"], ["evt", "bad"], {"evt_": "evt", "cal_": "bad"}, config.WORK_WEEK_COLUMNS)
    with pytest.raises(KeyError):
        model_columns(["evt_a"], ["no"], {"evt_": "evt"})


def test_predictors_refuse_what_does_not_fit(spark):
    from undercroft.plans.run import Predictor, Predictors, forecasts_of

    held = Predictors()
    held.add("FLOOD_RISK", Predictor(lambda units, at: units))
    with pytest.raises(ValueError):
        held.add("FLOOD_RISK", Predictor(lambda units, at: units))
    with pytest.raises(KeyError):
        held.add("NO_RISK", Predictor(lambda units, at: units))
    held.add("FIRE_RISK", Predictor(lambda units, at: units, features=("heat",)))
    assert held.due() == ["FIRE_RISK", "FLOOD_RISK"] and "UNAUTHORIZED_ACCESS" in held.missing()
    with pytest.raises(KeyError, match="heat"):
        forecasts_of("FIRE_RISK", held.held["FIRE_RISK"], spark.range(1).withColumnRenamed("id", "facility_id"), "2024-01-01", 1)
