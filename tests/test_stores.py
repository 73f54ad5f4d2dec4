"""Stores of cards and labels: what a run reads, what it rewrites, and the same result as over whole tables."""

import datetime as dt
import os

from pyspark.sql import functions as F

from undercroft.operators import cards as cm
from undercroft.operators.labels import relabel
from undercroft.sources import stores as st

CARDS = "prediction_id string, facility_id long, direction string, bucket timestamp, status string, assignee string, verdict string, probability double, level string, computed_at timestamp, run_id long"
FORE = "facility_id long, direction string, bucket timestamp, probability double, computed_at timestamp, event_at timestamp, run_id long"
NOW = dt.datetime(2024, 3, 5, 12)


def card(pid, fac, day, status, assignee=None, verdict=None, month=3):
    at = dt.datetime(2024, month, day) if day else None
    return (pid, fac, "FLOOD_RISK", at, status, assignee, verdict, 0.2, "HIGH", at, 1)


def some_cards(spark):
    old = [card(f"old{i}", i % 7, 1 + i % 3, "DECIDED", "u", "AGREED", 1 + i % 2) for i in range(60)]
    return spark.createDataFrame(old + [
        card("free", 1, 4, "NEW"), card("busy", 2, 5, "IN_REVIEW", "u"), card("done", 3, 5, "DECIDED", "u", "AGREED"), card("again", 4, 5, "CLOSED_CONFIRMED", "u"),
        card("taken", 5, 5, "NEW", "u"), card("bare", 8, 5, None), card("undated", 9, None, "DECIDED")], CARDS)


def some_forecasts(spark):
    rows = [(f, "FLOOD_RISK", dt.datetime(2024, 3, 5), 0.5, NOW, dt.datetime(2024, 3, 5, 6) if f == 4 else None, 9) for f in range(1, 10)]
    return cm.assign_levels(spark.createDataFrame(rows, FORE))


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_run_over_a_store_reads_and_rewrites_open_cards(spark, tmp_path):
    path = str(tmp_path / "cards")
    cards, fore = some_cards(spark), some_forecasts(spark)
    st.write_cards(cards, path)
    assert rows_of(st.read_cards(spark, path)) == rows_of(cards)
    before = files(path)
    merged = st.merge_stored(spark, path, fore)
    want = cm.merge_cards(cards, fore)
    assert rows_of(st.read_cards(spark, path)) == rows_of(want.drop("is_new"))
    assert {r.prediction_id for r in merged.filter("is_new").collect()} == {r.prediction_id for r in want.filter("is_new").collect()}
    # Finished cards keep their files, and only those of the run's month are in its input.
    assert {f for f in before if "part=done" in f} == {f for f in files(path) if "part=done" in f}
    some = st.read_cards(spark, path, since="2024-03-05")
    read = [r[0] for r in some.select(F.input_file_name()).distinct().collect()]
    assert read and all("part=open" in f or "part=done-2024-03" in f for f in read)
    # Folders are left out before their files are opened.
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "done-2024-03" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert st.merge_stored(spark, path, fore).filter("is_new").count() == 0
    assert rows_of(st.merge_stored(spark, path, fore.limit(0)).drop("is_new")) == rows_of(st.read_cards(spark, path, finished=False))


def test_decided_cards_leave_for_their_month(spark, tmp_path):
    path = str(tmp_path / "cards")
    cards = some_cards(spark)
    st.write_cards(cards, path)
    one = spark.createDataFrame([("free", "DECIDED", "v", "AGREED"), ("busy", None, "w", None), ("old1", "NEW", None, None), ("nowhere", "DECIDED", None, None)],
                                "prediction_id string, status string, assignee string, verdict string")
    st.settle(spark, path, one)
    after = {r.prediction_id: r for r in st.read_cards(spark, path).collect()}
    assert len(after) == cards.count()
    assert (after["free"].status, after["free"].assignee, after["busy"].status, after["busy"].assignee, after["old1"].status) == ("DECIDED", "v", "IN_REVIEW", "w", "DECIDED")
    assert {r.prediction_id for r in st.read_cards(spark, path, finished=False).collect()} == {"busy", "taken", "bare"}
    rest = spark.createDataFrame([(p, "DECIDED", "v", None) for p in ("busy", "taken", "bare")], one.schema)
    st.settle(spark, path, rest)
    assert st.read_cards(spark, path, finished=False).count() == 0 and st.read_cards(spark, path).count() == cards.count()


def test_labels_replaced_by_day(spark, tmp_path):
    path = str(tmp_path / "labels")
    day = lambda d: dt.date(2024, 3, d)
    old = spark.createDataFrame([(u, day(d), 0) for d in range(1, 11) for u in range(3)], "unit long, day date, ev int")
    # The tenth is due and has no fresh row.
    fresh = spark.createDataFrame([(u, day(d), 1) for d in (2, 9, 11, 12) for u in range(4)], "unit long, day date, ev int")
    st.write_labels(old, path)
    before = files(path)
    st.relabel_stored(spark, path, fresh, "2024-03-12")
    got = spark.read.parquet(path)
    assert rows_of(got) == rows_of(relabel(old, fresh, "2024-03-12"))
    assert {f for f in before if not f.split("day=")[1].startswith(("2024-03-09", "2024-03-10"))} <= files(path)
    st.relabel_stored(spark, path, fresh.limit(0), "2024-03-12")
    assert rows_of(spark.read.parquet(path)) == rows_of(got)
