import pytest
from pyspark.sql import functions as F

from undercroft.operators.features import FeatureGraph, value
from undercroft.plans import vectors


def graph(log):
    g = FeatureGraph("TEST", "units", "id")

    def made(name, df):
        log.append(name)
        return df

    g.frame("units")(lambda i: made("units", i.range(3).withColumn("group", F.col("id") % 2)))
    g.frame("base")(lambda i: made("base", i.range(2).selectExpr("id", "id * 10 AS v")))
    g.frame("sums", "base", on=("id",))(lambda i, base: made("sums", base.selectExpr("id", "v AS _v")))
    g.frame("groups", "units", on=("group",))(lambda i, units: made("groups", units.groupBy("group").agg(F.count(F.lit(1)).alias("_n"))))
    g.frame("one", "base", on=())(lambda i, base: made("one", base.agg(F.sum("v").alias("_total"))))
    g.add({"v": lambda i: F.coalesce(F.col("_v"), F.lit(0))}, ["sums"])
    g.add({"mates": lambda i: F.col("_n")}, ["groups"])
    g.add({"total": lambda i: F.col("_total")}, ["one"])
    g.add({"share": lambda i: value("v") / value("total")}, (), ["v", "total"])
    g.add({"twice": lambda i: value("share") * 2}, (), ["share"])
    return g


def test_only_what_is_wanted_is_made_in_order(spark):
    log = []
    g = graph(log)
    assert g.build(spark, ["mates"]).orderBy("id").collect() == [(0, 2), (1, 1), (2, 2)] and log == ["units", "groups"]
    assert g.plan(["twice"]) == (["units", "base", "sums", "one"], ["v", "total", "share", "twice"])
    rows = g.build(spark, ["twice", "v"])
    assert rows.columns == ["id", "twice", "v"] and rows.orderBy("id").collect() == [(0, 0.0, 0), (1, 2.0, 10), (2, 0.0, 0)]
    assert set(g.build(spark).columns) == {"id", *g.features}


def test_what_does_not_fit_is_refused(spark):
    g = graph([])
    with pytest.raises(ValueError, match="v"):
        g.add({"v": lambda i: F.lit(1)})
    with pytest.raises(ValueError, match="base"):
        g.frame("base")
    assert g.missing(["v", "no", "none"]) == ["no", "none"]
    with pytest.raises(LookupError, match="no, none"):
        g.build(spark, ["v", "no", "none"])
    g.add({"lost": lambda i: F.lit(1)}, ["nowhere"])
    with pytest.raises(LookupError, match="nowhere, which lost needs"):
        g.plan(["lost"])
    g.add({"a": lambda i: value("b")}, (), ["b"])
    g.add({"b": lambda i: value("a")}, (), ["a"])
    with pytest.raises(ValueError, match="made of itself"):
        g.plan(["a"])


def test_access_graph_prunes_its_frames():
    assert vectors.ACCESS.plan(["day_of_week"])[0] == ["known", "units"]
    assert vectors.ACCESS.plan(["hours_since_guard_change"])[0] == ["known", "units", "guard", "change"]
    assert len(vectors.ACCESS.features) == 28 and vectors.ACCESS.plan(list(vectors.ACCESS.features))[1]
