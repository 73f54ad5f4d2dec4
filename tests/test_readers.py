"""The journal reader finds the same rows whatever the size of a split."""

import random

import pytest

from undercroft.session import scratch_path
from undercroft.sources import readers as rd


@pytest.mark.parametrize("line_breaks", [True, False])
def test_rows_do_not_depend_on_splits(spark, line_breaks):
    rnd = random.Random(3)
    values = ["На охране", "21,5", 'с "кавычкой"', "строка, часть", ""] + ["строка, часть\nвторая\n\nтретья", "\n"] * line_breaks
    rows = [(k, rnd.randint(1, 9), f"2024-03-{1 + k % 28:02d}", "10:00:00", "t", rnd.choice(values)) for k in range(400)]
    quoted = lambda v: '"' + str(v).replace('"', '""') + '"'
    names = [*rd.COLUMNS.values(), "значение"]
    text = "\n".join([",".join(names), *[",".join(map(quoted, r)) if i % 50 else ",".join(names) + "\n" + ",".join(map(quoted, r)) for i, r in enumerate(rows)]])
    path = scratch_path(spark, "journal") + ".csv"
    spark.createDataFrame([(text,)], "t string").coalesce(1).write.text(path)
    whole = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (10_000_000, 700, 90):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        try:
            df = rd.read_journal_csv(spark, {"значение": [path]}, line_breaks=line_breaks)
            got = sorted((r.event_id, r.channel_id, r.value or "") for r in df.collect())
            tasks = df.rdd.getNumPartitions()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", whole)
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == [(r[0], r[1], r[5]) for r in rows], size
        assert (tasks == 1) == line_breaks
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
