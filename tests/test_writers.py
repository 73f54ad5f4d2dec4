"""Facts that are looked up by a channel: row groups that cannot hold it are not read."""

import glob

import pyarrow.parquet as pq
import pytest

from undercroft.sources import writers as wr


def scanned(df):
    """Rows that the scan of a plan gave out."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if p.getClass().getSimpleName() == "FileSourceScanExec":
            out.append(p.metrics().apply("numOutputRows").value())
        for k in range(p.children().size()):
            walk(p.children().apply(k))

    walk(plan)
    return sum(out)


@pytest.mark.parametrize("channel", [12345, 7])
def test_a_look_up_skips_row_groups(spark, tmp_path, channel):
    rows = spark.range(400_000).selectExpr("id AS event_id", "(id * 7919) % 40000 AS channel_id", "TIMESTAMP '2024-01-01' + make_dt_interval(0, 0, 0, id % 80000) AS ts", "xxhash64(id) AS value", "DATE '2024-01-01' AS day")
    plain, indexed = str(tmp_path / "plain"), str(tmp_path / "indexed")
    wr.write_journal(rows.coalesce(1), plain)
    wr.write_journal(rows.coalesce(1), indexed, index=("channel_id",), group_mb=1)
    found = [spark.read.parquet(p).filter(f"channel_id = {channel}") for p in (plain, indexed)]
    assert sorted(map(str, found[0].collect())) == sorted(map(str, found[1].collect())) and found[0].count() == 10
    assert scanned(found[1]) < 60_000 < scanned(found[0])
    file = pq.ParquetFile(glob.glob(f"{indexed}/day=*/*.parquet")[0])
    assert file.metadata.num_row_groups > 1


def test_a_bloom_filter_tells_what_bounds_cannot(spark, tmp_path):
    """A channel between the bounds of every group, but in none."""
    path = str(tmp_path / "facts")
    rows = spark.range(100_000).selectExpr("id AS event_id", "id * 2 AS channel_id", "TIMESTAMP '2024-01-01' AS ts", "DATE '2024-01-01' AS day")
    wr.write_journal(rows, path, index=("channel_id",))
    gone = spark.read.parquet(path).filter("channel_id = 50001")
    assert gone.count() == 0 and scanned(gone) == 0
