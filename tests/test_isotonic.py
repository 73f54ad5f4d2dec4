import random
from datetime import datetime, timedelta
from statistics import median

import pytest

from undercroft.operators import isotonic as iso
from undercroft.operators.grids import rolling_median


def by_hand(rows):
    """Value of every score: the greatest least mean of runs that end at or after it."""
    sums = {}
    for p, y in rows:
        s, n = sums.get(p, (0, 0))
        sums[p] = (s + y, n + 1)
    ps = sorted(sums)
    mean = lambda a, b: sum(sums[p][0] for p in ps[a:b + 1]) / sum(sums[p][1] for p in ps[a:b + 1])
    return {p: max(min(mean(j, k) for k in range(i, len(ps))) for j in range(i + 1)) for i, p in enumerate(ps)}


@pytest.mark.parametrize("parts", [1, 40])
def test_blocks_by_brute_force(spark, parts, monkeypatch):
    monkeypatch.setattr(iso, "FAN", 3)
    rng = random.Random(parts)
    rows = [(rng.randrange(60) / 60, int(rng.random() < 0.4)) for _ in range(400)] + [(0.5, k % 2) for k in range(200)]  # one score holds a third
    df = spark.createDataFrame(rows, "p double, y int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = iso.isotonic_blocks(df).collect()
        want = by_hand(rows)
        for p, v in want.items():
            assert [b.value for b in blocks if b.lo <= p <= b.hi] == [pytest.approx(v)]
        assert sorted(b.value for b in blocks) == [b.value for b in sorted(blocks, key=lambda b: b.lo)]
        targets = [-1.0, 2.0, 0.5, 0.123, 0.77, None, float("nan"), *sorted(want)[:5], *[0.5] * 50]
        got = iso.calibrated(df, spark.createDataFrame([(k, p) for k, p in enumerate(targets)], "k long, p double")).collect()
        points = sorted(want.items())
        for r in got:
            p = targets[r.k]
            if p is None or p != p:
                assert r.p_calibrated is None
                continue
            lo, hi = max((q for q in points if q[0] <= p), default=points[0]), min((q for q in points if q[0] >= p), default=points[-1])
            share = 0 if hi[0] <= lo[0] else (p - lo[0]) / (hi[0] - lo[0])
            assert r.p_calibrated == pytest.approx(lo[1] + (hi[1] - lo[1]) * share if points[0][0] <= p <= points[-1][0] else lo[1] if p > 1 else hi[1])
        assert len(got) == len(targets)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_nothing_to_learn_from(spark):
    none, target = spark.createDataFrame([], "p double, y int"), spark.createDataFrame([(0.5,)], "p double")
    assert iso.isotonic_blocks(none).count() == 0
    assert [r.p_calibrated for r in iso.calibrated(none, target).collect()] == [None]
    falling = spark.createDataFrame([(k / 10, 10 - k) for k in range(10)], "p double, y int")
    assert [(b.lo, b.hi, b.value) for b in iso.isotonic_blocks(falling).collect()] == [(0.0, 0.9, 5.5)]


def test_rolling_median_over_spans(spark):
    rng, t0 = random.Random(5), datetime(2023, 12, 30, 7)
    rows = [(k % 3 if k % 2 else 0, t0 + timedelta(hours=rng.randrange(0, 900)), float(rng.randrange(20))) for k in range(500)]  # one key holds over a half
    got = rolling_median(spark.createDataFrame(rows, "k long, ts timestamp, v double"), ("k",), "ts", "v", "norm", days=4, gap_hours=2).collect()
    assert len(got) == len(rows)
    for r in got:
        seen = [v for k, ts, v in rows if k == r.k and timedelta(hours=2) <= r.ts - ts <= timedelta(days=4)]
        assert r.norm == (median(seen) if seen else None)
