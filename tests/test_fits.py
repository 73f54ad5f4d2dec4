import threading
import time

import pytest

from undercroft.operators import models as md
from undercroft.operators.intervals import state_share_by_hour


def test_fits_run_at_once_and_keep_their_order(spark):
    running, most, lock = [0], [0], threading.Lock()

    def job(n):
        def run():
            with lock:
                running[0] += 1
                most[0] = max(most[0], running[0])
            time.sleep(0.05)
            with lock:
                running[0] -= 1
            return n, spark.sparkContext.getLocalProperty("spark.scheduler.pool")
        return run

    got = md.at_once(spark, [job(n) for n in range(9)], most=3)
    assert [n for n, _ in got] == list(range(9)) and {p for _, p in got} == {"fit-0", "fit-1", "fit-2"} and 1 < most[0] <= 3
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None and md.at_once(spark, []) == []
    with pytest.raises(ZeroDivisionError):
        md.at_once(spark, [lambda: 1, lambda: 1 // 0])


def test_state_shares_of_a_key_with_most_rows(spark):
    import random
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    rng, start, at = random.Random(3), datetime(2024, 1, 1, 2), datetime(2024, 1, 1, 8, 30)
    rows = sorted({(0 if k % 3 else 1, start + timedelta(seconds=rng.randrange(-9000, 23400)), rng.choice(("on", "off"))) for k in range(300)})
    rows = list({(k, t): (k, t, v) for k, t, v in rows}.values()) + [(2, start - timedelta(days=3), "on"), (3, start, "off"), (3, start - timedelta(hours=1), "on")]
    got = state_share_by_hour(spark.createDataFrame(rows, "k long, ts timestamp, value string"), ("k",), F.lit(at), 6, "on").collect()
    assert len(got) == 4 * 6
    for r in got:
        share = 0.0
        for minute in range(3600):
            t = r.hour + timedelta(seconds=minute)
            last = max(((ts, v) for k, ts, v in rows if k == r.k and ts <= t and ts < at), default=(None, "off"))
            share += last[1] == "on"
        assert abs(r.share - share / 3600) < 1e-9
