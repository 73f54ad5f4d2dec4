"""Fire incidents on the stream without the signals of bursts.

A signal belongs to a burst if more than ``most`` other places of its object signalled within ``minutes`` of it on the
same day, before it or after it.  So a signal is judged when the watermark has passed all that can still count, and
incidents take it in event time: the result is that of the batch rule, whatever the order in which rows come.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from undercroft import config

HOUR, DAY = 3_600_000_000, 86_400_000_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
OUTPUT = "object_id long, facility_id long, ts timestamp, burst boolean, started timestamp, n int, is_new boolean"
SIGNALS = "signals array<struct<at:bigint,gallery:bigint,picket:bigint,facility:bigint>>"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which list, map and timer state needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def in_bursts(signals: list[tuple[int, int, int]], lo: int, hi: int, reach: int, most: int) -> list[bool]:
    """For the sorted (at, gallery, picket) from place ``lo`` to ``hi``: whether over ``most`` other places signalled near it that day."""
    out, inside, a, b = [], Counter(), 0, 0
    for at, *_ in signals[lo:hi]:
        first, last = max(at - reach, at // DAY * DAY), min(at + reach, at // DAY * DAY + DAY - 1)
        while b < len(signals) and signals[b][0] <= last:
            inside[signals[b][1:3]] += 1
            b += 1
        while signals[a][0] < first:
            inside[signals[a][1:3]] -= 1
            if not inside[signals[a][1:3]]:
                del inside[signals[a][1:3]]
            a += 1
        out.append(len(inside) - 1 > most)
    return out


class BurstIncidents(StatefulProcessor):
    """Signals of an object by hour, and for each facility the start and size of its running incident.

    An hour is judged by a timer when the watermark passes what may still count for it; the hour before is then dropped, so
    an object holds the hours that the watermark leaves open and two more.  Incidents that have ended go once a day.
    """

    def __init__(self, minutes: int, most: int, hours: int) -> None:
        self.reach, self.most, self.span = minutes * 60_000_000, most, hours * HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", "hour long", SIGNALS)
        self.open = handle.getMapState("incidents", "facility long", "started long, n int")

    def wait(self, hour: int) -> int:
        """Milliseconds at which the hour can be judged."""
        return -(-((hour + 1) * HOUR + self.reach) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh: dict[int, list[tuple]] = {}
        for r in rows:
            if r.object_id is not None and r.ts is not None:
                fresh.setdefault(r.at // HOUR, []).append((r.at, r.gallery, r.picket, r.facility_id))
        for hour, signals in fresh.items():
            held = self.held(hour)
            self.hours.updateValue((hour,), ([*held, *signals],))
            for h in (hour, hour + 1):  # the second lets go of this hour where the next one is empty
                self.handle.registerTimer(self.wait(h))
        return iter(())

    def held(self, hour: int) -> list[tuple]:
        return [tuple(s) for s in self.hours.getValue((hour,))[0]] if self.hours.containsKey((hour,)) else []

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        hour = (expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.reach) // HOUR - 1
        before, own, after = (sorted(self.held(hour + d)) for d in (-1, 0, 1))
        flags = in_bursts([s[:3] for s in (*before, *own, *after)], len(before), len(before) + len(own), self.reach, self.most)
        for (at, _, _, facility), burst in zip(own, flags, strict=True):
            yield self.row(key[0], facility, at, burst)
        if before:
            self.hours.removeKey((hour - 1,))
        if hour % 24 == 0:
            for facility in [f for f, (started, _) in self.open.iterator() if started + self.span <= hour * HOUR]:
                self.open.removeKey(facility)

    def row(self, object_id: int, facility: int, at: int, burst: bool) -> Row:
        started, n, new = None, 0, False
        if not burst:
            started, n = self.open.getValue((facility,)) if self.open.containsKey((facility,)) else (None, 0)
            new = started is None or at - started >= self.span
            started, n = (at, 1) if new else (started, n + 1)
            self.open.updateValue((facility,), (started, n))
        return Row(object_id=object_id, facility_id=facility, ts=at, burst=burst, started=started, n=n, is_new=new)

    def close(self) -> None:
        pass


def burst_free_incidents(signals: DataFrame, hours: int = 24, minutes: int = config.BURST_MINUTES, most: int = config.BURST_NEIGHBOURS, late: str = "2 hours") -> DataFrame:
    """Every signal of ``object_id, gallery, picket, facility_id, ts``: in a burst, or with the incident it belongs to.

    An incident is keyed by its first signal; signals of the facility within ``hours`` of it belong to it, a later one opens
    the next.  Rows behind the watermark are dropped and counted by the stream's own metrics.  ``minutes`` are 60 at most.
    """
    if not 0 < minutes <= 60:
        raise ValueError("a burst reaches over an hour at most")
    kinds = signals.selectExpr("object_id", "gallery", "picket", "facility_id", "ts").withWatermark("ts", late)
    rows = kinds.selectExpr("CAST(object_id AS LONG) AS object_id", "CAST(gallery AS LONG) AS gallery", "CAST(picket AS LONG) AS picket", "CAST(facility_id AS LONG) AS facility_id", "ts", "unix_micros(ts) AS at")
    plain = OUTPUT.replace("ts timestamp", "ts long").replace("started timestamp", "started long")
    found = rows.groupBy("object_id").transformWithState(BurstIncidents(minutes, most, hours), plain, "append", "eventTime")
    return found.selectExpr("object_id", "facility_id", "timestamp_micros(ts) AS ts", "burst", "timestamp_micros(started) AS started", "n", "is_new")
