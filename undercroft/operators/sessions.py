"""Incidents and episodes: runs of moments with small gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undercroft import config
from undercroft.functions.clock import boundary_diff
from undercroft.operators.ordered import number_islands, stab_count
from undercroft.session import stored


def long_gap(minutes: int = config.INCIDENT_GAP_MINUTES, exact: bool = False):
    """Break rule between two stamps: minute boundaries (offline) or exact time (online)."""
    if exact:
        return lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) > minutes * 60_000_000
    return lambda a, b: boundary_diff("minute", a, b) > minutes


def off_guard(moment: DataFrame, windows: DataFrame, keys: Sequence[str] = ("object_id",)) -> DataFrame:
    """Adds whether a moment lies inside a disarm window of its object."""
    return stab_count(moment, windows, keys, "ts", "t_from", "t_to", "_n").withColumn(
        "off_guard", F.col("_n") > 0
    ).drop("_n")


def incidents(moment: DataFrame, keys: Sequence[str], minutes: int = config.INCIDENT_GAP_MINUTES,
              exact: bool = False) -> DataFrame:
    return number_islands(moment, keys, "ts", ["channel_id"], long_gap(minutes, exact), "incident")


def incident_facts(numbered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per incident with the facts the validity rule reads."""
    return numbered.groupBy(*keys, "incident").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"),
        F.count(F.lit(1)).alias("n_moments"),
        F.max((F.col("kind") == "contact").cast("int")).alias("has_contact"),
        F.countDistinct(F.when(F.col("kind") == "motion", F.col("channel_id"))).alias("motion_channels"),
        F.min("entry_dist").alias("entry_dist"),
        F.coalesce(F.max("n_contact"), F.lit(0)).alias("n_contact"),
    )


def is_valid(near_entry: bool = True) -> Column:
    """A contact, two motion channels, motion by an entry, or a section that lacks contacts.

    The online rule leaves the entry distance out.
    """
    ok = (F.col("has_contact") == 1) | (F.col("motion_channels") >= 2) | (
        F.col("n_contact") < config.TRUSTED_CONTACTS)
    if near_entry:
        ok = ok | F.coalesce(F.col("entry_dist") <= config.NEAR_ENTRY_PICKETS, F.lit(False))
    return ok


def flag_events(moment: DataFrame, windows: DataFrame, keys: Sequence[str],
                guard_keys: Sequence[str] = ("object_id",), minutes: int = config.INCIDENT_GAP_MINUTES,
                exact: bool = False, near_entry: bool = True) -> DataFrame:
    """Every moment with ``off_guard`` and ``event`` (armed and part of a valid incident).

    The marked moments are stored once: numbering, validity and the flags all read them.
    """
    marked = stored(off_guard(moment, stored(windows), guard_keys))
    numbered = incidents(marked.filter(~F.col("off_guard")), keys, minutes, exact)
    valid = incident_facts(numbered, keys).filter(is_valid(near_entry)).select(*keys, "incident")
    armed = numbered.join(valid.withColumn("event", F.lit(True)), [*keys, "incident"], "left")
    away = marked.filter(F.col("off_guard"))
    return armed.drop("incident").unionByName(away, allowMissingColumns=True).withColumn(
        "event", F.coalesce("event", F.lit(False))
    )


def episodes_per_day(signals: DataFrame, keys: Sequence[str], ts: str = "ts",
                     minutes: int = config.INCIDENT_GAP_MINUTES) -> DataFrame:
    """First stamp, span and number of episodes per unit and day.

    The window holds the distinct stamps of one unit and one day.
    """
    stamps = signals.select(*keys, F.to_date(ts).alias("day"), ts).distinct()
    w = Window.partitionBy(*keys, "day").orderBy(ts)
    gap = boundary_diff("minute", F.lag(ts).over(w), F.col(ts))
    return stamps.withColumn("_gap", gap).groupBy(*keys, "day").agg(
        F.min(ts).alias("first_ts"),
        boundary_diff("minute", F.min(ts), F.max(ts)).alias("span_minutes"),
        (1 + F.count_if(F.col("_gap") > minutes)).alias("n_episodes"),
    )
