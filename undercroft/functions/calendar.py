"""Calendar table and date flags."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undercroft import config
from undercroft.functions.clock import col


def month_day(day: str | Column) -> Column:
    return F.month(col(day)) * 100 + F.dayofmonth(col(day))


def is_holiday(day: str | Column) -> Column:
    return month_day(day).isin(*[m * 100 + d for m, d in config.HOLIDAYS])


def is_weekend(day: str | Column) -> Column:
    return F.weekday(col(day)) >= 5


def is_day_off(day: str | Column) -> Column:
    return is_holiday(day) | is_weekend(day)


def is_school_vacation(day: str | Column) -> Column:
    now = month_day(day)
    hit = F.lit(False)
    for (m1, d1), (m2, d2) in config.VACATIONS:
        lo, hi = m1 * 100 + d1, m2 * 100 + d2
        hit = hit | (now.between(lo, hi) if lo <= hi else (now >= lo) | (now <= hi))
    return hit


def is_fireworks_day(day: str | Column) -> Column:
    """Six fixed dates and the first Saturday of September."""
    fixed = month_day(day).isin(*[m * 100 + d for m, d in config.FIREWORK_DAYS])
    city = (F.month(col(day)) == 9) & (F.weekday(col(day)) == 5) & (F.dayofmonth(col(day)) <= 7)
    return fixed | city


def moon_phase(ts: str | Column) -> tuple[Column, Column]:
    """Cosine and sine of the synodic phase."""
    days = (F.unix_micros(col(ts)) - F.unix_micros(F.lit(config.NEW_MOON).cast("timestamp"))) / 8.64e10
    turns = days / config.SYNODIC_DAYS
    phase = 2 * math.pi * (turns - F.floor(turns))
    return F.cos(phase), F.sin(phase)


def season(day: str | Column) -> Column:
    return F.floor((F.month(col(day)) % 12) / 3).cast("int")


def calendar(spark: SparkSession, first: str = "2018-01-01", last: str = "2027-12-31") -> DataFrame:
    """One row per date. Bounded by the length of the period, so it may be broadcast."""
    days = spark.sql(
        f"SELECT explode(sequence(DATE '{first}', DATE '{last}', INTERVAL 1 DAY)) AS day"
    )
    return with_day_off_chain(days.select(
        "day",
        is_holiday("day").cast("int").alias("is_holiday"),
        is_weekend("day").cast("int").alias("is_weekend"),
        is_school_vacation("day").cast("int").alias("is_school_vacation"),
        is_day_off("day").cast("int").alias("is_day_off"),
        F.weekday("day").alias("day_of_week"),
        F.month("day").alias("month"),
        F.quarter("day").alias("quarter"),
        season("day").alias("season"),
        F.dayofmonth("day").alias("day_of_month"),
        F.weekofyear("day").alias("week_of_year"),
        F.dayofyear("day").alias("day_of_year"),
    ))


def with_day_off_chain(days: DataFrame, cap: int | None = None) -> DataFrame:
    """Adds the length of the run of days off around a date (0 on workdays).

    The table holds one row per date of the period, which bounds the window.
    """
    run = F.sum(1 - F.col("is_day_off")).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    size = F.count(F.lit(1)).over(Window.partitionBy("_run", "is_day_off"))
    chain = F.when(F.col("is_day_off") == 1, size).otherwise(0)
    if cap is not None:
        chain = F.least(chain, F.lit(cap))
    return (
        days.withColumn("_run", run)
        .withColumn("day_off_chain", chain.cast("int"))
        .withColumn("is_long_weekend", (F.col("day_off_chain") >= 3).cast("int"))
        .drop("_run")
    )
