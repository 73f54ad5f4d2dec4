"""Alert budgets: how many alerts a day may raise, and where the threshold falls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undercroft import config
from undercroft.operators.evaluate import by_score
from undercroft.operators.ordered import ranked
from undercroft.session import stored


def day_budget(df: DataFrame, keys: Sequence[str], day: str = "day") -> DataFrame:
    """Flags per day as many top scores as the naive rule raised that day."""
    order = ranked(df, by_score("p", keys), [day])
    k = df.groupBy(day).agg(F.sum("naive").alias("_k"))
    return order.join(k, day).withColumn("flag", (F.col("rn") <= F.col("_k")).cast("int")).drop("rn", "_k")


#: Fan-out of one pass over the score histogram.
BINS = 256


def rolling_thresholds(df: DataFrame, window: int, day: str = "day", p: str = "p", naive: str = "naive") -> DataFrame:
    """Threshold of every day: the budget-th largest score of its last ``window`` days.

    The budget is the number of naive alerts in those days; a day with none has no
    threshold, and one with fewer scores takes its smallest.  Distinct scores get their
    place from the top, once.  A place is read as digits to the base ``BINS``: each pass
    counts scores by day and digit inside the bins still open, adds up the days of a
    window, and keeps the bin in which the budget runs out.  What is sent to the days of a
    window are at most ``BINS`` counts a day and pass, whatever the number of scores.
    Null scores raise no threshold.
    """
    counts = df.filter(F.col(p).isNotNull()).groupBy(day, p).agg(F.count(F.lit(1)).alias("_c"))
    place = stored(ranked(counts.select(p).distinct(), [F.col(p).desc()], rank="_at").withColumn("_at", F.col("_at") - 1))
    cells = stored(counts.join(place, p).select(day, "_at", "_c"))
    serves = F.expr(f"sequence({day}, date_add({day}, {window - 1}), INTERVAL 1 DAY)")
    by_day = df.groupBy(day).agg(F.sum(naive).alias("_b"), F.count(p).alias("_n"))
    days = by_day.select(F.col(day).alias("_day"))
    budget = (
        by_day.select(F.explode(serves).alias("_day"), "_b", "_n").join(days, "_day", "left_semi")
        .groupBy("_day").agg(F.sum("_b").alias("budget"), F.sum("_n").alias("_n"))
    )
    # What is still to be counted from the top of the open bin; never more than there is.
    open_bin = budget.filter((F.col("budget") > 0) & (F.col("_n") > 0)).select(
        "_day", "budget", F.lit(0).cast("long").alias("_bin"), F.least("budget", "_n").alias("_left"))
    most = place.agg(F.max("_at")).first()[0] or 0
    passes = 1
    while BINS ** passes <= most:
        passes += 1
    for level in reversed(range(passes)):
        width = BINS ** level
        digit = F.floor(F.col("_at") / width).cast("long")
        hist = cells.groupBy(day, digit.alias("_to")).agg(F.sum("_c").alias("_c"))
        hist = hist.withColumn("_bin", F.floor(F.col("_to") / BINS).cast("long"))
        sources = open_bin.withColumn(day, F.explode(F.expr(
            f"sequence(date_sub(_day, {window - 1}), _day, INTERVAL 1 DAY)")))
        slid = sources.join(hist, [day, "_bin"]).groupBy("_day", "budget", "_left", "_to").agg(F.sum("_c").alias("_c"))
        # At most BINS rows a day.
        upto = F.sum("_c").over(Window.partitionBy("_day").orderBy("_to"))
        hit = F.min(F.when(F.col("_upto") >= F.col("_left"), F.struct("_to", (F.col("_left") - F.col("_upto") + F.col("_c")).alias("_left"))))
        open_bin = stored(slid.withColumn("_upto", upto).groupBy("_day", "budget").agg(hit.alias("_h")).select(
            "_day", "budget", F.col("_h._to").alias("_bin"), F.col("_h._left").alias("_left")))
    return open_bin.join(place, F.col("_bin") == F.col("_at")).select(F.col("_day").alias(day), F.col(p).alias("threshold"), "budget")


def rolling_budget(df: DataFrame, window: int, day: str = "day") -> DataFrame:
    """Flags rows whose score reaches the day's threshold; ties are all flagged."""
    limits = rolling_thresholds(df, window, day)
    # One row per day of the period, at most a few thousand.
    return df.join(F.broadcast(limits.select(day, "threshold")), day, "left").withColumn(
        "flag", F.coalesce((F.col("p") >= F.col("threshold")).cast("int"), F.lit(0))
    ).drop("threshold")


def hybrid_young_rule(df: DataFrame, window: int, young_days: int = 365, age: str = "age") -> DataFrame:
    """Young units follow the naive rule, the old ones a budget of their own."""
    young = df.filter(F.col(age) < young_days).withColumn("flag", F.col("naive").cast("int"))
    old = rolling_budget(df.filter(F.col(age) >= young_days), window)
    return young.unionByName(old.select(*young.columns))


def budget_bands(forecasts: DataFrame, at: Column, static: Sequence[tuple[str, float]],
                 window_days: int = 30, key: str = "facility_id") -> DataFrame:
    """Level bounds from the last forecasts per facility and day of the window.

    ``forecasts`` is (facility_id, computed_at, probability, naive).  HIGH is the
    budget-th score; MEDIUM stays below it and CRITICAL above; no row when the budget is 0.
    """
    point = F.date_trunc("day", at)
    inside = forecasts.filter(
        (F.col("computed_at") >= point - F.expr(f"INTERVAL {window_days - 1} DAYS"))
        & (F.col("computed_at") <= at)
    )
    latest = inside.groupBy(key, F.to_date("computed_at").alias("_d")).agg(
        F.max_by(F.struct("probability", "naive"), F.struct("computed_at", "probability")).alias("_l")
    ).select(key, "_d", "_l.probability", "_l.naive")
    counts = latest.groupBy(F.lit(1).alias("_g"), "probability").agg(F.count(F.lit(1)).alias("_c"))
    budget = latest.agg(F.count_if(F.col("naive") > 0).alias("budget")).withColumn("_g", F.lit(1))
    placed = ranked(counts, [F.col("probability").desc()], sums={"_upto": "_c"}).join(F.broadcast(budget), "_g")
    hit = F.min(F.when(F.col("_upto") >= F.col("budget"), F.struct("_upto", "probability")))
    high = placed.filter(F.col("budget") > 0).groupBy("budget").agg(
        F.coalesce(hit["probability"], F.min("probability")).alias("high"))
    bounds = dict(static)
    return high.select(
        "budget",
        F.least(F.lit(bounds.get("MEDIUM")), F.col("high")).alias("medium"), "high",
        F.greatest(F.lit(bounds.get("CRITICAL")), F.col("high")).alias("critical"),
    )


def rank_levels(df: DataFrame, group: Sequence[str], p: str = "probability", key: str = "facility_id",
                out: str = "level") -> DataFrame:
    """Levels by rank inside a run: shares with a minimum each, half-even sizes."""
    score = F.when(F.isnan(p), F.lit(-1.0)).otherwise(F.coalesce(F.col(p), F.lit(-1.0)))
    order = ranked(df.withColumn("_p", score), [F.col("_p").desc(), F.col(key).asc()], group)
    size = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    level, upto = None, F.lit(0)
    for code, share, least in config.RANK_SHARES:
        upto = upto + F.greatest(F.lit(least), F.bround(F.col("_n") * share, 0).cast("long"))
        hit = F.col("rn") <= upto
        level = F.when(hit, code) if level is None else level.when(hit, code)
    level = level.otherwise(config.LEVELS[0][0])
    return order.join(size, list(group)).withColumn(out, level).drop("_p", "_n", "rn")
