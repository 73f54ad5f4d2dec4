"""Tables kept on disk between runs, of which a run reads and rewrites only what it can change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undercroft import config
from undercroft.operators.cards import merge_cards
from undercroft.operators.labels import with_open_span
from undercroft.session import stored

OPEN = "open"


def card_part() -> Column:
    """Where a card lies: with the open ones, or with the finished ones of its month."""
    finished = F.coalesce(F.col("status").isin(*config.FINISHED_CARDS), F.lit(False))
    return F.when(finished, F.concat(F.lit("done-"), F.coalesce(F.date_format("bucket", "yyyy-MM"), F.lit("0000")))).otherwise(OPEN)


def overwrite_parts(rows: DataFrame, path: str, *parts: str) -> None:
    """Replaces the folders that ``rows`` have rows for, when the job commits; the others stay as they are."""
    # Ranges of (folder, hash) split a large folder and give a small one a single file.
    spread = F.xxhash64(*[c for c in rows.columns if c not in parts])
    rows.repartitionByRange(*parts, spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def empty_part(rows: DataFrame, path: str, part: str, value: str) -> None:
    """A folder without rows, for what an overwrite by rows leaves alone."""
    rows.limit(0).drop(part).write.mode("overwrite").parquet(f"{path}/{part}={value}")


def write_cards(cards: DataFrame, path: str) -> None:
    """A new store; over an old one, only the folders that ``cards`` has rows for are replaced."""
    overwrite_parts(cards.withColumn("part", card_part()), path, "part")


def read_cards(spark: SparkSession, path: str, since: str | None = None, finished: bool = True) -> DataFrame:
    """Open cards and the finished ones; with ``since`` those of that day's month and later, with ``finished=False`` none."""
    cards = spark.read.parquet(path)
    if not finished:
        return cards.filter(F.col("part") == OPEN).drop("part")
    if since is not None:
        cards = cards.filter((F.col("part") == OPEN) | (F.col("part") >= f"done-{since[:7]}"))
    return cards.drop("part")


def merge_stored(spark: SparkSession, path: str, forecasts: DataFrame) -> DataFrame:
    """``merge_cards`` over a store: gives the open cards after the run with ``is_new`` and leaves them in the store.

    A finished card never changes and speaks only for forecasts of its bucket or an earlier one, so the
    run reads the finished cards from the first month a forecast names, and rewrites the open ones alone.
    A run without forecasts changes nothing.
    """
    first = forecasts.agg(F.min(F.least(F.to_date("bucket"), F.to_date("computed_at")))).first()[0]
    cards = read_cards(spark, path, since=str(first), finished=first is not None)
    merged = stored(merge_cards(cards, forecasts).withColumn("part", card_part()).filter(F.col("part") == OPEN))
    overwrite_parts(merged.drop("is_new"), path, "part")
    return merged.drop("part")


def settle(spark: SparkSession, path: str, decisions: DataFrame) -> None:
    """Decisions on open cards; those finished by them leave for their month.

    ``decisions`` is (prediction_id, status, assignee, verdict), one row per card; a null keeps what the
    card has.  Cards that are finished, or not there, are left alone.  Read are the open cards and the
    finished ones of the months that gain some.
    """
    new = decisions.select("prediction_id", *[F.col(c).alias(f"_{c}") for c in ("status", "assignee", "verdict")])
    cards = read_cards(spark, path, finished=False)
    changed = stored(cards.join(new, "prediction_id", "left").withColumns(
        {c: F.coalesce(f"_{c}", c) for c in ("status", "assignee", "verdict")}
    ).select(*cards.columns).withColumn("part", card_part()))
    # One value per month of the cards that were decided.
    months = [r.part for r in changed.filter(F.col("part") != OPEN).select("part").distinct().collect()]
    beside = spark.read.parquet(path).filter(F.col("part").isin(months))
    whole = stored(changed.unionByName(beside))
    overwrite_parts(whole, path, "part")
    if whole.filter(F.col("part") == OPEN).isEmpty():
        empty_part(whole, path, "part", OPEN)


def write_labels(labels: DataFrame, path: str) -> None:
    """A new store by day; over an old one, only the days that ``labels`` has rows for are replaced."""
    overwrite_parts(labels, path, "day")


def relabel_stored(spark: SparkSession, path: str, fresh: DataFrame, today: str, **options) -> None:
    """``relabel`` over a store by day: the days that are due are replaced in place, all earlier ones stay unread.

    A stored day among those due that has no fresh row is left without rows.  Without fresh rows nothing changes.
    """
    labels = spark.read.parquet(path)
    days = stored(labels.select("day").distinct())
    due = stored(with_open_span(fresh, days, today, **options).select(*labels.columns))
    overwrite_parts(due, path, "day")
    first = due.agg(F.min("day")).first()[0]
    if first is not None:
        # At most the days that are labelled anew.
        gone = days.filter(F.col("day") >= F.lit(first)).join(due.select("day").distinct(), "day", "left_anti").collect()
        for row in gone:
            empty_part(due, path, "day", str(row.day))
