"""Writers. Facts are partitioned by time; micro-batches land under their day and batch, so a replay overwrites itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undercroft.functions.cards import level_for


def write_journal(df: DataFrame, path: str, partition: str = "day", mode: str = "errorifexists",
                  spread: Sequence[str] = ("ts",), index: Sequence[str] = (), group_mb: int = 128) -> None:
    """ZSTD parquet by day.

    Range partitioning on (day, time) gives every writer a few whole days and splits a hot
    day over several, so neither small files nor a hot task appear.  ``index`` columns take the place of an index: rows
    are sorted by them inside a file, which makes the bounds of its row groups narrow, and each has a Bloom filter, so
    a look-up by one of them reads the groups that may hold it.
    """
    rows = df.repartitionByRange(partition, *spread)
    writer = (rows.sortWithinPartitions(partition, *index, *spread) if index else rows).write.mode(mode).option("compression", "zstd")
    if index:
        writer = writer.option("parquet.block.size", group_mb * 1024 * 1024)
        for c in index:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.partitionBy(partition).parquet(path)


def journal_to_parquet(df: DataFrame, path: str, partition: str = "day") -> bool:
    """One pass to parquet; what is already there is not rebuilt."""
    try:
        df.sparkSession.read.parquet(path).schema  # noqa: B018  a folder that a failed job left has no committed file
        return False
    except AnalysisException:
        write_journal(df, path, partition, mode="overwrite")
        return True


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_events_csv(df: DataFrame, path: str) -> None:
    """Event rows for a bulk load: no header, stamps with the network's offset."""
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+03"))
    df.withColumn("ts", stamp).write.mode("overwrite").csv(path)


def write_stream_slice(df: DataFrame, path: str, lo: str, hi: str) -> None:
    """Rows of [lo, hi) ordered by time and id, gzipped CSV with a header, one file per range."""
    part = df.filter((F.col("ts") >= F.lit(lo).cast("timestamp")) & (F.col("ts") < F.lit(hi).cast("timestamp")))
    part.orderBy("ts", "event_id").write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def export_journal_csv(df: DataFrame, path: str) -> None:
    """Semicolon CSV for spreadsheets: quotes doubled, null as empty."""
    df.write.mode("overwrite").option("header", True).option("sep", ";").option("quote", '"').option(
        "escape", '"').option("emptyValue", "").csv(path)


def append_forecast_log(forecasts: DataFrame, path: str, run_id: int) -> None:
    """One JSON line per forecast; an unknown probability is null."""
    p = F.when(~F.isnan("probability"), F.col("probability"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
    forecasts.select(
        iso("computed_at").alias("at"), F.lit(run_id).alias("runId"), "direction", F.col("facility_id").alias("facilityId"),
        p.alias("probability"), F.coalesce("level", level_for("probability", "direction")).alias("level"),
        iso("bucket").alias("bucket"),
    ).write.mode("append").option("ignoreNullFields", False).json(path)


def upsert_replace(stored: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """On a key conflict the fresh values win; several fresh rows of a key need ``version``.

    A union and one aggregate with map-side combine; no join, no shuffle of losers twice.
    """
    values = [c for c in stored.columns if c not in keys]
    version = F.col("version") if "version" in fresh.columns else F.lit(0)
    old = stored.select(*keys, F.struct(*values).alias("_v"), F.struct(F.lit(0).alias("a"), F.lit(0).cast("long").alias("b")).alias("_r"))
    new = fresh.select(*keys, F.struct(*values).alias("_v"), F.struct(F.lit(1).alias("a"), version.cast("long").alias("b")).alias("_r"))
    return old.unionByName(new).groupBy(*keys).agg(F.max_by("_v", "_r").alias("_v")).select(*keys, "_v.*").select(*stored.columns)


def upsert_greatest(stored: DataFrame, fresh: DataFrame, keys: Sequence[str], value: str = "value",
                    carried: Sequence[str] = ()) -> DataFrame:
    """On a key conflict the greater value stays."""
    both = stored.select(*keys, value, *carried).unionByName(fresh.select(*keys, value, *carried))
    return both.groupBy(*keys).agg(F.max(value).alias(value), *[F.max(c).alias(c) for c in carried])


def write_batch(rows: DataFrame, path: str, batch_id: int, day: str = "day") -> None:
    """Rows of one micro-batch under their day.  A replayed batch overwrites what it wrote itself and nothing else."""
    rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day, "batch").parquet(path)


def read_greatest(spark: SparkSession, path: str, schema: str, keys: Sequence[str], value: str = "value", carried: Sequence[str] = ("day",), days: Sequence[str] = ()) -> DataFrame:
    """The greatest value of each key over the batches of ``write_batch``; ``days`` prunes the folders that are read."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    if days:
        rows = rows.filter(F.col("day").isin(*days))
    return rows.groupBy(*keys).agg(F.max(value).alias(value), *[F.max(c).alias(c) for c in carried])
