"""Readers of raw inputs. Schemas are given, never inferred; numbers are cast with ``try_cast``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undercroft import config
from undercroft.functions.mapping import alarm_flag

# Column names of the dump. The value column has two spellings.
COLUMNS = {"event_id": "ид_события", "channel_id": "ид_канала_данных", "day": "дата", "time": "время", "alarm": "тревожное"}
VALUE_NAMES = ("значение", "значение_датчика")
CHANNEL_COLUMNS = {"cid": "ид_канала_данных", "sys": "тип_инж_системы", "stype": "тип_датчика", "name": "название_датчика",
                   "oid": "ид_объект"}
OBJECT_COLUMNS = {"oid": "ид_объект", "level": "иерархия_уровень", "parent": "родитель",
                  "name": "диспетчерское_название_объекта"}
WEATHER_FIELDS = {"precip": "precipitation", "rain": "rain", "snowfall": "snowfall", "temp": "temperature_2m",
                  "snow_depth": "snow_depth"}


def read_csv_text(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], line_breaks: bool = True) -> DataFrame:
    """Quoted CSV with every column as text.

    With ``line_breaks`` values may hold some, and a file is one task; without, files are read in splits.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    return (
        spark.read.option("header", True).option("multiLine", line_breaks).option("quote", '"').option("escape", '"')
        .option("enforceSchema", False).schema(schema).csv(paths))


def read_journal_csv(spark: SparkSession, paths: Mapping[str, Sequence[str]], columns: Mapping[str, str] = COLUMNS,
                     online_flags: bool = False, line_breaks: bool = True) -> DataFrame:
    """Journal files as typed rows; a header, also one repeated inside a file, is not a row.

    ``paths`` maps the spelling of the value column to the files that use it; the files of each spelling are one scan
    and the scans are united by name.  ``line_breaks`` tells whether values may hold some: a dump that has none is read in
    splits of its files, one that has them file by file, so it should come in many files.  Turn it to Parquet once.
    """
    parts = []
    for value_name, files in paths.items():
        names = [*columns.values(), value_name]
        raw = read_csv_text(spark, list(files), names, line_breaks)
        parts.append(raw.select(*[F.col(src).alias(dst) for dst, src in columns.items()], F.col(value_name).alias("value")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    alarm = alarm_flag("alarm") if online_flags else F.col("alarm").isin(*config.OFFLINE_TRUE_WORDS)
    day = F.col("day").try_cast("date")
    return rows.filter(F.col("event_id").try_cast("long").isNotNull()).select(
        F.col("event_id").try_cast("long").alias("event_id"), F.col("channel_id").try_cast("long").alias("channel_id"),
        day.alias("day"), F.concat_ws(" ", "day", "time").try_cast("timestamp").alias("ts"),
        F.coalesce(alarm, F.lit(False)).alias("alarm"), "value")


def read_dictionary(spark: SparkSession, paths: str | Sequence[str], columns: Mapping[str, str], integers: Sequence[str]) -> DataFrame:
    raw = read_csv_text(spark, paths, list(columns.values()))
    return raw.select(*[
        (F.col(src).try_cast("long") if dst in integers else F.col(src)).alias(dst) for dst, src in columns.items()])


def read_channels(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return read_dictionary(spark, paths, CHANNEL_COLUMNS, ("cid", "oid"))


def read_objects(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return read_dictionary(spark, paths, OBJECT_COLUMNS, ("oid", "level", "parent"))


def hourly_json(spark: SparkSession, paths: str | Sequence[str], fields: Mapping[str, str]) -> DataFrame:
    """Parallel arrays under ``hourly`` to one row per hour."""
    inner = ", ".join(f"`{src}`: array<double>" for src in fields.values())
    raw = spark.read.option("multiLine", True).schema(f"hourly struct<`time`: array<string>, {inner}>").json(paths)
    zipped = F.arrays_zip(F.col("hourly.time").alias("time"), *[
        F.col(f"hourly.`{src}`").alias(dst) for dst, src in fields.items()])
    return raw.select(F.explode(zipped).alias("r")).select(
        F.to_timestamp("r.time", "yyyy-MM-dd'T'HH:mm").alias("hour"), *[F.col(f"r.{dst}").alias(dst) for dst in fields])


def read_weather_json(spark: SparkSession, paths: str | Sequence[str], before: str | None = None) -> DataFrame:
    """Hourly weather; missing precipitation is zero, missing temperature and snow stay unknown."""
    rows = hourly_json(spark, paths, WEATHER_FIELDS).fillna(0.0, ["precip", "rain", "snowfall"])
    return rows if before is None else rows.filter(F.col("hour") < F.lit(before).cast("timestamp"))


def weather_days(hours: DataFrame) -> DataFrame:
    """Daily sums, means and the melt of the snow cover against the day before."""
    d = hours.groupBy(F.to_date("hour").alias("day")).agg(
        F.sum("precip").alias("precip_mm"), F.sum("rain").alias("rain_mm"), F.sum("snowfall").alias("snowfall_cm"),
        F.avg("temp").alias("temp_mean"), F.max("temp").alias("temp_max"), F.min("temp").alias("temp_min"),
        F.max_by("snow_depth", "hour").alias("snow_depth_end_m"))
    gone = 100 * (F.lag("snow_depth_end_m").over(Window.orderBy("day")) - F.col("snow_depth_end_m"))
    return d.withColumn("melt_cm", F.greatest(F.lit(0.0), gone))


def read_air_and_wind_json(spark: SparkSession, wind: str, air: str) -> DataFrame:
    """Wind, cloud and soil from one file, particles and CO from another, by day."""
    w = hourly_json(spark, wind, {"wind": "wind_speed_10m", "gust": "wind_gusts_10m", "cloud": "cloud_cover",
                                  "soil": "soil_temperature_0_to_7cm"})
    a = hourly_json(spark, air, {"pm25": "pm2_5", "pm10": "pm10", "co": "carbon_monoxide"})
    day = F.to_date("hour").alias("day")
    return w.groupBy(day).agg(
        F.avg("wind").alias("wind_mean"), F.max("gust").alias("gust_max"), F.avg("cloud").alias("cloud_mean"),
        F.avg("soil").alias("soil_temp")).join(
        a.groupBy(day).agg(F.avg("pm25").alias("pm25_mean"), F.max("pm25").alias("pm25_max"),
                           F.avg("pm10").alias("pm10_mean"), F.max("co").alias("co_max")), "day", "full_outer")


def humidity_days(spark: SparkSession, path: str) -> DataFrame:
    rows = hourly_json(spark, path, {"rh": "relative_humidity_2m", "dew": "dew_point_2m", "pressure": "surface_pressure"})
    d = rows.groupBy(F.to_date("hour").alias("day")).agg(
        F.avg("rh").alias("rh_mean"), F.max("rh").alias("rh_max"), F.avg("dew").alias("dew_mean"),
        F.avg("pressure").alias("pressure_mean"))
    return d.withColumn("pressure_change", F.col("pressure_mean") - F.lag("pressure_mean").over(Window.orderBy("day")))


def read_kp_index(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace text with ``#`` comments: the day in the first three fields, kp in the eighth."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return rows.select(
        F.make_date(parts[0].cast("int"), parts[1].cast("int"), parts[2].cast("int")).alias("day"),
        parts[7].cast("double").alias("kp"))


def fill_merged_cells(rows: DataFrame, start: str = "start", shared: Sequence[str] = ("start", "back", "done"),
                      sheet: str = "sheet", order: str = "row_no") -> DataFrame:
    """A schedule row without dates shares the last window above it; ``accepted`` is its own or
    the inherited end.  A sheet has a few hundred rows."""
    w = Window.partitionBy(sheet).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    window = F.last(F.when(F.col(start).isNotNull(), F.struct(*shared)), ignorenulls=True).over(w)
    return rows.withColumn("_w", window).select(
        *[c for c in rows.columns if c not in shared], F.col("_w.start").alias("start"), F.col("_w.back").alias("back"),
        F.coalesce(F.col("done"), F.col("_w.done")).alias("accepted"))


def schedule_months(rows: DataFrame, cells: str = "cells", header: Column | None = None, mark: str = "ТО",
                    sheet: str = "sheet", order: str = "row_no") -> DataFrame:
    """Object header rows name the object of the rows below; months whose cell holds the mark."""
    is_header = F.col("is_header") if header is None else header
    w = Window.partitionBy(sheet).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    current = F.last(F.when(is_header, F.col("object_no")), ignorenulls=True).over(w)
    months = F.filter(
        F.transform(cells, lambda c, i: F.when(F.contains(c, F.lit(mark)), i + 1)), lambda m: m.isNotNull())
    return rows.withColumn("plan_object", current).filter(~is_header & F.col("plan_object").isNotNull()).select(
        "plan_object", F.col("n").alias("n"), months.alias("months"))


def cyclic_weather_fill(known: DataFrame, template: DataFrame, until: str, origin: str) -> DataFrame:
    """Hours missing up to ``until`` take the same hour of the week from a template
    (position, columns...).  The template has 168 rows."""
    size = 168
    last = known.agg(F.max("hour").alias("_last"))
    end = F.date_trunc("hour", F.lit(until).cast("timestamp"))
    step = F.expr("INTERVAL 1 HOUR")
    start = F.coalesce(F.col("_last") + step, end - F.expr("INTERVAL 24 HOURS"))
    missing = last.select(F.explode(F.when(start <= end, F.sequence(start, end, step))).alias("hour"))
    position = F.pmod(F.floor((F.unix_seconds("hour") - F.unix_seconds(F.lit(origin).cast("timestamp"))) / 3600), F.lit(size))
    return missing.withColumn("position", position.cast("int")).join(F.broadcast(template), "position").drop("position")
