"""Readers and writers, each on files written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from undercroft.queries.base import query
from undercroft.session import scratch_path
from undercroft.sources import readers as rd
from undercroft.sources import writers as wr

FLAG = "lower(trim(alarm)) IN ('t', 'true', '1', 'да')"


def journal_files(t) -> dict[str, list[str]]:
    """The raw journal as two sets of CSV files: two spellings of the value column, quotes,
    commas and line breaks inside values, a header repeated in the middle."""
    c = rd.COLUMNS
    value = F.when(F.col("event_id") % 50 == 0, F.concat(F.col("value"), F.lit(', "часть"\nдалее'))).otherwise(F.col("value"))
    rows = t.raw_journal.select(
        F.col("event_id").cast("string").alias(c["event_id"]), F.col("channel_id").cast("string").alias(c["channel_id"]),
        F.date_format("ts", "yyyy-MM-dd").alias(c["day"]), F.date_format("ts", "HH:mm:ss").alias(c["time"]),
        F.when(F.col("event_id") % 3 == 0, "t").otherwise(F.trim("alarm")).alias(c["alarm"]), value.alias("value"), F.col("event_id").alias("_id"))
    out = {}
    for i, name in enumerate(rd.VALUE_NAMES):
        path = scratch_path(t.spark, f"journal-csv-{i}")
        part = rows.filter(F.col("_id") % 2 == i).drop("_id")
        header = t.spark.createDataFrame([(*c.values(), name)], part.schema)
        part.unionByName(header).withColumnRenamed("value", name).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
        out[name] = [path]
    return out


@query("read_journal_csv", "event_id:i channel_id:i day:D ts:t alarm:b value:s", """
    SELECT event_id, channel_id, day, ts, CASE WHEN event_id % 3 = 0 OR trim(alarm) IN ('t', 'True') THEN 1 ELSE 0 END AS alarm,
           CASE WHEN event_id % 50 = 0 THEN concat(value, ', "часть"', chr(10), 'далее') ELSE value END AS value FROM raw_journal""")
def _(t):
    return rd.read_journal_csv(t.spark, journal_files(t))


@query("journal_to_parquet", "day:D n:i first_id:i rebuilt:b", "SELECT day, count(*) AS n, min(event_id) AS first_id, 0 AS rebuilt FROM journal GROUP BY day")
def _(t):
    path = scratch_path(t.spark, "journal-parquet")
    rows = t.journal.select("event_id", "channel_id", "ts", "day", "value")
    wr.journal_to_parquet(rows, path)
    rebuilt = wr.journal_to_parquet(rows.limit(0), path)
    back = t.spark.read.parquet(path)
    return back.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id")).withColumn("rebuilt", F.lit(rebuilt))


@query("time_partitioned_facts", "month:s n:i total:d", "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, sum(value) AS total FROM journal GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "facts")
    wr.write_journal(t.journal.select("event_id", "ts", "value", F.date_format("ts", "yyyy-MM").alias("month")), path, "month")
    return t.spark.read.parquet(path).groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("indexed_facts", "channel_id:i n:i total:d", "SELECT channel_id, count(*) AS n, sum(value) AS total FROM journal WHERE channel_id % 50 = 7 AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "indexed-facts")
    wr.write_journal(t.journal.select("event_id", "channel_id", "ts", "value", "day"), path, index=("channel_id",))
    facts = t.spark.read.parquet(path).filter("day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND channel_id % 50 = 7")
    return facts.groupBy("channel_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("read_dictionaries", "cid:i oid:i stype:s name:s parent:i", "SELECT cid, object_id AS oid, stype, name, object_id % 3 AS parent FROM channels")
def _(t):
    ch, ob = scratch_path(t.spark, "channels"), scratch_path(t.spark, "objects")
    names = rd.CHANNEL_COLUMNS
    t.channels.select(F.col("cid").alias(names["cid"]), F.lit("СКУД").alias(names["sys"]), F.col("stype").alias(names["stype"]), F.col("name").alias(names["name"]),
                      F.col("object_id").alias(names["oid"])).write.option("header", True).csv(ch)
    o = rd.OBJECT_COLUMNS
    t.channels.select(F.col("object_id").alias(o["oid"]), F.lit(2).alias(o["level"]), (F.col("object_id") % 3).alias(o["parent"]),
                      F.concat(F.lit("Объект "), F.col("object_id").cast("string")).alias(o["name"])).distinct().write.option("header", True).csv(ob)
    return rd.read_channels(t.spark, ch).join(rd.read_objects(t.spark, ob).select("oid", "parent"), "oid")


def weather_json(t, fields: dict, name: str) -> str:
    """One JSON document of parallel arrays, as a weather archive gives it."""
    path = scratch_path(t.spark, name)
    rows = F.sort_array(F.collect_list(F.struct(F.date_format("hour", "yyyy-MM-dd'T'HH:mm").alias("time"), *[F.expr(e).alias(k) for k, e in fields.items()])))
    doc = t.weather_hour.agg(rows.alias("r")).select(F.struct(
        F.col("r.time").alias("time"), *[F.col(f"r.{k}").alias(k) for k in fields]).alias("hourly"))
    doc.coalesce(1).write.option("ignoreNullFields", False).json(path)
    return path


@query("read_weather_json", "hour:t precip:d rain:d snowfall:d temp:d snow_depth:d", """
    SELECT hour, CASE WHEN temp < -5 THEN 0 ELSE precip END AS precip, rain, snowfall, CASE WHEN precip = 2 THEN NULL ELSE temp END AS temp, snow_depth FROM weather_hour WHERE hour < TIMESTAMP '2024-01-25'""")
def _(t):
    path = weather_json(t, {"precipitation": "CASE WHEN temp < -5 THEN NULL ELSE precip END", "rain": "rain", "snowfall": "snowfall",
                            "temperature_2m": "CASE WHEN precip = 2 THEN NULL ELSE temp END", "snow_depth": "snow_depth"}, "weather-json")
    return rd.read_weather_json(t.spark, path, before="2024-01-25 00:00:00")


@query("weather_days", "day:D precip_mm:d temp_mean:d temp_max:d temp_min:d snow_depth_end_m:d melt_cm:d", """
    SELECT *, greatest(0, 100 * (lag(snow_depth_end_m) OVER (ORDER BY day) - snow_depth_end_m)) AS melt_cm FROM (
      SELECT CAST(hour AS DATE) AS day, sum(precip) AS precip_mm, avg(temp) AS temp_mean, max(temp) AS temp_max, min(temp) AS temp_min, arg_max(snow_depth, hour) AS snow_depth_end_m FROM weather_hour GROUP BY 1)""")
def _(t):
    return rd.weather_days(t.weather_hour)


@query("read_air_and_wind_json", "day:D wind_mean:d gust_max:d cloud_mean:d soil_temp:d pm25_mean:d pm25_max:d pm10_mean:d co_max:d", """
    SELECT CAST(hour AS DATE) AS day, avg(temp) AS wind_mean, max(precip) AS gust_max, avg(rain) AS cloud_mean, avg(snow_depth) AS soil_temp, avg(snowfall) AS pm25_mean, max(snowfall) AS pm25_max, avg(precip) AS pm10_mean, max(rain) AS co_max FROM weather_hour GROUP BY 1""")
def _(t):
    wind = weather_json(t, {"wind_speed_10m": "temp", "wind_gusts_10m": "precip", "cloud_cover": "rain", "soil_temperature_0_to_7cm": "snow_depth"}, "wind-json")
    air = weather_json(t, {"pm2_5": "snowfall", "pm10": "precip", "carbon_monoxide": "rain"}, "air-json")
    return rd.read_air_and_wind_json(t.spark, wind, air)


@query("humidity_days", "day:D rh_mean:d rh_max:d dew_mean:d pressure_change:d", """
    SELECT day, rh_mean, rh_max, dew_mean, p - lag(p) OVER (ORDER BY day) AS pressure_change FROM (SELECT CAST(hour AS DATE) AS day, avg(rain) AS rh_mean, max(rain) AS rh_max, avg(temp) AS dew_mean, avg(precip) AS p FROM weather_hour GROUP BY 1)""")
def _(t):
    path = weather_json(t, {"relative_humidity_2m": "rain", "dew_point_2m": "temp", "surface_pressure": "precip"}, "humidity-json")
    return rd.humidity_days(t.spark, path)


@query("read_kp_index", "day:D kp:d n:i", "SELECT CAST(o_orderdate AS DATE) AS day, CAST(o_custkey % 9 AS DOUBLE) AS kp, count(*) AS n FROM orders GROUP BY 1, 2")
def _(t):
    path = scratch_path(t.spark, "kp-text")
    line = F.concat_ws("  ", F.date_format("o_orderdate", "yyyy MM dd").substr(1, 10), F.lit("03 1.50 24000.1 24000.2"), F.format_string("%.3f", (F.col("o_custkey") % 9).cast("double")), F.lit("7 1"))
    notes = t.orders.limit(5).select(F.lit("# comment line").alias("value"))
    t.orders.select(line.alias("value")).unionByName(notes).write.text(path)
    return rd.read_kp_index(t.spark, path).groupBy("day", "kp").agg(F.count(F.lit(1)).alias("n"))


@query("fill_merged_schedule_cells", "sheet:i row_no:i start:D back:D accepted:D", """
    SELECT sheet, row_no, last_value(start IGNORE NULLS) OVER w AS start, last_value(CASE WHEN start IS NOT NULL THEN back END IGNORE NULLS) OVER w AS back, coalesce(done, last_value(CASE WHEN start IS NOT NULL THEN done2 END IGNORE NULLS) OVER w) AS accepted
    FROM (SELECT o_custkey % 50 AS sheet, o_orderkey AS row_no, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) END AS start, CAST(o_orderdate AS DATE) + 20 AS back, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) + 30 END AS done,
                 CAST(o_orderdate AS DATE) + 30 AS done2 FROM orders) WINDOW w AS (PARTITION BY sheet ORDER BY row_no ROWS UNBOUNDED PRECEDING)""")
def _(t):
    d = F.to_date("o_orderdate")
    k = F.col("o_orderkey")
    rows = t.orders.select((F.col("o_custkey") % 50).alias("sheet"), k.alias("row_no"), F.when(k % 4 == 0, d).alias("start"), F.date_add(d, 20).alias("back"),
                           F.when((k % 3 == 0) | (k % 4 == 0), F.date_add(d, 30)).alias("done"))
    return rd.fill_merged_cells(rows)


@query("schedule_months", "plan_object:i n:i months:s", """
    SELECT plan_object, n, CASE WHEN plan_object % 2 = 0 THEN '3,7' ELSE '7' END AS months FROM (
      SELECT o_orderkey AS row_no, o_custkey % 9 AS n, o_orderkey % 5 = 0 AS h, last_value(CASE WHEN o_orderkey % 5 = 0 THEN o_custkey END IGNORE NULLS) OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS plan_object, o_custkey FROM orders)
    WHERE NOT h AND plan_object IS NOT NULL AND plan_object % 2 = o_custkey % 2""")
def _(t):
    k = F.col("o_orderkey")
    cells = F.array(F.lit(""), F.lit(""), F.when(F.col("o_custkey") % 2 == 0, "ТО-1"), F.lit(""), F.lit(""), F.lit("х"), F.lit("ТО"))
    rows = t.orders.select((F.col("o_custkey") % 20).alias("sheet"), k.alias("row_no"), (k % 5 == 0).alias("is_header"), F.col("o_custkey").alias("object_no"), (F.col("o_custkey") % 9).alias("n"), cells.alias("cells"))
    got = rd.schedule_months(rows)
    return got.filter(F.array_contains("months", 3) == (F.col("plan_object") % 2 == 0)).withColumn("months", F.concat_ws(",", F.transform("months", lambda m: m.cast("string"))))


@query("write_label_parquet", "object_id:i gallery:i section:i n:i", "SELECT object_id, gallery, section, count(*) AS n FROM acc_armed GROUP BY 1, 2, 3")
def _(t):
    path = scratch_path(t.spark, "labels")
    wr.write_table(t.acc_armed, path)
    return t.spark.read.parquet(path).groupBy("object_id", "gallery", "section").agg(F.count(F.lit(1)).alias("n"))


@query("write_events_csv", "event_id:i stamp:s kind:s", "SELECT event_id, concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), '+03') AS stamp, event_type AS kind FROM journal")
def _(t):
    path = scratch_path(t.spark, "events-csv")
    wr.write_events_csv(t.journal.select("event_id", "ts", "event_type"), path)
    return t.spark.read.schema("event_id long, stamp string, kind string").csv(path)


@query("write_stream_slice", "event_id:i position:i value:d", """
    SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position, value FROM journal WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'""")
def _(t):
    path = scratch_path(t.spark, "slice")
    wr.write_stream_slice(t.journal.select("event_id", "ts", "value"), path, "2024-01-08", "2024-01-15")
    # Files hold consecutive ranges; the position of a row is its file's offset plus its place in the file.
    back = t.spark.read.option("header", True).schema("event_id long, ts timestamp, value double").csv(path).select(
        "*", F.input_file_name().alias("_f"), F.monotonically_increasing_id().alias("_m"))
    sizes = back.groupBy("_f").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    from pyspark.sql import Window

    offset = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return back.join(offset, "_f").select("event_id", (F.col("_o") + F.col("_m") - F.col("_m0")).alias("position"), "value")


@query("append_forecast_log", "facilityId:i runId:i probability:d level:s at:s", """
    SELECT facility_id AS facilityId, r AS runId, CASE WHEN prediction_id % 50 = 0 THEN NULL ELSE probability END AS probability, level, strftime(computed_at, '%Y-%m-%dT%H:%M:%SZ') AS at FROM card CROSS JOIN (SELECT unnest([1, 2]) AS r)""")
def _(t):
    path = scratch_path(t.spark, "forecast-log")
    p = F.when(F.col("prediction_id") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("probability"))
    rows = t.card.withColumn("probability", p)
    for run in (1, 2):
        wr.append_forecast_log(rows, path, run)
    return t.spark.read.schema("at string, runId long, direction string, facilityId long, probability double, level string, bucket string").json(path)


@query("export_journal_csv", "prediction_id:i status:s assignee:s note:s", """
    SELECT prediction_id, status, assignee, concat('a "quoted"; part ', level) AS note FROM card""")
def _(t):
    path = scratch_path(t.spark, "export")
    wr.export_journal_csv(t.card.select("prediction_id", "status", "assignee", F.concat(F.lit('a "quoted"; part '), "level").alias("note")), path)
    return t.spark.read.option("header", True).option("sep", ";").option("quote", '"').option("escape", '"').schema(
        "prediction_id long, status string, assignee string, note string").csv(path)


@query("versioned_upsert", "day:D n:i total:d", "SELECT day, count(*) AS n, sum(v) AS total FROM (SELECT channel_id, day, hour, max(value) AS v FROM journal GROUP BY 1, 2, 3) GROUP BY day")
def _(t):
    path, keys = scratch_path(t.spark, "versioned"), ["channel_id", "hour"]
    rows = t.journal.groupBy("channel_id", "hour", "day", "event_type").agg(F.max("value").alias("value"))
    for i, kinds in enumerate((("error", "click"), ("view", "purchase"), ("signup",))):
        part = rows.filter(F.col("event_type").isin(*kinds)).groupBy("channel_id", "hour", "day").agg(F.max("value").alias("value"))
        wr.write_batch(part.withColumn("value", F.lit(1e9)), path, i)  # what a failed try left behind
        wr.write_batch(part, path, i)
    return wr.read_greatest(t.spark, path, "channel_id long, hour timestamp, value double, day date", keys).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("cyclic_weather_fill", "hour:t temp:d", """
    WITH k AS (SELECT max(hour) AS last FROM weather_hour), tpl AS (SELECT CAST(epoch(hour) - epoch(TIMESTAMP '2024-01-08') AS BIGINT) // 3600 AS position, temp FROM weather_hour WHERE hour >= TIMESTAMP '2024-01-08' AND hour < TIMESTAMP '2024-01-15')
    SELECT h AS hour, temp FROM (SELECT unnest(generate_series(last + INTERVAL 1 HOUR, TIMESTAMP '2024-02-10 05:00:00', INTERVAL 1 HOUR)) AS h FROM k) JOIN tpl ON position = (CAST(epoch(h) - epoch(TIMESTAMP '2024-01-08') AS BIGINT) // 3600) % 168""")
def _(t):
    week = t.weather_hour.filter("hour >= TIMESTAMP '2024-01-08' AND hour < TIMESTAMP '2024-01-15'")
    template = week.select(((F.unix_seconds("hour") - F.unix_seconds(F.lit("2024-01-08").cast("timestamp"))) / 3600).cast("int").alias("position"), "temp")
    return rd.cyclic_weather_fill(t.weather_hour, template, "2024-02-10 05:30:00", "2024-01-08 00:00:00")
