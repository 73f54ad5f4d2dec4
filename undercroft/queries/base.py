"""How a query is registered, and the views the queries read.

A view is one SQL text valid in Spark and in other ANSI engines, so both sides of a
check read the same input.  A query gives its columns as ``name:type`` with types
``i`` (integer), ``d`` (double, six decimals), ``s`` (text), ``D`` (date), ``t``
(timestamp) and ``b`` (boolean); both sides are cast to the same plain types.  Doubles
are nudged by 1e-9 before rounding, so a value that ends on half a unit rounds the same
way whatever the order its parts were added in.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undercroft.functions.calendar import calendar
from undercroft.session import pin_utc

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
           "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    # alarm journal of one month: a channel is a user
    "journal": """
        SELECT event_id, user_id AS channel_id, user_id % 10 AS object_id, (user_id % 10) % 3 AS complex_id,
               CAST(CASE WHEN user_id % 7 = 0 THEN 0 ELSE -1 END AS BIGINT) AS gallery,
               CAST(floor(user_id / 20) AS BIGINT) AS picket, CAST(floor(user_id / 60) AS BIGINT) AS section,
               CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts, CAST(ts AS DATE) AS day,
               CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type, value
        FROM events""",
    # typed journal rows: channel type, text value, alarm flag as written
    "raw_journal": """
        SELECT event_id, channel_id, object_id, ts, day, stype,
               CASE WHEN stype IN ('Датчик температуры', 'Газовый датчик')
                    THEN CASE WHEN event_id % 37 = 0 THEN '327,68' WHEN event_id % 41 = 0 THEN 'нет связи'
                              ELSE replace(CAST(CAST(value AS DECIMAL(12, 2)) AS STRING), '.', ',') END
                    WHEN event_type = 'error' THEN CASE stype WHEN 'Датчик движения' THEN 'Обнаружено движение'
                         WHEN 'Состояние насоса' THEN 'Затоплен' WHEN 'Датчик дыма' THEN 'Обнаружен дым' ELSE 'Не замкнут' END
                    WHEN event_type = 'view' THEN CASE stype WHEN 'Состояние охраны' THEN 'На охране' ELSE 'Выключен' END
                    WHEN event_type = 'signup' THEN CASE stype WHEN 'Состояние охраны' THEN 'Снято с охраны' ELSE 'Неисправен' END
                    WHEN event_type = 'purchase' THEN 'Включен' ELSE 'Обесточен' END AS value,
               CASE WHEN event_id % 3 = 0 THEN 'false' WHEN event_id % 3 = 1 THEN 'True' ELSE ' t ' END AS alarm
        FROM (SELECT *, CASE channel_id % 8 WHEN 0 THEN 'КД Дверь' WHEN 1 THEN 'Датчик движения' WHEN 2 THEN 'Состояние охраны'
                     WHEN 3 THEN 'Состояние насоса' WHEN 4 THEN 'Датчик затопления' WHEN 5 THEN 'Датчик дыма'
                     WHEN 6 THEN 'Датчик температуры' ELSE 'Газовый датчик' END AS stype FROM journal) j""",
    "channel_name": """
        SELECT p_partkey AS cid, p_partkey % 10 AS oid,
               CASE p_partkey % 4
                 WHEN 0 THEN concat('ТД ПК', CAST(p_partkey AS STRING))
                 WHEN 1 THEN concat('ДД ПК', CAST(p_partkey AS STRING), '+', CAST(p_size AS STRING), ',5')
                 WHEN 2 THEN concat('Темп. ПК', CAST(p_partkey AS STRING), ' Г', CAST(p_size % 3 AS STRING), 'ПК', CAST(p_size AS STRING))
                 ELSE p_name END AS name
        FROM part""",
    # channel dictionary with places and types
    "channels": """
        SELECT p_partkey AS cid, p_partkey % 10 AS object_id, CAST(CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE -1 END AS BIGINT) AS gallery,
               CAST(floor(p_partkey / 10) AS BIGINT) AS picket,
               CASE p_size % 6 WHEN 0 THEN 'КД АВ' WHEN 1 THEN 'КД Дверь' WHEN 2 THEN 'Датчик движения' WHEN 3 THEN 'КД Люк'
                    WHEN 4 THEN 'Датчик дыма' ELSE 'Датчик температуры' END AS stype,
               CASE p_partkey % 17 WHEN 0 THEN 'Темп. ВШ ПК' WHEN 1 THEN 'КД отс. ПК' ELSE 'Д ПК' END AS name
        FROM part""",
    "moment": """
        SELECT channel_id, object_id, gallery, section, CASE event_type WHEN 'error' THEN 'contact' ELSE 'motion' END AS kind, ts,
               count(*) AS n_rows, max(picket % 9) AS entry_dist
        FROM journal WHERE event_type IN ('error', 'click')
        GROUP BY channel_id, object_id, gallery, section, CASE event_type WHEN 'error' THEN 'contact' ELSE 'motion' END, ts""",
    "guard": """
        SELECT object_id, ts, CASE event_type WHEN 'signup' THEN 'off' ELSE 'on' END AS value
        FROM journal WHERE event_type IN ('signup', 'view')""",
    "section_contacts": """
        SELECT object_id, gallery, section, count(DISTINCT CASE WHEN channel_id % 3 = 0 THEN channel_id END) AS n_contact
        FROM journal GROUP BY object_id, gallery, section""",
    # pumps: every channel has one
    "pump_rows": """
        SELECT channel_id, object_id, complex_id, gallery, picket, ts, hour, day,
               CASE event_type WHEN 'purchase' THEN 'on' WHEN 'view' THEN 'off' WHEN 'click' THEN 'unavailable'
                    WHEN 'signup' THEN 'all_running' ELSE 'flooded' END AS value, event_id % 4 <> 0 AS alarm
        FROM journal""",
    # fire signals and readings
    "fire_signal": """
        SELECT channel_id, object_id, complex_id, gallery, picket, ts, day, event_id,
               CASE event_type WHEN 'error' THEN 'smoke' ELSE 'heat' END AS stype
        FROM journal WHERE event_type IN ('error', 'click')""",
    # seven years of rows for year-long windows
    "long_rows": """
        SELECT l_suppkey AS channel_id, l_suppkey % 10 AS object_id, (l_suppkey % 10) % 3 AS complex_id, CAST(-1 AS BIGINT) AS gallery,
               CAST(floor(l_suppkey / 20) AS BIGINT) AS section, CAST(floor(l_suppkey / 10) AS BIGINT) AS picket,
               CAST(l_shipdate AS DATE) AS day, CAST(l_shipdate AS TIMESTAMP) + (l_orderkey % 24) * INTERVAL 1 HOUR AS hour,
               CAST(l_shipdate AS TIMESTAMP) + (l_orderkey % 3) * INTERVAL 1 HOUR + (l_partkey % 60) * INTERVAL 1 MINUTE AS moment,
               l_orderkey, l_partkey, l_linenumber, l_quantity, l_discount, l_returnflag
        FROM lineitem""",
    "unit_event": """
        SELECT channel_id AS unit_id, object_id, complex_id, day, count(*) AS m,
               max(CASE WHEN l_returnflag = 'R' AND l_quantity >= 45 THEN 1 ELSE 0 END) AS ev
        FROM long_rows GROUP BY channel_id, object_id, complex_id, day""",
    "acc_alarm": """
        SELECT object_id, gallery, section, hour, count(*) AS n_alarms, count(*) AS n_moments, count(DISTINCT channel_id) AS n_channels
        FROM long_rows GROUP BY object_id, gallery, section, hour""",
    "acc_armed": """
        SELECT object_id, gallery, section, hour, count(*) AS n_alarms, count(*) AS n_moments, count(DISTINCT channel_id) AS n_channels
        FROM long_rows WHERE l_returnflag = 'R' AND l_quantity >= 35 GROUP BY object_id, gallery, section, hour""",
    "acc_unit": """
        SELECT object_id, gallery, section, CAST(min(day) AS TIMESTAMP) AS hour_from,
               CAST(max(day) AS TIMESTAMP) + INTERVAL 23 HOUR AS hour_to, count(DISTINCT channel_id) AS n_channels
        FROM long_rows GROUP BY object_id, gallery, section""",
    "acc_guard": """
        SELECT o_custkey % 10 AS object_id, CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 24) * INTERVAL 1 HOUR AS ts,
               CASE WHEN o_orderstatus = 'P' THEN 'off' ELSE 'on' END AS value
        FROM orders WHERE o_custkey % 10 <> 7""",
    "acc_fault": """
        SELECT object_id, gallery, section, day, count(*) AS n_fault, count(DISTINCT channel_id) AS n_fault_channels
        FROM long_rows WHERE l_returnflag = 'N' AND l_quantity >= 40 GROUP BY object_id, gallery, section, day""",
    "acc_chain": """
        SELECT object_id, gallery, section, moment AS completed_ts FROM long_rows WHERE l_linenumber = 7 AND l_discount >= 0.07""",
    "section_info": """
        SELECT object_id, gallery, section, max(CASE WHEN gallery <> -1 THEN 1 ELSE 0 END) AS is_branch,
               max(CASE WHEN section >= 3 THEN 1 ELSE 0 END) AS no_entry, count(DISTINCT picket) AS n_pickets,
               count(DISTINCT channel_id) AS n_contact, count(DISTINCT l_linenumber) AS n_motion, min(l_linenumber) AS n_emergency_exit,
               max(l_linenumber) AS n_hatch, min(l_orderkey % 5) AS n_vent_shaft
        FROM long_rows GROUP BY object_id, gallery, section""",
    "weather_daily": """
        SELECT CAST(o_orderdate AS DATE) AS day, CAST((count(*) * 7) % 23 AS DOUBLE) AS precip_mm,
               CAST((CAST(sum(o_custkey) AS BIGINT) % 45) - 15 AS DOUBLE) AS temp_mean, CAST((max(o_orderkey) % 60) AS DOUBLE) AS snow_cm,
               CAST((CAST(sum(o_custkey) AS BIGINT) % 50) - 10 AS DOUBLE) AS temp_max
        FROM orders GROUP BY CAST(o_orderdate AS DATE)""",
    # hourly weather of the journal month: one value per hour
    "weather_hour": """
        SELECT hour, CAST(count(*) % 5 AS DOUBLE) AS precip, CAST(count(*) % 3 AS DOUBLE) AS rain,
               CAST(count(DISTINCT channel_id) % 4 AS DOUBLE) AS snowfall, CAST(max(event_id) % 41 - 15 AS DOUBLE) AS temp,
               CAST(min(event_id) % 50 AS DOUBLE) / 100 AS snow_depth
        FROM journal GROUP BY hour""",
    "facility": """
        SELECT c_custkey AS facility_id, c_custkey % 50 AS collector, c_nationkey AS district, (c_custkey % 360) - 180 AS lon,
               (c_custkey % 170) - 85 AS lat FROM customer""",
    "card": """
        SELECT o_orderkey AS prediction_id,
               CASE o_orderkey % 3 WHEN 0 THEN 'FIRE_RISK' WHEN 1 THEN 'FLOOD_RISK' ELSE 'UNAUTHORIZED_ACCESS' END AS direction,
               o_custkey AS facility_id, CAST(o_orderkey % 1000 AS DOUBLE) / 1000 AS probability,
               CASE WHEN o_orderkey % 1000 >= 780 THEN 'CRITICAL' WHEN o_orderkey % 1000 >= 550 THEN 'HIGH'
                    WHEN o_orderkey % 1000 >= 300 THEN 'MEDIUM' ELSE 'LOW' END AS level,
               CASE o_orderstatus WHEN 'O' THEN 'NEW' WHEN 'P' THEN 'IN_REVIEW' ELSE 'CLOSED_CONFIRMED' END AS status,
               CASE WHEN o_orderkey % 11 = 0 THEN 'LOW' END AS dispatcher_level,
               CASE WHEN o_orderkey % 7 = 0 THEN concat('user', CAST(o_orderkey % 3 AS STRING)) END AS assignee,
               CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 24) * INTERVAL 1 HOUR AS computed_at,
               CAST(o_orderdate AS TIMESTAMP) AS bucket, o_orderkey % 700 AS compute_ms, 24 + o_orderkey % 24 AS horizon_hours,
               CASE WHEN o_orderkey % 13 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 30 DAY END AS suppress_until,
               CAST(floor(o_totalprice) AS BIGINT) % 5 AS evt_hours_24h
        FROM orders""",
    "work_order": """
        SELECT o_orderkey AS order_id, o_orderkey AS prediction_id, o_custkey AS facility_id,
               CASE o_orderkey % 3 WHEN 0 THEN 'FIRE_RISK' WHEN 1 THEN 'FLOOD_RISK' ELSE 'UNAUTHORIZED_ACCESS' END AS direction,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'AUTO_CREATED' ELSE 'REJECTED' END AS status,
               CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 24) * INTERVAL 1 HOUR AS created_at,
               CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY AS due_at
        FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""",
    # scored rows: seven years of unit-days with a label, the naive rule and a score
    "scored": """
        SELECT unit_id, object_id, day, ev AS y,
               CASE WHEN m >= 2 THEN 1 ELSE 0 END AS naive,
               CAST((unit_id * 31 + year(day) * 17 + month(day) * 13 + day(day) * 7 + ev * 90) % 500 AS DOUBLE) / 500 AS p,
               CAST((unit_id * 13 + month(day) * 5 + day(day)) % 60 + 1 AS BIGINT) AS since,
               CAST((unit_id * 37) % 800 AS BIGINT) AS age
        FROM unit_event""",
}


def dense_calendar_sql(first: str, last: str) -> str:
    """Calendar in portable SQL: the same columns as ``functions.calendar``."""
    holidays = "(101, 102, 103, 104, 105, 106, 107, 108, 223, 308, 501, 509, 612, 1104)"
    return f"""
        SELECT *, CASE WHEN is_day_off = 1 THEN count(*) OVER (PARTITION BY run, is_day_off) ELSE 0 END AS day_off_chain
        FROM (SELECT *, sum(1 - is_day_off) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS run
        FROM (SELECT *, CASE WHEN is_holiday = 1 OR is_weekend = 1 THEN 1 ELSE 0 END AS is_day_off
        FROM (SELECT day, CASE WHEN month(day) * 100 + day(day) IN {holidays} THEN 1 ELSE 0 END AS is_holiday,
               CASE WHEN isodow(day) >= 6 THEN 1 ELSE 0 END AS is_weekend,
               CASE WHEN month(day) * 100 + day(day) BETWEEN 1026 AND 1103 OR month(day) * 100 + day(day) >= 1228
                      OR month(day) * 100 + day(day) <= 108 OR month(day) * 100 + day(day) BETWEEN 323 AND 331
                      OR month(day) IN (6, 7, 8) THEN 1 ELSE 0 END AS is_school_vacation,
               isodow(day) - 1 AS day_of_week, month(day) AS month, quarter(day) AS quarter, (month(day) % 12) // 3 AS season,
               day(day) AS day_of_month, weekofyear(day) AS week_of_year, dayofyear(day) AS day_of_year
        FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '{first}', TIMESTAMP '{last}', INTERVAL 1 DAY)) AS DATE) AS day)))) c"""


CALENDAR_SPAN = ("1994-01-01", "2025-12-31")
# Views only the checking side needs; Spark builds the calendar from its own function.
CHECK_VIEWS: dict[str, str] = {"cal": dense_calendar_sql(*CALENDAR_SPAN)}

CASTS = {"i": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "D": "VARCHAR", "t": "VARCHAR", "b": "INTEGER"}


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


class Tables:
    """Source tables and views of one data folder, loaded on first use."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self._made = spark, folder, {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in SOURCES:
                self._made[name] = self.spark.read.parquet(self.path(name))
            elif name == "cal":
                self._made[name] = calendar(self.spark, *CALENDAR_SPAN)
            elif name in VIEWS:
                needs = {n: getattr(self, n) for n in mentioned(VIEWS[name])}
                text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(needs)})\b", r"\1 {\2}", VIEWS[name])
                self._made[name] = self.spark.sql(text, **needs)
            else:
                raise AttributeError(name)
        return self._made[name]


def mentioned(sql: str) -> list[str]:
    names = re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)\b", sql)
    return [n for n in dict.fromkeys(names) if n in VIEWS or n in SOURCES or n in CHECK_VIEWS]


def with_views(sql: str) -> str:
    """Prefixes the views a statement reads, in the order they depend on each other."""
    every = {**VIEWS, **CHECK_VIEWS}
    order: list[str] = []

    def visit(text: str) -> None:
        for n in mentioned(text):
            if n in every and n not in order:
                visit(every[n])
                order.append(n)

    visit(sql)
    return ",\n".join(f"{n} AS ({every[n]})" for n in order)


def typed_sql(columns: tuple[tuple[str, str], ...], sql: str) -> str:
    def one(name: str, kind: str) -> str:
        value = f'CAST("{name}" AS {CASTS[kind]})'
        return f'round({value} + 1e-9, 6) AS "{name}"' if kind == "d" else f'{value} AS "{name}"'

    views = with_views(sql)
    head = f"WITH {views}, " if views else "WITH "
    return f"{head}result AS ({sql})\nSELECT {', '.join(one(n, k) for n, k in columns)} FROM result"


def typed_frame(columns: tuple[tuple[str, str], ...], df: DataFrame) -> DataFrame:
    def one(name: str, kind: str):
        c = F.col(name)
        if kind == "d":
            return F.round(c.cast("double") + 1e-9, 6).alias(name)
        return c.cast({"i": "bigint", "b": "int"}.get(kind, "string")).alias(name)

    return df.select(*[one(n, k) for n, k in columns])


def query(name: str, columns: str, sql: str | None = None):
    spec = tuple(tuple(c.split(":")) for c in columns.split())

    def register(build):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, spec, build, sql)
        return build

    return register


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        pin_utc(spark)
        return typed_frame(q.columns, q.build(Tables(spark, folder)))

    run.__name__ = q.name
    return run
