"""From journal rows to units: filters, moments, roll-ups, lives, sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undercroft import config
from undercroft.functions.clock import col, shift


def exclude_artifact(df: DataFrame, object_id: str = "object_id", day: str = "day",
                     artifact: int = config.ARTIFACT_OBJECT,
                     years: Sequence[int] = config.ARTIFACT_YEARS) -> DataFrame:
    return df.filter(~((F.col(object_id) == artifact) & F.year(day).isin(*years)))


def pair_filter(pairs: Sequence[tuple[str, str]], stype: str = "stype", value: str = "value") -> Column:
    """(type, value) is one of the pairs. A short fixed list, so a predicate and not a join."""
    by_type: dict[str, list[str]] = {}
    for t, v in pairs:
        by_type.setdefault(t, []).append(v)
    hit = F.lit(False)
    for t, values in by_type.items():
        hit = hit | ((F.col(stype) == t) & F.col(value).isin(*values))
    return hit


def commissioning(journal: DataFrame, dump_start: str = config.DUMP_START,
                  object_days: int = config.OBJECT_READY_DAYS,
                  channel_days: int = config.CHANNEL_READY_DAYS) -> DataFrame:
    """Day from which a channel counts: the later of object and channel readiness.

    Sources seen at the start of the dump are exempt.
    """
    first = journal.groupBy("channel_id").agg(
        F.min("object_id").alias("object_id"), F.min("day").alias("first_day")
    )
    objects = first.groupBy("object_id").agg(F.min("first_day").alias("object_first"))

    def ready(day: str, days: int) -> Column:
        return F.when(F.col(day) <= F.lit(dump_start).cast("date"), F.lit("1900-01-01").cast("date")).otherwise(
            F.date_add(day, days)
        )

    return first.join(objects, "object_id").select(
        "channel_id", "object_id", "first_day",
        F.greatest(ready("object_first", object_days), ready("first_day", channel_days)).alias("ready_day"),
    )


def exclude_commissioning(journal: DataFrame, ready: DataFrame) -> DataFrame:
    """``ready`` holds one row per channel; the journal side is never collected by channel."""
    return journal.join(ready.select("channel_id", "ready_day"), "channel_id").filter(
        F.col("day") >= F.col("ready_day")
    ).drop("ready_day")


def moments(journal: DataFrame, keys: Sequence[str], ts: str = "ts", channel: str = "channel_id") -> DataFrame:
    """Distinct (channel, stamp) with its row count. Combined map-side before the shuffle."""
    return journal.groupBy(*keys, channel, ts).agg(F.count(F.lit(1)).alias("n_rows"))


def hourly_rollup(moment: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Rows, moments and channels per unit and hour."""
    return moment.groupBy(*keys, F.date_trunc("hour", ts).alias("hour")).agg(
        F.sum("n_rows").alias("n_alarms"),
        F.count(F.lit(1)).alias("n_moments"),
        F.countDistinct("channel_id").alias("n_channels"),
    )


def unit_life(journal: DataFrame, channels: DataFrame, keys: Sequence[str],
              ready: DataFrame | None = None) -> DataFrame:
    """Life of a unit over all rows of its channels, alarms or not.

    ``channels`` is (channel_id, keys...).
    """
    life = (
        journal.join(channels.select("channel_id").distinct(), "channel_id", "left_semi")
        .groupBy("channel_id")
        .agg(F.min("day").alias("d_from"), F.max("day").alias("d_to"))
    )
    if ready is not None:
        life = life.join(ready.select("channel_id", "ready_day"), "channel_id").withColumn(
            "d_from", F.greatest("d_from", "ready_day")
        )
    return (
        channels.select(*keys, "channel_id").distinct().join(life, "channel_id")
        .groupBy(*keys)
        .agg(
            F.min("d_from").cast("timestamp").alias("hour_from"),
            shift(F.max("d_to").cast("timestamp"), 23 * 3600).alias("hour_to"),
            F.count(F.lit(1)).alias("n_channels"),
        )
    )


def fault_days(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys, "day").agg(
        F.count(F.lit(1)).alias("n_fault"), F.countDistinct("channel_id").alias("n_fault_channels")
    )


def live_channels(channels: DataFrame, journal: DataFrame, **artifact) -> DataFrame:
    """Channels with at least one journal row outside the artefact."""
    clean = exclude_artifact(journal, **artifact)
    return channels.join(clean.select(F.col("channel_id").alias("cid")), "cid", "left_semi")


def lost_without_picket(rows: DataFrame, by: str = "value") -> DataFrame:
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("picket").isNull()).alias("lost")
    )


# --- access sections: dictionary-sized tables --------------------------------------


def is_entry(stype: str = "stype", name: str = "name") -> Column:
    """Hatches and exits, ventilation shafts, doors that are not inner or cabinet ones."""
    inner = F.col(name).ilike("%отс%") | F.col(name).ilike("%шкаф%") | F.col(name).ilike("%щ%")
    return (
        F.col(stype).isin(*config.ENTRY_TYPES)
        | F.col(name).ilike("%ВШ%")
        | ((F.col(stype) == config.DOOR_TYPE) & ~inner)
    )


def entry_nodes(entries: DataFrame, line: Sequence[str] = ("object_id", "gallery"),
                merge: int = config.ENTRY_MERGE_PICKETS) -> DataFrame:
    """Entries no further than ``merge`` pickets apart are one node."""
    w = Window.partitionBy(*line).orderBy("picket")
    step = F.col("picket") - F.lag("picket").over(w)
    rows = entries.select(*line, "picket").distinct().withColumn(
        "_new", F.when(step.isNull() | (step > merge), 1).otherwise(0)
    )
    node = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.withColumn("node", node).groupBy(*line, "node")
        .agg(F.min("picket").alias("pk_from"), F.max("picket").alias("pk_to"))
    )


def section_map(pickets: DataFrame, nodes: DataFrame, line: Sequence[str] = ("object_id", "gallery"),
                bin_pickets: int = config.BIN_PICKETS) -> DataFrame:
    """Section of a picket: its nearest entry node, the lower one on a tie.

    Nodes of a line do not overlap, so the nearest is the last one starting at or
    before the picket or the first one after it: two ordered look-ups instead of
    every picket against every node.  A line without nodes is cut into bins.
    """
    places = pickets.select(*line, "picket").distinct()
    node = F.struct("node", "pk_from", "pk_to")
    both = places.withColumn("_at", F.col("picket")).withColumn("_side", F.lit(1)).unionByName(
        nodes.select(*line, F.col("pk_from").alias("_at"), F.lit(0).alias("_side"), node.alias("_n")),
        allowMissingColumns=True,
    )
    order = Window.partitionBy(*line).orderBy("_at", "_side")
    back = F.last("_n", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # Read backwards: a frame that runs on to the end is gone through anew at every row.
    backward = Window.partitionBy(*line).orderBy(F.desc("_at"), F.desc("_side"))
    ahead = F.last("_n", ignorenulls=True).over(backward.rowsBetween(Window.unboundedPreceding, 0))
    near = (
        both.withColumn("_back", back).withColumn("_ahead", ahead).filter(F.col("picket").isNotNull())
        .withColumn("_db", F.greatest(F.lit(0), F.col("picket") - F.col("_back.pk_to")))
        .withColumn("_da", F.col("_ahead.pk_from") - F.col("picket"))
    )
    take_back = F.col("_ahead").isNull() | (F.col("_db") <= F.col("_da"))
    return near.select(
        *line, "picket",
        F.when(F.col("_back").isNotNull() & take_back, F.col("_back.node"))
        .when(F.col("_ahead").isNotNull(), F.col("_ahead.node"))
        .otherwise(1000 + F.floor(F.col("picket") / bin_pickets)).cast("int").alias("section"),
        F.when(F.col("_back").isNotNull() & take_back, F.col("_db"))
        .otherwise(F.col("_da")).alias("entry_dist"),
    )


def section_passport(sections: DataFrame, channels: DataFrame,
                     line: Sequence[str] = ("object_id", "gallery")) -> DataFrame:
    """Counts of pickets and channels by type. A channel sits on one picket, so plain
    conditional counts replace six distinct ones."""
    joined = sections.join(channels, [*line, "picket"])
    per_channel = joined.select(*line, "section", "picket", "cid", "stype", "name").distinct()
    base = per_channel.groupBy(*line, "section").agg(
        F.countDistinct("picket").alias("n_pickets"),
        F.count_if(F.col("stype").isin(*config.CONTACT_TYPES)).alias("n_contact"),
        F.count_if(F.col("stype") == config.MOTION_TYPE).alias("n_motion"),
        F.count_if(F.col("stype") == "КД АВ").alias("n_emergency_exit"),
        F.count_if(F.col("stype").isin("КД Люк", "9-секционный люк")).alias("n_hatch"),
        F.count_if(F.col("name").ilike("%ВШ%")).alias("n_vent_shaft"),
    )
    return base.withColumn("is_branch", (F.col("gallery") != config.MAIN_LINE).cast("int")).withColumn(
        "no_entry", (F.col("section") >= 1000).cast("int")
    )


def sensors_of_units(unit_channels: DataFrame, channel: str = "cid", unit: str = "facility_id") -> DataFrame:
    """Sensor id: C<channel>, with the unit added when the channel sits on several."""
    spread = unit_channels.groupBy(channel).agg(F.count(F.lit(1)).alias("_n"))
    base = F.concat(F.lit("C"), F.col(channel).cast("string"))
    return unit_channels.join(spread, channel).withColumn(
        "sensor_id", F.when(F.col("_n") > 1, F.concat(base, F.lit("-"), F.col(unit))).otherwise(base)
    ).drop("_n")


def object_channel_fanout(object_channels: DataFrame, sections: DataFrame, oid: str = "object_id",
                          parts: int = 128) -> DataFrame:
    """Channels of a whole object (guard mode) put on every section of it.

    The sections of an object are dealt over ``parts``, so that few objects still make many tasks.
    """
    places = sections.distinct()
    dealt = places.withColumn("_part", F.pmod(F.xxhash64(*places.columns), F.lit(parts)).cast("int"))
    asked = object_channels.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return asked.repartition(parts, oid, "_part").join(dealt, [oid, "_part"]).drop("_part")


def parent_child(units: DataFrame, parents: DataFrame) -> DataFrame:
    """Members of a unit: its children, or itself when it has none."""
    kids = parents.select(F.col("parent").alias("facility_id"), F.col("child").alias("member"))
    return units.select("facility_id").join(kids, "facility_id", "left").withColumn(
        "member", F.coalesce("member", "facility_id")
    )


def section_birth(unit_channels: DataFrame, ready: DataFrame) -> DataFrame:
    """First day of a section: the earliest of its channels' effective first days."""
    return unit_channels.join(ready, "channel_id").groupBy("facility_id").agg(
        F.min(F.greatest("first_day", "ready_day")).alias("born")
    )


def channel_day_check(rows: DataFrame, journal: DataFrame) -> DataFrame:
    """Channels, channel-days, event days and the share repeated next day."""
    events = rows.select("channel_id", "day").distinct()
    life = (
        journal.join(events.select("channel_id").distinct(), "channel_id", "left_semi")
        .groupBy("channel_id").agg(F.min("day").alias("d_from"), F.max("day").alias("d_to"))
        .agg(F.count(F.lit(1)).alias("channels"),
             F.sum(F.datediff("d_to", "d_from") + 1).alias("channel_days"))
    )
    next_day = events.select("channel_id", F.date_sub("day", 1).alias("day"), F.lit(1).alias("_rep"))
    hits = events.join(next_day, ["channel_id", "day"], "left").agg(
        F.count(F.lit(1)).alias("event_days"), F.count("_rep").alias("repeated")
    )
    return _side_by_side(life, hits)


def _side_by_side(*one_row: DataFrame) -> DataFrame:
    """Glues one-row tables. The key is constant because each side is a single row."""
    out = one_row[0].withColumn("_k", F.lit(1))
    for df in one_row[1:]:
        out = out.join(df.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


side_by_side = _side_by_side


def choose_week(events: DataFrame, groups: dict[str, Sequence[str]], lo: str, hi: str,
                ts: str = "ts", code: str = "code") -> DataFrame:
    """Week with the largest sum of ln(1+n) over the groups, none of them empty; first on a tie."""
    weeks = (
        events.filter((col(ts) >= F.lit(lo).cast("timestamp")) & (col(ts) < F.lit(hi).cast("timestamp")))
        .groupBy(F.date_trunc("week", ts).alias("week"))
        .agg(*[F.count_if(F.col(code).isin(*codes)).alias(n) for n, codes in groups.items()])
    )
    full = F.lit(True)
    score = F.lit(0.0)
    for n in groups:
        full = full & (F.col(n) > 0)
        score = score + F.log1p(F.col(n))
    scored = weeks.filter(full).withColumn("score", score)
    best = F.max_by(F.struct("week", "score", *groups), F.struct(F.col("score"), -F.unix_seconds("week")))
    return scored.agg(best.alias("b")).select("b.*")
