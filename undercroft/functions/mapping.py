"""Journal row to place, event code, reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undercroft import config
from undercroft.functions.clock import col

# Fixed value: the place pattern inside a channel name.
PLACE = r"ПК\s?(\d+)(?:\s?[Гг]\s?(\d+)\s?ПК\s?(\d+))?(?:\s?\+\s?(\d+(?:[.,]\d+)?))?"


def _part(name: Column, i: int) -> Column:
    return F.nullif(F.regexp_extract(name, PLACE, i), F.lit(""))


def parse_place(name: str | Column) -> Column:
    """Struct (picket, offset_m, gallery); null when the name holds no picket.

    A gallery picket has its own numbering and no offset; the main line is -1.
    """
    n = col(name)
    gallery = _part(n, 2)
    place = F.struct(
        F.coalesce(_part(n, 3), _part(n, 1)).cast("int").alias("picket"),
        F.when(gallery.isNotNull(), F.lit(0.0))
        .otherwise(F.coalesce(F.replace(_part(n, 4), F.lit(","), F.lit(".")).cast("double"), F.lit(0.0)))
        .alias("offset_m"),
        F.coalesce(gallery.cast("int"), F.lit(config.MAIN_LINE)).alias("gallery"),
    )
    return F.when(_part(n, 1).isNotNull(), place)


def chainage_m(picket: str | Column, offset_m: str | Column) -> Column:
    return col(picket) * 10 + F.coalesce(col(offset_m), F.lit(0.0))


def sensor_code(stype: str | Column) -> Column:
    pairs = [F.lit(x) for kv in config.SENSOR_CODES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col(stype))


def event_code(stype: str | Column = "stype", value: str | Column = "value",
               alarm: str | Column = "alarm") -> Column:
    """Code of the event a journal row is, null when it is none.

    One look-up by (type, value) instead of a chain of fourteen tests.
    """
    pairs = []
    for types, values, needs_alarm, code in config.EVENT_RULES:
        for t in types:
            for v in values:
                rule = F.struct(F.lit(code).alias("code"), F.lit(needs_alarm).alias("needs"))
                pairs += [F.lit(f"{t}|{v}"), rule]
    hit = F.try_element_at(F.create_map(*pairs), F.concat(col(stype), F.lit("|"), col(value)))
    return F.when(~hit["needs"] | col(alarm), hit["code"])


def decimal(value: str | Column) -> Column:
    """Number with a decimal comma; null when it is not one."""
    number = F.replace(col(value), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(number), number)


def metric(stype: str | Column = "stype") -> Column:
    out = F.lit(None).cast("string")
    for t, (name, _, _, _) in config.NUMERIC.items():
        out = F.when(col(stype) == t, name).otherwise(out)
    return out


def metric_unit(stype: str | Column = "stype") -> Column:
    out = F.lit(None).cast("string")
    for t, (_, unit, _, _) in config.NUMERIC.items():
        out = F.when(col(stype) == t, unit).otherwise(out)
    return out


def reading_value(stype: str | Column = "stype", value: str | Column = "value") -> Column:
    """Reading of a numeric channel; codes of broken firmware and values off the scale drop."""
    number = decimal(value)
    out = F.lit(None).cast("double")
    for t, (_, _, lo, hi) in config.NUMERIC.items():
        fits = number.between(lo, hi) & ~number.isin(*config.BROKEN_NUMBERS)
        out = F.when(col(stype) == t, F.when(fits, number)).otherwise(out)
    return out


def alarm_flag(raw: str | Column) -> Column:
    return F.lower(F.trim(col(raw).cast("string"))).isin(*config.TRUE_WORDS)


def with_place(df: DataFrame, name: str = "name") -> DataFrame:
    return df.withColumn("_p", parse_place(name)).select(
        "*", "_p.picket", "_p.offset_m", "_p.gallery"
    ).drop("_p")


def unit_id(kind: str | Column, oid: str | Column, gallery: str | Column, number: str | Column) -> Column:
    """S-/P-/O- identifier of a section, a picket or a whole object."""
    line = F.when(col(gallery).isNull() | (col(gallery) == config.MAIN_LINE), F.lit("")).otherwise(
        F.concat(F.lit("G"), col(gallery).cast("string"), F.lit("-"))
    )
    tail = F.concat(col(oid).cast("string"), F.lit("-"), line, col(number).cast("string"))
    return (
        F.when(col(kind) == "section", F.concat(F.lit("S-"), tail))
        .when(col(kind) == "picket", F.concat(F.lit("P-"), tail))
        .otherwise(F.concat(F.lit("O-"), col(oid).cast("string")))
    )
