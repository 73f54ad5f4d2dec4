"""Card columns: levels, factor weights, summaries, rates, blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undercroft import config
from undercroft.functions.clock import col

DEFAULT_BANDS = tuple((code, bound) for code, _, bound in config.LEVELS)


def level_from(p: str | Column, bands: Sequence[tuple[str, float | Column]]) -> Column:
    """The last bound the probability reaches; the lowest level below all of them."""
    out = F.lit(config.LEVELS[0][0])
    for code, bound in bands:
        out = F.when(col(p) >= bound, code).otherwise(out)
    return out


def level_for(p: str | Column, direction: str | Column) -> Column:
    """Level by the bounds of the row's direction, by the common bounds otherwise."""
    out = level_from(p, DEFAULT_BANDS)
    for d in config.DIRECTIONS:
        if d.bands:
            out = F.when(col(direction) == d.code, level_from(p, d.bands)).otherwise(out)
    return out


def level_order(level: str | Column) -> Column:
    out = F.lit(0)
    for code, order in config.LEVEL_ORDER.items():
        out = F.when(col(level) == code, order).otherwise(out)
    return out


def step_level(level: str | Column, delta: int, ceiling: str = "CRITICAL") -> Column:
    """Level moved by ``delta``, held between the lowest level and ``ceiling``."""
    codes = F.array(*[F.lit(c) for c, _, _ in config.LEVELS])
    moved = F.greatest(F.lit(1), F.least(level_order(level) + delta, F.lit(config.LEVEL_ORDER[ceiling])))
    return F.element_at(codes, moved)


def shap_weight(contribution: str | Column) -> Column:
    """Contribution in log odds to a weight between -1 and 1."""
    return F.tanh(col(contribution) / 2)


def factors_filter(df: DataFrame, keys: Sequence[str], name: str = "name",
                   contribution: str = "contribution", always: int = 3, floor: float = 0.02) -> DataFrame:
    """Factors by falling weight: the first ``always``, then those above the floor.

    The window holds the factors of one card, a few dozen rows.
    """
    w = Window.partitionBy(*keys).orderBy(F.abs(contribution).desc(), name)
    return (
        df.withColumn("weight", F.round(shap_weight(contribution), 6))
        .withColumn("position", F.row_number().over(w))
        .filter((F.col("position") <= always) | (F.abs("weight") >= floor))
    )


def times_text(ratio: str | Column) -> Column:
    """'N times' in Russian: one decimal below ten, the word agrees with the number."""
    r = col(ratio).cast("double")
    shown = F.when(r >= 10, F.bround(r, 0)).otherwise(F.bround(r, 1))
    whole = shown.cast("long")
    few = (whole % 10).isin(2, 3, 4) & ~(whole % 100).isin(12, 13, 14)
    word = F.when(few, "раза").otherwise("раз")
    return F.when(
        shown == whole, F.concat(F.lit("в "), whole.cast("string"), F.lit(" "), word)
    ).otherwise(F.concat(F.lit("в "), F.replace(F.format_string("%.1f", shown), F.lit("."), F.lit(",")), F.lit(" раза")))


def relative_summary(df: DataFrame, group: Sequence[str], p: str = "probability",
                     out: str = "summary") -> DataFrame:
    """Risk of a card against the mean of its run. Means are joined back, not windowed:
    a run may hold a third of all cards."""
    value = F.col(p).cast("double")
    known = F.when(~F.isnan(value), value)
    means = df.groupBy(*group).agg(F.avg(known).alias("_mean"), F.count(known).alias("_n"))
    ratio = F.try_divide(known, F.col("_mean"))
    text = (
        F.when(known.isNull() | (F.col("_mean") <= 0), "Риск не оценён")
        .when(ratio >= 1.25, F.concat(F.lit("Риск "), times_text(ratio), F.lit(" выше среднего по сети")))
        .when(ratio <= 0.8, "Риск ниже среднего по сети")
        .otherwise("Риск на уровне среднего по сети")
    )
    return (
        df.join(means, list(group))
        .withColumn(out, F.when(F.col("_n") >= 2, text))
        .drop("_mean", "_n")
    )


def nested_rates(columns: Sequence[tuple[int, str]]) -> Column:
    """Disjoint rates per day from nested counters, oldest window first.

    ``columns`` pairs a window in hours with its counter.  Returns an array of
    (middle_hours_back, rate).
    """
    edges = [*columns, (0, None)]
    points = []
    for (start, older), (end, newer) in zip(edges, edges[1:], strict=False):
        diff = F.col(older) - (F.col(newer) if newer else F.lit(0))
        points.append(F.struct(
            F.lit((start + end) / 2.0).alias("hours_back"),
            F.bround(F.greatest(F.lit(0.0), diff.cast("double")) / ((start - end) / 24.0), 3).alias("rate"),
        ))
    return F.array(*points)


def hours_back(value: str | Column, age_days: str | Column) -> Column:
    """A 'since' feature, null when its value is the never-happened sentinel."""
    v, age = col(value), col(age_days)
    return F.when(v.isNull() | F.isnan(v.cast("double")), None).when(
        age.isNotNull() & (v >= 24 * (age + 1)), None
    ).otherwise(v.cast("double"))


def json_feature(features: str | Column, name: str) -> Column:
    """Number under a key of a JSON feature map; a missing one counts 0."""
    return F.coalesce(F.get_json_object(col(features), f"$.{name}").try_cast("double"), F.lit(0.0))


def tolerant_blocks(raw: str | Column) -> Column:
    """JSON block list to array<struct<type,title,data>>: broken parts drop, never fail."""
    items = F.from_json(col(raw), "array<string>")
    objects = F.filter(F.coalesce(items, F.array().cast("array<string>")),
                       lambda x: F.ltrim(x).startswith("{"))
    return F.transform(objects, lambda x: F.struct(
        F.coalesce(F.get_json_object(x, "$.type"), F.lit("unknown")).alias("type"),
        F.coalesce(F.get_json_object(x, "$.title"), F.lit("")).alias("title"),
        F.get_json_object(x, "$.data").alias("data"),
    ))


def replace_blocks(stored: Column, live: Column,
                   replaceable: Sequence[str] = config.REPLACEABLE_BLOCKS) -> Column:
    """Live blocks over stored ones, in turn: a live block takes the place of the first
    block with its title, or with its type when that type is replaceable; else it goes last."""
    def put(acc: Column, new: Column) -> Column:
        twins = F.transform(acc, lambda old: (old["title"] == new["title"]) | (
            (old["type"] == new["type"]) & new["type"].isin(*replaceable)))
        at = F.array_position(twins, True)
        swapped = F.transform(acc, lambda old, i: F.when(i + 1 == at, new).otherwise(old))
        return F.when(at > 0, swapped).otherwise(F.concat(acc, F.array(new)))

    return F.aggregate(live, stored, put)


def audit_row(entity: str, entity_id: str | Column, action: str | Column, actor: str | Column,
              payload: Column) -> Column:
    return F.struct(
        F.lit(entity).alias("entity_type"), col(entity_id).cast("string").alias("entity_id"),
        col(action).alias("action_code"), col(actor).alias("actor"), F.to_json(payload).alias("payload"),
    )


def point_on_polyline(line: str | Column, share: str | Column) -> Column:
    """Point at a share of the line counted in links, linear inside a link."""
    pts = col(line)
    links = F.greatest(F.size(pts) - 1, F.lit(1))
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(share).cast("double"))) * links
    i = F.least(F.floor(at).cast("int"), links - 1)
    a = F.element_at(pts, i + 1)
    b = F.coalesce(F.try_element_at(pts, i + 2), a)
    t = at - i
    return F.struct(
        (a["lon"] + (b["lon"] - a["lon"]) * t).alias("lon"),
        (a["lat"] + (b["lat"] - a["lat"]) * t).alias("lat"),
    )
