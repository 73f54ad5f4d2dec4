"""Mixing sources to target weights by weighted fair queueing.

Every document of a source is put in a shuffled order (by the MD5 of its id).  A copy of it has the
virtual finish time ``words of its source up to its end / target of the source``; the second pass
over a source goes on where the first one ended.  All copies are sorted by finish time and cut where
the running total reaches the sum of the targets.  Virtual time runs alike for all sources, so equal
slices of it hold about equal numbers of words: they are the ranges of the global sort.

Running sums are two-level: inside a slice, and over one row per slice.  No source and no slice is
ever whole in a task.  The windows without slices see one row per source, or per slice.

Defined results: a null text has size 0; a null source is a source of its own, the last in order; rows that
repeat an id are mixed as documents of their own.  An empty document is never taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undercroft.llm.common import WORD, fresh, sized, staged, text_of

#: Rows a slice of the shuffled order and of virtual time holds on average.
SLICE_ROWS = 4096


def words(text: str) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...], budget: float, most_repeats: int) -> DataFrame:
    """``source, source_size, target``: the budget by weight, no target above ``most_repeats`` times its source.

    Where weights repeat in order, source number i has weight ``weights[i % len]``.  The share above a limit goes to the
    others by weight until none is above: sources are limited in order of limit by weight, up to the first that is not.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    t = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    t = t.withColumn("most", F.col("source_size") * float(most_repeats)).withColumn("ratio", F.col("most") / F.col("weight"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("all_words", F.sum("source_size").over(whole) * float(budget))
    before = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("level", (F.col("all_words") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    free = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull().alias("n"), "source", "level"))).over(whole)
    level = free["level"]
    return t.select("source", "source_size", F.when(level.isNull(), F.col("most")).otherwise(F.least("most", level * F.col("weight"))).alias("target"))


def shuffle_key(id_col: str) -> Column:
    return F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def mix_order(docs: DataFrame, id_col: str, size: Column, source_col: str, weights: tuple[int, ...], budget: float, most_repeats: int) -> DataFrame:
    """A row for each document: ``id, source, size``, its key ``h`` and ``place`` in its source's order, ``source_size, target, ends`` (finish time of the first copy)."""
    base = staged(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")), "mix")
    slices = min(65536, sized(base.count(), SLICE_ROWS, 64))
    base = base.withColumn("h", shuffle_key("id")).withColumn("slice", F.floor(F.conv(F.substring("h", 1, 4), 16, 10).cast("long") * slices / 65536).cast("int"))
    sums = staged(base.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")), "mix-slices")
    totals = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    aim = staged(targets(totals, weights, budget, most_repeats), "mix-targets")
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    begins = staged(
        sums.withColumn("words_before", F.coalesce(F.sum("words").over(ahead), F.lit(0))).withColumn("rows_before", F.coalesce(F.sum("rows").over(ahead), F.lit(0)))
        .join(aim.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "words", "rows"), "mix-begins")
    inside = Window.partitionBy("source", "slice").orderBy("h", "id", "size")
    placed = base.withColumn("cum", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rn", F.row_number().over(inside))
    begins = begins.withColumnsRenamed({"source": "s", "slice": "c"})
    met = placed.join(begins, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("c")))
    ends = (F.col("cum") + F.col("words_before")) / F.col("target")
    return met.select("id", "source", "size", "h", (F.col("rn") + F.col("rows_before")).alias("place"), "source_size", "target", (F.col("cum") + F.col("words_before")).alias("ends"), F.when(F.col("target") > 0, ends).alias("finish"))


def mixture(order: DataFrame, most_repeats: int = 2) -> DataFrame:
    """The copies that the mix takes: ``source, place, copy, h, id, size, finish, total`` (words of the mix up to its end, which is its order).

    ``order`` is a staged result of ``mix_order``.
    """
    slices = min(65536, sized(order.count(), SLICE_ROWS, 64))
    sources = order.groupBy("source").agg(F.max("target").alias("target"))
    most = F.lit(float(sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]))
    copies = order.filter("size > 0").select(
        "id", "h", "source", "place", "size", "target", "source_size", "ends", F.explode(F.sequence(F.lit(1), F.lit(most_repeats))).alias("copy")
    ).filter((F.col("copy") == 1) | (F.col("target") > (F.col("copy") - 1) * F.col("source_size")))
    copies = copies.withColumn("finish", (F.col("ends") + (F.col("copy") - 1) * F.col("source_size")) / F.col("target"))
    copies = copies.withColumn("time", F.least(F.floor(F.col("finish") * slices), F.lit(4 * slices)))
    per = copies.groupBy("time").agg(F.sum("size").alias("words"))
    per = per.withColumn("before", F.coalesce(F.sum("words").over(Window.orderBy("time").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = staged(per.filter(F.col("before") <= most).drop("words"), "mix-time")
    inside = Window.partitionBy("time").orderBy("finish", F.col("source").isNull(), "source", "place", "copy").rowsBetween(Window.unboundedPreceding, 0)
    # slices past the budget leave before anything is put in order
    got = copies.join(per, "time").withColumn("run", F.sum("size").over(inside)).withColumn("total", F.col("run") + F.col("before"))
    return got.filter(F.col("total") - F.col("size") / 2 <= most).select("source", "place", "copy", "h", "id", "size", "finish", "total")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most_repeats: int = 2) -> DataFrame:
    """A row for each document: id, ``size, source_size, target, taken``, and ``copies``, how often the mix takes it."""
    order = staged(mix_order(docs, id_col, words(text_col), source_col, weights, budget, most_repeats), "mix-order")
    taken = mixture(order, most_repeats).groupBy(F.col("source").alias("s"), F.col("place").alias("p")).agg(F.count(F.lit(1)).alias("copies"))
    met = order.join(taken, F.col("source").eqNullSafe(F.col("s")) & (F.col("place") == F.col("p")), "left")
    copies = F.coalesce("copies", F.lit(0).cast("long"))
    return met.select(F.col("id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), F.col("source").alias(source_col))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most_repeats: int = 2) -> DataFrame:
    """The documents of the mix, all columns of ``docs``, each as often as the mix takes it.

    Finish times rise along a source's order, so of each pass over a source the mix takes all up to a last document.  Those are
    a row per source and pass; each document is held against them where it stands, and no text is shuffled.  Rows that are
    equal in id and size share the verdict.
    """
    order = staged(mix_order(docs, id_col, words(text_col), source_col, weights, budget, most_repeats), "mix-order")
    src, last, turn, key = fresh(docs, "mix_source", "mix_last", "mix_turn", "mix_key")
    place = F.struct("h", "id", "size")
    ends = mixture(order, most_repeats).groupBy("source", "copy").agg(F.max(place).alias("end"))
    ends = staged(ends.groupBy(F.col("source").alias(src)).agg(F.collect_list("end").alias(last)), "mix-ends")
    mine = docs.withColumn(key, F.struct(shuffle_key(id_col).alias("h"), F.col(id_col).alias("id"), words(text_col).alias("size")))
    met = mine.join(ends, F.col(source_col).eqNullSafe(F.col(src)))
    copies = F.when(F.col(key)["size"] > 0, F.size(F.filter(F.col(last), lambda e: F.col(key) <= e))).otherwise(0)
    return met.withColumn(turn, copies).filter(F.col(turn) > 0).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(turn)))).select(*docs.columns)


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
             source_size * 2.0::DOUBLE AS most, sum(source_size) OVER () * 1.5::DOUBLE AS words FROM s),
r AS (SELECT *, most / weight AS ratio FROM w),
v AS (SELECT *, (words - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM r),
f AS (SELECT lv AS free_level FROM v WHERE lv <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(most, (SELECT free_level FROM f) * weight), most) AS target FROM v),
o AS (SELECT d.doc_id, d.size, t.source, t.source_size, t.target, row_number() OVER g AS place,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ends
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WINDOW g AS (PARTITION BY d.source ORDER BY h, doc_id, size)),
c AS (SELECT *, 1 AS copy, ends / target AS finish FROM o WHERE size > 0
      UNION ALL SELECT *, 2 AS copy, (ends + source_size) / target AS finish FROM o WHERE size > 0 AND target > source_size),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, place, copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM c),
k AS (SELECT source, place, count(*) AS copies FROM g WHERE total - size / 2.0::DOUBLE <= (SELECT sum(target) FROM t) GROUP BY source, place)
SELECT o.doc_id, o.size, CAST(o.source_size AS BIGINT) AS source_size, o.target, coalesce(k.copies, 0) * o.size AS taken, coalesce(k.copies, 0) AS copies, o.source
FROM o LEFT JOIN k ON o.source IS NOT DISTINCT FROM k.source AND o.place = k.place"""
