"""Exact dedup: counting quotient filters find fingerprints that repeat, bytes decide.

1. One pass over the texts leaves a slim table: id, fingerprint, SHA-256 of the normalised text.
2. Each partition of it builds counting quotient filters, one for each slab of the fingerprint
   space; filters of a slab are merged by their sorted remainders.  Copies inside a partition
   travel as one remainder and a count, so a hot text costs one entry a partition.
3. Only texts whose fingerprint counts more than one are routed on, and they are grouped by
   their bytes, with partial aggregation before the shuffle.
4. The slim table meets the groups on the SHA-256 of the verified bytes.

Defined results: a null text is an empty text.  A null id comes after every other id; where a
group has null ids only, its rows are one document.  Rows that repeat an id with an equal text are
the same document: they share the verdict, count towards ``group_size``, and ``drop_copies`` leaves one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undercroft.llm import quotient
from undercroft.llm.common import SPACE, fresh, sized, staged, text_of

#: Fingerprints a merged filter holds on average; fingerprints a task holds before it writes filters.
SLAB_ROWS, FLUSH = 200_000, 4_000_000


def normalised(text: str) -> Column:
    """Each run of ASCII white space as one space."""
    return F.regexp_replace(text_of(text), SPACE, " ")


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """``fp`` and count ``n`` of the fingerprints that occur more than once in column ``fp``."""
    slab_bits = max(5, (sized(rows, SLAB_ROWS) - 1).bit_length())
    out = pa.schema([("slab", pa.int64()), ("filter", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            pairs = list(quotient.filters_of(np.concatenate(held), slab_bits)) if held else []
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in pairs], pa.int64()), pa.array([f for _, f in pairs], pa.binary())], schema=out)

        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += b.num_rows
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        yield from flush()

    def many(filters: list[bytes]) -> Iterator[pa.RecordBatch]:
        if filters:
            found, counts, _, _ = quotient.decode(quotient.merge(filters))
            more = counts > 1
            yield pa.RecordBatch.from_arrays([pa.array(found[more].view(np.int64)), pa.array(counts[more])], names=["fp", "n"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, held, size = None, [], 0
        for b in batches:
            for s, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if s != slab:
                    yield from many(held)
                    slab, held, size = s, [], 0
                held.append(f)
                size += len(f)
                if size > 32_000_000:  # filters of many partitions: fold what has come
                    held, size = [quotient.merge(held)], 0
        yield from many(held)

    filters = prints.select("fp").mapInArrow(build, "slab long, filter binary")
    return filters.repartition("slab").sortWithinPartitions("slab").mapInArrow(meet, "fp long, n long")


def slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("t")).select("id", F.xxhash64("t").alias("fp"), F.sha2("t", 256).alias("sha"))


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: DataFrame | None = None) -> DataFrame:
    """``sha, keep_id, group_size`` of every text that occurs more than once."""
    base = staged(slim(docs, id_col, text_col), "exact") if base is None else base
    repeated = staged(repeated_fingerprints(base, base.count()), "exact-fp").select("fp")
    texts = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("t")).withColumn("fp", F.xxhash64("t"))
    return (
        texts.join(repeated, "fp", "left_semi")
        .groupBy("t").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1").select(F.sha2("t", 256).alias("sha"), "keep_id", "group_size")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: the id, ``keep_id, group_size, kept, text_sha256``."""
    base = staged(slim(docs, id_col, text_col), "exact")
    groups = staged(copy_groups(docs, id_col, text_col, base), "exact-groups")
    alone = F.col("group_size").isNull()
    return base.join(groups, "sha", "left").select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all their columns; of rows that repeat an id and a text, one.

    Texts move once: to the repeated fingerprints, by a sort-merge join at every size.  Those that meet one are folded by
    their bytes, before the shuffle and after it, to the row with the least id.
    """
    base = staged(slim(docs, id_col, text_col), "exact")
    fp, again, norm = fresh(docs, "fp", "again", "norm")
    repeated = staged(repeated_fingerprints(base.select("fp"), base.count()), "exact-fp").select(F.col("fp").alias(fp), F.lit(True).alias(again))
    met = docs.withColumn(fp, F.xxhash64(normalised(text_col))).join(repeated.hint("merge"), fp, "left")
    once = met.filter(F.col(again).isNull()).select(*docs.columns)
    own = [f"c{i}" for i in range(len(docs.columns))]
    row = F.struct(*[F.col(c).alias(o) for c, o in zip(docs.columns, own, strict=True)])
    first = met.filter(F.col(again)).groupBy(normalised(text_col).alias(norm)).agg(F.min_by(row, F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"))).alias("row"))
    return once.union(first.select(*[F.col("row")[o].alias(c) for o, c in zip(own, docs.columns, strict=True)]))


COPIES_SQL = r"""
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW w AS (PARTITION BY t ORDER BY doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
