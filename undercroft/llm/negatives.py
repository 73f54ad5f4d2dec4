"""Hard negatives by Kronecker-packed products.

Components are scaled to integers, so scores are exact inner products.  A block of candidates is packed by
dimension: each candidate's component, less the block's least one, is a field of one wide integer, and the fields are
wide enough for any sum.  An anchor multiplies each of these integers once, by its own component less its least
one; no field is negative, so none borrows, and the sum of the products holds every candidate's score.  Two sums take
the shifts out again: ``sum(a x) = fields + b sum(a - a0) + a0 sum(x)``, with ``b`` and ``a0`` the least components.

Anchors are a stated set against all rows, in blocks of both sides.  First every anchor meets the rows of its own label,
and a block gives its best few; the positives so found then meet all rows, and a block gives for each of them the best few
rows of another label inside its band.  Both are merged by anchor.  Copies of a vector under one label are folded
before, to those least ids that could be named: ``positives + 1``, or ``negatives`` if more.

Defined results: rows without an id, a label or a vector, or with a null or non-finite component, take no part.  Of
rows that repeat an id the one with the least label and vector counts.  Vectors meet those of their own length.  A
component is held in 64 bits and so is a score: what lies beyond stands at the end of that range.  Columns other than
the three named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undercroft.llm.common import staged

ROWS, ANCHORS = 4096, 1024
LONG = 1 << 63


def integers(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """Rows of a list column as a matrix of 64-bit integers."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), size)


class Packed:
    """Candidates packed for products with anchors whose components, less their least, are ``reach`` at most."""

    def __init__(self, rows: np.ndarray, reach: int) -> None:
        low, high = (int(rows.min()), int(rows.max())) if rows.size else (0, 0)
        most = (high - low) * reach * rows.shape[1]
        self.rows, self.least, self.width = len(rows), low, 4 if most < 1 << 32 else 8 if most < 1 << 62 else most.bit_length() // 8 + 1
        self.narrow = self.width <= 8 and max(abs(low), abs(high)) * max(1, rows.shape[1]) < 1 << 62
        self.sums = rows.sum(1) if self.narrow else np.array([sum(r) for r in rows.tolist()], object)
        self.packed = [int.from_bytes(self.fields(c), "little") for c in rows.T]

    def fields(self, column: np.ndarray) -> bytes:
        if self.width <= 8:
            return (column - self.least).astype(f"<u{self.width}").tobytes()
        return b"".join((x - self.least).to_bytes(self.width, "little") for x in column.tolist())

    def scores(self, anchor: list[int]) -> np.ndarray:
        """The inner product with every candidate."""
        low = min(anchor, default=0)
        total = sum((a - low) * p for a, p in zip(anchor, self.packed, strict=True) if a != low)
        data = total.to_bytes(self.width * self.rows, "little")
        shift = self.least * (sum(anchor) - low * len(anchor))
        if self.narrow and abs(shift) < 1 << 61 and abs(low) * int(np.abs(self.sums).max(initial=0)) < 1 << 61:
            return np.frombuffer(data, f"<u{self.width}").astype(np.int64) + (low * self.sums + shift)
        fields = [int.from_bytes(data[i:i + self.width], "little") for i in range(0, len(data), self.width)]
        return np.array([held(f + low * int(s) + shift) for f, s in zip(fields, self.sums, strict=True)], np.int64)


def held(score: int) -> int:
    return max(-LONG, min(LONG - 1, score))


def first(scores: np.ndarray, ids: np.ndarray, where: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``where``, the ``k`` with the highest scores, ties by smaller id."""
    if len(where) > 4 * k:
        kth = np.partition(scores[where], len(where) - k)[len(where) - k]
        where = where[scores[where] >= kth]
    return where[np.lexsort((ids[where], ~scores[where]))][:k]


def usable(vectors: DataFrame, id_col: str, label_col: Column, vector_col: str, scale: int) -> DataFrame:
    """``id, label, q``: the rows that take part, components as ``floor(scale * x)``."""
    v = F.col(vector_col)
    fine = v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.filter(F.col(id_col).isNotNull() & label_col.isNotNull() & fine)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), label_col.cast("long").alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "q")).alias("r")).select("id", "r.label", "r.q")


def blocks(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with blocks ``a`` and ``b``, each row in one of its own side and copied to those of the other.

    Every key has as many blocks as it has rows for, so a label with a third of all rows is many groups.
    """
    none, one = F.lit(0).cast("long"), F.count(F.lit(1))
    sizes = left.groupBy(*keys).agg(one.alias("x"), none.alias("y")).union(right.groupBy(*keys).agg(none.alias("x"), one.alias("y")))
    sizes = sizes.groupBy(*keys).agg(F.ceil(F.sum("x") / ANCHORS).cast("int").alias("na"), F.ceil(F.sum("y") / ROWS).cast("int").alias("nb"))
    sizes = staged(sizes.filter("na > 0 AND nb > 0"), "negatives-blocks")

    def spread(df: DataFrame, own: str, other: str) -> DataFrame:
        met = df.join(sizes, keys).withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"n{own}")).cast("int"))
        return met.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1))).drop("na", "nb")

    return spread(left, "a", "b"), spread(right, "b", "a"), [*keys, "a", "b"]


def packed_block(anchors: pa.Table, rows: pa.Table) -> tuple[Packed, np.ndarray, list[list[int]]]:
    """The rows packed, their ids, and the anchors' components."""
    size = anchors["n"][0].as_py()
    own = integers(anchors["q"], size).tolist()
    reach = max(max(a, default=0) - min(a, default=0) for a in own)
    return Packed(integers(rows["q"], size), reach), rows["id"].to_numpy(), own


def longs(rows: list[tuple], names: str) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else ([] for _ in names.split())
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names.split(), columns, strict=True)})


def positives_of(anchors: DataFrame, rows: DataFrame, positives: int) -> DataFrame:
    """``anchor, ids, scores``: each anchor's nearest rows of its label, in order."""
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            packed, ids, own = packed_block(left, right)
            for anchor, q in zip(left["id"].to_pylist(), own, strict=True):
                scores = packed.scores(q)
                found += [(anchor, int(ids[i]), int(scores[i])) for i in first(scores, ids, np.flatnonzero(ids != anchor), positives)]
        return longs(found, "anchor id score")

    a, b, keys = blocks(anchors, rows, ["label", "n"])
    met = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(search, "anchor long, id long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    top = met.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= positives)
    near = top.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rn", "id", "score"))).alias("near"))
    return near.select("anchor", F.col("near.id").alias("ids"), F.col("near.score").alias("scores"))


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, band: tuple[int, int] = (50, 95), scale: int = 256,
                   id_col: str = "vec_id", label_col: str | Column = "label", vector_col: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``.  ``band`` bounds a negative's score, in hundredths of the positive's.
    """
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    fold = Window.partitionBy("q", "label").orderBy("id")
    taking = staged(usable(vectors, id_col, label, vector_col, scale).withColumn("n", F.size("q")), "negatives-all")
    anchors = taking.filter(F.col("id") % every == 0)
    rows = taking.withColumn("rn", F.row_number().over(fold)).filter(F.col("rn") <= max(positives + 1, negatives)).drop("rn")
    rows = staged(rows, "negatives-rows")
    near = positives_of(anchors, rows, positives)
    asked = staged(anchors.join(near, anchors["id"] == near["anchor"]).drop("anchor"), "negatives-asked")
    low, high = band

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            packed, ids, own = packed_block(left, right)
            labels = right["label"].to_numpy()
            for anchor, label, q, named, reached in zip(*(left[c].to_pylist() for c in ("id", "label")), own, *(left[c].to_pylist() for c in ("ids", "scores")), strict=True):
                scores = packed.scores(q)
                bounds = [(held(-(-low * p // 100)), held(high * p // 100)) for p in reached]
                where = np.flatnonzero((labels != label) & (scores >= min(b for b, _ in bounds)) & (scores <= max(t for _, t in bounds)))
                near = scores[where]
                for p, reach, (bottom, top) in zip(named, reached, bounds, strict=True):
                    mine = where[(near >= bottom) & (near <= top)]
                    found += [(anchor, p, int(ids[i]), reach, int(scores[i])) for i in first(scores, ids, mine, negatives)]
        return longs(found, "anchor_id positive_id negative_id positive_score negative_score")

    a, b, keys = blocks(asked, rows, ["n"])
    out = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    met = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(search, out)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    top = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return top.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


NEGATIVES_SQL = """
WITH vectors AS (
    SELECT vec_id, min(struct_pack(label := CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END, q := list_transform(embedding, lambda x: floor(256 * x::DOUBLE)))) AS r
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id
), scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.r.label = r.r.label AS same, CAST(list_dot_product(a.r.q, r.r.q) AS BIGINT) AS score
    FROM vectors a JOIN vectors r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id AND len(a.r.q) = len(r.r.q)
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3"""
