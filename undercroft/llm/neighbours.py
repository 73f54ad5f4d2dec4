"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on at most ``SAMPLE`` vectors (those with the least hash of their id), so it and its broadcast
have a bound; every vector is then put in its leaf.  A query walks the tree with a priority queue of nodes by their
centre's cosine and visits leaves in that order.  How many is calibrated: at most ``PROBES`` queries are compared
with every vector, and the number of visits widens until they would have found the share ``recall`` of their neighbours.

Copies of a vector are folded first: of equal vectors only the ``k + 1`` least ids can ever be an answer, and equal
queries are searched once, so a very common vector is a few rows.  Leaves meet their queries in blocks of bounded
size on both sides.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows
without an id, nor vectors whose length is not the most frequent one.  Rows that repeat an id are its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undercroft.llm.common import staged

SAMPLE, PROBES, LEAF_ROWS, MAX_LEAVES, BRANCH, BLOCK, VISITS = 20_000, 200, 400, 4096, 8, 8192, 4096


@dataclass
class Tree:
    """Node 0 is the root; ``children`` of a leaf are empty; ``leaf`` numbers the leaves."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    def place(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each vector: at each node the nearest child."""
        node = np.zeros(len(unit), np.int64)
        while True:
            moved = False
            for n in np.unique(node):
                if self.children[n]:
                    rows = np.flatnonzero(node == n)
                    kids = np.array(self.children[n])
                    node[rows] = kids[(unit[rows] @ self.centres[kids].T).argmax(1)]
                    moved = True
            if not moved:
                return np.array(self.leaf)[node]

    def order(self, unit: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves of a query, best bin first."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, n = heapq.heappop(queue)
            kids = self.children[n]
            if not kids:
                out.append(self.leaf[n])
                continue
            for near, kid in zip(self.centres[kids] @ unit, kids, strict=True):
                heapq.heappush(queue, (-float(near), kid))
        return out


def k_means(unit: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    centres = unit[np.random.default_rng(len(unit)).choice(len(unit), k, replace=False)]
    for _ in range(rounds):
        near = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        length = np.linalg.norm(sums, axis=1)
        centres = sums[length > 0] / length[length > 0, None]
    return centres


def grow(unit: np.ndarray, leaves: int) -> Tree:
    """Splits nodes by k-means until about ``leaves`` leaves stand."""
    centres, children, rows = [np.zeros(unit.shape[1])], [[]], [np.arange(len(unit))]
    todo, count, each = [(-len(unit), 0)], 1, max(4, len(unit) // max(leaves, 1))
    while todo and count < leaves:
        _, n = heapq.heappop(todo)
        k = min(BRANCH, max(2, len(rows[n]) // each))
        if len(rows[n]) <= each or len(rows[n]) < 2 * k:
            continue
        own = unit[rows[n]]
        found = k_means(own, k)
        near = (own @ found.T).argmax(1)
        parts = [p for p in (rows[n][near == j] for j in range(len(found))) if len(p)]
        if len(parts) < 2:
            continue
        for p in parts:
            mean = unit[p].sum(0)
            centres.append(mean / max(np.linalg.norm(mean), 1e-12))
            children.append([])
            rows.append(p)
            children[n].append(len(centres) - 1)
            heapq.heappush(todo, (-len(p), len(centres) - 1))
        count += len(parts) - 1
    leaf, at = [-1] * len(centres), 0
    for n, kids in enumerate(children):
        if not kids:
            leaf[n], at = at, at + 1
    return Tree(np.array(centres), children, leaf)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def matrix(column) -> np.ndarray:
    """Rows of a list column of one length, as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def best(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, id and exact cosine of each query's ``k`` nearest, ties to the smaller id."""
    q_norm, v_norm = np.sqrt((queries * queries).sum(1)), np.sqrt((vectors * vectors).sum(1))
    q_unit, v_unit = queries / q_norm[:, None], vectors / v_norm[:, None]
    rows, cols = [], []
    for at in range(0, len(queries), 256):
        near = q_unit[at:at + 256] @ v_unit.T
        floor = np.partition(near, near.shape[1] - k, 1)[:, near.shape[1] - k] if near.shape[1] > k else near.min(1)
        r, c = np.nonzero(near >= floor[:, None] - 1e-9)
        rows.append(r + at)
        cols.append(c)
    r, c = np.concatenate(rows), np.concatenate(cols)
    score = (queries[r] * vectors[c]).sum(1) / (q_norm[r] * v_norm[c])
    order = np.lexsort((ids[c], -score, r))
    r, c, score = r[order], c[order], score[order]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
    rank = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
    keep = rank < k
    return r[keep], ids[c[keep]], score[keep]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` of the rows that take part."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull()).filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    # a length beyond doubles' range would not be finite
    rows = rows.filter(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).between(1e-290, 1e290))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n").collect()
    return rows.filter(F.size("v") == (common[0][0] if common else 0))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.98) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    first = Window.partitionBy("v").orderBy("id")
    rows = staged(usable(vectors, id_col, vector_col).distinct().withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= k + 1).drop("rn"), "ann-rows")
    asked = staged(usable(vectors.filter(F.col(id_col) % every == 0), id_col, vector_col).distinct(), "ann-asked")
    reps = asked.groupBy("v").agg(F.min("id").alias("rep"))
    count = rows.count()
    out = "query_id long, rank int, vec_id long, score double"
    if not count or not reps.limit(1).count():
        return spark.createDataFrame([], out)

    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    tree = grow(unit_rows(matrix(sample["v"])), min(MAX_LEAVES, -(-count // LEAF_ROWS)))
    leaves = max(tree.leaf) + 1
    held = spark.sparkContext.broadcast((tree.centres, tree.children, tree.leaf))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(*held.value)
        for b in batches:
            if b.num_rows:
                leaf = tree.place(unit_rows(matrix(b.column(1))))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf, pa.int32())], names=["id", "v", "leaf"])

    placed = staged(rows.mapInArrow(place, "id long, v array<double>, leaf int"), "ann-placed")
    visits = calibrated(placed, reps, tree, k + 1, recall, leaves)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(*held.value)
        for b in batches:
            if b.num_rows:
                routes = [tree.order(u, visits) for u in unit_rows(matrix(b.column(0)))]
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array(routes, pa.list_(pa.int32()))], names=["rep", "v", "leaves"])

    routes = staged(reps.mapInArrow(walk, "rep long, v array<double>, leaves array<int>"), "ann-routes")
    sizes = dict(placed.groupBy("leaf").count().collect())  # a row per leaf, MAX_LEAVES at most
    calls = dict(routes.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect())

    def parts(counts: dict, each: int):
        cut = {leaf: -(-n // each) for leaf, n in counts.items() if n > each}
        return F.coalesce(F.create_map(*[F.lit(x) for kv in cut.items() for x in kv])[F.col("leaf")], F.lit(1)) if cut else F.lit(1)

    def spread(n, own: str, name: str, other, other_name: str, df: DataFrame) -> DataFrame:
        """Each row has one block of its own side and is copied to all of the other's."""
        return df.withColumn(name, F.pmod(F.xxhash64(own), n).cast("int")).withColumn(other_name, F.explode(F.sequence(F.lit(0), other.cast("int") - 1)))

    n_rows, n_calls = parts(sizes, BLOCK), parts(calls, VISITS)
    left = spread(n_calls, "rep", "qb", n_rows, "vb", routes.select("rep", "v", F.explode("leaves").alias("leaf")))
    right = spread(n_rows, "id", "vb", n_calls, "qb", placed)

    def search(q: pa.Table, v: pa.Table) -> pa.Table:
        if not q.num_rows or not v.num_rows:
            return pa.table({"rep": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        r, ids, score = best(matrix(q["v"]), matrix(v["v"]), v["id"].to_numpy(), k + 1)
        return pa.table({"rep": pa.array(q["rep"].to_numpy()[r]), "id": pa.array(ids), "score": pa.array(score)})

    keys = ("leaf", "vb", "qb")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "rep long, id long, score double")
    top = found.withColumn("rn", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "id"))).filter(F.col("rn") <= k + 1)
    lists = top.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("rn", "id", "score"))).alias("near"))
    named = asked.join(reps, "v").select("id", "rep")
    own = named.join(lists, "rep").select("id", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    return own.select(F.col("id").alias("query_id"), F.posexplode("near").alias("at", "n")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("vec_id"), F.col("n.score").alias("score"))


def exact_lists(placed: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """``probe, id, score, leaf``: each probe's ``k`` nearest among all rows, by comparing all; probes are few and broadcast."""
    held = placed.sparkSession.sparkContext.broadcast((ids, queries))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, q = held.value
        for b in batches:
            if b.num_rows:
                own, leaf = b.column(0).to_numpy(), b.column(2).to_numpy()
                where = np.arange(len(own))
                r, at, score = best(q, matrix(b.column(1)), where, k)
                yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int64)), pa.array(own[at]), pa.array(score), pa.array(leaf[at])], names=["probe", "id", "score", "leaf"])

    met = placed.mapInArrow(scan, "probe long, id long, score double, leaf int")
    return met.withColumn("rn", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "id"))).filter(F.col("rn") <= k).drop("rn")


def calibrated(placed: DataFrame, reps: DataFrame, tree: Tree, k: int, recall: float, leaves: int) -> int:
    """Visits with which the probes find the wanted share of their nearest."""
    probes = reps.orderBy(F.xxhash64("rep"), "rep").limit(PROBES).toArrow()
    queries = matrix(probes["v"])
    want = exact_lists(placed, probes["rep"].to_numpy(), queries, k).select("probe", "leaf").collect()  # at most PROBES * k rows
    turn = [{leaf: n for n, leaf in enumerate(tree.order(u, leaves), 1)} for u in unit_rows(queries)]
    needed = np.sort([turn[p][leaf] for p, leaf in want])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
