"""SimHash near-dedup with pigeonring filtering.

The 64 bits are nine segments on a ring.  If two fingerprints differ in at most ``TAU`` bits, some segment
starts a chain whose first l segments differ in at most l * TAU / 9 bits, for every l.  So of the first
L segments the differing ones obey these budgets, and the others are equal: the sets of equal segments that
budgets allow, from each start, are the keys under which fingerprints meet.  L grows with the number of
fingerprints (21, 28 or 35 equal bits), which keeps chance meetings in proportion to the input.

A pair that meets is first checked along the chain, budget by budget, then by its full distance.  Only distinct
fingerprints meet, copies having been folded, and a key gives a spanning forest of its links, not its pairs.  A key
with more than ``MOST`` fingerprints is not taken into one task: its fingerprints link through the ball of
radius two around them, since two within four bits share a point within two of both.

Defined results: a null text is empty; an empty one has fingerprint 0, and all of them are one group.  A group's
name is its smallest id, null ids aside (null where it has no other).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undercroft.llm.common import fresh, staged, text_batches
from undercroft.llm.components import components

TAU, SEGMENTS, SEED, MOST = 4, 9, 42, 4096
UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, size: int = 4) -> int:
    """A bit is set where over half of the shingles' XXH64 have it; 0 without words."""
    words = (text or "").encode("utf-8", "replace").translate(UPPER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - size + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    ones = np.zeros(64, np.int64)
    xx = xxhash.xxh64_intdigest
    for at in range(0, n, 65536):
        h = np.array([xx(joined[s:e], SEED) for s, e in zip(starts[at:at + 65536], ends[at:at + 65536], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``id, fp``: the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_batches([whole], "text"):
                known: dict = {}
                prints = np.array([known[t] if t in known else known.setdefault(t, fingerprint(t, size)) for t in b.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(prints.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def segment_masks() -> list[int]:
    """Nine runs of seven bits, the first of eight."""
    widths = [64 // SEGMENTS + (i < 64 % SEGMENTS) for i in range(SEGMENTS)]
    return [((1 << w) - 1) << sum(widths[:i]) for i, w in enumerate(widths)]


def budget(chain: int) -> int:
    return chain * TAU // SEGMENTS


def chain_keys(chain: int) -> list[tuple[int, tuple[int, ...]]]:
    """Start and equal segments of every key: those that chains of this length within their budgets leave equal."""
    out = []
    for differ in combinations(range(chain), budget(chain)):
        if all(sum(d < part for d in differ) <= budget(part) for part in range(1, chain + 1)):
            equal = [k for k in range(chain) if k not in differ]
            out += [(start, tuple((start + k) % SEGMENTS for k in equal)) for start in range(SEGMENTS)]
    return out


def chain_for(rows: int) -> int:
    """The shortest chain with at most one chance meeting a fingerprint."""
    for chain in (4, 6):
        keys = chain_keys(chain)
        bits = 64 * len(keys[0][1]) / SEGMENTS
        if len(keys) * rows <= 2 ** (bits + 1):
            return chain
    return 8


def within(x: np.ndarray, y: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Whether pairs hold every budget along the chain from their start, and then the full distance."""
    masks = np.array(segment_masks(), np.uint64)
    differ, alive, total = x ^ y, np.ones(len(x), bool), np.zeros(len(x), np.int64)
    at = np.broadcast_to(np.asarray(start), x.shape)
    for k in range(SEGMENTS):
        live = np.flatnonzero(alive)
        if not len(live):
            break
        total[live] += np.bitwise_count(differ[live] & masks[(at[live] + k) % SEGMENTS])
        alive[live] = total[live] <= budget(k + 1)
    return alive & (np.bitwise_count(differ) <= TAU)


def forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links in a bounded group: each new fingerprint joins where it was first reached."""
    todo, heads, tails = prints.copy(), [], []
    front = todo[:0]
    while len(todo) or len(front):
        if not len(front):
            front, todo = todo[:1], todo[1:]
        rows, front = front[:256], front[256:]
        near = np.bitwise_count(rows[:, None] ^ todo[None, :]) <= TAU
        got = near.any(0)
        if got.any():
            heads.append(rows[near[:, got].argmax(0)])
            tails.append(todo[got])
            front, todo = np.r_[front, todo[got]], todo[~got]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(heads), np.concatenate(tails)) if heads else (none, none)


def links(prints: DataFrame, rows: int, most: int = MOST) -> DataFrame:
    """``a, b``: links that connect the distinct fingerprints ``fp`` just as all pairs within ``TAU`` bits do."""
    keys, masks = chain_keys(chain_for(rows)), segment_masks()
    starts = np.array([s for s, _ in keys])

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    entries = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(sum(masks[e] for e in equal)))).alias("key")) for k, (_, equal) in enumerate(keys)])
    spread = prints.select("fp", F.explode(entries).alias("e")).select("e.t", "e.key", "fp")
    spread = spread.repartition("t", "key").sortWithinPartitions("t", "key", "fp")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            other = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), other], names=["a", "b"])

        def small(fp: np.ndarray, group: np.ndarray, table: np.ndarray, most_rows: int) -> Iterator[pa.RecordBatch]:
            for step in range(1, most_rows):
                same = np.flatnonzero(group[step:] == group[:-step])
                if not len(same):
                    return
                hit = same[within(fp[same], fp[same + step], starts[table[same]])]
                if len(hit):
                    yield out(fp[hit], fp[hit + step])

        def closed(t: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole groups."""
            if not len(t):
                return
            first = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
            size = np.diff(np.r_[first, len(t)])
            group, mine = np.repeat(np.arange(len(first)), size), np.repeat(size, size)
            few = (mine > 1) & (mine <= 16)
            yield from small(fp[few], group[few], t[few], 16)
            for k in np.flatnonzero(size > 16):
                part = fp[first[k]:first[k] + size[k]]
                if size[k] > most:
                    yield out(part, None)
                else:
                    a, b = forest(part)
                    if len(a):
                        yield out(a, b)

        held: list[tuple] = []
        count, hot = 0, None
        for batch in batches:
            t, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fp = fp.view(np.uint64)
            if hot is not None:  # the rest of a key that was too large goes on
                rest = (t == hot[0]) & (key == hot[1])
                if rest.any():
                    yield out(fp[rest], None)
                t, key, fp = t[~rest], key[~rest], fp[~rest]
                if not len(t):
                    continue
                hot = None
            if not len(t):
                continue
            held.append((t, key, fp))
            count += len(t)
            t, key, fp = (np.concatenate(c) for c in zip(*held, strict=True))
            last = int(np.flatnonzero((t != t[-1]) | (key != key[-1]))[-1]) + 1 if ((t != t[-1]) | (key != key[-1])).any() else 0
            yield from closed(t[:last], key[:last], fp[:last])
            if len(t) - last > most:
                yield out(fp[last:], None)
                hot, held, count = (t[-1], key[-1]), [], 0
            else:
                held, count = [(t[last:], key[last:], fp[last:])], len(t) - last
        if count:
            yield from closed(*held[0])

    met = staged(spread.mapInArrow(meet, "a long, b long"), "simhash-links")
    return met.filter("b IS NOT NULL").union(ball_links(met.filter("b IS NULL").select("a").distinct()))


def ball_links(hot: DataFrame) -> DataFrame:
    """Links of fingerprints through the points within two bits of them: everyone at a point joins its least one."""
    one = [F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)]]
    flips = F.array(*one)
    first = hot.select("a", F.explode(F.transform(flips, lambda m: F.col("a").bitwiseXOR(m))).alias("p"))
    points = first.select("a", F.explode(F.transform(flips, lambda m: F.col("p").bitwiseXOR(m))).alias("p")).distinct()
    least = points.groupBy("p").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return points.join(least, "p").filter("a <> b").select("a", "b").distinct()


def near_groups(prints: DataFrame, most: int = MOST) -> DataFrame:
    """``fp, component_id``: the smallest id reachable from each distinct fingerprint of ``id, fp``."""
    distinct = staged(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    linked = components(links(distinct.select("fp"), distinct.count(), most)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = staged(distinct.join(linked, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(names, "root").select("fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, most: int = MOST) -> DataFrame:
    """Every row with ``fingerprint`` (16 hex digits) and ``component_id``."""
    prints = staged(with_fingerprint(docs, id_col, text_col, size), "simhash")
    groups = staged(near_groups(prints, most), "simhash-groups")
    return prints.join(groups, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, most: int = MOST) -> DataFrame:
    """One row of ``docs`` for each group, the one with its smallest id, all columns.

    What goes is taken out, being less than what stays.  Rows that share an id stay if one of them does.
    """
    prints = staged(with_fingerprint(docs, id_col, text_col, size), "simhash")
    groups = staged(near_groups(prints, most), "simhash-groups")
    own, = fresh(docs, "gone_id")
    stays = F.col("id").eqNullSafe(F.col("component_id"))
    gone = prints.join(groups, "fp").groupBy("id").agg(F.max(stays).alias("stays")).filter("NOT stays")
    gone = staged(gone.select(F.col("id").alias(own)), "simhash-gone")
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col(own)), "left_anti")
