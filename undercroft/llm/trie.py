"""Prefix trie of conversations by vertical bitmaps.

Conversations are sorted by their first ``KEY`` turns, then by id, and range-partitioned in that order; a partition is cut
into shards of at most ``SHARD`` conversations or ``TURNS`` turns.  A shard indexes (position, turn) to a bitset of its
conversations, numbered by id.  From the root a node's bitset is taken apart depth first: the lowest conversation left
names the next turn, the intersection with that turn's posting is the child, and so on until no bit is left.  Popcounts are
the members, the lowest bit is the least id, and the bits of conversations that end here are the shard's end list.

A node that one shard holds alone is whole, with all below it.  Nodes of several shards (the root, what lies across a
border, a prefix too common for a shard) are the spine: their counts are added, and sums over their subtrees are
composed by doubling, each round adding what lies 1, 2, 4, ... steps below.  A turn common to any share of the
conversations is thus many shards, and their rows for a node are summed before they are shuffled.

Turns are told apart by 128 bits of the SHA-256 of role and text, nodes by 128 bits of the SHA-256 of the chain of turns.

Defined results: a null role or text is empty.  Turns are ordered by number, null first, those that share one by their
digest; repeated rows are turns of their own.  Rows without a conversation id take no part.  A conversation without turns
ends at the root.  Without conversations there is no node.  One conversation's turns are one row, whatever its length;
only the columns named are read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undercroft.llm.common import staged, text_of

KEY, SHARD, TURNS = 8, 4096, 65_536

PART = pa.schema([("path", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("bytes", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("parent_low", pa.int64()),
                  ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.list_(pa.int64()))])
PART_DDL = "path binary, parent binary, depth long, bytes long, n long, low long, parent_low long, children long, leaves long, saved long, ends array<long>"


def ordered_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``c, pos, turn, bytes``: the digest and size of each turn, positions from 0."""
    role, text = text_of(role_col), text_of(text_col)
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    slim = conversations.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("c"), F.col(turn_col).alias("number"), digest.alias("turn"), F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("c").orderBy(F.col("number").asc_nulls_first(), "turn")
    return slim.select("c", (F.row_number().over(order) - 1).cast("long").alias("pos"), "turn", "bytes")


def sequences(turns: DataFrame) -> DataFrame:
    """``c, turns``: one row for each conversation, its turns in order as (turn, bytes)."""
    lists = turns.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("pos", "turn", "bytes"))).alias("t"))
    return lists.select("c", F.transform("t", lambda x: F.struct(x["turn"].alias("turn"), x["bytes"].alias("bytes"))).alias("turns"))


def branches(turns: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """``c, turns`` of conversations rebuilt from the head of their family.

    Conversation ``c`` begins with the first ``h`` turns of ``c - c % family`` (all if fewer, none if that is absent), then
    follow its own after its first ``h``; ``h`` is the unsigned CRC-32 of the decimal id modulo ``heads``.
    """
    turns = staged(turns, "trie-turns")
    held = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    first = held.select(F.col("c").alias("lead"), F.col("n").alias("lead_n"))
    convs = held.select("c", (F.col("c") - F.col("c") % family).alias("lead"), (F.crc32(F.col("c").cast("string")) % heads).alias("h"))
    convs = staged(convs.join(first, "lead", "left").withColumn("m", F.least("h", F.coalesce("lead_n", F.lit(0)))), "trie-families")
    head = turns.filter(F.col("pos") < heads - 1).select(F.col("c").alias("lead"), "pos", "turn", "bytes")
    taken = convs.select("c", "lead", "h").join(head, "lead").filter("pos < h").select("c", "pos", "turn", "bytes")
    own = turns.join(convs.select("c", "h", "m"), "c").filter("pos >= h").select("c", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "turn", "bytes")
    none = F.array().cast("array<struct<turn:binary,bytes:bigint>>")
    return convs.select("c").join(sequences(taken.union(own)), "c", "left").select("c", F.coalesce("turns", none).alias("turns"))


def shard_nodes(ids: list[int], turns: list[list[bytes]], sizes: list[list[int]]) -> Iterator[list]:
    """The rows of a shard's trie, columns as in ``PART``; a parent comes before its children."""
    order = sorted(range(len(ids)), key=ids.__getitem__)
    ids, turns, sizes = ([x[i] for i in order] for x in (ids, turns, sizes))
    postings: list[dict[bytes, int]] = []
    ending: dict[int, int] = defaultdict(int)
    for i, seq in enumerate(turns):
        bit = 1 << i
        ending[len(seq)] |= bit
        while len(postings) < len(seq):
            postings.append(defaultdict(int))
        for d, turn in enumerate(seq):
            postings[d][turn] |= bit

    def lowest(bits: int) -> int:
        return (bits & -bits).bit_length() - 1

    nodes: list[list] = []
    above: list[int] = []  # the place of each node's parent
    todo = [((1 << len(ids)) - 1, 0, b"", None, 0, -1)]
    while todo:
        bits, depth, path, parent, size, up = todo.pop()
        ends, here = bits & ending.get(depth, 0), len(nodes)
        rest, low, n = bits ^ ends, ids[lowest(bits)], bits.bit_count()
        ended = []
        while ends:
            at = lowest(ends)
            ended.append(ids[at])
            ends ^= 1 << at
        children = 0
        while rest:
            at = lowest(rest)
            turn = turns[at][depth]
            child = rest & postings[depth][turn]
            rest ^= child
            children += 1
            todo.append((child, depth + 1, hashlib.sha256(path + turn).digest()[:16], path, sizes[at][depth], here))
        above.append(up)
        nodes.append([path, parent, depth, size, n, low, nodes[up][5] if up >= 0 else None, children, int(not children), (n - 1) * size, ended])
    for here in range(len(nodes) - 1, 0, -1):
        nodes[above[here]][8] += nodes[here][8]
        nodes[above[here]][9] += nodes[here][9]
    yield from nodes


def shard_rows(batches: Iterator[pa.RecordBatch], shard: int) -> Iterator[pa.RecordBatch]:
    """Cuts sorted conversations into shards and gives the rows of each."""
    held: tuple[list, list, list] = ([], [], [])
    count = 0

    def flush() -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        for row in shard_nodes(*held):
            rows.append(row)
            if len(rows) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PART, strict=True)], schema=PART)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PART, strict=True)], schema=PART)

    for b in batches:
        for c, turns in zip(b.column("c").to_pylist(), b.column("turns").to_pylist(), strict=True):
            for part, value in zip(held, (c, [t["turn"] for t in turns], [t["bytes"] for t in turns]), strict=True):
                part.append(value)
            count += len(turns)
            if len(held[0]) >= shard or count >= TURNS:
                yield from flush()
                held, count = ([], [], []), 0
    if held[0]:
        yield from flush()


@dataclass
class Trie:
    """``parts``: a row for each shard and node, with the shard's end list; ``spine``: the nodes of several shards, with ``n`` and ``low``."""

    parts: DataFrame
    spine: DataFrame


def prefix_trie(conversations: DataFrame, shard: int = SHARD) -> Trie:
    """The trie of ``c, turns``."""
    key = F.transform(F.slice("turns", 1, KEY), lambda t: t["turn"])
    inputs = staged(conversations.withColumn("key", key), "trie-conversations")
    parts = inputs.repartitionByRange("key", "c").sortWithinPartitions("key", "c").select("c", "turns").mapInArrow(lambda batches: shard_rows(batches, shard), PART_DDL)
    parts = staged(parts, "trie-parts")
    spine = parts.groupBy("path", "parent", "depth", "bytes").agg(F.count(F.lit(1)).alias("shards"), F.sum("n").alias("n"), F.min("low").alias("low"))
    return Trie(parts, staged(spine.filter("shards > 1").drop("shards"), "trie-spine"))


def subtree_sums(trie: Trie, tops: DataFrame) -> DataFrame:
    """``path, children, leaves, saved`` of the spine; ``tops`` are whole nodes right under it."""
    spine = trie.spine
    under = tops.groupBy("parent").agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    zero = F.lit(0).cast("long")
    also = spine.filter("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("children")).select("parent", "children", zero.alias("leaves"), zero.alias("saved"))
    under = under.union(also).groupBy(F.col("parent").alias("path")).agg(F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    now = spine.join(under, "path", "left").select(
        "path", F.col("parent").alias("jump"), F.coalesce("children", zero).alias("children"),
        F.when(F.coalesce("children", zero) == 0, 1).otherwise(F.col("leaves")).cast("long").alias("leaves"),
        ((F.col("n") - 1) * F.col("bytes") + F.coalesce("saved", zero)).alias("saved"))
    now = staged(now, "trie-sums")
    deepest = spine.agg(F.max("depth")).first()[0] or 0
    for _ in range(deepest.bit_length()):
        below = now.filter("jump IS NOT NULL").groupBy(F.col("jump").alias("path")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        further = now.select(F.col("path").alias("jump"), F.col("jump").alias("next"))
        now = staged(now.join(below, "path", "left").join(further, "jump", "left").select(
            "path", F.col("next").alias("jump"), "children", (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved")), "trie-sums")
    return now.select("path", "children", "leaves", "saved")


def nodes(trie: Trie) -> DataFrame:
    """``path, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens`` and, of whole nodes, ``ends``."""
    low = trie.spine.select(F.col("path").alias("parent"), F.col("low").alias("spine_low"))
    whole = trie.parts.join(trie.spine.select("path"), "path", "left_anti").join(low, "parent", "left")
    sums = subtree_sums(trie, whole.filter("spine_low IS NOT NULL"))
    whole = whole.select("path", "parent", F.col("low").alias("conv_id"), "depth", F.coalesce("spine_low", "parent_low").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                         F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends")
    own = trie.spine.join(sums, "path").join(low, "parent", "left")
    return whole.union(own.select("path", "parent", F.col("low").alias("conv_id"), "depth", F.col("spine_low").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                                  F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.lit(None).cast("array<long>").alias("ends")))


def spine_digests(trie: Trie) -> DataFrame:
    """``path, sha``: SHA-256 of the end lists of the spine, ids ascending and comma-joined.

    A node's lists are of one sort key, so those of its shards follow each other; they are read in order, and no more than one is held.
    """
    lists = trie.parts.filter(F.size("ends") > 0).select("path", "ends").join(trie.spine.select("path"), "path", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, digest = None, None
        for b in batches:
            done = []
            for own, ends in zip(b.column("path").to_pylist(), b.column("ends").to_pylist(), strict=True):
                text = ",".join(map(str, ends)).encode()
                if own == path:
                    digest.update(b"," + text)
                    continue
                if path is not None:
                    done.append((path, digest.hexdigest()))
                path, digest = own, hashlib.sha256(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "sha"])
        if path is not None:
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest.hexdigest()])], names=["path", "sha"])

    ordered = lists.withColumn("from", F.element_at("ends", 1)).repartition("path").sortWithinPartitions("path", "from")
    return ordered.select("path", "ends").mapInArrow(run, "path binary, sha string")


def node_digests(trie: Trie) -> DataFrame:
    """The nodes with ``ends_sha256`` in place of paths and lists."""
    spine = spine_digests(trie)
    own = F.sha2(F.array_join(F.transform("ends", lambda x: x.cast("string")), ","), 256)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return nodes(trie).join(spine, "path", "left").select(*columns, F.coalesce(own, "sha", nothing).alias("ends_sha256"))


TRIE_SQL = """
WITH rows AS (
    SELECT conv_id AS c, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS digest, strlen(coalesce(text, '')) AS bytes
    FROM conversations WHERE conv_id IS NOT NULL
), turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) - 1 AS pos, digest, bytes FROM rows),
convs AS (
    SELECT c, count(*) AS n, c - c % 5 AS lead,
           xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
               lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384)))) % 9 AS h
    FROM turns GROUP BY c
), rebuilt AS (
    SELECT v.c, t.pos, digest, bytes FROM convs v JOIN turns t ON t.c = v.lead AND t.pos < v.h
    UNION ALL
    SELECT t.c, t.pos - v.h + least(v.h, coalesce(l.n, 0)), digest, bytes FROM turns t JOIN convs v ON v.c = t.c LEFT JOIN convs l ON l.c = v.lead WHERE t.pos >= v.h
), prefixes AS (
    SELECT c, pos + 1 AS d, string_agg(digest, '') OVER (PARTITION BY c ORDER BY pos) AS path, bytes FROM rebuilt
    UNION ALL SELECT c, 0, '', 0 FROM convs
), members AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS last FROM prefixes),
nodes AS (
    SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS own, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256
    FROM members GROUP BY path, d
), linked AS (
    SELECT x.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.d = x.d + 1 AND starts_with(k.path, x.path)) AS n_children
    FROM nodes x LEFT JOIN nodes u ON u.d = x.d - 1 AND u.path = left(x.path, greatest(length(x.path) - 32, 0))
), sums AS (
    SELECT p.path, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(u.own) AS saved_tokens FROM linked u JOIN members p ON p.c = u.conv_id AND p.d <= u.d GROUP BY p.path
)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM linked JOIN sums USING (path)"""
