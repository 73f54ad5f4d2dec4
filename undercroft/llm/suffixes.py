"""Suffix-array dedup: bytes covered by a string of ``LEAST`` bytes that also starts elsewhere.

**Where to look.** Every window of ``LEAST`` bytes has an anchor: the run of ``GRAM`` bytes in it with the least hash,
the first of equals.  Equal windows have equal anchors at equal places, so they meet under the anchor's hash.  An
anchor owns a row of windows; they and their bytes are its context.  Anchors that occur once are done with, and so are those
whose contexts are all one: each of its windows repeats.  Only anchors with several contexts are searched, each context once.

**Search.** Contexts of whole anchors are joined into local texts of bounded size.  Of such a text the Burrows-Wheeler
transform is taken, and intervals of rows with a common prefix are extended backward, breadth first: a level handles
prefixes one byte longer and settles the borders where the common prefix of neighbours has just that length.  It stops
at ``LEAST``; neighbours whose border is not settled by then share at least that many bytes.

**Large anchors.** One with more than ``MOST`` bytes of contexts is never in one task: its windows are counted by a 128-bit
digest, with partial aggregation, which gives the same windows.

UTF-8 has no byte 255, so it parts the contexts.  Defined results: a null text is empty; texts shorter than ``LEAST``
keep every byte; rows that repeat an id and a text repeat each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undercroft.llm.common import staged, text_batches, text_of
from undercroft.llm.hashing import Spans
from undercroft.llm.passages import remove

LEAST, GRAM, MOST, LOCAL, BREAK = 400, 160, 8_000_000, 2_000_000, 255
#: Bytes of one document looked at at once.
PIECE = 4_000_000


# --- anchors ---


def anchors(data: np.ndarray, last: np.ndarray, first: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, first window, number of windows and document of every anchor in a buffer of documents."""
    none = np.zeros(0, np.int64)
    n = len(data) - least + 1
    if n <= 0:
        return none.view(np.uint64), none, none, none
    width = least - gram + 1
    hashes = Spans(data).grams(gram)
    # the hash's upper 40 bits, then the place: the least key is the first of the least hashes
    keys = np.full(-(-len(hashes) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    keys[:len(hashes)] = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    rows = keys.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:n], ahead[width - 1:width - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
    place = np.arange(n)
    doc = np.searchsorted(first, place, side="right") - 1
    whole = np.flatnonzero(place + least <= last[doc])
    if not len(whole):
        return none.view(np.uint64), none, none, none
    at, doc = at[whole], doc[whole]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    return hashes[at[new]], whole[new], np.diff(np.r_[new, len(whole)]), doc[new]


def pieces(raw: list[bytes], least: int) -> Iterator[tuple[bytes, list[int], list[int], list[int]]]:
    """Buffers of documents, or of overlapping pieces of a long one: bytes, first, last, and number of documents and offsets."""
    held, owner, offset, size = [], [], [], 0
    for i, r in enumerate(raw):
        for at in range(0, max(1, len(r) - least + 1), PIECE):
            held.append(r[at:at + PIECE + least - 1])
            owner.append(i)
            offset.append(at)
            size += len(held[-1])
            if size >= PIECE:
                yield b"".join(held), [len(h) for h in held], owner, offset
                held, owner, offset, size = [], [], [], 0
    if held:
        yield b"".join(held), [len(h) for h in held], owner, offset


def read(docs: DataFrame, id_col: str, text_col: str, least: int, gram: int) -> DataFrame:
    """``id, th, n_bytes, sha`` and ``anchors``: hash ``g``, context hash ``c``, first window ``lo``, windows ``n``."""
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.struct([("g", pa.int64()), ("c", pa.int64()), ("lo", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_batches([whole], "text", 2_000_000):
                raw = [(t or "").encode("utf-8", "replace") for t in b.column("text").to_pylist()]
                found, counts = [], np.zeros(len(raw), np.int64)
                for buffer, sizes, owner, offset in pieces(raw, least):
                    last = np.cumsum(sizes)
                    first = last - sizes
                    g, lo, n, doc = anchors(np.frombuffer(buffer, np.uint8), last, first, least, gram)
                    c = [xxhash.xxh3_64_intdigest(buffer[x:x + k + least - 1]) for x, k in zip(lo.tolist(), n.tolist(), strict=True)]
                    own, moved = np.array(owner)[doc], np.array(offset)[doc] - first[doc]
                    counts += np.bincount(own, minlength=len(raw))
                    found.append((g.view(np.int64), np.array(c, np.uint64).view(np.int64), lo + moved, n.astype(np.int32)))
                columns = [pa.array(np.concatenate(x)) if found else pa.array([], t.type) for x, t in zip(zip(*found, strict=True), item, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.StructArray.from_arrays(columns, fields=list(item)))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array([len(r) for r in raw], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw]), lists], names=["id", "th", "n_bytes", "sha", "anchors"])

    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("th"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {kind}, th long, n_bytes long, sha string, anchors array<struct<g:long,c:long,lo:long,n:int>>")


# --- local texts ---


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by at least their first ``depth`` bytes; the end is greater than any byte."""
    n = len(text)
    padded = np.r_[text, np.full(8, BREAK, np.uint8)].astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k:k + n]
    order = np.argsort(key)
    key = key[order]
    head = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = n
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = 8
    while h < depth:
        open_ = np.flatnonzero(~(head & np.r_[head[1:], True]))  # slots of groups of two or more
        if not len(open_):
            break
        at = order[open_]
        key = (rank[at] << 32) | rank[np.minimum(at + h, n)]
        new = np.argsort(key)
        key, at = key[new], at[new]
        order[open_] = at
        head[open_] |= np.r_[True, key[1:] != key[:-1]]
        rank[at] = np.maximum.accumulate(np.where(head[open_], open_, 0))
        h *= 2
    return order


def settled_borders(bwt: np.ndarray, least: int) -> np.ndarray:
    """Whether the common prefix of rows i - 1 and i is shorter than ``least``, for i from 1.

    Intervals [lb, rb) of level l hold the rows that begin with one string of l bytes.  Each byte c before its rows gives the
    interval of the string that c extends; the border behind it has a common prefix of l bytes unless it is settled already.
    """
    n = len(bwt)
    by_byte = np.argsort(bwt, kind="stable").astype(np.int32)
    lf = np.empty(n, np.int32)
    lf[by_byte] = np.arange(n, dtype=np.int32)
    begins = np.r_[0, np.cumsum(np.bincount(bwt, minlength=257))]
    before, behind = np.full(n, -1, np.int32), np.full(n, n, np.int32)  # the row of the same byte before and behind
    same = bwt[by_byte[1:]] == bwt[by_byte[:-1]]
    before[by_byte[1:][same]], behind[by_byte[:-1][same]] = by_byte[:-1][same], by_byte[1:][same]
    present = np.flatnonzero(np.diff(begins))
    done = np.zeros(n + 1, bool)
    done[0] = done[n] = True
    lb, rb = np.array([0], np.int64), np.array([n], np.int64)
    for _ in range(least):
        if not len(lb):
            break
        size = rb - lb
        one = lb[size == 1]
        starts, ends = [lf[one]], [lf[one] + 1]
        mid = (size > 1) & (size <= 8192)
        if mid.any():
            a, b, s = lb[mid], rb[mid], size[mid]
            shift = np.r_[0, np.cumsum(s)[:-1]]
            rows = np.arange(s.sum()) + np.repeat(a - shift, s)
            which = np.repeat(np.arange(len(a)), s)
            first, last = before[rows] < a[which], behind[rows] >= b[which]
            x, y = which[first] * n + lf[rows[first]], which[last] * n + lf[rows[last]]
            x.sort()
            y.sort()
            starts.append(x % n)
            ends.append(y % n + 1)
        for c in present if (size > 8192).any() else ():
            rows = by_byte[begins[c]:begins[c + 1]]
            a, b = np.searchsorted(rows, lb[size > 8192]), np.searchsorted(rows, rb[size > 8192])
            starts.append(begins[c] + a[b > a])
            ends.append(begins[c] + b[b > a])
        lb, rb = np.concatenate(starts).astype(np.int64), np.concatenate(ends).astype(np.int64)
        new = ~done[rb]
        lb, rb = lb[new], rb[new]
        done[rb] = True
    return done[1:n]


def repeated_starts(text: np.ndarray, least: int) -> np.ndarray:
    """Whether the ``least`` bytes (breaks are bytes too) that start at each place of the text also start at another."""
    n, out = len(text), np.zeros(len(text), bool)
    if n < 2:
        return out
    order = np.r_[suffix_order(text, least), n]  # the end is a row of its own, greater than all
    shared = ~settled_borders(np.where(order > 0, text[order - 1], np.int16(256)).astype(np.int16), least)
    out[order[np.flatnonzero(np.r_[shared, False] | np.r_[False, shared])]] = True
    return out


def runs(mark: np.ndarray) -> list[dict]:
    step = np.diff(np.r_[0, mark.astype(np.int8), 0])
    return [{"a": int(a), "b": int(b)} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]


RANGES = "g long, c long, ranges array<struct<a:int,b:int>>"
RANGE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def search(contexts: DataFrame, least: int, local: int) -> DataFrame:
    """``g, c, ranges``: which windows of each context (``g, c, n, raw``) also stand in another of its anchor."""

    def local_text(rows: list[tuple]) -> pa.RecordBatch:
        text = np.frombuffer(b"".join(r[3] + b"\xff" for r in rows), np.uint8)
        mark = repeated_starts(text, least)
        at, ranges = 0, []
        for _, _, n, raw in rows:
            ranges.append(runs(mark[at:at + n]))
            at += len(raw) + 1
        keep = [i for i, r in enumerate(ranges) if r]
        return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in keep], pa.int64()), pa.array([rows[i][1] for i in keep], pa.int64()), pa.array([ranges[i] for i in keep], RANGE)], names=["g", "c", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, before = [], 0, None
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if size >= local and row[0] != before:  # anchors stay whole
                    yield local_text(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
                before = row[0]
        if held:
            yield local_text(held)

    return contexts.select("g", "c", "n", "raw").repartition("g").sortWithinPartitions("g").mapInArrow(run, RANGES)


def count_windows(contexts: DataFrame, least: int) -> DataFrame:
    """The same by counting digests of windows over all contexts of too large anchors."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, c, n, raw in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                digest = [xxhash.xxh3_128_digest(raw[k:k + least]) for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([g] * n), pa.array([c] * n), pa.array(range(n), pa.int32()), pa.array(digest, pa.binary())], names=["g", "c", "k", "digest"])

    rows = contexts.select("g", "c", "n", "raw").mapInArrow(windows, "g long, c long, k int, digest binary")
    many = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("digest")
    met = rows.join(many, "digest").groupBy("g", "c").agg(F.collect_list(F.struct(F.col("k").alias("a"), (F.col("k") + 1).alias("b"))).alias("ranges"))
    return met.select("g", "c", "ranges")


# --- the operator ---


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM, most: int = MOST, local: int = LOCAL) -> DataFrame:
    """Every row: id, ``n_bytes, n_removed, n_spans`` and ``kept_sha256``."""
    slim = staged(read(docs, id_col, text_col, least, gram), "suffix")
    rows = slim.select("id", "th", F.explode("anchors").alias("x")).select("id", "th", "x.*")
    meets = rows.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1")).filter("m > 1").select("g", (F.col("c0") == F.col("c1")).alias("alone"))
    found = staged(rows.join(meets, "g"), "suffix-met")

    # one of each context of an anchor that has several is read
    several = found.filter("NOT alone").groupBy("g", "c").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "th", "lo", "n")).alias("x"))
    several = staged(several.select("g", "c", "m", "x.*").drop("no_id"), "suffix-contexts")
    large = several.groupBy("g").agg(F.sum(F.col("n") + F.lit(least)).alias("size")).filter(F.col("size") > most).select("g", F.lit(True).alias("large"))
    large = staged(large, "suffix-large")
    wanted = several.join(large, "g", "left").select("id", "th", "g", "c", "lo", "n", F.coalesce("large", F.lit(False)).alias("large"))
    per = found.groupBy(F.col("id").alias("i"), F.col("th").alias("h")).agg(F.count(F.lit(1)).alias("hits"))
    lists = wanted.groupBy(F.col("id").alias("wi"), F.col("th").alias("wh")).agg(F.collect_list(F.struct("g", "c", "lo", "n", "large")).alias("wanted"))
    per = per.join(lists, F.col("i").eqNullSafe(F.col("wi")) & (F.col("h") == F.col("wh")), "left").select("i", "h", "wanted")
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("th"), F.col(text_col).alias("text"))
    texts = source.join(per, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h"))).select("i", "h", "text", "wanted")
    texts = staged(texts, "suffix-texts")

    contexts = cut_contexts(texts, least)
    ranges = staged(search(contexts.filter("NOT large"), least, local).union(count_windows(contexts.filter("large"), least)), "suffix-ranges")
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    every = found.filter("alone").select("id", "th", "lo", whole.alias("ranges"))
    copies = several.filter("m > 1").select("g", "c", F.lit(True).alias("copied"))
    others = found.filter("NOT alone").join(copies, ["g", "c"], "left").join(ranges, ["g", "c"], "left")
    others = others.select("id", "th", "lo", F.when(F.col("copied"), whole).otherwise(F.col("ranges")).alias("ranges")).filter("ranges IS NOT NULL")
    spans = every.union(others).select("id", "th", F.transform("ranges", lambda r: F.struct((F.col("lo") + r["a"]).alias("start"), (F.col("lo") + r["b"] - 1 + least).alias("end"))).alias("s"))
    cuts = spans.groupBy(F.col("id").alias("ci"), F.col("th").alias("ch")).agg(F.flatten(F.collect_list("s")).alias("cuts"))
    kept = taken_out(texts.select("i", "h", "text"), cuts)
    met = slim.select("id", "th", "n_bytes", "sha").join(kept, F.col("id").eqNullSafe(F.col("ki")) & (F.col("th") == F.col("kh")), "left")
    zero = F.lit(0).cast("long")
    return met.select(F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def cut_contexts(texts: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_batches([whole], "text"):
                out = []
                for text, wanted in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                    raw = text.encode("utf-8", "replace")
                    out += [(w["g"], w["c"], w["n"], raw[w["lo"]:w["lo"] + w["n"] + least - 1], w["large"]) for w in wanted]
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()), strict=True)], names=["g", "c", "n", "raw", "large"])

    some = texts.filter("wanted IS NOT NULL").select("text", "wanted")
    # rows that repeat an id and a text would give a context twice
    return staged(some.mapInArrow(run, "g long, c long, n int, raw binary, large boolean").dropDuplicates(["g", "c"]), "suffix-bytes")


def taken_out(texts: DataFrame, cuts: DataFrame) -> DataFrame:
    """``ki, kh, n_removed, n_spans, kept_sha256``."""
    kind = texts.schema["i"].dataType.simpleString()
    met = texts.join(cuts, F.col("i").eqNullSafe(F.col("ci")) & (F.col("h") == F.col("ch"))).select("i", "h", "text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_batches([whole], "text"):
                made = [remove(t.encode("utf-8", "replace"), [(w["start"], w["end"]) for w in c]) for t, c in zip(b.column("text").to_pylist(), b.column("cuts").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("i"), b.column("h"), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64()), pa.array([hashlib.sha256(m[0]).hexdigest() for m in made])], names=["ki", "kh", "n_removed", "n_spans", "kept_sha256"])

    out = met.mapInArrow(run, f"ki {kind}, kh long, n_removed long, n_spans long, kept_sha256 string")
    return staged(out.dropDuplicates(["ki", "kh"]), "suffix-kept")
