"""Substring dedup: near-equal paragraphs across documents, by MinHash bands.

A paragraph is a line of at least ``WORDS`` words; shingles are five words, lower-cased by A-Z.

1. One pass gives every paragraph's place, a 128-bit hash of its words, and MinHash bands; equal paragraphs are one
   from then on, so a common passage travels once a task.
2. Bands that collide link paragraphs to the least one of the band.  The components of these links are candidate
   families.  Bands are tuned so that a pair of the wanted similarity is missed with the given probability at most.
3. Texts with such a paragraph are taken out of the documents once.  A family's distinct paragraphs meet with their words; exact Jaccard similarity is computed from a front of reached
   paragraphs to all that are left, and gives a spanning forest of the links, not its pairs.  A family of more than
   ``MOST`` paragraphs is met in pairs of blocks, so no task holds more than two blocks.
4. Components of verified links are classes.  The first occurrence of a class (least document id, then place) stays,
   the others are removed.
5. With ``runs``, passages of that many words are found whatever the line breaks.  Every window of so many words stands
   under the least-hash shingle in it, its anchor: equal windows have equal anchors.  Anchors that stand in one place only are
   dropped.  The windows in a row of one anchor are folded with equal rows by a 128-bit hash of their words, and meet one by
   one, by anchor and 64-bit hash, where rows of an anchor differ.  A window goes where an equal one that does not
   overlap it comes first.  What goes by lines and by windows is merged.

Defined results: a null text is empty; a null id is after all others; rows that repeat an id and a text are
one document whose passages stay or go together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undercroft.llm.common import forget, swept, text_batches, text_of
from undercroft.llm.components import components
from undercroft.llm.hashing import BASE, INVERSE, Spans, mix, powers

WORDS, SHINGLE, SIMILARITY, RECALL, ROWS, MOST = 50, 5, 0.8, 0.999, 3, 2048
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def tuned(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` hashes that find a pair of this similarity with at least this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows))


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space."""
    gap = np.r_[True, (data == 32) | ((data >= 9) & (data <= 13)), True]
    step = np.diff(gap.astype(np.int8))
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)


def shingle_hashes(spans: Spans, starts: np.ndarray, ends: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of every ``size`` words in a row."""
    word = spans.of(starts, ends)
    n = len(word) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        out = out * np.uint64(0x100000001B3) + word[k:k + n]
    return mix(out)


def paragraphs(text: bytes, first_doc: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Of a buffer of documents that end in a line feed: owner, start and end byte, first and last word of each long line."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = words_of(data)
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, starts)
    head = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, int)
    count = np.diff(np.r_[head, len(line)])
    head, count = head[count >= least], count[count >= least]
    last = head + count
    owner = np.searchsorted(first_doc, starts[head], side="right") - 1 if len(head) else head
    return owner, starts[head], ends[last - 1] if len(head) else head, head, last, starts, ends


def signatures(text: bytes, first_doc: np.ndarray, least: int, bands: int, rows: int) -> tuple:
    """Owner, start, end, band keys (a row per paragraph)."""
    owner, a, b, head, last, starts, ends = paragraphs(text, first_doc, least)
    if not len(owner):
        return owner, a, b, np.zeros((0, bands), np.uint64)
    hashes = shingle_hashes(Spans(np.frombuffer(text, np.uint8)), starts, ends)
    size = last - head - SHINGLE + 1
    at = np.repeat(head - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    own, cut = hashes[at], np.r_[0, np.cumsum(size)[:-1]]
    factors = mix(powers(0xD1342543DE82EF95, bands * rows + 1)[1:]) | np.uint64(1)
    keys = np.zeros((len(owner), bands), np.uint64)
    for k, f in enumerate(factors):
        low = np.minimum.reduceat(own * f, cut)
        keys[:, k // rows] = mix(keys[:, k // rows] * np.uint64(0x100000001B3) + low)
    return owner, a, b, keys


def windows(text: bytes, first_doc: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Of every run of ``size`` words inside a document: first word and anchor (place of its least shingle hash); then hashes of all shingles, starts and ends of all words."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = words_of(data)
    hashes = shingle_hashes(Spans(data), starts, ends)
    none = np.zeros(0, np.int64)
    if len(starts) < size:
        return none, none, hashes, starts, ends
    least = [np.lib.stride_tricks.sliding_window_view(hashes[at:at + 65536 + size - SHINGLE], size - SHINGLE + 1).argmin(1) for at in range(0, len(starts) - size + 1, 65536)]
    least = np.concatenate(least)
    owner = np.searchsorted(first_doc, starts, side="right")
    head = np.flatnonzero(owner[:len(least)] == owner[size - 1:])
    return head, head + least[head], hashes, starts, ends


def anchors(text: bytes, first_doc: np.ndarray, size: int) -> list[list[int]]:
    """The hashes under which the windows of each document stand."""
    _, anchor, hashes, starts, _ = windows(text, first_doc, size)
    at = np.unique(anchor)
    cut = np.searchsorted(starts[at], first_doc[1:]) if len(at) else np.zeros(len(first_doc) - 1, int)
    return [x.tolist() for x in np.split(hashes[at].view(np.int64), cut)]


def buffer_of(texts: list) -> tuple[bytes, np.ndarray]:
    """Documents lower-cased by A-Z, each with a line feed, and where each begins."""
    parts = [(t or "").encode("utf-8", "replace") + b"\n" for t in texts]
    return b"".join(parts).translate(LOWER), np.r_[0, np.cumsum([len(p) for p in parts])[:-1]].astype(np.int64)


def paragraph_hash(raw: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(raw.split()))


def occurrences(docs: DataFrame, id_col: str, text_col: str, least: int, bands: int, runs: int = 0) -> DataFrame:
    """``id, th`` (hash of the text), ``n_bytes, sha``, ``lines``: start, end, 128-bit hash, band keys; and ``anchors`` of runs."""
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("ph", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_batches([whole], "text", 2_000_000):
                raw = [(t or "").encode("utf-8", "replace") for t in b.column("text").to_pylist()]
                text, first = buffer_of(b.column("text").to_pylist())
                owner, s, e, keys = signatures(text, first, least, bands, ROWS)
                lines: list[list] = [[] for _ in raw]
                for o, x, y, k in zip(owner.tolist(), s.tolist(), e.tolist(), keys.view(np.int64).tolist(), strict=True):
                    lines[o].append({"start": x - int(first[o]), "end": y - int(first[o]), "ph": paragraph_hash(text[x:y]), "keys": k})
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("th"), pa.array([len(r) for r in raw], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw]), pa.array(lines, pa.list_(item)),
                     pa.array(anchors(text, first, runs) if runs else [[]] * len(raw), pa.list_(pa.int64()))],
                    names=["id", "th", "n_bytes", "sha", "lines", "anchors"])

    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("th"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {kind}, th long, n_bytes long, sha string, lines array<struct<start:long,end:long,ph:binary,keys:array<long>>>, anchors array<long>")


def band_links(distinct: DataFrame) -> DataFrame:
    """``a, b``: every paragraph (by ``pid``) with the least one of each of its bands, in one sorted sweep."""
    rows = distinct.select("pid", F.posexplode("keys").alias("band", "key")).repartition("band", "key").sortWithinPartitions("band", "key", "pid")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            if not b.num_rows:
                continue
            pid, band, key = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            new = np.r_[before is None or (band[0], key[0]) != before[:2], (band[1:] != band[:-1]) | (key[1:] != key[:-1])]
            at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            head = np.where(at >= 0, pid[np.maximum(at, 0)], before[2] if before else 0)
            before = (band[-1], key[-1], head[-1])
            link = head != pid
            if link.any():
                yield pa.RecordBatch.from_arrays([pa.array(pid[link]), pa.array(head[link])], names=["a", "b"])

    return rows.mapInArrow(sweep, "a long, b long").distinct()


def jaccard_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of sets with at least this Jaccard similarity."""
    size = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    cut = np.r_[0, np.cumsum(size)]
    parts = [flat[cut[i]:cut[i + 1]] for i in range(len(sets))]
    mark, out = np.zeros(flat.max() + 1, np.int32), []
    left, front = np.arange(len(sets)), []
    while len(left) or front:
        if not front:
            front, left = [int(left[0])], left[1:]
        i = front.pop()
        if not len(left):
            break
        mark[parts[i]] = 1
        n = size[left]
        common = np.add.reduceat(mark[np.concatenate([parts[j] for j in left])], np.r_[0, np.cumsum(n)[:-1]])
        mark[parts[i]] = 0
        near = common >= similarity * (n + size[i] - common) - 1e-9
        out += [(i, int(j)) for j in left[near]]
        front += left[near].tolist()
        left = left[~near]
    return out


def shingle_set(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    starts, ends = words_of(data)
    return np.unique(shingle_hashes(Spans(data), starts, ends))


def texts_of(docs: DataFrame, id_col: str, text_col: str, lines: DataFrame, marks: DataFrame, standing: DataFrame) -> DataFrame:
    """``i, h, text, fetch, anchors``: the documents that have a marked paragraph or an anchor that repeats, the family paragraphs that are
    read from them (each from its first place), and those anchors."""
    met = lines.select("id", "th", "start", "end", "ph").join(marks, "ph")
    mine = F.col("keep.id").eqNullSafe(F.col("id")) & (F.col("keep.th") == F.col("th")) & (F.col("keep.start") == F.col("start")) & F.col("family").isNotNull()
    per = met.groupBy(F.col("id").alias("i"), F.col("th").alias("h")).agg(F.collect_list(F.when(mine, F.struct("ph", "start", "end", "family", "block", "blocks"))).alias("fetch"))
    again = swept(standing.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "passages-anchors")
    held = standing.join(again, "anchor").groupBy(F.col("id").alias("i"), F.col("th").alias("h")).agg(F.collect_set("anchor").alias("anchors"))
    none = F.array().cast("array<long>").alias("anchors")
    per = per.select("i", "h", "fetch", none).union(held.select("i", "h", F.array().cast(per.schema["fetch"].dataType), "anchors"))
    per = per.groupBy("i", "h").agg(F.flatten(F.collect_list("fetch")).alias("fetch"), F.flatten(F.collect_list("anchors")).alias("anchors"))
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("th"), F.col(text_col).alias("text"))
    return source.join(per, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h"))).select("i", "h", "text", "fetch", "anchors")


def verified(texts: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links by exact Jaccard between the distinct paragraphs (by hash) of each family."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_batches([whole], "text"):
                out = []
                for text, fetch in zip(b.column("text").to_pylist(), b.column("fetch").to_pylist(), strict=True):
                    raw = text.encode("utf-8", "replace").translate(LOWER)
                    for f in fetch:
                        # block i meets every block j once
                        out += [(f["family"], min(f["block"], j), max(f["block"], j), f["ph"], raw[f["start"]:f["end"]]) for j in range(f["blocks"])]
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["family", "lo", "hi", "ph", "raw"])

    met = texts.filter(F.size("fetch") > 0).select("text", "fetch").mapInArrow(lines, "family long, lo int, hi int, ph binary, raw binary")

    def meet(group: pa.Table) -> pa.Table:
        ph, raw = group["ph"].to_pylist(), group["raw"].to_pylist()
        links = jaccard_forest([shingle_set(r) for r in raw], similarity) if len(ph) > 1 else []
        return pa.table({"a": pa.array([ph[i] for i, _ in links], pa.binary()), "b": pa.array([ph[j] for _, j in links], pa.binary())})

    return met.groupBy("family", "lo", "hi").applyInArrow(meet, "a binary, b binary")


def candidates(lines: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Distinct paragraphs ``ph, n, keep`` (their first place), and of those that repeat or have a family ``ph, keep, family, block, blocks``."""
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "th", "start")
    distinct = swept(lines.groupBy("ph").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("keep"), F.first("keys").alias("keys"))
                      .withColumn("pid", F.conv(F.substring(F.hex("ph"), 1, 15), 16, 10).cast("long")), "passages-distinct")
    linked = components(swept(band_links(distinct), "passages-links")).withColumnsRenamed({"node": "pid", "component": "family"})
    sizes = linked.join(distinct.select("pid"), "pid").groupBy("family").agg(F.count(F.lit(1)).alias("size")).withColumn("blocks", F.ceil(F.col("size") / most).cast("int"))
    linked = swept(linked.join(sizes, "family").select("pid", "family", "blocks"), "passages-families")
    marks = distinct.select("ph", "n", "keep", "pid").join(linked, "pid", "left").filter("n > 1 OR family IS NOT NULL")
    marks = marks.select("ph", "keep", "family", F.pmod(F.xxhash64("ph"), F.col("blocks")).cast("int").alias("block"), "blocks")
    return distinct.select("ph", "n", "keep"), swept(marks, "passages-marks")


def classes(distinct: DataFrame, links: DataFrame) -> DataFrame:
    """``ph, keep`` (id, text hash and start of the occurrence that stays) of paragraphs in a class of two or more."""
    roots = components(links).withColumnsRenamed({"node": "ph", "component": "root"})
    rooted = swept(distinct.join(roots, "ph", "left").filter("n > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "ph")), "passages-roots")
    whole = rooted.groupBy("root").agg(F.min("keep").alias("class_keep"))
    return rooted.join(whole, "root").select("ph", F.col("class_keep").alias("keep"))


def segments(texts: DataFrame, size: int) -> DataFrame:
    """``id, th, seg, anchor, at, n, hashes``: the windows of each kept anchor, which stand in a row: hash of their words, first word, how many,
    and their hashes (where a task meets the segment first)."""
    kind = texts.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for whole in batches:
            for b in text_batches([whole], "text", 2_000_000):
                text, first = buffer_of(b.column("text").to_pylist())
                head, anchor, shingles, starts, ends = windows(text, first, size)
                cut = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]][:len(anchor)])
                n = np.diff(np.r_[cut, len(anchor)])
                begin, key = head[cut], shingles[anchor[cut]].view(np.int64)
                doc = np.searchsorted(first, starts[begin], side="right") - 1
                kept = [set(x) for x in b.column("anchors").to_pylist()]
                use = [j for j, (d, k) in enumerate(zip(doc.tolist(), key.tolist(), strict=True)) if k in kept[d]]
                begin, n, key, doc = begin[use], n[use], key[use], doc[use]
                word = Spans(np.frombuffer(text, np.uint8)).of(starts, ends)
                sums, back = np.zeros(len(word) + 1, np.uint64), powers(INVERSE, len(word) + 1)
                np.cumsum(word * powers(BASE, len(word)), out=sums[1:])
                joined, at = b" ".join(text.split()), np.r_[0, np.cumsum(ends - starts + 1)]
                spans = zip(at[begin].tolist(), (at[begin + n + size - 1] - 1).tolist(), strict=True)
                segs, hashes = [xxhash.xxh3_128_digest(joined[x:y]) for x, y in spans], []
                for seg, x, y in zip(segs, begin.tolist(), (begin + n).tolist(), strict=True):
                    hashes.append(None if seg in seen else mix((sums[x + size:y + size] - sums[x:y]) * back[x:y]).view(np.int64))
                    seen.add(seg)
                if len(seen) > 300_000:
                    seen.clear()
                mine, base = pa.array(doc), np.searchsorted(starts, first)
                yield pa.RecordBatch.from_arrays(
                    [b.column("i").take(mine), b.column("h").take(mine), pa.array(segs, pa.binary()), pa.array(key), pa.array(begin - base[doc]), pa.array(n.astype(np.int64)), pa.array(hashes, pa.list_(pa.int64()))],
                    names=["id", "th", "seg", "anchor", "at", "n", "hashes"])

    return texts.filter(F.size("anchors") > 0).select("i", "h", "text", "anchors").mapInArrow(run, f"id {kind}, th long, seg binary, anchor long, at long, n long, hashes array<long>")


def others_type(each: DataFrame) -> str:
    return f"array<struct<o:bigint,e:bigint,keep:struct<no_id:boolean,id:{each.schema['id'].dataType.simpleString()},th:bigint,at:bigint>>>"


def met_windows(each: DataFrame) -> DataFrame:
    """``seg, others``: the rows of windows (offsets ``o`` to ``e``) of a segment that stand in an earlier segment of its anchor, from ``keep`` on.

    ``each`` is (anchor, seg, no_id, id, th, at, hashes), few segments to an anchor.  Hashes stay arrays in the shuffle, and a task
    holds the segments of one anchor and a batch."""
    fields = ["anchor", "seg", "no_id", "id", "th", "at", "hashes"]
    rows = each.select(*fields).repartition("anchor").sortWithinPartitions("anchor", "no_id", "id", "th", "at")

    def meet(t: pa.Table) -> pa.RecordBatch:
        lists = t["hashes"].combine_chunks()
        n = np.diff(lists.offsets.to_numpy())
        wh, cut = lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(n)]
        own = np.repeat(np.arange(len(n)), n)
        o, anchor = np.arange(len(wh)) - cut[own], t["anchor"].to_numpy()[own]
        order = np.lexsort((wh, anchor))  # stable: the first of equal windows is the first place
        new = np.r_[True, (wh[order][1:] != wh[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])][:len(order)]
        head = np.empty(len(order), np.int64)
        head[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        goes = head != np.arange(len(order))
        # windows in a row that stand in a row elsewhere too
        on = np.zeros(len(order), bool)
        on[1:] = goes[1:] & goes[:-1] & (own[1:] == own[:-1]) & (own[head[1:]] == own[head[:-1]]) & (head[1:] == head[:-1] + 1)
        begin = np.flatnonzero(goes & ~on)
        end = np.flatnonzero(goes & ~np.r_[on[1:], False][:len(order)]) + 1
        seg, first = own[begin], own[head[begin]]
        keep = pa.StructArray.from_arrays([*(t[c].combine_chunks().take(pa.array(first)) for c in ("no_id", "id", "th")), pa.array(t["at"].to_numpy()[first] + o[head[begin]])], names=["no_id", "id", "th", "at"])
        items = pa.StructArray.from_arrays([pa.array(o[begin]), pa.array(o[begin] + end - begin), keep], names=["o", "e", "keep"])
        at = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]][:len(seg)])
        return pa.RecordBatch.from_arrays([t["seg"].combine_chunks().take(pa.array(seg[at])), pa.ListArray.from_arrays(pa.array(np.r_[at, len(seg)].astype(np.int32)), items)], names=["seg", "others"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            if t.num_rows:
                anchor = t["anchor"].to_numpy()
                last = int(np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])[-1])
                if last:
                    yield meet(t.slice(0, last).combine_chunks())
                rest = t.slice(last)
        if rest is not None and rest.num_rows:
            yield meet(rest.combine_chunks())

    return rows.mapInArrow(sweep, f"seg binary, others {others_type(each)}")


def met_windows_apart(each: DataFrame) -> DataFrame:
    """The same for anchors of any number of segments: every window is a row, and no group is held."""
    mine = F.struct("no_id", "id", "th", (F.col("at") + F.col("o")).alias("at"))
    rows = each.select("seg", "anchor", "no_id", "id", "th", "at", F.posexplode("hashes").alias("o", "wh")).select("seg", "anchor", F.col("o").cast("long").alias("o"), "wh", mine.alias("mine"))
    firsts = rows.groupBy("anchor", "wh").agg(F.min("mine").alias("keep"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    met = rows.join(firsts, ["anchor", "wh"]).filter(~F.col("keep").eqNullSafe(F.col("mine")))
    return met.groupBy("seg").agg(F.collect_list(F.struct("o", (F.col("o") + 1).alias("e"), "keep")).cast(others_type(each)).alias("others"))


def repeated_runs(texts: DataFrame, size: int, most: int = MOST) -> DataFrame:
    """``id, th, start, end`` (words) and ``keep`` (id of the first place) of the windows of ``size`` words that an equal one comes before.

    Equal segments are folded first.  Only where an anchor has several segments do their windows meet: an anchor of up to ``most`` in one
    sweep over its segments, one of more as rows of single windows."""
    found = swept(segments(texts, size), "passages-segments")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "th", "at")
    distinct = swept(found.groupBy("seg").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("times"), F.first("anchor").alias("anchor"), F.first("hashes", ignorenulls=True).alias("hashes")), "passages-distinct-segments")
    several = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    each = distinct.join(several, "anchor").select("m", "anchor", "seg", "place.*", "hashes")
    others = met_windows(each.filter(F.col("m") <= most)).union(met_windows_apart(each.filter(F.col("m") > most)))
    known = distinct.select("seg", "place", "times").join(others, "seg", "left").filter("times > 1 OR others IS NOT NULL")
    known = swept(known.drop("times"), "passages-known-segments")
    met = found.select("id", "th", "seg", "at", "n").join(known, "seg")

    def apart(keep, at):
        return ~(keep["id"].eqNullSafe(F.col("id")) & (keep["th"] == F.col("th"))) | (keep["at"] + size <= at)

    # a window that goes for its segment's first place goes for an earlier one too; a row of windows moves as one with the row it is equal to
    rows = F.filter(F.coalesce("others", F.array().cast(known.schema["others"].dataType)), lambda x: apart(x["keep"], F.col("at") + x["o"]))
    some = F.transform(rows, lambda x: F.struct((F.col("at") + x["o"]).alias("start"), (F.col("at") + x["e"] - 1 + size).alias("end"), x["keep"]["id"].alias("keep")))
    gone = F.aggregate(F.coalesce("others", F.array().cast(known.schema["others"].dataType)), F.lit(0).cast("long"), lambda n, x: n + F.when(apart(x["keep"], F.col("at") + x["o"]), x["e"] - x["o"]).otherwise(0))
    whole = F.when(apart(F.col("place"), F.col("at")) & (gone < F.col("n")), F.array(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("n") - 1 + size).alias("end"), F.col("place.id").alias("keep"))))
    spans = F.concat(F.coalesce(whole, F.array().cast(f"array<struct<start:bigint,end:bigint,keep:{texts.schema['i'].dataType.simpleString()}>>")), some)
    out = swept(met.select("id", "th", F.explode(spans).alias("s")).select("id", "th", "s.*").distinct(), "passages-runs")
    forget(found, distinct, known)
    return out


def drop_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST, runs: int = 0) -> DataFrame:
    """Every row: id, ``n_bytes, n_paragraphs, n_repeated`` (paragraphs in a class), ``n_removed`` (bytes), ``n_spans``, ``kept_sha256`` and
    ``repeats_of`` (ids of the documents whose passage stays for each class the document has part in, and for each of its runs that go).
    ``runs``: words of a passage that repeats whatever its line breaks, ``SHINGLE`` at least; 0 looks at lines only."""
    read = swept(occurrences(docs, id_col, text_col, least, tuned(similarity, recall), runs), "passages")
    lines = read.select("id", "th", F.explode("lines").alias("l")).select("id", "th", "l.*")
    distinct, marks = candidates(lines, most)
    standing = read.select("id", "th", F.explode("anchors").alias("anchor"))
    texts = swept(texts_of(docs, id_col, text_col, lines, marks, standing), "passages-texts")
    links = swept(verified(texts, similarity), "passages-verified")
    found = swept(classes(distinct, links), "passages-classes")
    hit = lines.select("id", "th", "start", "end", "ph").join(found, "ph")
    stays = F.col("keep.id").eqNullSafe(F.col("id")) & (F.col("keep.th") == F.col("th")) & (F.col("keep.start") == F.col("start"))
    hit = hit.withColumn("gone", ~stays).dropDuplicates(["id", "th", "start"])
    hit = hit.select("id", "th", "start", "end", "gone", F.col("keep.id").alias("keep"), F.lit(1).cast("long").alias("line"))
    if runs:
        hit = hit.union(repeated_runs(texts, runs, most).select("id", "th", "start", "end", F.lit(True), "keep", F.lit(0).cast("long")))
    per = swept(hit.groupBy(F.col("id").alias("i"), F.col("th").alias("h")).agg(
        F.sum("line").alias("n_repeated"), F.sort_array(F.collect_set("keep")).alias("repeats_of"),
        F.sort_array(F.collect_list(F.when(F.col("gone"), F.struct("start", "end", (F.col("line") == 0).alias("words"))))).alias("cuts")), "passages-cuts")
    slim = read.select("id", "th", "n_bytes", "sha", F.size("lines").cast("long").alias("n_paragraphs"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h"))
    forget(links, found)
    kept = swept(without(texts, per.filter(F.size("cuts") > 0).select("i", "h", "cuts")), "passages-kept").withColumnsRenamed({"i": "ki", "h": "kh"})
    forget(texts)
    met = slim.join(per.drop("cuts"), same, "left").join(kept, F.col("id").eqNullSafe(F.col("ki")) & (F.col("th") == F.col("kh")), "left")
    zero = F.lit(0).cast("long")
    return met.select(
        F.col("id").alias(id_col), "n_bytes", "n_paragraphs", F.coalesce("n_repeated", zero).alias("n_repeated"), F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("repeats_of", F.array().cast(per.schema["repeats_of"].dataType)).alias("repeats_of"))


def without(texts: DataFrame, cuts: DataFrame) -> DataFrame:
    """``i, h, n_removed, n_spans, kept_sha256`` of the documents with spans ``cuts`` taken out, of bytes or of words."""
    kind = texts.schema["i"].dataType.simpleString()
    cuts = cuts.withColumnsRenamed({"i": "ci", "h": "ch"})
    met = texts.select("i", "h", "text").join(cuts, F.col("i").eqNullSafe(F.col("ci")) & (F.col("h") == F.col("ch"))).select("i", "h", "text", "cuts").dropDuplicates(["i", "h"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_batches([whole], "text"):
                gone, spans, shas = [], [], []
                for text, where in zip(b.column("text").to_pylist(), b.column("cuts").to_pylist(), strict=True):
                    raw = (text or "").encode("utf-8", "replace")
                    starts, ends = words_of(np.frombuffer(raw, np.uint8)) if any(w["words"] for w in where) else ([], [])
                    kept, n, at = remove(raw, [(int(starts[w["start"]]), int(ends[w["end"] - 1])) if w["words"] else (w["start"], w["end"]) for w in where])
                    gone.append(n)
                    spans.append(at)
                    shas.append(hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column("i"), b.column("h"), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string())], names=["i", "h", "n_removed", "n_spans", "kept_sha256"])

    return met.mapInArrow(cut, f"i {kind}, h long, n_removed long, n_spans long, kept_sha256 string")


def remove(raw: bytes, cuts: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left, bytes removed, and maximal runs removed; spans may touch or overlap."""
    out, at, runs, gone = [], 0, 0, 0
    for a, b in sorted(cuts):
        if b <= at:
            continue
        if a > at or not runs:
            runs += 1
            out.append(raw[at:a])
        gone += b - max(a, at)
        at = b
    return b"".join([*out, raw[at:]]), gone, runs
