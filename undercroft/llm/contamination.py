"""Benchmark decontamination by a prefix-filtered set join.

Every item is cut into windows of ``window`` consecutive words (a shorter item is one window), and a window is the set of
its shingles with their places.  A document holds a window if, laid over some run of its words of the window's size, the
share ``share`` of the window's shingles agree in place; with a share of 1 that is exact containment.

1. One pass over the texts hashes their shingles and keeps those that a bitmap of all item shingles knows (of at most
   ``2 ** MOST_BITS`` bits: a larger benchmark only lets more through), with the words around them.  Texts are read once.
2. Item shingles are counted over all documents.  A window's shingles are put in order of rarity; of ``k`` shingles of
   which ``m`` must agree, the first ``k - m + 1`` are its prefix, since one of them is in every place that holds the window.
3. Kept shingles of documents meet the prefixes.  The place in the window gives the place in the document: windows that
   would begin before the document or end after it go, and the others are compared word by word.

Equal windows are folded before they meet, and get their items after they have been found.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case.

Defined results: a null text has no words, and a document without words holds nothing.  Every row of ``docs`` is a
document of its own, rows that repeat an id too, and gets a row.  Items are told apart by id: rows that share one are one
item, rows without an id are one item with an empty name.  A long document is cut where its hits are, and no more than
``PIECE`` bytes of its words are held as such.  Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undercroft.llm.common import fresh, staged
from undercroft.llm.hashing import BASE, mix, powers

MOST_BITS, PIECE, SEGMENT = 26, 1_000_000, 500
#: Word bytes in lower case, a space for all others.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def pieces(text: bytes | None, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, in lists from about ``size`` bytes of it."""
    data, at = (text or b"").translate(WORDS), 0
    while at < len(data):
        cut = len(data) if at + size >= len(data) else data.find(b" ", at + size)
        cut = len(data) if cut < 0 else cut
        yield data[at:cut].split()
        at = cut


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Of every run of ``size`` words, from the words' hashes."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, factor in enumerate(powers(BASE, size + 1)[1:]):
        total += hashes[k:n + k] * factor
    return mix(total)


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """``item, words, size, shingles``: the distinct windows of every item."""
    kind = "item string, words array<string>, size int, shingles array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = [w for part in pieces(text) for w in part]
                n, size = min(window, len(words)), min(window, len(words), shingle)
                if not words:
                    continue
                grams, found = shingle_hashes(word_hashes(words), size).view(np.int64).tolist(), range(len(words) - n + 1)
                for at in range(0, len(found), 4096):
                    own = found[at:at + 4096]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([item] * len(own), pa.string()), pa.array([[w.decode() for w in words[i:i + n]] for i in own], pa.list_(pa.string())),
                        pa.array([size] * len(own), pa.int32()), pa.array([grams[i:i + n - size + 1] for i in own], pa.list_(pa.int64())),
                    ], names=["item", "words", "size", "shingles"])

    named = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return items.select(named.alias("item"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, kind).dropDuplicates(["item", "words"])


def bitmap(shingles: DataFrame, count: int) -> tuple[int, np.ndarray]:
    """Which upper bits the hashes ``h`` have: the number of bits, and words of 64 flags."""
    bits = min(MOST_BITS, max(12, (1024 * count).bit_length()))
    upper = f"shiftrightunsigned(h, {64 - bits})"
    rows = shingles.selectExpr(f"shiftright({upper}, 6) AS w", f"shiftleft(1L, int({upper} & 63)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    flags = np.zeros(1 << (bits - 6), np.uint64)
    flags[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return bits, flags


def segments(found: np.ndarray, reach: int, most: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Places of hits, in runs of at most ``most`` whose reaches touch."""
    apart = np.flatnonzero(np.diff(found) > 2 * reach) + 1
    for a, b in zip(np.r_[0, apart], np.r_[apart, len(found)], strict=True):
        for at in range(int(a), int(b), most):
            yield at, min(int(b), at + most)


def scan(docs: DataFrame, id_col: str, text_col: str, window: int, sizes: list[int], bits: int, flags: np.ndarray) -> DataFrame:
    """``k, id, n_words, seg, first, words, pos, hash``: a row for each document, and one more for each further segment.

    ``words`` begin with word ``first`` of the document, ``pos`` and ``hash`` are the shingles that may be an item's.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(flags)
    upper, lower = np.uint64(64 - bits), np.uint64(63)
    names = ["k", "id", "n_words", "seg", "first", "words", "pos", "hash"]
    kinds = [pa.int64(), None, pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def known(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places, grams = [], []
        for size in sizes:
            h = shingle_hashes(hashes, size)
            at = h >> upper
            hit = np.flatnonzero((held.value[at >> np.uint64(6)] >> (at & lower)) & np.uint64(1))
            places.append(hit)
            grams.append(h[hit].view(np.int64))
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, gram = np.concatenate(places), np.concatenate(grams)
        order = np.argsort(place, kind="stable")
        return place[order], gram[order]

    def rows_of(k: int, own: object, text: bytes | None) -> Iterator[tuple]:
        counts, parts = [], []
        for words in pieces(text):
            counts.append(len(words))
            parts.append(word_hashes(words))
        n = sum(counts)
        place, gram = known(np.concatenate(parts)) if parts else (np.zeros(0, np.int64),) * 2
        if not len(place):
            yield k, own, n, 0, 0, [], [], []
            return
        borders, cuts, at = np.cumsum([0, *counts]), list(segments(place, window)), 0
        kept: list[bytes] = []
        source = pieces(text)
        start = end = 0  # ``kept`` are the document's words from start to end
        for seg, (a, b) in enumerate(cuts):
            low, high = max(0, int(place[a]) - window), min(n, int(place[b - 1]) + window)
            while end < high:
                more = next(source)
                kept, start = (kept[low - start:], low) if low < end else ([], end)
                kept, end, at = kept + more, int(borders[at + 1]), at + 1
            yield k, own, n, seg, low, [w.decode() for w in kept[low - start:high - start]], place[a:b].tolist(), gram[a:b].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds[1] = b.column(1).type
            out, size = [], 0
            for k, own, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for row in rows_of(k, own, text):
                    out.append(row)
                    size += 1 + len(row[5])
                    if size > 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("k"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"k long, id {kind}, n_words long, seg int, first long, words array<string>, pos array<long>, hash array<long>")


def prefixes(windows: DataFrame, counts: DataFrame, share: float) -> DataFrame:
    """``h, offset, w, words, size, need``: the rarest shingles of every window, as many as it cannot do without."""
    k = F.size("shingles")
    need = F.greatest(F.lit(1), F.ceil(k * F.lit(share) - 1e-9).cast("int"))
    tokens = windows.select("w", need.alias("need"), F.posexplode("shingles").alias("offset", "h")).join(counts, "h", "left")
    ranked = tokens.groupBy("w").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset"))).alias("t"), F.first("need").alias("need"))
    there = ranked.filter(F.size(F.filter("t", lambda x: x["n"] > 0)) >= F.col("need"))
    rare = there.select("w", "need", F.explode(F.slice("t", F.lit(1), F.size("t") - F.col("need") + 1)).alias("t")).filter("t.n > 0")
    return rare.select(F.col("t.h").alias("h"), F.col("t.offset").alias("offset"), "w", "need").join(windows.select("w", "words", "size"), "w")


def found_windows(rows: DataFrame, prefix: DataFrame) -> DataFrame:
    """``k, start, end, w``: the runs of words of documents that hold a window."""
    hits = rows.select("k", "seg", "n_words", F.explode(F.arrays_zip("pos", "hash")).alias("x")).select("k", "seg", "n_words", F.col("x.pos").alias("pos"), F.col("x.hash").alias("h"))
    start, size = F.col("pos") - F.col("offset"), F.size("words")
    near = hits.join(prefix, "h").filter((start >= 0) & (start + size <= F.col("n_words")))
    near = near.select("k", "seg", start.alias("start"), "w", F.col("words").alias("want"), "size", "need").dropDuplicates(["k", "seg", "start", "w"])
    met = near.join(rows.select("k", "seg", "first", "words"), ["k", "seg"])
    laid = F.slice("words", (F.col("start") - F.col("first") + 1).cast("int"), F.size("want"))
    equal = F.zip_with(laid, "want", lambda a, b: a == b)
    agreeing = F.filter(F.sequence(F.lit(1), F.size("want") - F.col("size") + 1), lambda i: F.forall(F.slice(equal, i, F.col("size")), lambda x: x))
    exact = F.when(F.col("need") == F.size("want") - F.col("size") + 1, laid == F.col("want")).otherwise(F.size(agreeing) >= F.col("need"))
    return met.filter(exact).select("k", "start", (F.col("start") + F.size("want")).alias("end"), "w").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, share: float = 1.0, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document: its id, ``n_words``, ``spans`` of words that windows cover (end exclusive), and ``items`` found."""
    own = staged(item_windows(items, item_col, item_text_col, window, shingle), "leak-items")
    distinct = own.groupBy("words").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"))
    windows = staged(distinct.withColumn("w", F.monotonically_increasing_id()), "leak-windows")
    shingles = windows.select(F.explode("shingles").alias("h")).distinct()
    sizes = sorted(r.size for r in windows.select("size").distinct().collect())  # ``shingle`` values at most
    bits, flags = bitmap(shingles, shingles.count())
    rows = staged(scan(docs, id_col, text_col, window, sizes, bits, flags), "leak-scan")
    hit = rows.filter(F.size("pos") > 0)
    counts = hit.select(F.explode("hash").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    found = staged(found_windows(hit, prefixes(windows, counts, share)), "leak-found")

    order = Window.partitionBy("k").orderBy("start")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.groupBy("k", "start").agg(F.max("end").alias("end")).withColumn("fresh", F.coalesce(F.col("start") > before, F.lit(True)))
    runs = runs.withColumn("run", F.sum(F.col("fresh").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("k", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = own.join(windows.select("words", "w"), "words").select("w", "item")
    names = found.select("k", "w").distinct().join(named, "w").select("k", "item").distinct().groupBy("k").agg(F.array_sort(F.collect_list("item")).alias("items"))
    leaks = staged(spans.join(names, "k"), "leaks")

    documents = rows.filter("seg = 0").select("k", F.col("id").alias(id_col), "n_words")
    kinds = {"spans": "array<struct<start:bigint,end:bigint>>", "items": "array<string>"}
    return documents.join(leaks, "k", "left").select(id_col, "n_words", *[F.coalesce(F.col(c), F.array().cast(t)).alias(c) for c, t in kinds.items()])


def words_covered(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def drop_contaminated(docs: DataFrame, items: DataFrame, most: float = 0.0, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` of whose words at most the share ``most`` is covered, all columns.

    Rows without an id are judged together with all others that have none, rows that share one likewise: one that goes takes them along.
    """
    own, = fresh(docs, "gone_id")
    judged = contamination(docs, items, id_col=id_col, **options)
    gone = staged(judged.filter(words_covered() > F.col("n_words") * F.lit(most)).select(F.col(id_col).alias(own)).distinct(), "leak-gone")
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col(own)), "left_anti")


CONTAMINATION_SQL = r"""
WITH doc AS (
    SELECT row_number() OVER () AS k, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), item AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), places AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM places),
runs AS (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
found AS (SELECT k, i, r.n, r.t FROM (SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM runs) r WHERE t IN (SELECT t FROM windows)),
covered AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM found) GROUP BY k),
named AS (SELECT k, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT k, item FROM found JOIN windows USING (t)) GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN covered USING (k) LEFT JOIN named USING (k)"""
