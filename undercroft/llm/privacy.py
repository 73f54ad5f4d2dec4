"""Personal data: patterns for the protected entities, and terms that disclose them.

**Base.** Emails, ip addresses, card and phone numbers are found by pattern in every whole text, in linear time.

**Method.** An entity is one value of a kind.  What a term gives away of it is measured over the corpus: of the ``n(t)``
documents that have the term, ``n(e, t)`` have the entity too, so a reader of the term finds the entity with
``P(e | t) = n(e, t) / n(t)`` and has ``-log2 P`` bits left to guess.  All pairs are measured, each by a lower bound of P
(Wilson's, one-sided 95 %), which shrinks what few documents say; copies are no evidence, so a pair weighs as many documents
as it has different texts.  A term that leaves at most ``REMOVE`` bits is removed, one that leaves at most ``GENERALISE``
is replaced by its class, wherever it stands, in every text of the corpus; one that tells no more than the entity's own
frequency is left.  One text alone, whose term stands nowhere else, gives 0.27: it is generalised.

1. A pass over the texts gives the base spans and partial document counts of all terms (a task's counts leave it whenever they
   reach ``FLUSH`` terms), and of documents with an entity their entities and terms.  Words inside base spans are no terms.
2. Terms of which a quarter of the documents has no entity at all cannot be judged and go first.  Entities that stand in just the
   same texts are one (told apart by 128 bits over these), so a list of addresses meets its document's terms once.
3. A second pass gives the places of terms that a bitmap of the judged ones knows (of bounded size), and these meet the
   judged table.

Defined results: a null text is empty.  Rows that repeat a text count as rows of the corpus and as one text of a pair; rows that
repeat an id and a text get the same spans.  An empty table has no rows.  Very long texts are read whole, a text at a time.
``sanitised`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undercroft.llm.common import fresh, staged, text_batches
from undercroft.llm.contamination import bitmap

KINDS = ("email", "ip", "card", "phone")
REMOVE, GENERALISE, NORMAL, FLUSH = 1.0, 2.0, 1.6448536269514722, 300_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match begins where a run of digits begins, so nothing is tried twice.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @: the characters of a local part before it, after the last match, and a domain with a dot behind it."""
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        at = text.find("@", max(at + 1, last))


def ip_fits(value: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in value.split("."))


def digits_of(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def card_fits(value: str) -> bool:
    """13 to 19 digits whose weighted digit sum is a multiple of ten."""
    digits = digits_of(value)
    if not 13 <= len(digits) <= 19:
        return False
    return sum(sum(divmod(int(c) << (k & 1), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans by kind as listed, then by start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if ip_fits(m.group())]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and card_fits(m.group())]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return out


def entity(kind: str, value: str) -> str:
    """One spelling for each value."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else digits_of(value)}"


def free_terms(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Places of the terms that no base span touches."""
    found = [m.span() for m in TERM.finditer(text)]
    if not spans:
        return found
    inside = sorted((a, b) for _, a, b in spans)
    opens, reach, top = [a for a, _ in inside], [], 0
    for _, b in inside:
        top = max(top, b)
        reach.append(top)

    def free(a: int, b: int) -> bool:
        i = bisect_left(opens, b)
        return i == 0 or reach[i - 1] <= a

    return [(a, b) for a, b in found if free(a, b)]


def written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


PARTS = "id {id}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, hash long, entities array<string>, terms array<string>, term string, seen long"


def source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))


def read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each document, and rows ``term, seen`` of partial document counts."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "hash", "entities", "terms", "term", "seen"]
    words = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        id_type = None

        def partial() -> pa.RecordBatch:
            n = len(counts)
            empty = [pa.nulls(n, id_type), *[pa.nulls(n, pa.int64())] * 4, *[pa.nulls(n, pa.string())] * 2, pa.nulls(n, pa.int64()), *[pa.nulls(n, words)] * 2]
            return pa.RecordBatch.from_arrays([*empty, pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=names)

        for whole in batches:
            for b in text_batches([whole], "text"):
                id_type = b.column("id").type
                rows = []
                for text in b.column("text").to_pylist():
                    text = text or ""
                    spans = base_spans(text)
                    terms = {text[s:e].lower() for s, e in free_terms(text, spans)} if spans else {t.lower() for t in set(TERM.findall(text))}
                    counts.update(terms)
                    per = Counter(k for k, _, _ in spans)
                    base = written(spans)
                    own = (sorted({entity(k, text[s:e]) for k, s, e in spans}), sorted(terms)) if spans else (None, None)
                    rows.append((*(per[k] for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), base, *own))
                    if len(counts) >= FLUSH:
                        yield partial()
                        counts.clear()
                n = len(rows)
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), *[pa.array(x, pa.int64()) for x in c[:4]], pa.array(c[4], pa.string()), pa.array(c[5], pa.string()),
                     b.column("hash"), pa.array(c[6], words), pa.array(c[7], words), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names=names)
        if counts:
            yield partial()

    return source(docs, id_col, text_col).mapInArrow(run, PARTS.format(id=kind))


def least_share(hits: Column, texts: Column, rows: Column) -> Column:
    """Wilson's lower bound of ``hits / rows``, with the weight of so many rows as there are different ``texts`` among the hits."""
    p, z2 = hits / rows, NORMAL * NORMAL
    m = texts / p
    return (p + z2 / (2 * m) - NORMAL * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m))) / (1 + z2 / m)


def disclosing(parts: DataFrame, remove: float, generalise: float) -> DataFrame:
    """``term, kind``: the terms to remove (``term``) or generalise (``class``)."""
    documents = parts.filter("term IS NULL")
    total = documents.count()
    texts = staged(documents.filter("base <> ''").groupBy("hash").agg(F.count(F.lit(1)).alias("c"), F.first("entities").alias("entities"), F.first("terms").alias("terms")), "private-texts")
    named = texts.select("hash", "c", F.explode("entities").alias("entity"))
    same = [F.bit_xor(F.xxhash64(F.lit(k), "hash")).alias(f"s{k}") for k in (1, 2)]
    folded = named.groupBy("entity").agg(F.sum("c").alias("n_e"), *same)
    entities = named.join(folded, "entity").select("hash", "c", "s1", "s2", "n_e").distinct()
    words = texts.select("hash", "c", F.explode("terms").alias("term"))
    counts = parts.filter("term IS NOT NULL").groupBy("term").agg(F.sum("seen").alias("n_t"))
    possible = words.groupBy("term").agg(F.sum("c").alias("n_in")).join(counts, "term").filter(F.col("n_in") >= F.col("n_t") * F.lit(2.0 ** -max(remove, generalise)))
    pairs = words.select("hash", "term").join(possible.select("term", "n_t"), "term").join(entities, "hash")
    measured = pairs.groupBy("term", "n_t", "s1", "s2", "n_e").agg(F.sum("c").alias("n_et"), F.count(F.lit(1)).alias("texts"))
    share = least_share(F.col("n_et").cast("double"), F.col("texts").cast("double"), F.col("n_t").cast("double"))
    told = F.when(share * F.lit(float(total)) > F.col("n_e"), share)
    left = -F.log2(F.max(told))
    kind = F.when(left <= remove, "term").when(left <= generalise, "class")
    return measured.groupBy("term").agg(kind.alias("kind")).filter("kind IS NOT NULL")


def places(docs: DataFrame, id_col: str, text_col: str, judged: DataFrame) -> DataFrame:
    """``id, hash, term, start, end`` of the terms that may be judged ones."""
    kind = docs.schema[id_col].dataType.simpleString()
    bits, flags = bitmap(judged.select(F.xxhash64("term").alias("h")), judged.count())
    held = docs.sparkSession.sparkContext.broadcast(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, known = held.value, {}

        def may(word: str) -> bool:
            got = known.get(word)
            if got is None:
                if len(known) >= FLUSH:
                    known.clear()
                h = xxhash.xxh64_intdigest(word.lower().encode(), 42) >> (64 - bits)
                got = known[word] = bool(int(flags[h >> 6]) >> (h & 63) & 1)
            return got

        for whole in batches:
            for b in text_batches([whole], "text"):
                out: list[tuple] = []
                for own, text, h in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("hash").to_pylist(), strict=True):
                    if text and any(map(may, set(TERM.findall(text)))):
                        out += [(own, h, text[s:e].lower(), s, e) for s, e in free_terms(text, base_spans(text)) if may(text[s:e])]
                if out:
                    kinds = (b.column("id").type, pa.int64(), pa.string(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "hash", "term", "start", "end"])

    return source(docs, id_col, text_col).mapInArrow(run, f"id {kind}, hash long, term string, start int, end int")


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """Every row: id, ``n_email, n_ip, n_card, n_phone, base_sha256, spans``, ``n_term, n_class``, and ``text_hash``.

    ``spans`` are the base spans by kind and start, then the method's by start: ``term`` ones to be removed, ``class``
    ones to be generalised.
    """
    parts = staged(read(docs, id_col, text_col), "private")
    judged = staged(disclosing(parts, remove, generalise), "private-terms")
    met = places(docs, id_col, text_col, judged).join(judged, "term").select("id", "hash", "start", "end", "kind").distinct()
    found = met.groupBy("id", "hash").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("found"))
    found = staged(found, "private-places").withColumnsRenamed({"id": "i", "hash": "h"})
    rows = parts.filter("term IS NULL").drop("entities", "terms", "term", "seen")
    all_rows = rows.join(found, F.col("id").eqNullSafe(F.col("i")) & F.col("hash").eqNullSafe(F.col("h")), "left")
    more = F.coalesce(F.col("found"), F.array().cast("array<struct<start:int,end:int,kind:string>>"))

    def of(kind: str) -> Column:
        return F.filter(more, lambda x: x["kind"] == kind)

    def texts(kind: str) -> Column:
        return F.transform(of(kind), lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))

    base = F.filter(F.array("base"), lambda x: x != "")
    spans = F.concat_ws(",", F.concat(base, texts("term"), texts("class")))
    counts = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    return all_rows.select(F.col("id").alias(id_col), *counts, spans.alias("spans"), F.size(of("term")).cast("long").alias("n_term"), F.size(of("class")).cast("long").alias("n_class"), F.col("hash").alias("text_hash"))


def masked(text: str | None, spans: str) -> str | None:
    """The text with its spans replaced: base ones by their kind, classes by the kind of word, terms by nothing."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(","))), key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        out.append(text[at:max(a, at)])
        word = text[a:b]
        out.append("" if kind == "term" else ("<Name>" if word[:1].isupper() else "<word>") if kind == "class" else f"<{kind}>")
        at = b
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with their texts masked, all columns."""
    own, h, spans = fresh(docs, "own_id", "text_hash", "spans")
    found = find_private(docs, id_col, text_col).filter("spans <> ''")
    found = found.groupBy(F.col(id_col).alias(own), F.col("text_hash").alias(h)).agg(F.first("spans").alias(spans))
    met = docs.join(found, F.col(id_col).eqNullSafe(F.col(own)) & (F.xxhash64(text_col) == F.col(h)), "left")

    @F.pandas_udf("string")
    def mask(texts, marks):
        import pandas as pd

        return pd.Series([masked(t, m) if m else t for t, m in zip(texts, marks, strict=True)], dtype=object)

    return met.withColumn(text_col, mask(F.col(text_col), F.col(spans))).select(*docs.columns)
