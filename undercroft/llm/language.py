"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features are runs of one to three characters inside a word, its two borders included, hashed to
``BUCKETS`` buckets.  Letters are lower-cased, everything else is a border.  Counts of a language and
bucket are summed over all training texts: each task keeps one matrix and gives its non-zero cells.
The model is a matrix of log probabilities with ``BUCKETS`` columns and a row per language; its size
is bounded by ``MAX_LANGUAGES`` (an error beyond it), so it is broadcast.  Texts are scored in batches
by gathering columns of the matrix and summing them by text.

Defined results: a text that is null or has no letter is ``und`` with score 0.  Ties go to the first
language by code point.  Without training rows every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undercroft.llm.common import text_batches

BUCKET_BITS, ORDERS, MAX_LANGUAGES, SMOOTH = 16, (1, 2, 3), 512, 0.5
BUCKETS = 1 << BUCKET_BITS
#: Characters that are featurised at once; longer texts are cut at a border.
PIECE = 500_000
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """``log_prob``: a row per bucket, a column per language."""

    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray


def letters() -> np.ndarray:
    """Of every code point."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def pieces(texts: list, is_letter: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points with borders as blanks, a blank around each text, and the number of the text of each point."""
    points, owner, size, edge = [], [], 0, np.full(1, 32, np.uint32)
    for i, text in enumerate(texts):
        if not text:
            continue
        whole = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        whole = np.where(is_letter[whole], whole, np.uint32(32))
        at = 0
        while at < len(whole):
            end = min(len(whole), at + PIECE)
            if end < len(whole):
                blank = np.flatnonzero(whole[at:end] == 32)
                end = at + int(blank[-1]) + 1 if len(blank) else end
            points += [edge, whole[at:end], edge]
            owner.append((i, end - at + 2))
            size += end - at + 2
            at = end
            if size >= PIECE:
                yield np.concatenate(points), np.repeat(*map(np.array, zip(*owner, strict=True)))
                points, owner, size = [], [], 0
    if size:
        yield np.concatenate(points), np.repeat(*map(np.array, zip(*owner, strict=True)))


def grams(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets of its n-grams and where they begin."""
    blank, wide = points == 32, points.astype(np.uint64)
    key = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(points) < n:
            return
        key = key[: len(points) - n + 1] * np.uint64(0x100000001B3) + wide[n - 1:] + np.uint64(n)
        use = ~blank if n == 1 else ~(blank[:-1] & blank[1:]) if n == 2 else ~blank[1:-1] if n == 3 else ~np.lib.stride_tricks.sliding_window_view(blank[1:-1], n - 2).any(1)
        if n in ORDERS:
            at = np.flatnonzero(use)
            mixed = key[at] * MULTIPLY
            yield ((mixed ^ (mixed >> np.uint64(29))) * MULTIPLY >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), at


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over every row whose language is not null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter, names, cells, texts = letters(), {}, {}, {}
        for whole in batches:
            for b in text_batches([whole], "text"):
                langs = b.column("lang").to_pylist()
                code = np.array([names.setdefault(x, len(names)) for x in langs])
                for x in langs:
                    texts[x] = texts.get(x, 0) + 1
                for points, owner in pieces(b.column("text").to_pylist(), is_letter):
                    for bucket, at in grams(points):
                        lang = code[owner[at]]
                        for k in np.unique(lang):
                            got = np.bincount(bucket[lang == k], minlength=BUCKETS)
                            cells[k] = cells[k] + got if k in cells else got
        for name, k in names.items():
            where = np.flatnonzero(cells.get(k, np.zeros(1)))
            bucket = np.r_[-1, where]
            n = np.r_[texts[name], cells[k][where]] if len(where) else np.array([texts[name]])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(bucket)), pa.array(bucket.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "bucket", "n"])

    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    cells = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    from undercroft.llm.common import staged

    cells = staged(cells, "language")
    languages = sorted(r[0] for r in cells.filter("bucket = -1").select("lang").limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the model would be too large to broadcast")
    got = cells.toPandas()  # at most MAX_LANGUAGES x BUCKETS cells
    index = {x: k for k, x in enumerate(languages)}
    counts, prior = np.zeros((BUCKETS, len(languages))), np.zeros(len(languages))
    code, bucket, n = got["lang"].map(index).to_numpy(int), got["bucket"].to_numpy(), got["n"].to_numpy()
    prior[code[bucket < 0]] = n[bucket < 0]
    counts[bucket[bucket >= 0], code[bucket >= 0]] = n[bucket >= 0]
    log_prob = np.log(counts + SMOOTH) - np.log(counts.sum(0) + SMOOTH * BUCKETS)
    return Model(languages, np.log(prior / max(prior.sum(), 1)) if languages else prior, np.ascontiguousarray(log_prob.T))


def score_texts(texts: list, model: Model, is_letter: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text."""
    total, seen = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), bool)
    for points, owner in pieces(texts, is_letter):
        for bucket, at in grams(points):
            if len(at):
                who = owner[at]
                first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
                for k in range(len(model.languages)):
                    total[who[first], k] += np.add.reduceat(model.log_prob[k][bucket], first)
                seen[who[first]] = True
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    total += model.log_prior
    best = total.argmax(1)
    share = 1 / np.exp(np.maximum(total - total.max(1, keepdims=True), -700)).sum(1)
    return [model.languages[k] if s else "und" for k, s in zip(best, seen, strict=True)], np.where(seen, np.round(share, 9), 0.0)


def identify(docs: DataFrame, model: Model, text_col: str, keep: list[Column], keep_schema: str) -> DataFrame:
    """The ``keep`` columns with ``lang_pred`` and ``score``."""
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_prior, model.log_prob))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter, known = letters(), Model(*held.value)
        for whole in batches:
            for b in text_batches([whole], "text__"):
                lang, score = score_texts(b.column("text__").to_pylist(), known, is_letter)
                rest = [b.column(i) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score"])

    return docs.select(*keep, F.col(text_col).alias("text__")).mapInArrow(predict, f"{keep_schema}, lang_pred string, score double")


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Rows whose id's CRC-32 is divisible by ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """Every document with ``held_out, lang_pred, score``; the model learns from the rows that are not held out."""
    model = train(docs.filter(~held_out(id_col, folds)), text_col, lang_col)
    kind = docs.schema[id_col].dataType.simpleString()
    return identify(docs, model, text_col, [F.col(id_col).alias("id__"), held_out(id_col, folds).alias("held_out")], f"id__ {kind}, held_out boolean").withColumnRenamed("id__", id_col)


def known_language(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text has letters and a language with a probability of at least ``least``, all columns."""
    model = train(docs.filter(~held_out(id_col)), text_col, lang_col)
    if not model.languages:  # nothing was learned: only texts without letters go
        return docs.filter(F.col(text_col).rlike(r"\p{L}"))
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_prior, model.log_prob))
    text_at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter, known = letters(), Model(*held.value)
        for whole in batches:
            for b in text_batches([whole], whole.schema.names[text_at]):
                lang, score = score_texts(b.column(text_at).to_pylist(), known, is_letter)
                yield b.filter(pa.array((np.array(lang) != "und") & (score >= least)))

    own = [f"c{i}" for i in range(len(docs.columns))]
    out = docs.toDF(*own)
    return out.mapInArrow(keep, out.schema).toDF(*docs.columns)
