"""A small documents table with every awkward case, and helpers."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, id long, fp long, TEXT_ string"


def prose(rng, n, words=None):
    words = words or [a + b for a in ("th", "er", "in", "on", "at", "re") for b in ("a", "ed", "ing", "ion", "es", "ly", "er")]
    return " ".join(rng.choice(words) for _ in range(n))


def rows():
    rng = random.Random(5)
    long = prose(rng, 9000)
    base, passage = prose(rng, 120), prose(rng, 90)
    texts = [None, "", " \t\n", "!!! 12 ??", "Word", long, long, base, base.replace(" ", "\n ", 3), base, base + " tail", passage + "\n" + prose(rng, 60), prose(rng, 70) + "\n" + passage,
             "x" * 5000, "x" * 5000, "é" * 900, "mail a.b@c.example.org now", prose(rng, 30), prose(rng, 30), "Ünïcode \u0301 <|endoftext|> text"]
    out = []
    for k, t in enumerate(texts):
        out.append((k, t, None if k % 7 == 3 else "en" if k % 2 else "fr", None if k % 5 == 4 else f"s{k % 3}", None if t is None else len(t), "clash", -k, None, "x"))
    out.append(out[7])  # a repeated row
    out.append((None, base, "en", None, 1, None, None, None, None))
    out.append((None, None, None, None, None, None, None, None, None))
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
