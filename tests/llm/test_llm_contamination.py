import random
import re

from llm_cases import SCHEMA, empty, frame, prose, rows

from undercroft.llm import contamination as leak

ITEMS = "item_id long, text string, doc_id long, words string, k long"


def items_frame(spark, data):
    return spark.createDataFrame([(i, t, 1, "clash", 2) for i, t in data], ITEMS).repartition(2)


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, window=10, size=5, share=1.0):
    """n_words, hit words, items of every document."""
    out = []
    for text in docs:
        w, hit, names = words_of(text), set(), set()
        for item, source in items:
            own = words_of(source)
            n = min(window, len(own))
            k = n - min(size, n) + 1
            for j in range(len(own) - n + 1 if own else 0):
                part = own[j:j + n]
                for i in range(len(w) - n + 1):
                    if share == 1:
                        held = w[i:i + n] == part
                    else:
                        s = min(size, n)
                        held = sum(w[i + x:i + x + s] == part[x:x + s] for x in range(k)) >= share * k - 1e-9
                    if held:
                        hit |= set(range(i, i + n))
                        names.add("" if item is None else str(item))
        out.append((len(w), sorted(hit), sorted(names)))
    return out


def found(df):
    return sorted((r.n_words, [p for s in r.spans for p in range(s.start, s.end)], list(r["items"])) for r in df.collect())


def planted(rng, n=60):
    items = [(k, prose(rng, rng.choice((1, 4, 9, 10, 11, 30)))) for k in range(12)]
    items = [(i, t if len(t.split()) > 1 else "Zebra!") for i, t in items]
    docs = []
    for _ in range(n):
        parts = [prose(rng, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            own = rng.choice(items)[1].split()
            a = rng.randint(0, max(0, len(own) - 10))
            parts += [rng.choice((" ", "\n", " -- ")).join(own[a:a + rng.randint(8, 14)]).upper(), prose(rng, rng.randint(0, 30))]
        docs.append(" ".join(parts))
    return docs, items


def test_contamination_by_brute_force(spark):
    rng = random.Random(1)
    docs, items = planted(rng)
    items += [(3, items[4][1]), (20, items[5][1]), (None, items[6][1])]  # an id twice, a text twice, no id
    df = frame(spark, [(k, t, None, None, 0, None, None, None, None) for k, t in enumerate(docs)])
    want = brute(docs, items)
    assert any(h for _, h, _ in want) and any(not h for _, h, _ in want)
    assert found(leak.contamination(df, items_frame(spark, items))) == sorted(want)
    for share, size in ((0.5, 3), (0.8, 5)):
        got = found(leak.contamination(df, items_frame(spark, items), share=share, shingle=size))
        assert got == sorted(brute(docs, items, size=size, share=share))
    kept = {r.doc_id for r in leak.drop_contaminated(df, items_frame(spark, items)).collect()}
    assert kept == {k for k, (_, h, _) in enumerate(want) if not h}


def test_long_texts_are_cut_and_lose_nothing(spark, monkeypatch):
    rng = random.Random(2)
    items = [(k, prose(rng, 25)) for k in range(3)]
    docs = [" ".join([*([prose(rng, 300), items[k % 3][1]] * 4), *([items[0][1]] * 90)]) for k in range(3)] + ["y" * 3_000_000, "é " * 200_000 + items[1][1]]
    df = frame(spark, [(k, t, None, None, 0, None, None, None, None) for k, t in enumerate(docs)])
    assert [w for p in leak.pieces(docs[0].encode(), 100) for w in p] == docs[0].encode().lower().split()
    want = sorted(brute(docs[:4], items) + [(200_025, list(range(200_000, 200_025)), ["1"])])
    assert found(leak.contamination(df, items_frame(spark, items))) == want
    assert list(leak.segments(leak.np.array([1, 2, 50, 51, 52]), 5, 2)) == [(0, 2), (2, 4), (4, 5)]


def test_contamination_edges(spark):
    data, none = rows(), items_frame(spark, [])
    texts = [r[1] for r in data]
    items = [(1, None), (2, ""), (3, "!! ?"), (4, "WORD"), (5, texts[7]), (6, "é" * 900), (None, "mail A.B")]
    got = leak.contamination(frame(spark), items_frame(spark, items))
    assert got.columns == ["doc_id", "n_words", "spans", "items"]
    assert found(got) == sorted(brute(texts, items))
    assert found(leak.contamination(frame(spark), none)) == sorted((len(words_of(t)), [], []) for t in texts)
    assert leak.contamination(empty(spark), items_frame(spark, items)).count() == 0
    out = leak.drop_contaminated(frame(spark), items_frame(spark, items))
    assert out.columns == frame(spark).columns == [c.split()[0] for c in SCHEMA.split(", ")]
