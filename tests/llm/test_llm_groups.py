import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from llm_cases import SCHEMA, empty, frame, prose, rows

from undercroft.llm import components, neighbours, passages, simhash, suffixes
from undercroft.llm.queries import op2_passages


def classes_of(n, pairs):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(k) for k in range(n)]


def test_components_of_a_long_chain_and_a_star(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 300)] + [(500, 500)]
    rng.shuffle(edges)
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 300)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chain_keys_miss_no_pair():
    masks = simhash.segment_masks()
    assert sum(masks) == (1 << 64) - 1
    rng = random.Random(2)
    for chain in (4, 6, 8):
        keys = [sum(masks[e] for e in equal) for _, equal in simhash.chain_keys(chain)]
        for _ in range(3000):
            differ = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(differ & m == 0 for m in keys)
    x = np.array([0], np.uint64)
    for bits in combinations(range(0, 64, 5), 4):
        y = np.array([sum(1 << b for b in bits)], np.uint64)
        assert any(simhash.within(x, y, s)[0] for s in range(9))


def test_fingerprint_by_hand():
    import xxhash

    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One Two") == xxhash.xxh64_intdigest(b"one two", 42)
    words = "a b c d e f".split()
    h = [xxhash.xxh64_intdigest(" ".join(words[k:k + 4]).encode(), 42) for k in range(3)]
    assert simhash.fingerprint("A b\tC d\n\ne  f") == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) > 1.5)


def test_simhash_links_by_brute_force(spark):
    rng = random.Random(4)
    family = [rng.getrandbits(64)]
    while len(family) < 150:
        family.append(family[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints = list(dict.fromkeys(family + [rng.getrandbits(64) for _ in range(100)] + [0, (1 << 64) - 1]))
    near = [(i, j) for i, j in combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = classes_of(len(prints), near)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    for most in (4096, 8):  # the second sends keys to the balls
        got = {r.fp: r.component_id for r in simhash.near_groups(df, most).collect()}
        assert [got[s] for s in signed] == want


def test_simhash_edges(spark):
    got = simhash.near_dedup(frame(spark)).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].component_id == by[1].component_id == 0 and by[0].fingerprint == "0" * 16 and by[8].component_id == 7
    assert simhash.near_dedup(empty(spark)).count() == 0
    left = simhash.drop_near_copies(frame(spark))
    assert left.columns == frame(spark).columns and {r.doc_id for r in left.collect()} == {r.component_id for r in got}
    assert simhash.drop_near_copies(empty(spark)).count() == 0


def test_nearest_by_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    data = [(int(k), [float(x) for x in centres[k % 20] + 0.4 * rng.normal(size=16)]) for k in range(1500)]
    data += [(k, data[0][1]) for k in range(2000, 2300)]  # a very common vector
    odd = [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] * 16), (5200, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame(data + odd + [data[50]], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ids, v = np.array([d[0] for d in data]), np.array([d[1] for d in data], np.float32).astype(float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    asked = [k for k in ids if k % 50 == 0]
    assert set(got) == set(asked)
    hits = 0
    for q in asked:
        score = unit @ unit[list(ids).index(q)]
        best = sorted((-round(s, 12), i) for s, i in zip(score, ids, strict=True) if i != q)[:5]
        hits += len({i for _, i in best} & {i for i, _ in got[q]})
        assert len(got[q]) == 5 and all(abs(s - score[list(ids).index(i)]) < 1e-9 for i, s in got[q])
    assert hits >= 0.9 * 5 * len(asked)
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert neighbours.nearest(df.filter("vec_id IN (50, 51)")).count() == 1


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "VISITS", 5)
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(int(k), [float(x) for x in rng.normal(size=8)]) for k in range(1000)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, recall=1.0).collect()
    assert len(got) == 100 and {r["rank"] for r in got} == {1, 2, 3, 4, 5}


def near_lines(text):
    out, at = [], 0
    low = (text or "").encode().translate(passages.LOWER)
    for line in low.split(b"\n"):
        w = line.split()
        if len(w) >= 50:
            a = at + line.find(w[0])
            out.append((a, at + line.rfind(w[-1]) + len(w[-1]), frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4))))
        at += len(line) + 1
    return out


def test_passages_by_brute_force(spark):
    rng = random.Random(7)
    line = prose(rng, 100).split()
    data = []
    for k in range(120):
        own = list(line)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(100)] = "zz" + str(rng.randrange(50))
        text = prose(rng, 60) + ("\n" + " ".join(own) if k % 2 else "") + "\nshort line"
        data.append((k, text, None, None, 0, None, None, None, None))
    lines = [(k, *x) for k, t, *_ in data for x in near_lines(t)]
    near = [(i, j) for i, j in combinations(range(len(lines)), 2) if len(lines[i][3] & lines[j][3]) >= 0.8 * len(lines[i][3] | lines[j][3])]
    root = classes_of(len(lines), near)
    cuts = defaultdict(list)
    for i, r in enumerate(root):
        if r != i:
            cuts[lines[i][0]].append(lines[i][1:3])
    for most in (2048, 16):  # the second meets a family in pairs of blocks
        got = {r.doc_id: r for r in passages.drop_passages(frame(spark, data), most=most).collect()}
        for k, t, *_ in data:
            kept, gone, runs = passages.remove(t.encode(), cuts[k])
            assert (got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (gone, runs, hashlib.sha256(kept).hexdigest())


def brute_runs(texts, size):
    """Byte spans of the windows of words that an equal one, not overlapping, comes before."""
    first, cuts = {}, defaultdict(list)
    for k, t in enumerate(texts):
        at = [(m.start(), m.end(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t.encode().translate(passages.LOWER))]
        for i in range(len(at) - size + 1):
            a, b = at[i][0], at[i + size - 1][1]
            doc, end = first.setdefault(tuple(w for *_, w in at[i:i + size]), (k, b))
            if doc != k or end <= a:
                cuts[k].append((a, b))
    return cuts


def test_passages_whatever_the_lines_by_brute_force(spark):
    rng = random.Random(17)
    shared = [prose(rng, n).split() for n in (50, 51, 60, 140)]
    texts = []
    for k in range(80):
        parts = [prose(rng, rng.randint(1, 30))]
        for _ in range(rng.randint(0, 3)):
            own = rng.choice(shared)
            cut = rng.choice((0, 0, 1, 30))
            parts += ["".join(w + rng.choice((" ", " ", " ", "\n", " \n\t")) for w in own[cut:]), prose(rng, rng.randint(1, 30)).upper()]
        texts.append(" ".join(parts) + "\n" * (k % 2))
    texts += ["x " * 300, "y\n" * 99, "y\n" * 100, " ".join(["é"] + shared[3])]
    want = brute_runs(texts, 50)
    data = [(k, t, None, None, 0, None, None, None, None) for k, t in enumerate(texts)]
    data.append(data[3])  # a repeated row is the same document
    assert len(want) > 30
    seen = []
    for most in (2048, 4):  # the second meets most anchors as rows of single windows
        got = {r.doc_id: r for r in passages.drop_passages(frame(spark, data), least=10_000, runs=50, most=most).collect()}
        seen.append([(k, got[k].repeats_of) for k in sorted(got)])
        for k, t in enumerate(texts):
            kept, gone, n = passages.remove(t.encode(), want[k])
            assert (got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (gone, n, hashlib.sha256(kept).hexdigest()), k
    assert seen[0] == seen[1]


def test_passages_query_crosses_lines(spark, tmp_path):
    rng = random.Random(18)
    own = prose(rng, 120).split()
    texts = [prose(rng, 9) + " " + " ".join(own), "\n".join(" ".join(own[k:k + 12]) for k in range(0, 120, 12))]
    frame(spark, [(k, t, None, None, 0, None, None, None, None) for k, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op2_passages(spark, str(tmp_path)).collect()}
    assert got[0].n_removed == 0 and got[1].n_removed == len(texts[1]) and got[1].repeats_of == [0]


def test_passages_edges(spark):
    got = passages.drop_passages(frame(spark)).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[11].n_removed == 0 and by[12].n_removed > 0 and by[12].repeats_of == [11] and by[17].repeats_of == []
    assert passages.drop_passages(empty(spark)).count() == 0
    assert passages.tuned(0.8, 0.999, 3) == 10


def test_local_text_by_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        n, letters, least = rng.choice([1, 2, 5, 50, 300]), rng.choice([2, 3, 8]), rng.choice([1, 2, 3, 5, 9, 20])
        t = np.array([rng.randrange(97, 97 + letters) if rng.random() > 0.03 else 255 for _ in range(n)], np.uint8)
        if n > 60:
            t[n // 2:n // 2 + 25] = t[:25]
        raw = t.tobytes()
        count = Counter(raw[i:i + least] for i in range(n - least + 1))
        assert suffixes.repeated_starts(t, least)[:max(0, n - least + 1)].tolist() == [count[raw[i:i + least]] > 1 for i in range(n - least + 1)]


def brute_bytes(texts, least):
    count = Counter(t[k:k + least] for t in texts for k in range(len(t) - least + 1))
    return [passages.remove(t, [(k, k + least) for k in range(len(t) - least + 1) if count[t[k:k + least]] > 1]) for t in texts]


def test_suffix_dedup_by_brute_force(spark):
    rng = random.Random(11)
    shared = [prose(rng, 25) for _ in range(6)]
    data = []
    for k in range(150):
        parts = [rng.choice(shared)[rng.randrange(30):] if rng.random() < 0.6 else prose(rng, rng.randint(1, 30)) for _ in range(rng.randint(0, 5))]
        data.append((k, "".join(parts) + "é" * (k % 3), None, None, 0, None, None, None, None))
    data += [(900, "ab" * 400, None, None, 0, None, None, None, None), data[3]]
    want = brute_bytes([r[1].encode() for r in data], 60)
    for options in ({}, {"most": 300}, {"local": 500}):  # the second counts digests
        got = {r.doc_id: r for r in suffixes.repeated_bytes(frame(spark, data), least=60, gram=25, **options).collect()}
        for r, (kept, gone, runs) in zip(data, want, strict=True):
            assert (got[r[0]].n_removed, got[r[0]].n_spans, got[r[0]].kept_sha256) == (gone, runs, hashlib.sha256(kept).hexdigest()), r[0]


def test_suffix_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 700)
    rng = random.Random(12)
    common = prose(rng, 200)
    data = [(k, prose(rng, 300) + common + prose(rng, 100 * k), None, None, 0, None, None, None, None) for k in range(4)]
    want = brute_bytes([r[1].encode() for r in data], 400)
    got = {r.doc_id: r for r in suffixes.repeated_bytes(frame(spark, data)).collect()}
    assert all((got[k].n_removed, got[k].n_spans) == want[k][1:] for k in range(4))


def test_suffix_edges(spark):
    got = suffixes.repeated_bytes(frame(spark)).collect()
    assert len(got) == len(rows())
    want = brute_bytes([(r[1] or "").encode() for r in rows()], 400)
    by = {r[0]: w for r, w in zip(rows(), want, strict=True) if r[0] is not None}
    assert all((r.n_removed, r.n_spans) == by[r.doc_id][1:] for r in got if r.doc_id is not None)
    assert suffixes.repeated_bytes(empty(spark)).count() == 0
    assert SCHEMA
