import math
import random

import numpy as np

from undercroft.llm import negatives
from undercroft.llm.queries import op11_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id long, n long, q string, LABEL_ string"


def frame(spark, data, parts=3):
    return spark.createDataFrame([(*r, 1, 2, "clash", "clash") for r in data], SCHEMA).repartition(parts)


def brute(data, every=50, positives=5, count=3, band=(50, 95)):
    rows = {}
    for i, v, label in data:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * float(np.float32(x))) for x in v]
            rows[i] = min(rows.get(i, (label, q)), (label, q))
    out = []
    for a, (la, qa) in rows.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(qa, q)), i, la == lb) for i, (lb, q) in rows.items() if i != a and len(q) == len(qa))
        for p, pid, _ in [s for s in scored if s[2]][:positives]:
            fit = [(s, i) for s, i, same in scored if not same and band[0] * -p <= 100 * -s <= band[1] * -p][:count]
            out += [(a, pid, k, i, -p, -s) for k, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def vectors(rng, n, size=16, labels=4):
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(labels)]
    out = []
    for i in range(n):
        label = rng.randrange(labels)
        v = [c + rng.gauss(0, 0.8) for c in centres[label if rng.random() < 0.7 else rng.randrange(labels)]]
        length = math.sqrt(sum(x * x for x in v))
        out.append((i - 60, [x / length for x in v], label))
    return out


def test_packed_scores_are_inner_products():
    rng = np.random.default_rng(1)
    for size, reach in ((7, 5), (64, 300), (64, 1 << 20), (3, 1 << 40), (2, 1 << 62), (0, 1), (5, 0)):
        rows = rng.integers(-reach, reach + 1, (50, size))
        rows[:3] = reach
        for anchor in (*rows[:4].tolist(), [-reach] * size):
            span = max(anchor, default=0) - min(anchor, default=0)
            got = negatives.Packed(rows, max(span, 2)).scores(anchor)
            want = [negatives.held(sum(a * x for a, x in zip(anchor, r))) for r in rows.tolist()]
            assert got.tolist() == want


def test_hard_negatives_by_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    data = vectors(rng, 400)
    hot = data[3][1]
    data += [(1000 + k, hot, k % 3) for k in range(130)]  # copies of one vector, a third of the rows, anchors among them
    for rows, anchors in ((4096, 1024), (50, 3)):
        monkeypatch.setattr(negatives, "ROWS", rows)
        monkeypatch.setattr(negatives, "ANCHORS", anchors)
        assert found(negatives.hard_negatives(frame(spark, data, 7), every=10)) == brute(data, 10)


def test_hard_negatives_edges(spark):
    rng = random.Random(3)
    data = vectors(rng, 150, 6, 2)
    data += [(None, [1.0] * 6, 1), (300, None, 1), (350, [1.0] * 6, None), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (450, [float("nan")] + [0.0] * 5, 1), (500, [float("inf")] + [0.0] * 5, 1)]
    data += [(550, [0.0] * 6, 1), (600, [], 0), (601, [], 0), (602, [], 1), (650, [0.5, 0.25], 0), (651, [0.5, 0.5], 0), (652, [0.5, 0.0], 1)]  # zero, empty and shorter vectors
    data += [data[0], data[0], (data[61][0], [0.3] * 6, 0)]  # repeated rows, an id with two vectors
    data += [(700, [3e38] * 6, 0), (701, [3e38] * 6, 0), (702, [2e38] * 6, 1)]  # beyond 64 bits: no failure
    got = found(negatives.hard_negatives(frame(spark, data), every=50))
    small = [r for r in data if r[0] is None or r[0] < 700]
    assert [r for r in got if r[0] != 700 and max(r[1], r[3]) < 700] and [r for r in got if r[0] == 700] == [r for r in got if r[0] == 700 and abs(r[4]) <= 2**63]
    assert found(negatives.hard_negatives(frame(spark, small), every=50)) == brute(small)
    assert {r[0] for r in brute(small)} >= {600, 650}
    assert negatives.hard_negatives(frame(spark, [])).count() == 0
    few = [(50, [1.0, 0.0], 1), (51, [0.9, 0.1], 1), (52, [0.8, 0.0], 2)]  # fewer than asked for
    assert found(negatives.hard_negatives(frame(spark, few))) == brute(few) != []


def test_query_moves_labels(spark, tmp_path):
    data = [(i, v, label) for i, v, label in vectors(random.Random(4), 300, 8, 10) if i >= 0]
    frame(spark, data).write.parquet(f"{tmp_path}/embeddings.parquet")
    moved = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in data]
    assert found(op11_hard_negatives(spark, str(tmp_path))) == brute(moved) != []
