import hashlib
import random
import re
from collections import defaultdict

import numpy as np
from llm_cases import empty, frame, rows

from undercroft.llm import exact, mixing, quotient


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_quotient_filters_lose_nothing():
    rng = np.random.default_rng(3)
    for bits in (0, 5):
        prints = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
        many = np.concatenate([prints, prints[:700], prints[:50], np.zeros(3, np.uint64)])
        parts = defaultdict(list)
        for cut in np.array_split(rng.permutation(many), 4):
            for slab, data in quotient.filters_of(cut, bits):
                parts[slab].append(data)
        got = [quotient.decode(quotient.merge(v))[:2] for _, v in sorted(parts.items())]
        found, counts = (np.concatenate(x) for x in zip(*got, strict=True))
        want, n = np.unique(many, return_counts=True)
        assert (found == want).all() and (counts == n).all()


def test_exact_dedup_by_brute_force(spark):
    groups = defaultdict(list)
    for r in rows():
        groups[norm(r[1])].append(r[0])
    got = exact.exact_dedup(frame(spark)).collect()
    assert len(got) == len(rows())
    for r, t in [(r, t) for t in groups for r in got if r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()]:
        ids = groups[t]
        keep = min((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
    assert exact.exact_dedup(empty(spark)).count() == 0


def test_drop_copies_keeps_columns_and_one_row(spark):
    df = frame(spark)
    out = exact.drop_copies(df)
    assert out.columns == df.columns
    left = out.collect()
    assert len(left) == len({norm(r[1]) for r in rows()}) == len({norm(r.text) for r in left})
    assert exact.drop_copies(empty(spark)).count() == 0


def test_mix_targets_and_order(spark):
    rng = random.Random(1)
    data = [(k, " ".join("w" * 3 for _ in range(rng.randint(0, 60))), "en", ("a", "b", None, "c")[0 if k % 3 else k % 4], 0, None, None, None, None) for k in range(400)]
    df = frame(spark, data)
    got = mixing.mix(df).collect()
    size = {r[0]: len(r[1].split()) for r in data}
    total = defaultdict(int)
    for r in data:
        total[r[3]] += size[r[0]]
    # water filling, step by step
    weight = dict(zip(sorted((s for s in total if s is not None)) + [None], (3, 1, 2, 3), strict=True))
    target, free, left = {}, dict(weight), 1.5 * sum(total.values())
    while free:
        over = {s for s, w in free.items() if left * w / sum(free.values()) > 2 * total[s]}
        if not over:
            target |= {s: left * w / sum(free.values()) for s, w in free.items()}
            break
        for s in over:
            target[s] = 2 * total[s]
        left -= sum(2 * total[s] for s in over)
        free = {s: w for s, w in free.items() if s not in over}
    taken = defaultdict(int)
    for r in got:
        assert r.size == size[r.doc_id] and r.taken in (0, r.size, 2 * r.size) and abs(r.target - target[r.source]) < 1e-6 and r.source_size == total[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 120 for s in target)
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(7)).collect()}


def test_mix_orders_only_the_slices_it_takes(spark):
    order = mixing.staged(mixing.mix_order(frame(spark), "doc_id", mixing.words("text"), "source", (3, 1, 2), 1.5, 2), "test-order")
    plan = mixing.mixture(order)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Window [") < plan.index("Join ")  # the join feeds the window


def test_mixed_documents_are_the_mix(spark):
    rng = random.Random(2)
    data = [(k, " ".join("w" for _ in range(rng.randint(0, 60))), "en", ("a", "b", None, "c")[0 if k % 3 else k % 4], 0, None, None, None, None) for k in range(500)]
    df = frame(spark, data)
    plan = {r.doc_id: r.copies for r in mixing.mix(df).collect() if r.copies}
    assert plan == {r.doc_id: r["count"] for r in mixing.mixed_documents(df).groupBy("doc_id").count().collect()}


def test_mix_edges(spark):
    got = mixing.mix(frame(spark)).collect()
    assert len(got) == len(rows()) and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0
    out = mixing.mixed_documents(frame(spark))
    assert out.columns == frame(spark).columns and out.filter("text IS NULL OR trim(text) = ''").count() == 0
    nothing = frame(spark, [(1, None, None, "a", 0, None, None, None, None), (2, "", None, None, 0, None, None, None, None)])
    assert [r.taken for r in mixing.mix(nothing).collect()] == [0, 0]
