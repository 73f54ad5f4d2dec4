import hashlib
import random
import zlib
from collections import defaultdict

from undercroft.llm import trie
from undercroft.llm.queries import op12_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, c long, pos string, path binary, TURNS string"


def frame(spark, data, parts=3):
    return spark.createDataFrame([(*r, 1, "clash", b"x", None) for r in data], SCHEMA).repartition(parts)


def sequences(data):
    """Turns of each conversation in order; ties by the operator's digest."""
    out = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            out[c].append(((turn is not None, turn or 0), digest, (role, text)))
    return {c: [t for *_, t in sorted(v)] for c, v in out.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        lead = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(lead, [])[:h] + turns[h:]
    return out


def brute(conversations):
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
        saved[path] = own + sum(saved[k] for k in children[path])
    out = []
    for path, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(conversations[c]) == len(path))
        out.append((min(of), len(path), min(members[path[:-1]]) if path else None, len(of), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def talks(rng, n):
    """Conversations that share turns: a third begin alike, some are copies, some are long."""
    data = []
    for c in range(n):
        length = rng.choice((1, 2, 3, 4, 7, 12))
        for d in range(length):
            text = "hello é" if d == 0 and rng.random() < 0.4 else f"t{rng.randrange(3)}" * (d + 1)
            data.append((c * 3 - 20, d, rng.choice(("user", "assistant")) if d else "user", text))
    for c in range(5000, 5000 + n // 2):  # copies, longer than the sort key
        data += [(c, d, "user", f"same {d}") for d in range(10)] + ([(c, 10, "user", f"x{c % 3}")] if c % 2 else [])
    return data


def test_shards_and_spine_by_brute_force(spark):
    data = talks(random.Random(1), 120)
    own = sequences(data)
    conversations = trie.sequences(trie.ordered_turns(frame(spark, data, 5)))
    want = brute(own)
    for shard in (4096, 7, 1):
        held = trie.prefix_trie(conversations, shard)
        assert found(trie.node_digests(held)) == want
        if shard == 1:
            assert held.spine.count() == sum(r[3] > 1 for r in want)


def test_nodes_hold_end_lists(spark):
    data = [(1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "u", "b"), (3, 0, "u", "c")]
    held = trie.prefix_trie(trie.sequences(trie.ordered_turns(frame(spark, data, 1))))
    ends = sorted((r.depth, r.conv_id, r.ends) for r in trie.nodes(held).collect() if r.ends is not None and r.depth)
    assert ends == [(1, 1, [1]), (1, 3, [3]), (2, 2, [2])]


def test_query_by_brute_force_and_edges(spark, tmp_path):
    rng = random.Random(3)
    data = talks(rng, 90)
    data += [(None, 0, "user", "lost"), (7001, None, "user", "null first"), (7001, -1, None, None), (7001, 5, "user", ""), (7001, 5, "user", ""), (7001, 5, "a", "tie")]
    data += [(8000, d, "user", "long " * 3000 if d == 3 else "y") for d in range(300)] + [(8001, d, "user", "y") for d in range(280)]  # deep and large
    frame(spark, data).write.parquet(f"{tmp_path}/a/conversations.parquet")
    own = rebuilt(sequences(data))
    assert any(not turns for turns in own.values())  # without turns: ends at the root
    assert found(op12_prefix_trie(spark, f"{tmp_path}/a")) == brute(own)
    frame(spark, []).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert op12_prefix_trie(spark, f"{tmp_path}/b").count() == 0
