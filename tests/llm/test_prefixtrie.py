"""The trie of conversations against a plain program over all prefixes."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tacgrid.llm import prefixtrie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def words(text):
    return len([w for w in re.split("[ \t-\r]+", text) if w])


def plain_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), role, key, text))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    return {c: own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:] for c, v in own.items() if (h := zlib.crc32(str(c).encode()) % 4) is not None}


def plain_nodes(built):
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    own = {p: (len(m) - 1) * words(p[-1][1]) if p else 0 for p, m in members.items()}
    kids = {p: 0 for p in members}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += own[p]
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


def told(frame):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in frame.collect())


def some_rows(seed, n, turns, choices):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, turns)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(choices)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns", [1, 7, 60, 1 << 17])
def test_equals_plain(spark, shard_turns):
    rows = some_rows(shard_turns, 150, 6, ["a b", "c", "", None, "long words here\tand there"])
    got = P.conversation_trie(spark.createDataFrame(rows, SCHEMA), shard_turns=shard_turns)
    assert told(got) == plain_nodes(plain_rebuilt(rows))


def test_long_shared_prefix_over_many_shards(spark, monkeypatch):
    """Prefixes of 60 turns that all shards share, conversations that end inside others, and a group of copies."""
    monkeypatch.setattr(P, "ID_RANGE", 8)
    rows = [(c, t, "user", f"turn {t} " * (t % 3)) for c in range(40) for t in range(20 + c)] + [(c, 100, "user", f"own {c % 7}") for c in range(40)]
    rows += [(1000 + 20 * c, t, "u", "copy of it") for c in range(50) for t in range(3)]
    for size in (1, 300):
        got = P.conversation_trie(spark.createDataFrame(rows, SCHEMA), shard_turns=size)
        assert told(got) == plain_nodes(plain_rebuilt(rows))


def test_edges(spark):
    frame = lambda rows: P.conversation_trie(spark.createDataFrame(rows, SCHEMA))
    assert frame([]).collect() == [] and frame([(None, 1, "a", "b")]).collect() == []
    rows = [(7, None, None, None), (7, 1, "u", "x"), (7, 1, "u", "x"), (7, 1, "u", "y"), (7, 1, "a", "z"), (-3, 2, "a", "b"), (41, 1, "u", "only one"), (None, 1, "a", "b")]
    assert told(frame(rows)) == plain_nodes(plain_rebuilt(rows))  # a negative id's base is found by the remainder as SQL has it
    wide = spark.createDataFrame([(5, 1, "u", "w " * 100_000, "k", "p")], SCHEMA + ", key string, path string")
    assert P.conversation_trie(wide).count() == (1 if zlib.crc32(b"5") % 4 else 2)


def test_turnless_conversations(spark):
    """Conversations of fewer turns than are replaced, without a base: members of the root."""
    rows = [(c, 0, "u", "t") for c in range(21, 40)]
    got = told(P.conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain_nodes(plain_rebuilt(rows)) and got[0][3] == 19


def test_double_array_holds_what_was_put():
    rng = np.random.default_rng(1)
    trie = P.DoubleArray(4)
    states, held = [0], {}
    for _ in range(300):
        s = states[len(held) % len(states)]
        if any(k[0] == s for k in held):
            s = next(x for x in states if not any(k[0] == x for k in held))
        turns = np.unique(rng.integers(0, 500, rng.integers(1, 6)))
        trie.put(s, turns) if len(turns) > 1 else trie.put_single(np.array([s]), turns)
        for t in turns.tolist():
            held[s, t] = int(trie.base[s]) + t
        states += [held[s, t] for t in turns.tolist()]
    assert len(set(held.values())) == len(held)
    for (s, t), to in held.items():
        assert trie.step(np.array([s]), np.array([t]))[0] == to
        absent = (t + 1) % 500
        if (s, absent) not in held:
            assert trie.step(np.array([s]), np.array([absent]))[0] == -1


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(P.op12_trie(spark, "/root/testdata/sf0.01")) == plain_nodes(plain_rebuilt(rows))
