import hashlib
from collections import Counter

import numpy as np
import pytest

from tacgrid.llm import suffixdedup as S


def plain(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        out.append((len(t), bytes(np.frombuffer(t, np.uint8)[~gone]), edges.tolist()))
    return out


def corpus():
    rng = np.random.default_rng(3)
    text = lambda n: "".join(rng.choice(list("abcé \n"), n))
    passage, other = text(900), text(450)
    docs = [text(int(n)) for n in rng.integers(0, 3000, 12)]
    docs += [text(100) + passage + text(50), text(333) + passage, passage + text(7), text(400) + passage[100:640] + other, other + text(20) + other]
    docs += [docs[3], docs[3], docs[4][:700] + "X" + docs[4][700:], "aaaa" * 300, "ab" * 450, None, "", "short", text(399), "é" * 700]
    docs += [passage[k : k + 420 + k] + text(5) for k in range(0, 400, 37)]
    return docs


@pytest.mark.parametrize("together", [256, 2, 1])
def test_same_as_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(S, "TOGETHER", together)
    monkeypatch.setattr(S, "PIECE", 1000)
    monkeypatch.setattr(S, "BLOCK", 5000)
    docs = corpus()
    rows = [(i, t, b"x", 1) for i, t in enumerate(docs)] + [(3, docs[3], b"x", 1), (None, docs[5], b"y", 2), (7, docs[6], b"z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept binary, n int")
    got = sorted((str(r["doc_id"]), r["n_bytes"], bytes(r["kept"]), r["spans"]) for r in S.drop_repeats(df).collect())
    want = plain([(r[1] or "").encode() for r in rows], S.LENGTH)
    assert got == sorted((str(r[0]), *w) for r, w in zip(rows, want, strict=True))


def test_planted_passages(spark, tmp_path):
    """Passages of over 50 words are told by n_removed, whatever n_bytes is; what decides is 400 bytes, not the words."""
    rng = np.random.default_rng(7)
    words = lambda n, size: " ".join("".join(rng.choice(list("abcdefghijklmnop"), size)) for _ in range(n))
    passages, short = [words(51 + k, 8) for k in range(5)], words(60, 5)
    assert len(short) < S.LENGTH <= min(map(len, passages))
    planted = [words(int(rng.integers(0, 400)), 6) + " " + p + " " + words(int(rng.integers(0, 40)), 6) for p in passages for _ in range(3)]
    clean = [words(int(rng.integers(1, 600)), 6) for _ in range(20)] + [words(9, 6) + " " + short, short + " " + words(70, 6)]
    texts = [*planted, *clean]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in S.op10_repeats(spark, str(tmp_path)).orderBy("doc_id").collect()]
    want = [(i, n, n - len(kept), len(edges) // 2, hashlib.sha256(kept).hexdigest()) for i, (n, kept, edges) in enumerate(plain([t.encode() for t in texts], S.LENGTH))]
    assert got == want
    assert [r[2] > 0 for r in got] == [True] * len(planted) + [False] * len(clean)


def test_empty(spark):
    assert S.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cover_reaches_all_pairs():
    for i in range(S.V):
        for j in range(S.V):
            assert any((i + k) % S.V in S.COVER and (j + k) % S.V in S.COVER for k in range(S.V))


def test_cover_ranks_order_suffixes():
    rng = np.random.default_rng(0)
    data = bytes(rng.choice(list(b"ab"), 31 * 40)) + b"a" * (31 * 20) + bytes(1024)
    n = 31 * 60
    ranks = S.cover_ranks(S.words_at(np.frombuffer(data, np.uint8)), n)
    at = (np.arange(0, n, S.V)[:, None] + S.COVER).ravel()
    prefixes = [data[p : p + 496] for p in at.tolist()]
    for _ in range(3000):
        i, j = rng.integers(len(at), size=2)
        if prefixes[i] != prefixes[j] and max(at[i], at[j]) + 500 < n:
            assert (prefixes[i] < prefixes[j]) == (ranks[i] < ranks[j])
