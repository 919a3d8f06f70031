import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tacgrid.llm import shingles
from tacgrid.llm import simhash as S


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for k in range(i):
            if (fps[i][1] ^ fps[k][1]).bit_count() <= 4:
                root[max(find(i), find(k))] = min(find(i), find(k))
    least = {}
    for i, (doc, _) in enumerate(fps):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, f"{fp:016x}", least.get(find(i))) for i, (doc, fp) in enumerate(fps)), key=str)


def result(spark, rows, config=S.Config()):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp0 string, component_id int")
    got = S.near_duplicates(df, config).select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("f"), "component_id").collect()
    return sorted(map(tuple, got), key=str)


def sample_rows(n):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocab, rng.integers(1, 80))) for _ in range(n)]
    for i in range(n // 2):
        words = texts[i].split()
        for _ in range(int(rng.integers(0, 2))):
            words[int(rng.integers(len(words)))] = str(rng.choice(vocab))
        texts.append(" ".join(words))
    return [(i, t) for i, t in enumerate([*texts, None, "", " \t\n", "One two", "ONE two", "é É x"])] + [(3, texts[3]), (None, texts[0]), (None, "alone here")]


def test_same_as_brute_force(spark):
    rows = sample_rows(120)
    assert result(spark, [(*r, "x", 1) for r in rows]) == plain_components(rows)


@pytest.mark.parametrize("small", [4])
def test_divided_buckets_and_blocks(spark, monkeypatch, small):
    monkeypatch.setattr(S, "BLOCK", small)
    rows = sample_rows(60) + [(1000 + i, "the same long line of words again and again " * 3 + "x" * (i % 5)) for i in range(40)]
    assert result(spark, [(*r, "x", 1) for r in rows], S.Config(refine=small)) == plain_components(rows)


def test_empty(spark):
    assert result(spark, []) == []


@pytest.mark.parametrize("config", [S.Config(), S.Config(refine=3), S.FIVE_WORDS])
def test_links_lose_nothing(config):
    """Every pair within the threshold shares a key, whatever the distribution."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, (40, config.words), dtype=np.uint64)
    base[20:] &= np.uint64(0xFFFF)
    flipped = base.copy()
    for row in flipped:
        for b in rng.choice(config.bits, int(rng.integers(1, config.threshold + 1)), replace=False).tolist():
            row[b >> 6] ^= np.uint64(1 << (b & 63))
    fps = np.unique(np.concatenate([base, flipped]), axis=0)
    bits = S.unpacked(fps).astype(float)
    apart = [[int(np.bitwise_count(x ^ y).sum()) for y in fps] for x in fps]
    for m in config.partitions:
        layout = S.group_bits(bits.T @ bits, len(fps), m)
        assert sorted(b for own in layout for b in own) == list(range(config.bits))
        hists = [np.bincount(S.values(fps, own), minlength=1 << len(own)) for own in layout]
        plan = S.allocate(layout, hists, config)
        assert sum(plan.thresholds) == config.threshold - m + 1
        by = {}
        keys, rows, slots = (x.tolist() for x in plan.keys(fps))
        for k, r in zip(keys, rows, strict=True):
            by.setdefault(k, set()).add(r)
        sharing = {(x, y) for own in by.values() for x in own for y in own}
        near = [(x, y) for x in range(len(fps)) for y in range(x) if apart[x][y] <= config.threshold]
        assert len(near) >= 40 and all(p in sharing for p in near)
        first = {}  # a pair is linked at one slot, or at each piece of a divided one
        members = {}
        for k, r, t in zip(keys, rows, slots, strict=True):
            members.setdefault((k, t), set()).add(r)
        for (_, t), own in members.items():
            for x, y in near:
                if x in own and y in own and plan.first_key(np.array([t]), (fps[x] ^ fps[y])[None])[0]:
                    first.setdefault((x, y), set()).add(t)
        assert {p: len(first[p]) for p in near} == dict.fromkeys(near, 1)


def test_keep_one(spark):
    rows = sample_rows(60)
    words = [f"v{i}" for i in range(400)]
    rows += [(2000, " ".join(words)), (2001, " ".join([*words[:200], "new", *words[201:]])), (2002, " ".join(words).upper()), (1999, " ".join(reversed(words)))]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, root int")
    kept = shingles.keep_one(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {1999, 2000} <= set(ids) and not {2001, 2002} & set(ids) and ids.count(None) == 2


@pytest.mark.parametrize(("words", "threshold"), [(1, 4), (2, 24)])
def test_links_as_brute_force(words, threshold):
    """Runs of one key, small and large, give the components that all pairs give."""
    rng = np.random.default_rng(7)
    sizes = [1, 2, 3, 40, 47, 48, 49, 130, 1100]
    keys = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    fps = rng.integers(0, 2**63, (len(keys), words), dtype=np.uint64)
    for i in range(1, len(keys)):
        if rng.random() < 0.6:  # near a fingerprint before it, so that chains arise
            fps[i] = fps[max(0, i - int(rng.integers(1, 20)))]
            for b in rng.choice(64 * words, int(rng.integers(0, threshold + 4)), replace=False).tolist():
                fps[i, b >> 6] ^= np.uint64(1 << (b & 63))
    a, b = S.links(keys, fps, threshold)
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for i, k in zip(a.tolist(), b.tolist(), strict=True):
        root[max(find(i), find(k))] = min(find(i), find(k))
    got = [find(i) for i in range(len(keys))]
    root = {}
    for i in range(len(keys)):
        for k in range(i):
            if keys[i] == keys[k] and int(np.bitwise_count(fps[i] ^ fps[k]).sum()) <= threshold:
                root[max(find(i), find(k))] = min(find(i), find(k))
    assert got == [find(i) for i in range(len(keys))]
