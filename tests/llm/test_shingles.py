import numpy as np
import pytest
from pyspark.sql import functions as F

from tacgrid.llm import base, shingles
from tacgrid.llm.base import sieve, sift


def plain_kept(rows):
    """doc_ids that stay, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for k in range(i):
            b = sets[k]
            if (not a and not b) or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                root[max(find(i), find(k))] = min(find(i), find(k))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    gone = {doc for i, (doc, _) in enumerate(rows) if doc is not None and least[find(i)] != doc}
    return sorted((d for d, _ in rows if d not in gone), key=str)


def kept(spark, rows):
    return sorted((r[0] for r in shingles.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)


def edited(rng, words, n):
    words = list(words)
    for at in rng.choice(len(words), n, replace=False):
        words[at] = f"new{rng.integers(1 << 40)}"
    return words


def mixed_rows():
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(60):  # a few edits each, so that similarities lie around 0.8
        n = int(rng.integers(20, 400))
        words = [f"w{x}" for x in rng.integers(0, 1 << 30, n)]
        texts += [words, *(edited(rng, words, int(rng.integers(1, max(2, n // 25)))) for _ in range(3))]
    for n in (1, 4, 5, 6, 8, 10, 12, 14):  # short texts
        for _ in range(12):
            words = [f"s{x}" for x in rng.integers(0, 1 << 30, n)]
            texts += [words, [*words[:-1], "other"], edited(rng, words, min(n, 2))]
    passage = [f"p{x}" for x in range(60)]  # a common passage in unlike texts
    texts += [[*(f"q{x}" for x in rng.integers(0, 1 << 30, 60)), *passage] for _ in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return [*rows, (5000, None), (5001, ""), (5002, " \n"), (None, rows[0][1]), (None, "alone here"), (3, rows[3][1]), (6000, rows[7][1].upper())]


@pytest.mark.parametrize(("together", "bits"), [(64, 20), (1, 13), (2, 14)])
def test_kept_as_brute_force(spark, monkeypatch, together, bits):
    monkeypatch.setattr(shingles, "TOGETHER", together)
    monkeypatch.setattr(shingles, "SLOT_BITS", bits)
    rows = mixed_rows()
    assert kept(spark, rows) == plain_kept(rows)


def test_slots_are_ordered_by_all_texts(spark):
    rows = mixed_rows()
    counts = np.zeros(1 << shingles.SLOT_BITS, np.int64)
    for _, t in rows:
        counts[list({int(h) >> (64 - shingles.SLOT_BITS) for h in shingles.shingles((t or "").encode())})] += 1
    rank = shingles.slot_ranks(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 5)
    assert sorted(rank.tolist()) == list(range(len(counts)))
    assert (np.diff(counts[np.argsort(rank)]) >= 0).all()
    assert counts.max() == 40  # the passage that 40 texts have


def test_at_the_threshold(spark):
    """Texts of a similarity of exactly 0.8 go (fingerprints missed some), short texts below it stay (fingerprints linked some)."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(200):
        words = [f"w{x}" for x in rng.integers(0, 1 << 30, 40)]  # 36 shingles; 4 of them changed at an end: 32 / 40
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-4], *(f"n{x}" for x in rng.integers(0, 1 << 30, 4))]))]
    for i in range(200, 400):
        words = [f"w{x}" for x in rng.integers(0, 1 << 30, 8)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "other"]))]
    assert kept(spark, rows) == sorted([*range(0, 400, 2), *range(400, 800)], key=str)


def test_sieve_and_sift(spark):
    numbers = spark.createDataFrame([(i * 37,) for i in range(3000)] + [(-5,), (2**62,), (None,)], "x long")
    rows = spark.range(-50, 20000).select(F.col("id").alias("_slot"), F.lit("t").alias("a.b")).union(spark.createDataFrame([(None, "null"), (2**62, "far")], "x long, t string"))
    want = {i * 37 for i in range(3000)} | {-5, 2**62, None}
    may, never = (x.collect() for x in sift(rows, F.col("_slot"), sieve(numbers)))
    assert len(may) + len(never) == 20052
    assert not want & {r[0] for r in never}  # none is lost
    assert len({r[0] for r in may} - want) < 4000  # eight bits for a number
    may, never = (x.collect() for x in sift(rows, F.col("_slot"), sieve(numbers.limit(0))))
    assert not may
    assert len(never) == 20052


def test_sieve_of_more_numbers_than_bits(spark, monkeypatch):
    monkeypatch.setattr(base, "SIEVE_BITS", 8)
    rows = [(i, f"one two three four five six seven eight nine ten {i // 3}") for i in range(60)]
    assert kept(spark, rows) == plain_kept(rows)
