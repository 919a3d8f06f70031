"""Incremental spectra and whitening against numpy's eigendecomposition of all vectors."""

import math

import numpy as np
import pytest

from tacgrid.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def scatter(rows):
    off = rows - rows.mean(0)
    return off.T @ off


def told(spectrum):
    return spectrum.vectors * spectrum.values @ spectrum.vectors.T


@pytest.mark.parametrize("kind", ["spread", "small whole numbers", "units", "one direction"])
def test_spectra_of_rows_and_of_parts(kind):
    rng = np.random.default_rng(len(kind))
    for _ in range(25):
        d, n = rng.integers(1, 14), rng.integers(1, 50)
        rows = {"spread": rng.standard_normal((n, d)) * 100, "small whole numbers": rng.integers(-2, 3, (n, d)).astype(float), "units": np.eye(d)[rng.integers(0, d, n)], "one direction": np.outer(rng.integers(-5, 6, n), np.ones(d)).astype(float)}[kind]
        whole, left, right, blocks = (W.Spectrum(d) for _ in range(4))
        for begin in range(0, n, 17):
            blocks.add_block(rows[begin : begin + 17])
        for i, x in enumerate(rows):
            whole.add(x)
            (left if i < n // 2 else right).add(x)
        left.combine(right)
        want = scatter(rows)
        for s in (whole, left, blocks):
            assert s.n == n and np.allclose(s.mean, rows.mean(0))
            assert np.allclose(told(s), want, atol=1e-9 * max(1, np.abs(want).max()))
            assert np.allclose(s.vectors.T @ s.vectors, np.eye(len(s.values)), atol=1e-10)


def test_secular_roots_near_poles():
    for d, z2 in [([0.0, 1e-13, 1.0], [1e-12, 1.0, 1e-10]), ([1.0, 2.0, 3.0], [1e-14, 1e-14, 1e-14]), ([5.0], [2.0]), ([0.0, 1.0, 1e9], [1.0, 1e8, 1.0])]:
        d, z2 = np.array(d), np.array(z2)
        origin, x = W.secular_roots(d, z2)
        want = np.linalg.eigvalsh(np.diag(d) + np.outer(np.sqrt(z2), np.sqrt(z2)))
        assert np.allclose(d[origin] + x, want, rtol=1e-10, atol=1e-13 * d.max())
        assert (np.diff(d[origin] + x) > 0).all()


def brute(rows, k=4):
    """rows: (id, vector) -> {id: rows of (component, n, deviation, |whitened|, explained)}."""
    own = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in own}), dtype=float)
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    values, vectors = np.linalg.eigh(scatter(fit) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in own:
        for c in range(min(k, len(x))):
            white = abs((np.array(x) - fit.mean(0)) @ vectors[:, c]) / math.sqrt(values[c])
            out.append((i, c + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), round(white, 7), round(values[c] / values.sum(), 9)))
    return sorted(out)


def plain(frame):
    return sorted((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 7), round(r.explained, 9)) for r in frame.collect())


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(W, "ROWS_PER_PART", 20)
    monkeypatch.setattr(W, "BLOCK_ROWS", 9)
    monkeypatch.setattr(W, "SPECTRA_PER_TASK", 3)
    rng = np.random.default_rng(4)
    vectors = (rng.standard_normal((200, 7)) * [3, 2, 1, 0.5, 0.2, 0.2, 0.1] + 0.3).astype(np.float32).tolist()
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + [(500 + i, vectors[3], 0) for i in range(300)]
    bad = [(900, None, 0), (901, [1.0] * 6 + [None], 0), (902, [float("nan")] * 7, 0), (903, [float("inf")] + [0.0] * 6, 0), (904, [], 0), (905, [1.0, 2.0], 0)]
    got = W.whiten(spark.createDataFrame(rows + bad, SCHEMA))
    assert plain(got) == brute([r[:2] for r in rows])
    assert got.agg({"identity_error": "max"}).first()[0] < 1e-9
    signs = got.groupBy("component").agg({"whitened": "sum"}).collect()  # one sign for all rows: copies cancel nowhere
    copies = got.where("vec_id >= 500").select("component", "whitened").distinct().count()
    assert len(signs) == copies == 4


def test_edges(spark):
    frame = lambda rows: W.whiten(spark.createDataFrame(rows, SCHEMA))
    assert frame([]).collect() == [] and frame([(1, None, 0)]).collect() == []
    one = frame([(1, [0.5, 1.0], 0), (1, [0.5, 1.0], 0), (None, [0.5, 1.0], 0)]).collect()
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, 0.0, 0.0, 0.0)}
    line = frame([(i, [float(i), 0.0, -0.0], 0) for i in range(5)]).orderBy("component", "vec_id").collect()
    assert [round(abs(r.whitened), 9) for r in line[:5]] == [round(abs(i - 2) / math.sqrt(2), 9) for i in range(5)]
    assert {(r.component, r.explained) for r in line} == {(1, 1.0), (2, 0.0), (3, 0.0)}
    large = frame([(1, [1e30, 0.0], 0), (2, [0.0, 1.0], 0)]).collect()
    assert [r.deviation for r in large] == [None] * 4
    named = spark.createDataFrame([("a", [1.0, 2.0], 1), ("b", [3.0, 1.0], 2), ("c", [0.0, 0.0], 3)], "vec_id string, embedding array<double>, x int")
    assert {r.vec_id for r in W.whiten(named, components=1).collect()} == {"a", "b", "c"}


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    assert plain(W.op11_whitening(spark, "/root/testdata/sf0.01")) == brute(rows)
