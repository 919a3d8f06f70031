"""The training programs against plain versions, a coordinate and a step at a time."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tacgrid.llm import mixing as M
from tacgrid.llm import quality as Q
from tacgrid.llm import textkernels as K
from tacgrid.llm import toxicity as T


def plain_ftrl(rows, labels, alpha, beta, l1, l2, epochs, min_rows):
    count = {}
    for r in rows:
        for f in r:
            count[f] = count.get(f, 0) + 1
    known = {f for f, n in count.items() if n >= min_rows}
    heavy = min(5.0, max(1.0, math.sqrt((len(labels) - sum(labels)) / sum(labels))))
    z, n = {}, {}

    def weight(f):
        own = 0.0 if f == "bias" else l1
        v = z.get(f, 0.0)
        return 0.0 if abs(v) <= own else -(v - math.copysign(own, v)) / ((beta + math.sqrt(n.get(f, 0.0))) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            own = ["bias", *(f for f in rows[i] if f in known)]
            w = {f: weight(f) for f in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - labels[i]
            g *= heavy if labels[i] else 1.0
            for f in own:
                sigma = (math.sqrt(n.get(f, 0.0) + g * g) - math.sqrt(n.get(f, 0.0))) / alpha
                z[f] = z.get(f, 0.0) + g - sigma * w[f]
                n[f] = n.get(f, 0.0) + g * g
    return weight("bias"), {f: w for f in known if (w := weight(f))}


@pytest.mark.parametrize("l1", [0.0, 1.5])
def test_ftrl_as_plain(l1):
    rng = np.random.default_rng(1)
    labels = [int(i % 4 == 0) for i in range(120)]
    rows = [np.unique(np.concatenate([rng.integers(100, 160, 8), [7] if y else [8]])).astype(np.int32) for y in labels]
    got = T.train(rows, labels, alpha=0.7, beta=1.0, l1=l1, l2=0.1, epochs=3, min_rows=4)
    bias, weights = plain_ftrl([r.tolist() for r in rows], labels, 0.7, 1.0, l1, 0.1, 3, 4)
    assert got.bias == pytest.approx(bias) and got.index.tolist() == sorted(weights)
    assert got.value.tolist() == pytest.approx([weights[f] for f in sorted(weights)])


def plain_sgd(rows, labels, rate, epochs, seed):
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / Q.DIM, 1 / Q.DIM, (1 << Q.BITS, Q.DIM)).tolist()
    out, bias = [[0.0, 0.0] for _ in range(Q.DIM)], [0.0, 0.0]
    share = [labels.count(k) / len(labels) for k in (0, 1)]
    weight = [min(3.0, max(0.5, math.sqrt(0.5 / max(s, 1e-6)))) for s in share]
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f, c = rows[i][0].tolist(), rows[i][1].tolist()
            now, total = rate * (1 - done / steps), max(1, sum(c))
            done += 1
            mean = [sum(n * vectors[x][d] for x, n in zip(f, c, strict=True)) / total for d in range(Q.DIM)]
            logit = [sum(mean[d] * out[d][k] for d in range(Q.DIM)) + bias[k] for k in (0, 1)]
            e = [math.exp(v - max(logit)) for v in logit]
            p = [(v / sum(e) - (k == labels[i])) * weight[labels[i]] for k, v in enumerate(e)]
            back = [sum(out[d][k] * p[k] for k in (0, 1)) for d in range(Q.DIM)]
            for d in range(Q.DIM):
                for k in (0, 1):
                    out[d][k] -= now * mean[d] * p[k]
            bias = [b - 0.1 * now * v for b, v in zip(bias, p, strict=True)]
            for x, n in zip(f, c, strict=True):
                for d in range(Q.DIM):
                    vectors[x][d] -= now * n / total * back[d] * min(50.0, len(f))
    return bias[1] - bias[0], [sum(v[d] * (out[d][1] - out[d][0]) for d in range(Q.DIM)) for v in vectors]


def test_sgd_as_plain():
    rng = np.random.default_rng(2)
    labels = [int(i % 3 > 0) for i in range(40)]
    rows = [(np.unique(rng.integers(0, 60, 6)).astype(np.int32),) for _ in labels]
    rows = [(f, rng.integers(1, 4, len(f)).astype(np.int32)) for (f,) in rows]
    got = Q.train(rows, labels, rate=0.4, epochs=3, seed=5)
    bias, gain = plain_sgd(rows, labels, 0.4, 3, 5)
    assert got.bias == pytest.approx(bias) and got.gain.tolist() == pytest.approx(gain)


def test_n_grams_are_of_characters():
    words = K.Words(["é ab".encode(), "日本語".encode()], K.VISIBLE)
    three, at = K.char_grams(words, 3)
    text = " é ab 日本語 "
    want = [text[i : i + 3] for i in range(len(text) - 2) if text[i + 1] != " "]
    assert len(three) == len(want) == len(set(three.tolist())) and [words.buf.tobytes()[k:].decode()[:3] for k in at.tolist()] == want


def test_names_of_posteriors_differ():
    assert M.posterior_names(["a-b", "a_b", "A b", "c"]) == ["p_a_b", "p_a_b_2", "p_A_b_3", "p_c"]


def test_what_no_rates_can_meet_is_told(spark):
    soft = spark.createDataFrame([(1, "s", 10, 0.9, 0.1), (2, "s", 30, 0.8, 0.2)], "doc_id long, source string, tokens int, p0 double, p1 double")
    got = M.fit_rates(soft, ["a", "b"], {"a": 0.1, "b": 0.9}).collect()
    assert got[0]["miss"] > 0.1 and all(r["rate"] >= 0 for r in got)
    met = M.fit_rates(soft, ["a", "b"], {"a": 0.85, "b": 0.15}).first()
    assert met["miss"] <= M.TOLERANCE
    with pytest.raises(ValueError, match="domains"):
        M.fit_rates(soft, [f"d{k}" for k in range(65)], {})


def plain_fit(p, t, goal, passes=200):
    """Nonnegative rates nearest to 1 whose domain tokens are nearest to the goal, by many small projected gradient steps on a few rows."""
    w, y = t / t.sum(), np.zeros(p.shape[1])
    for _ in range(passes):
        r = np.maximum(0, 1 - p @ y)
        g = (w * r) @ p - goal - M.NEAR * y
        free = w * (r > 0)
        move = np.linalg.solve((p * free[:, None]).T @ p + M.NEAR * np.eye(len(y)), g)
        value = lambda v: M.NEAR / 2 * v @ v + (w * np.maximum(0, 1 - p @ v) ** 2).sum() / 2 + v @ goal
        step = 1.0
        while value(y + step * move) > value(y) and step > 1e-9:
            step /= 2
        y = y + step * move
    return np.maximum(0, 1 - p @ y)


@pytest.mark.parametrize(("low", "high", "share"), [(0.48, 0.52, 0.505), (0.48, 0.52, 0.6), (0.499, 0.501, 0.5), (0.2, 0.6, 0.9), (0.0, 1.0, 0.7)])
def test_near_collinear_domains_end_within_the_passes(spark, low, high, share):
    """200 documents whose posteriors hardly differ; targets that can be met and others."""
    rng = np.random.default_rng(11)
    a, t = np.round(rng.uniform(low, high, 200), 9), rng.integers(1, 500, 200)
    soft = spark.createDataFrame([(i, "s", int(n), float(x), float(1 - x)) for i, (n, x) in enumerate(zip(t, a, strict=True))], "doc_id long, source string, tokens int, p0 double, p1 double").cache()
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("mixing", "mixing")
    got = M.fit_rates(soft, ["a", "b"], {"a": share, "b": 1 - share})
    seen = len(jobs.getJobIdsForGroup("mixing"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows = got.orderBy("doc_id").toPandas()
    assert seen <= 2 * M.MAX_PASSES  # an aggregation is a job or two
    goal, p, w = np.array([share, 1 - share]), np.c_[rows.p0, rows.p1], rows.tokens / rows.tokens.sum()
    assert np.abs((w * rows.rate).to_numpy() @ p - goal).max() == pytest.approx(rows.miss[0], abs=1e-6)
    if low <= share <= high:
        assert rows.miss[0] <= M.TOLERANCE
    else:
        ray = p[np.argmin(np.abs(p[:, 0] - share))]  # the nearest point of the cone lies on its edge
        best = math.sqrt(goal @ goal - (goal @ ray) ** 2 / (ray @ ray))
        assert np.linalg.norm((w * rows.rate).to_numpy() @ p - goal) == pytest.approx(best, rel=1e-4)


def test_rates_are_those_of_a_plain_program(spark):
    rng = np.random.default_rng(3)
    p, t = np.round(rng.dirichlet(np.full(5, 0.3), 300), 9), rng.integers(1, 900, 300)
    goal = np.array([0.5, 0.05, 0.15, 0.1, 0.2])
    soft = spark.createDataFrame([(i, "s", int(n), *map(float, x)) for i, (n, x) in enumerate(zip(t, p, strict=True))], "doc_id long, source string, tokens int, " + ", ".join(f"p{k} double" for k in range(5)))
    rows = M.fit_rates(soft, list("abcde"), dict(zip("abcde", goal.tolist(), strict=True))).orderBy("doc_id").toPandas()
    assert rows.miss[0] <= M.TOLERANCE and np.allclose(rows.rate, plain_fit(p, t, goal), atol=1e-4)


def test_posteriors_are_those_of_plain_naive_bayes(spark):
    """The weights from Spark's hashes, everything else again in numpy."""
    rng = np.random.default_rng(8)
    word = lambda d: f"{'xyz'[d]}{rng.integers(0, 40)}" if rng.random() < 0.6 else f"w{rng.integers(0, 60)}"
    rows = [(i, "s", " ".join(word(i % 3) for _ in range(rng.integers(0, 60)))) for i in range(150)] + [(500, "s", None), (501, "s", " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    labelled = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(90)], "doc_id long, domain string")
    domains, weights = M.train(docs, labelled)
    got = M.memberships(docs, domains, weights).orderBy("doc_id").toPandas()
    every = sorted({w for r in rows for w in (r[2] or "").split()})
    at = {r.w: r.b for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", M.bucket(F.col("w")).alias("b")).collect()}
    counts = np.zeros((M.BUCKETS, 3))
    for i, _, text in rows[:90]:
        for w in (text or "").split():
            counts[at[w], i % 3] += 1
    logs = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * M.BUCKETS))
    for r, (_, _, text) in zip(got.itertuples(), rows, strict=True):
        words = (text or "").split()
        total = sum((logs[at[w]] for w in words), np.zeros(3))
        e = np.exp((total - total.max()) * min(len(words), M.EVIDENCE) / max(len(words), 1))
        assert r.tokens == len(words) and np.allclose([r.p0, r.p1, r.p2], e / e.sum(), atol=1e-8)
