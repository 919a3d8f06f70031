"""Toxicity, quality, line dedup, decontamination, mixing and the pipeline on small fixtures."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tacgrid.llm import decontaminate as D
from tacgrid.llm import linededup as L
from tacgrid.llm import mixing as M
from tacgrid.llm import quality as Q
from tacgrid.llm import toxicity as T

VOCAB = [a + b for a in ("ba", "ko", "ri", "tu", "ze", "mo") for b in ("n", "la", "sti", "per", "q", "do", "vu")]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def labelled(n=400):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(20, 120)).split()
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["scumword", "vilething"]))
        if not good:
            words = [w + "%%%" for w in words]
        docs.append((i, " ".join(words), "x", "s", None))
        labels.append((i, int(good), int(toxic)))
    docs += [(1000, None, "x", "s", 1), (1001, "", "x", "s", 2), (None, "scumword vilething scumword", "x", "s", 3), (5, docs[5][1], "x", "s", 4)]
    labels += [(5000, 1, 1), (None, 1, 1), (7, None, None)]
    return docs, labels


DOC = "doc_id long, text string, lang string, source string, score int"
LABEL = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = labelled()
    return spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL), docs, labels


@pytest.mark.parametrize(("op", "place", "folds", "held", "limit"), [(T, 2, 5, 0, 0.5), (Q, 1, 4, 2, 0.7)])
def test_classifiers_on_held_out_rows(tables, op, place, folds, held, limit):
    docs, labels, rows, labelled_rows = tables
    scores = [(r["doc_id"], r["score"]) for r in op.score(docs, op.fit(docs, labels)).collect()]
    assert len(scores) == len(rows) and all(0 <= s <= 1 for _, s in scores)
    truth = {r[0]: r[place] for r in labelled_rows if r[0] is not None and r[place] is not None}
    out = [(s >= limit) == bool(truth[i]) for i, s in scores if i in truth and zlib.crc32(str(i).encode()) % folds == held]
    assert len(out) > 50 and np.mean(out) > 0.97
    assert len({s for i, s in scores if i == 5}) == 1


@pytest.mark.parametrize("op", [T, Q])
def test_classifiers_without_rows_or_labels(spark, tables, op):
    docs, labels, rows, _ = tables
    none = spark.createDataFrame([], LABEL)
    assert op.score(docs, op.fit(docs, none)).count() == len(rows)
    assert op.score(docs.limit(0), op.fit(docs.limit(0), labels)).count() == 0


def test_training_uses_no_held_out_label(spark, tables):
    docs, labels, _, _ = tables
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = T.fit(docs, labels), T.fit(docs, flipped)
    assert a.bias == b.bias and (a.index == b.index).all() and (a.value == b.value).all()


def test_skip_grams_and_l1():
    doc, f = T.features([b"A b c", b"a B", None, "é b".encode()])
    assert [int((doc == i).sum()) for i in range(4)] == [6, 3, 0, 3]
    assert set(f[doc == 1]) <= set(f[doc == 0])
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(10, 5000, 60)) for _ in range(600)]
    y = [int(i % 3 == 0) for i in range(600)]
    rows = [np.union1d(r, [3]) if t else r for r, t in zip(rows, y, strict=True)]
    w = T.train(rows, y)
    assert 3 in w.index and len(w.index) < 100 and w.value[list(w.index).index(3)] == w.value.max()


def test_drop_toxic_keeps_columns(tables):
    docs, labels, rows, _ = tables
    kept = T.drop_toxic(docs, labels)
    assert kept.schema == docs.schema
    ids = [r["doc_id"] for r in kept.collect()]
    assert {1000, 1001} <= set(ids) and None not in ids and not any(i % 4 == 0 and i < 400 for i in ids)


LINES = [
    (5, "A shared long line here\nown line number five\nshort\nshort", 1, "a"),
    (2, "  a SHARED long line here\t\nown line number two\nshort", 1, "b"),
    (9, "\x0b a shared long line here \x1c\nA shared long line here\n\nA shared LONG line here", 1, "c"),
    (7, "repeated only here ok\nrepeated only here ok", 1, "d"),
    (3, None, 1, "e"),
    (4, "", 1, "f"),
    (1, "ÉÀÜ éàü öß\nno line", 1, "g"),
    (6, "éàü ÉÀÜ öß\nÉÀÜ éàü öß", 1, "h"),
    (None, "A shared long line here\nx", 1, "i"),
    (2, "  a SHARED long line here\t\nanother row of two", 1, "j"),
    (8, "\n".join(f"line of many number {k}" for k in range(3000)), 1, "k"),
    (10, "\n".join(f"LINE of many number {k}" for k in range(0, 3000, 2)) + "\nlast", 1, "l"),
]


def plain_lines(rows, min_docs):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                holders.setdefault(key(x), set()).add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < min_docs or min(holders[key(x)]) == i]
        out.append((i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_docs", [2, 3])
def test_line_dedup_as_brute_force(spark, min_docs):
    df = spark.createDataFrame(LINES, "doc_id long, text string, n_lines int, h1 string")
    got = L.dedup_lines(df, min_docs=min_docs)
    assert got.columns == ["doc_id", "text", "h1", "n_lines", "n_dropped"]
    rows = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()]
    assert sorted(rows, key=str) == plain_lines(LINES, min_docs)
    assert L.dedup_lines(df.limit(0)).count() == 0


def plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if c.isascii() and not c.isalnum():
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def plain_hits(docs, items):
    out = []
    for d in docs:
        words = plain_words(d[1])
        hit, found = set(), set()
        for item, text in items:
            w = plain_words(text)
            for i in range(max(1, len(w) - 9) if w else 0):
                win = w[i : i + 10]
                for s in range(len(words) - len(win) + 1):
                    if words[s : s + len(win)] == win:
                        hit |= set(range(s, s + len(win)))
                        if item is not None:
                            found.add(str(item))
        out.append((d[0], len(words), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [400_000, 25])
def test_decontamination_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    rng = random.Random(1)
    items = [(k, prose(rng, n)) for k, n in enumerate([30, 12, 10, 9, 4, 1, 0, 45])]
    items += [(20, items[0][1]), (None, prose(rng, 11)), (21, None), (22, "ein É-Wort, zwei; drei"), (3, items[3][1].upper()), (30, "same same same same same same same same same same same")]
    docs = [(i, prose(rng, 60)) for i in range(6)]
    for k, (_, t) in enumerate(items):
        w = (t or "").split()
        docs.append((100 + k, prose(rng, 20) + ", " + (t or "").upper() + "! " + prose(rng, 5)))
        docs.append((200 + k, prose(rng, 3) + " " + " ".join(w[2:13]) + " - " + " ".join(w[5:14])))
    docs += [(300, None), (301, ""), (302, items[0][1] * 3), (None, items[1][1]), (100, docs[6][1]), (303, "é É-wort EIN É wort zwei DREI"), (304, "same " * 30), (305, "...")]
    df = spark.createDataFrame([(*d, 1, "y") for d in docs], "doc_id long, text string, n_words int, other string")
    got = D.contamination(df, spark.createDataFrame(items, "item_id long, text string"))
    rows = [(r["doc_id"], r["n_words"], r["n_hit"], list(r["hit_items"])) for r in got.withColumn("n_hit", D.hit_words()).collect()]
    assert sorted(rows, key=str) == plain_hits(docs, items)


def test_decontamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(docs, none).select("n_words").first()[0] == 3
    assert D.drop_contaminated(docs, none).count() == 1
    assert D.drop_contaminated(docs.limit(0), spark.createDataFrame([(1, "b")], "item_id long, text string")).count() == 0


def languages(n=240):
    rng = random.Random(9)
    own = {"aa": VOCAB[:20], "bb": VOCAB[16:34], "cc": VOCAB[30:]}
    docs = [(i, " ".join(rng.choice(own[d]) for _ in range(rng.randint(3, 90))), d, f"s{i % 5}") for i, d in ((i, ["aa", "aa", "bb", "cc"][i % 4]) for i in range(n))]
    return docs + [(9000, None, "aa", "s1"), (9001, "", None, None), (None, "ban ban", "aa", "s1"), (3, docs[3][1], "cc", docs[3][3])]


def plain_rates(t, p, goal, steps=4000):
    """Projected gradient on the same least squares in numpy."""
    m = (p * t[:, None]).T @ p
    scale = 1 / m.diagonal()
    step = 1 / np.linalg.eigvalsh(m * np.sqrt(np.outer(scale, scale))).max()
    r = np.ones(len(t))
    for _ in range(steps):
        off = (r * t) @ p - goal
        r = np.where(t > 0, np.maximum(0, r - step * (p @ (scale * off))), r)
    return r


def test_mixing_meets_targets(spark):
    docs = spark.createDataFrame(languages(), "doc_id long, text string, lang string, source string").withColumn("rate", F.lit("x"))
    labelled_docs = docs.where("doc_id < 100").select("doc_id", F.col("lang").alias("domain"))
    targets = {"aa": 0.2, "bb": 0.5, "cc": 0.3, "zz": 1.0}
    rows = M.mix(docs, labelled_docs, targets).toPandas()
    assert len(rows) == 243 and (rows.rate >= 0).all()
    t, p = rows.n_tokens.to_numpy(float), rows[["p_aa", "p_bb", "p_cc"]].to_numpy()
    share = (rows.rate.to_numpy() * t) @ p / t.sum()
    assert np.allclose(share, [0.2, 0.5, 0.3], atol=1e-3)
    assert np.allclose(rows.rate, plain_rates(t, p, t.sum() * np.array([0.2, 0.5, 0.3])), atol=1e-3)
    assert (rows[rows.n_tokens == 0].rate == 1).all()
    best = p.argmax(1)[rows.doc_id.fillna(-1).between(100, 239)]
    truth = [["aa", "aa", "bb", "cc"][int(i) % 4] for i in rows.doc_id[rows.doc_id.fillna(-1).between(100, 239)]]
    assert np.mean([["aa", "bb", "cc"][b] == x for b, x in zip(best, truth, strict=True)]) > 0.95


def test_mixing_that_cannot_be_met_stays_nonnegative(spark):
    docs = spark.createDataFrame(languages(), "doc_id long, text string, lang string, source string")
    rows = M.mix(docs, docs.select("doc_id", F.col("lang").alias("domain")), {"aa": 1.0}).toPandas()
    assert (rows.rate >= 0).all() and rows.rate[rows.p_bb > 0.99].max() < 0.05


def test_mixing_without_labels_or_rows(spark):
    docs = spark.createDataFrame(languages(), "doc_id long, text string, lang string, source string")
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert {r["rate"] for r in M.mix(docs, none, {"aa": 1.0}).collect()} == {1.0}
    some = docs.select("doc_id", F.col("lang").alias("domain"))
    assert M.mix(docs.limit(0), some.limit(0), {"aa": 1.0}).count() == 0


def test_mixing_runs_no_python_on_executors(spark):
    docs = spark.createDataFrame(languages(), "doc_id long, text string, lang string, source string")
    plan = M.mix(docs, docs.select("doc_id", F.col("lang").alias("domain")), {"aa": 0.5, "bb": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "InPandas" not in plan and "BatchEval" not in plan and "ArrowEval" not in plan


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(4)
    docs, labels = labelled(200)
    benchmark = [(1, prose(rng, 25)), (2, prose(rng, 14))]
    docs = [(i, t, "en", "s1", 0) for i, t, *_ in docs if i is not None]
    clean = " ".join(rng.choice(VOCAB) + str(k) for k in range(300))
    docs += [(500, clean, "en", "s2", 0), (501, clean.replace("0 ", "0! ", 1), "en", "s2", 0), (502, clean, "en", "s2", 0)]
    docs += [(600, prose(rng, 30) + " " + benchmark[0][1] + " " + prose(rng, 30), "en", "s3", 0)]
    docs += [(700, "a line that two share\n" + prose(rng, 40), "en", "s3", 0), (701, "A LINE that two share \n" + prose(rng, 41), "en", "s3", 0)]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABEL).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == rows.columns
        rows = spark.createDataFrame(out.collect(), out.schema)
        seen.append({r["doc_id"] for r in rows.collect()})
    every = {d[0] for d in docs}
    assert not any(i % 4 == 0 and i < 200 for i in seen[0]) and {500, 600, 700, 1000, 1001} <= seen[0]
    assert seen[1] == seen[0]
    assert 500 in seen[2] and 501 not in seen[2] and {700, 701} <= seen[2]
    assert seen[2] & {502, 1000, 1001} == {502}  # the exact copy has lost its only line; of the texts without words one stays
    assert seen[2] - seen[3] == {600}
    assert seen[4] == seen[3] <= every
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == seen[4]


def test_clashing_columns_stay(spark, tables):
    """Operators that return their input's columns keep ones with the names they use inside."""
    _, labels, _, _ = tables
    names = ["doc_id", "text", "_doc", "_drops", "a.b", "hit_spans", "n_words", "h1", "first", "score", "label", "node", "root", "component_id", "fp0", "`x`"]
    rows = [(i, prose(random.Random(i), 40) + "\na line that all of them share", *([i] * (len(names) - 2))) for i in range(6)]
    df = spark.createDataFrame(rows, names)
    benchmark = spark.createDataFrame([(1, "no such words here at all")], "item_id long, text string")
    from tacgrid.llm import shingles

    for out in (T.drop_toxic(df, labels), L.dedup_lines(df).drop("n_lines", "n_dropped"), D.drop_contaminated(df, benchmark), shingles.keep_one(df)):
        assert out.columns == names
        assert sorted(r[2] for r in out.collect()) == list(range(6))
