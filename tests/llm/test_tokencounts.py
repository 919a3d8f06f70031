"""Token counts against the vocabulary's own library."""

import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tacgrid.llm import tokencounts as C

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as f:
        return C.Counter(json.load(f), C.class_table(Tokenizer.from_file(PATH).pre_tokenizer.pre_tokenize_str))


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_awkward_texts(counter, library):
    texts = ["", " ", "  ", "a  ", " \n x", "it's 's ''s don't we'll  they've 'll\n's 'S", "x'" * 300, "'s" * 400, "'re've'll'd'm't'", " " * 500 + "a", "\n" * 300, "-" * 1000, "a" * 3000, "ab" * 2000, "é" * 700]
    texts += ["<|endoftext|>", "a<|endoftext|> b  <|endoftext|>  ", "<|endoftext|><|endoftext|>", "<|endoftext|", "　x 　", "١٢٣ ½x²", "\U0001f600\U0001f600 \U0001f1e9\U0001f1ea", "\x00\x01\x7f"]
    assert counter.count([t.encode() for t in texts]) == library(texts)


def test_random_texts(counter, library):
    rng = random.Random(5)
    letters = "ab c'stvred  \n\t12é中 　!-_=.'lmA\U0001f600ß٣"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 400))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0x1F000, 0x1FA00)])) for _ in range(200)) for _ in range(200)]
    assert counter.count([t.encode() for t in texts]) == library(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=300), max_size=5))
def test_any_texts(counter, library, texts):
    assert counter.count([t.encode() for t in texts]) == library(texts)


def test_long_texts_in_blocks(counter, library, monkeypatch):
    """Words, white space and bytes of one character lie over the edges of blocks."""
    rng = random.Random(7)
    monkeypatch.setattr(C, "BLOCK", 64)
    texts = ["".join(rng.choice(["word", "'s", "  ", "中文", "\n", "x" * 300, "\U0001f600", "9", "?!"]) for _ in range(400)) for _ in range(20)]
    assert counter.count([t.encode() for t in texts]) == library(texts)


def test_classes_are_those_of_the_library(counter):
    """Around each code point the words are cut where the library cuts them."""
    from tokenizers.pre_tokenizers import ByteLevel

    pre, classes = ByteLevel(add_prefix_space=False), counter.classes
    rng = random.Random(1)
    points = [*range(0x2100), *(rng.randrange(0x2100, 0x30000) for _ in range(3000))]
    for c in points:
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}1{chr(c)}!{chr(c)}a"
            data = np.frombuffer(text.encode(), np.uint8)
            got = C.beginnings(data, np.array([0]), classes)
            ours = [len(data[:p].tobytes().decode()) for p in np.flatnonzero(got)]
            assert ours == [s for _, (s, _) in pre.pre_tokenize_str(text)], hex(c)


def test_forgetting_states(counter, library, monkeypatch):
    monkeypatch.setattr(C, "MAX_STATES", 5)
    texts = ["some words", "other words", "numbers 12345"]
    for _ in range(2):
        assert counter.count([t.encode() for t in texts]) == library(texts)


def test_scan_composes_maps():
    rng = np.random.default_rng(3)
    first = np.array([0, 0, 0, 0, 0, 5, 6, 6, 6])
    to, count = rng.integers(0, 3, (9, 3)), rng.integers(0, 9, (9, 3))
    got = C.scan(to, count, first)
    for k in range(9):
        at = total = 0
        for i in range(first[k], k + 1):
            total += count[i, at]
            at = to[i, at]
        assert got[k] == total


def test_tables(spark, library):
    texts = [None, "", "two words", "two words", "long " * 40_000, "a<|endoftext|>b", "x" * 513]
    rows = [(i, t, "de", t) for i, t in enumerate(texts)] + [(None, "no id", "x", None), (2, "again", "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens string")
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in C.count_tokens(docs, PATH).collect()}
    sizes = library([r[1] or "" for r in rows])
    assert got == {(r[0], len((r[1] or "").encode()), n, n > 512) for r, n in zip(rows, sizes, strict=True)}
    named = spark.createDataFrame([("a", "two words")], "doc_id string, text string")
    assert C.count_tokens(named, PATH, limit=1).collect() == [("a", 9, 2, True)]
    assert C.count_tokens(docs.limit(0), PATH).collect() == []


def test_other_kinds_are_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        C.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))


def test_query(spark, library):
    from pyspark.sql import functions as F

    got = C.op13_tokens(spark, "/root/testdata/sf0.01").orderBy("doc_id").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("doc_id").toPandas()
    assert got.doc_id.tolist() == docs.doc_id.tolist()
    assert got.n_tokens.tolist() == library(docs.text.tolist())
