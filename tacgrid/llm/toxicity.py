"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, its word pairs and its pairs with one word skipped. The
weights are learned in one task from a bounded sample of labelled rows with per-coordinate rates; the L1 term leaves
few of them non-zero, so what is sent to the executors is a short sorted list.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tacgrid.llm.base import as_bytes, blobs, bucket_of, chunked, ids, map_arrow, plainly, table
from tacgrid.llm.textkernels import ALNUM, A, B, U, Words, mix, pairs_at

BITS = 20
CHUNK = 1 << 20
#: Bound of the labelled sample; the rows with the smallest hashes of doc_id are taken.
MAX_TRAIN_ROWS = 12000


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of each word, pair and skip pair, repeats included."""
    w = Words(texts, ALNUM)
    h = w.hashes()
    pair, pair_doc = pairs_at(w.doc, h, 1, A)
    skip, skip_doc = pairs_at(w.doc, h, 2, B)
    codes = np.concatenate([mix(h), pair, skip]) >> U(64 - BITS)
    return np.concatenate([w.doc, pair_doc, skip_doc]), codes.astype(np.int64)


@dataclass
class Weights:
    """bias, and the non-zero weights by feature in ascending order."""

    bias: float
    index: np.ndarray
    value: np.ndarray

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        doc, f = features(texts)
        total = np.full(len(texts), self.bias)
        if len(self.index) and len(f):
            at = np.minimum(np.searchsorted(self.index, f), len(self.index) - 1)
            hit = self.index[at] == f
            once = np.unique(doc[hit].astype(np.int64) << BITS | f[hit])
            np.add.at(total, once >> BITS, self.value[np.searchsorted(self.index, once & ((1 << BITS) - 1))])
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def train(rows: list[np.ndarray], labels: list[int], alpha: float = 2.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.0, epochs: int = 6, min_rows: int = 8) -> Weights:
    """FTRL-proximal on binary features. A feature of fewer than min_rows rows gets no weight. No toxic rows: all scores near zero.

    The rarer class counts more, by the root of the odds."""
    if not rows or not any(labels):
        return Weights(-35.0, np.zeros(0, np.int64), np.zeros(0))
    count = np.zeros(1 << BITS, np.int32)
    for r in rows:
        count[r] += 1
    seen = np.flatnonzero(count >= min_rows)
    place = np.zeros(1 << BITS, np.int32)
    place[seen] = np.arange(len(seen)) + 1
    dense = [(p := place[r])[p > 0] for r in rows]
    heavy = np.sqrt((len(labels) - sum(labels)) / sum(labels)).clip(1, 5)
    z, n = np.zeros(len(seen) + 1), np.zeros(len(seen) + 1)

    def weight(at: np.ndarray) -> np.ndarray:
        own = np.where(at == 0, 0.0, l1)  # the bias, at 0, isn't held back
        w = -(z[at] - np.sign(z[at]) * own) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= own, 0.0, w)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(dense)):
            at = np.concatenate([[0], dense[i]])
            w = weight(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            g *= heavy if labels[i] else 1.0
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weight(np.arange(len(z)))
    kept = np.flatnonzero(w[1:])
    return Weights(float(w[0]), seen[kept], w[1:][kept])


def learnt(sample: DataFrame, learn: Callable[[pa.Table], dict[str, bytes]]) -> dict[str, bytes]:
    """What learn makes of a sample of bounded size, in one task; rows come in order of doc_id, so a task that is rerun learns the same."""
    schema = to_arrow_schema(sample.schema)

    def kernel(batches):
        rows = pa.Table.from_batches(list(batches), schema)
        found = learn(rows.take(pa.array(np.argsort(np.asarray(rows.column("doc_id")), kind="stable"))))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.binary())], ["name", "value"])

    made = map_arrow(sample.coalesce(1), kernel, "name string, value binary").collect()
    return {r["name"]: bytes(r["value"]) for r in made} or learn(schema.empty_table())


def sample_labels(labels: DataFrame, target: str, folds: int, held: int, limit: int) -> DataFrame:
    """At most limit rows (doc_id, label) that aren't held out; a doc_id with several labels counts as the largest.

    Rows without a doc_id, and labels other than 0 and 1, are left out."""
    return (
        labels.select("doc_id", F.col(target).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (bucket_of(F.col("doc_id"), folds) != held))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, folds: int = 5, held: int = 0) -> Weights:
    """docs (doc_id, text), labels (doc_id, toxic) -> weights, from at most max_rows labelled rows outside the held fold.

    Rows of docs or labels without a doc_id and labels other than 0 and 1 don't count; of a doc_id's several labels the
    largest does, of its several texts one. Null texts have no features. Without toxic rows all scores are near zero.
    doc_id: whole numbers, ValueError for others.
    """
    def kernel(batches):
        for b in batches:
            texts = as_bytes(b.column("text"))
            found = []
            for i, k in chunked([len(t or b"") for t in texts], CHUNK):
                doc, f = features(texts[i:k])
                once = np.unique(doc.astype(np.int64) << BITS | f)
                cut = np.searchsorted(once >> BITS, np.arange(k - i + 1))
                found += [(once[x:y] & ((1 << BITS) - 1)).astype(np.int32) for x, y in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), blobs(found)], ["doc_id", "label", "features"])

    def learn(rows: pa.Table) -> dict[str, bytes]:
        labels_of, found = rows.column("label").to_pylist(), rows.column("features")
        w = train([np.frombuffer(found[i].as_buffer(), np.int32) for i in range(len(found))], labels_of)
        return {"bias": np.float64(w.bias).tobytes(), "index": w.index.astype(np.int64).tobytes(), "value": w.value.astype(np.float64).tobytes()}

    sample = sample_labels(labels, "toxic", folds, held, max_rows)
    rows = docs.select(ids(docs), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    got = learnt(map_arrow(rows, kernel, "doc_id long, label int, features binary").dropDuplicates(["doc_id"]), learn)
    return Weights(float(np.frombuffer(got["bias"])[0]), np.frombuffer(got["index"], np.int64), np.frombuffer(got["value"]))


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """docs (doc_id, text; further columns are ignored) -> doc_id, score, one row for each row.

    Null and empty texts get the score of no features. Repeated rows get equal scores. No rows: no rows.
    doc_id: whole numbers, ValueError for others.
    """

    def kernel(batches):
        for b in batches:
            texts = as_bytes(b.column("text"))
            parts = [weights.scores(texts[i:k]) for i, k in chunked([len(t or b"") for t in texts], CHUNK)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(parts) if parts else np.zeros(0))], ["doc_id", "score"])

    return map_arrow(docs.select(ids(docs), "text"), kernel, "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose score reaches threshold; all columns stay. A null text has the score of no features."""
    weights = fit(docs, labels)

    def kernel(batches):
        for b in batches:
            texts = as_bytes(b.column("text"))
            parts = [weights.scores(texts[i:k]) for i, k in chunked([len(t or b"") for t in texts], CHUNK)]
            keep = np.concatenate(parts) < threshold if parts else np.zeros(0, bool)
            yield b.filter(pa.array(keep))

    plain = plainly(docs)
    return map_arrow(plain, kernel, plain.schema).toDF(*docs.columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(bucket_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
