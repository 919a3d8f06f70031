"""Quality classifier: supervised subword embeddings.

Each word and each of its character n-grams has a learned vector, found by hash. A text is the mean of its vectors; a softmax
over two classes sits on top; plain stochastic gradient descent in numpy learns both from a bounded sample of labelled
rows. A word that repeats the one before also gives a feature of its own. As the output is linear in the mean, each
vector counts in scoring only by its product with the output weights: one number for each hash is sent to executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tacgrid.llm.base import as_bytes, blobs, bucket_of, chunked, ids, map_arrow, table
from tacgrid.llm.textkernels import VISIBLE, U, Words, char_grams
from tacgrid.llm.toxicity import learnt, sample_labels

BITS = 16
CHUNK = 1 << 20
GRAMS = (2, 3, 4)
DIM = 8
#: Bound of the labelled sample; the rows with the smallest hashes of doc_id are taken.
MAX_TRAIN_ROWS = 5000
#: The feature of a repeated word; words and n-grams of hash 0 share it.
REPEAT = 0


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of each word, n-gram and repetition."""
    w = Words(texts, VISIBLE)
    h = w.hashes()
    again = np.flatnonzero((h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])) + 1
    docs, codes = [w.doc, w.doc[again]], [h >> U(64 - BITS), np.full(len(again), REPEAT, np.uint64)]
    for n in GRAMS:
        code, at = char_grams(w, n)
        docs.append(np.searchsorted(w.first, at + 1, "right") - 1)  # the space before a text's first word is the text's
        codes.append(code >> U(64 - BITS))
    doc = np.concatenate(docs)
    return np.clip(doc, 0, max(0, w.n - 1)), np.concatenate(codes).astype(np.int64)


@dataclass
class Model:
    """logit = bias + mean of gain over the features."""

    bias: float
    gain: np.ndarray

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        doc, f = features(texts)
        total = np.bincount(doc, self.gain[f], len(texts))
        count = np.bincount(doc, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(count, 1), -35, 35)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], rate: float = 0.5, epochs: int = 8, seed: int = 11) -> Model:
    """rows: distinct features and their counts. No rows: every score is near one."""
    if not rows:
        return Model(35.0, np.zeros(1 << BITS))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM))
    out, bias = np.zeros((DIM, 2)), np.zeros(2)
    share = np.bincount(labels, minlength=2) / len(labels)
    weight = np.sqrt(0.5 / np.maximum(share, 1e-6)).clip(0.5, 3)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f, c = rows[i]
            now = rate * (1 - done / steps)
            done += 1
            part = c / max(1, c.sum())
            mean = part @ vectors[f]
            logit = mean @ out + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= weight[labels[i]]
            back = out @ p
            out -= now * np.outer(mean, p)
            bias -= 0.1 * now * p
            vectors[f] -= now * np.outer(part, back) * min(50.0, len(f))
    return Model(float(bias[1] - bias[0]), vectors @ (out[:, 1] - out[:, 0]))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, folds: int = 4, held: int = 2) -> Model:
    """docs (doc_id, text), labels (doc_id, quality) -> model, from at most max_rows labelled rows outside the held fold.

    Rows of docs or labels without a doc_id and labels other than 0 and 1 don't count; of a doc_id's several labels the
    largest does, of its several texts one. Null texts have no features. Without labelled rows all scores are near one.
    doc_id: whole numbers, ValueError for others.
    """
    def kernel(batches):
        for b in batches:
            texts = as_bytes(b.column("text"))
            found, counts = [], []
            for i, k in chunked([len(t or b"") for t in texts], CHUNK):
                doc, f = features(texts[i:k])
                once, n = np.unique(doc.astype(np.int64) << BITS | f, return_counts=True)
                cut = np.searchsorted(once >> BITS, np.arange(k - i + 1))
                for x, y in zip(cut[:-1], cut[1:], strict=True):
                    found.append((once[x:y] & ((1 << BITS) - 1)).astype(np.int32))
                    counts.append(n[x:y].astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), blobs(found), blobs(counts)], ["doc_id", "label", "features", "counts"])

    def learn(rows: pa.Table) -> dict[str, bytes]:
        found, counts = rows.column("features"), rows.column("counts")
        own = [(np.frombuffer(found[i].as_buffer(), np.int32), np.frombuffer(counts[i].as_buffer(), np.int32)) for i in range(len(found))]
        model = train(own, rows.column("label").to_pylist())
        return {"bias": np.float64(model.bias).tobytes(), "gain": model.gain.tobytes()}

    sample = sample_labels(labels, "quality", folds, held, max_rows)
    rows = docs.select(ids(docs), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    got = learnt(map_arrow(rows, kernel, "doc_id long, label int, features binary, counts binary").dropDuplicates(["doc_id"]), learn)
    return Model(float(np.frombuffer(got["bias"])[0]), np.frombuffer(got["gain"]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text; further columns are ignored) -> doc_id, score, one row for each row.

    Null and empty texts get the score of no features. Repeated rows get equal scores. No rows: no rows.
    doc_id: whole numbers, ValueError for others.
    """

    def kernel(batches):
        for b in batches:
            texts = as_bytes(b.column("text"))
            parts = [model.scores(texts[i:k]) for i, k in chunked([len(t or b"") for t in texts], CHUNK)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(parts) if parts else np.zeros(0))], ["doc_id", "score"])

    return map_arrow(docs.select(ids(docs), "text"), kernel, "doc_id long, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(bucket_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
