"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents.

A window of an item is the set of its word shingles. The shingles are ordered by rarity, counted over all documents;
of a window whose shingles must all be found, the first in that order must be there, so only it is joined. Its place
in the window gives the one place where the window can begin (positional bound), the ends of the text rule out others
(length bound), and the words of the item-sized window are then compared one by one.

The benchmark is read in blocks of bounded size. Each block is sent to the executors and passes over all documents
once for the counts and once for the join, so no document is shuffled and a hot passage costs no more than its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tacgrid.llm.base import as_bytes, chunked, map_arrow, materialise, plainly, table, unused
from tacgrid.llm.textkernels import ALNUM, A, U, mix

WINDOW = 10
SHINGLE = 5
CHUNK = 1 << 20
#: Most words of the benchmark in one block; a longer item is cut into overlapping pieces.
BLOCK_WORDS = 400_000
#: Stands between documents; no word.
BREAK, OTHER = -2, -1


def split_words(text: str | bytes | None) -> list[bytes]:
    data = text.encode() if isinstance(text, str) else text or b""
    return data.translate(ALNUM).split()


def shingle_codes(ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, code) of the k-word shingles in which all words are known."""
    n = len(ids) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = ids >= 0
    if k > 1:
        sums = np.concatenate([[0], np.cumsum(known)])
        at = np.flatnonzero(sums[k:] - sums[:-k] == k)
    else:
        at = np.flatnonzero(known)
    code = np.zeros(len(at), np.uint64)
    for j in range(k):
        code = code * A + ids[at + j].astype(np.uint64) + U(1)
    return at, mix(code + U(k))


@dataclass
class Block:
    """Distinct windows of a part of the benchmark. items: by window, the ids of the items that have it."""

    vocabulary: dict[bytes, int]
    windows: list[np.ndarray]
    items: list[list[str]]
    rarity: dict[tuple[int, int], int] = field(default_factory=dict)

    def shingles(self) -> dict[int, np.ndarray]:
        """Distinct codes by shingle size; a window of fewer words than SHINGLE is one shingle."""
        by: dict[int, list[np.ndarray]] = {}
        for w in self.windows:
            k = min(SHINGLE, len(w))
            by.setdefault(k, []).append(shingle_codes(w, k)[1])
        return {k: np.unique(np.concatenate(v)) for k, v in by.items()}

    def prefixes(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By shingle size: the rarest shingle of each window, sorted; where its windows begin; windows; places in them."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for i, w in enumerate(self.windows):
            k = min(SHINGLE, len(w))
            at, code = shingle_codes(w, k)
            _, first, place = min((self.rarity.get((k, c), 0), c, p) for p, c in zip(at.tolist(), code.tolist(), strict=True))
            by.setdefault(k, []).append((first, i, place))
        out = {}
        for k, rows in by.items():
            rows.sort()
            code = np.array([r[0] for r in rows], np.uint64)
            once, begin = np.unique(code, return_index=True)
            out[k] = (once, np.append(begin, len(rows)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        return out


def build_block(items: list[tuple[str | None, list[bytes]]]) -> Block:
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str | None]] = {}
    for item, words in items:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
        for i in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
            found.setdefault(tuple(ids[i : i + WINDOW]), set()).add(item)
    return Block(vocabulary, [np.array(w, np.int64) for w in found], [sorted(x for x in own if x is not None) for own in found.values()])


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The benchmark comes to the driver a partition at a time, and is held a block at a time."""
    held: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item"), "text").toLocalIterator():
        words = split_words(row["text"])
        step = BLOCK_WORDS - WINDOW + 1
        for i in range(0, max(1, len(words) - WINDOW + 1), step):
            held.append((row["item"], words[i : i + BLOCK_WORDS]))
            size += len(held[-1][1])
            if size >= BLOCK_WORDS:
                yield build_block(held)
                held, size = [], 0
    yield build_block(held)


def numbered(texts: list[bytes | None], vocabulary: dict[bytes, int]) -> np.ndarray:
    """Word numbers of the texts, one after the other with a BREAK before each and at the end."""
    data = b" . ".join([b"", *((t or b"").translate(ALNUM) for t in texts), b""])
    words = data.split()
    return np.fromiter(map(vocabulary.get, words, repeat(OTHER)), np.int64, len(words))


def count_rarity(docs: DataFrame, block: Block) -> None:
    known = block.vocabulary | {b".": BREAK}
    codes = block.shingles()

    def kernel(batches):
        sums = {k: np.zeros(len(c), np.int64) for k, c in codes.items()}
        for b in batches:
            texts = as_bytes(b.column("text"))
            for i, j in chunked([len(t or b"") for t in texts], CHUNK):
                ids = numbered(texts[i:j], known)
                for k, own in codes.items():
                    found = shingle_codes(ids, k)[1]
                    at = np.minimum(np.searchsorted(own, found), len(own) - 1)
                    sums[k] += np.bincount(at[own[at] == found], minlength=len(own))
        for k, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["k", "at", "n"])

    if codes:
        for r in map_arrow(docs.select("text"), kernel, "k int, at int, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toLocalIterator():
            block.rarity[r["k"], int(codes[r["k"]][r["at"]])] = r["n"]


@dataclass
class Matcher:
    vocabulary: dict[bytes, int]
    prefixes: dict
    windows: np.ndarray  # padded
    lengths: np.ndarray
    items: list[list[str]]

    @classmethod
    def of(cls, block: Block) -> Matcher:
        padded = np.full((len(block.windows), WINDOW), OTHER, np.int64)
        for row, w in zip(padded, block.windows, strict=True):
            row[: len(w)] = w
        return cls(block.vocabulary | {b".": BREAK}, block.prefixes(), padded, np.array([len(w) for w in block.windows], np.int64), block.items)

    def find(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[tuple[list[tuple[int, int]], set[str]]]]:
        """Numbers of words, and for each text its merged hit spans (in words, end exclusive) and items."""
        ids = numbered(texts, self.vocabulary)
        breaks = np.flatnonzero(ids == BREAK)
        begins, window = [], []
        for k, (codes, first, which, place) in self.prefixes.items():
            at, code = shingle_codes(ids, k)
            near = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = codes[near] == code
            at, near = at[hit], near[hit]
            n = first[near + 1] - first[near]
            row = np.repeat(first[near] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            begins.append(np.repeat(at, n) - place[row])
            window.append(which[row])
        out: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in texts]
        if begins:
            s, w = np.concatenate(begins), np.concatenate(window)
            fits = (s >= 0) & (s + self.lengths[w] <= len(ids))
            s, w = s[fits], w[fits]
            same = np.ones(len(s), bool)
            for j in range(WINDOW):
                inside = j < self.lengths[w]
                same &= ~inside | (ids[np.minimum(s + j, len(ids) - 1)] == self.windows[w, j])
            s, w = s[same], w[same]
            doc = np.searchsorted(breaks, s, "right") - 1
            for i in np.lexsort((s, doc)).tolist():
                spans, items = out[doc[i]]
                a = int(s[i] - breaks[doc[i]] - 1)
                b = a + int(self.lengths[w[i]])
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
                else:
                    spans.append((a, b))
                items.update(self.items[w[i]])
        return np.diff(breaks) - 1, out


ADDED = ["n_words", "hit_spans", "hit_items"]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (text, ...) -> all its columns and n_words, hit_spans, hit_items.

    hit_spans: words covered by an occurrence of a window, as begin, end, begin, end ... (end exclusive, merged).
    hit_items: ids of the items with an occurring window, sorted as strings. Null and empty texts have no words. Items
    without words have no windows; a window of an item without an id hits words but adds no id. Repeated items count
    once; repeated rows get equal results. Columns of docs with the added names are replaced.
    """
    given = docs.drop(*ADDED)
    docs = plainly(given)
    names = docs.columns
    kinds = (LongType(), ArrayType(LongType()), ArrayType(StringType()))
    schema = StructType([*docs.schema, *(StructField(n, t) for n, t in zip(ADDED, kinds, strict=True))])
    out = None
    for block in blocks(benchmark):
        count_rarity(docs, block)
        matcher = Matcher.of(block)

        def kernel(batches, matcher=matcher, again=out is not None):
            for b in batches:
                texts = as_bytes(b.column("text"))
                words, found = [], []
                for i, j in chunked([len(t or b"") for t in texts], CHUNK):
                    n, own = matcher.find(texts[i:j])
                    words.append(n)
                    found += own
                spans = [s for s, _ in found]
                items = [x for _, x in found]
                if again:
                    for i, (s, x) in enumerate(zip(b.column("hit_spans").to_pylist(), b.column("hit_items").to_pylist(), strict=True)):
                        spans[i] = merge(spans[i] + list(zip(s[::2], s[1::2], strict=True)))
                        items[i] = items[i] | set(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(n) for n in names),
                        pa.array(np.concatenate(words) if words else np.zeros(0, np.int64)),
                        pa.array([[x for ab in s for x in ab] for s in spans], pa.list_(pa.int64())),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    ],
                    [*names, *ADDED],
                )

        source = docs if out is None else materialise(out, "contamination")
        out = map_arrow(source, kernel, schema)
    return out.toDF(*given.columns, *ADDED)


def hit_words() -> F.Column:
    ends = F.filter("hit_spans", lambda _, i: i % 2 == 1)
    begins = F.filter("hit_spans", lambda _, i: i % 2 == 0)
    return F.aggregate(F.zip_with(ends, begins, lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a window of the benchmark; all columns stay."""
    aside = docs.withColumnsRenamed({c: unused(docs, f"_{c}") for c in ADDED})  # columns of the input with these names stay
    found = contamination(aside, benchmark).where(F.size("hit_spans") == 0).drop(*ADDED)
    return found.toDF(*docs.columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark")).withColumn("n_hit", hit_words())
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, coalesce({_WORDS.format("text")}, []) AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, len(w[i:i + 9]) AS k, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
places AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k),
hit AS (
  SELECT doc_id, i, x.k, item
  FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM places) x JOIN win ON win.k = x.k AND win.s = x.s),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
       coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
