"""Near-duplicates by the Jaccard similarity of shingles: SimHash links first, then a prefix join for the links they miss.

The fingerprints of a text's set of shingles are searched by the generalised pigeonhole principle, as in simhash.py. At a
similarity of 0.8 fingerprints differ in a sixth of their bits, more than any such search can cover below the cost of all
pairs; what it finds is therefore completed: two sets with a similarity of 0.8 or more share SHARED of the first
n // 5 + SHARED members of each, in any order that holds for all sets. Shingles are ordered by how often their slot, the
leading bits of the hash, is taken over all documents, rarest first; the order has no influence on the result. Every
candidate is settled by the sets themselves, each member by the upper 32 bits of its hash.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tacgrid.llm.base import as_bytes, every, ids, map_arrow, materialise, sieve, sift, skew_join, unused
from tacgrid.llm.graph import components
from tacgrid.llm.simhash import FIVE_WORDS, make_plan, near_edges
from tacgrid.llm.textkernels import mix

SEED = 42
#: Bits of a hash that name its slot; slots that travel together as one row.
SLOT_BITS, SLOTS_PER_ROW = 20, 1 << 13
#: Members that the prefixes of similar sets have in common at least. Sets of fewer than four are similar to none but themselves.
SHARED = 3
#: Bits of 128 in which the fingerprints of similar sets differ at most: 19 on average at a similarity of 0.8, and over this
#: once in 10^9. Sets under MANY members aren't judged by it.
APART, MANY = 44, 16
#: Sets that share a prefix member are paired with each other up to this number; beyond it, with one of them first.
TOGETHER = 64


def shingles(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of size words; of all words where there are fewer; empty without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - size + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[size - 1 :] if len(words) >= size else ends[-1:]
    cut = [joined[i:k] for i, k in zip(starts[:n].tolist(), last.tolist(), strict=True)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), np.uint64, n))


def short(own: np.ndarray) -> np.ndarray:
    """The set as it travels: the upper halves of the hashes, sorted and distinct."""
    return np.unique((own >> np.uint64(32)).astype(np.uint32))


def node_of(own: np.ndarray) -> int:
    """Signed 64 bits for a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def majority(own: np.ndarray) -> int:
    """The set's fingerprint, as signed 64 bits; zero for an empty set."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(own), 1 << 16):
        part = np.ascontiguousarray(own[i : i + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(own), bitorder="little").view(np.int64)[0])


def slot_of(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def prefix(own: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The members by which a set is found: those of the rarest slots first, then by value."""
    n = len(own) // 5 + SHARED if len(own) > SHARED else 0
    return own[np.argsort(rank[slot_of(own)], kind="stable")[:n]]


def slot_ranks(docs: DataFrame, size: int) -> np.ndarray:
    """The place of every slot when they are ordered by the number of texts that have a shingle in them, over all docs.

    A task sends one number for a slot, as byte planes, which compress well; they are summed as they come, a row of slots
    in one task. As many numbers as there are slots reach the driver, whatever the size of the input.
    """

    def count(batches):
        slots = np.zeros(1 << SLOT_BITS, np.uint64)
        for b in batches:
            for t in as_bytes(b.column("text")):
                slots[slot_of(shingles(t, size))] += np.uint64(1)
        if slots.any():
            yield rows_of(dict(enumerate(slots.reshape(-1, SLOTS_PER_ROW))))

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, planes in zip(b.column("at").to_pylist(), b.column("planes").to_pylist(), strict=True):
                sums[at] = sums.get(at, np.uint64(0)) + counts_in(planes)
        if sums:
            yield rows_of(sums)

    def rows_of(counts: dict[int, np.ndarray]) -> pa.RecordBatch:
        planes = [np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in counts.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(planes, pa.binary())], ["at", "planes"])

    schema = "at int, planes binary"
    total = map_arrow(map_arrow(docs.select("text"), count, schema).repartition("at"), add, schema).toArrow()
    counts = np.zeros(1 << SLOT_BITS, np.uint64).reshape(-1, SLOTS_PER_ROW)
    for at, planes in zip(total.column("at").to_pylist(), total.column("planes").to_pylist(), strict=True):
        counts[at] = counts_in(planes)
    rank = np.empty(1 << SLOT_BITS, np.uint32)
    rank[np.argsort(counts.ravel(), kind="stable")] = np.arange(1 << SLOT_BITS, dtype=np.uint32)
    return rank


def counts_in(planes: bytes) -> np.ndarray:
    """The counts of a row of slots, from their byte planes."""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def marked(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, node, n, fp0, fp1, keys): a number for the set of shingles, its size, fingerprints and prefix; a row for each row."""
    rank = slot_ranks(docs, size)

    def kernel(batches):
        for b in batches:
            own = [shingles(t, size) for t in as_bytes(b.column("text"))]
            keys = [prefix(s, rank).view(np.int64) for s in own]
            cols = [pa.array(map(node_of, own), pa.int64()), pa.array(map(len, own), pa.int32()), pa.array(map(majority, own), pa.int64()), pa.array((majority(mix(s)) for s in own), pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "node", "n", "fp0", "fp1", "keys"])

    return map_arrow(docs, kernel, "doc_id long, node long, n int, fp0 long, fp1 long, keys array<long>")


def may_be_alike(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether sets of n members, with fingerprints fp0 and fp1, can have a similarity of 0.8 if the member at place pos of each is one of the first SHARED in common.

    At most SHARED - 1 common members come before that one, so what follows has to hold the others.
    """
    enough = 9 * (SHARED - 1 + F.least(a("n") - a("pos"), b("n") - b("pos"))) >= 4 * (a("n") + b("n"))
    apart = sum((F.bit_count(a(c).bitwiseXOR(b(c))) for c in ("fp0", "fp1")), F.lit(0))
    return enough & (4 * a("n") <= 5 * b("n")) & (4 * b("n") <= 5 * a("n")) & ((F.least(a("n"), b("n")) < MANY) | (apart <= APART))


def sets_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, own): the sets of the nodes (node, first), each from the row with the smallest doc_id that has it.

    A sieve of these doc_ids keeps other texts from being cut into shingles and moved.
    """

    def kernel(batches):
        for b in batches:
            own = [shingles(t, size) for t in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(node_of, own), pa.int64()), pa.array([short(s).tobytes() for s in own], pa.binary())], ["doc_id", "node", "own"])

    nodes = materialise(nodes, "wanted", 1 << 14)
    may_be, _ = sift(docs, F.col("doc_id"), sieve(nodes.select("first")))
    rows = map_arrow(may_be, kernel, "doc_id long, node long, own binary").alias("s")
    wanted = nodes.alias("w")
    found = rows.join(wanted, (F.col("s.node") == F.col("w.node")) & F.col("s.doc_id").eqNullSafe(F.col("w.first")))
    return found.groupBy("s.node").agg(F.first("s.own").alias("own"))


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose sets have a similarity of 0.8 or more."""
    one = skew_join(pairs, sets.select(F.col("node").alias("a"), F.col("own").alias("x")), ["a"], "inner")
    both = skew_join(one, sets.select(F.col("node").alias("b"), F.col("own").alias("y")), ["b"], "inner")

    def kernel(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = np.sort(np.concatenate([p, q]), kind="stable")
                keep.append(9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both.select("a", "b", "x", "y"), kernel, "a long, b long")


def fingerprint_links(unique: DataFrame) -> DataFrame:
    """(a, b): nodes whose fingerprints are within a few bits, enough pairs to connect all such."""
    plan = make_plan(unique, FIVE_WORDS)
    if plan is None:
        return unique.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    return materialise(near_edges(unique, plan), "near", 1 << 14)


def near_components(docs: DataFrame, size: int = 5) -> DataFrame:
    """docs (doc_id, text; further columns are ignored) -> (doc_id, component_id), one row for each row.

    component_id is the smallest doc_id that can be reached over pairs of texts whose shingles have a Jaccard similarity
    of 0.8 or more. Texts without words are alike. Rows without a doc_id get a component like others but are never its
    smallest; a component of only such rows has none. Sets that share a prefix member with few others are paired up; of more
    than TOGETHER sets each is compared with the first one, and then, pair by pair, those that are still in different
    components: only a group whose members are mostly just below the similarity takes time by its square.
    """
    docs = docs.select(ids(docs), "text")
    about = ("n", "fp0", "fp1")
    left, right, head = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}")), (lambda c: F.col(f"head.{c}"))
    rows = materialise(marked(docs, size), "shingles")  # read below as nodes, keys and documents
    unique = materialise(rows.groupBy("node").agg(F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in (*about, "keys"))), "unique")
    keys = unique.select("node", F.posexplode("keys").alias("pos", "key"))
    several = keys.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    sized = unique.select("node", *about)
    shared = materialise(skew_join(keys, several, ["key"], "inner").join(sized, "node"), "shared", 1 << 14)
    candidates = shared.select("node").distinct()

    few = shared.where(F.col("times") <= TOGETHER)
    a, b = few.alias("a"), few.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & may_be_alike(left, right))
    pairs = pairs.groupBy(F.col("a.node").alias("a"), F.col("b.node").alias("b")).count().where(F.col("count") >= SHARED).drop("count")
    crowd = shared.where(F.col("times") > TOGETHER)
    heads = crowd.groupBy("key").agg(F.min(F.struct("node", *about, "pos")).alias("head"))
    first = skew_join(crowd, heads, ["key"], "inner").where((F.col("node") > head("node")) & may_be_alike(F.col, head))
    near = fingerprint_links(unique.join(candidates, "node", "left_semi").select("node", "fp0"))
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = pairs.union(first.select(head("node").alias("a"), F.col("node").alias("b"))).union(near)
    pairs = materialise(pairs.distinct(), "pairs", 1 << 14)

    many = crowd.select("key", "node", *about, "pos")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(many.select("node")).distinct()
    sets = materialise(sets_of(docs, unique.join(wanted, "node", "left_semi").select("node", "first"), size), "sets")
    links = materialise(alike(pairs, sets), "links", 1 << 14)
    roots = components(links)

    apart = skew_join(many, roots, ["node"], "left").select("key", "node", *about, "pos", F.coalesce("root", "node").alias("root"))
    open_keys = apart.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    apart = materialise(skew_join(apart, open_keys, ["key"], "inner"), "apart", 1 << 14)
    a, b = apart.alias("a"), apart.alias("b")
    rest = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.root") < F.col("b.root")) & may_be_alike(left, right))
    rest = materialise(rest.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), "rest", 1 << 14)
    more = materialise(alike(rest, sets), "more", 1 << 14)
    roots = components(links.union(more)) if more.limit(1).count() else roots

    rooted = unique.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = skew_join(rooted, least, ["root"], "inner").select("node", "component_id")
    return skew_join(rows.select("doc_id", "node"), classes, ["node"], "inner").select("doc_id", "component_id")


def keep_one(docs: DataFrame, size: int = 5) -> DataFrame:
    """docs without the rows that aren't the first of their component by similarity of shingles; all columns stay.

    Rows without a doc_id stay. Rows that share a doc_id are one document and stay or go together.
    """
    name = unused(docs, "_gone")
    gone = near_components(docs, size).where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    gone = materialise(gone, "gone", 1 << 14)
    may_go, stay = sift(docs, ids(docs), sieve(gone))
    kept = may_go.join(gone, ids(docs) == F.col(name), "left_anti").select(*every(docs))
    return stay.union(kept)
