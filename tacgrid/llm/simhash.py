"""SimHash near-dedup with the generalised pigeonhole principle.

Fingerprints within T bits of each other are found by partitions of the 64 bits with thresholds t_i that sum to
T - m + 1 (-1: a partition is not looked at): at least one partition differs in t_i bits or fewer. Bits that go
together share a partition; the number of partitions and the thresholds come from a dynamic programme on candidate
counts, taken from histograms of all distinct fingerprints. Candidates that share a key are verified in numpy blocks;
of each block only a spanning forest goes on to the search for connected components.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tacgrid.llm.base import BROADCAST_ROWS, as_bytes, ids, map_arrow, materialise, skew_join, table
from tacgrid.llm.graph import components, local_roots
from tacgrid.llm.textkernels import A, U, mix

@dataclass(frozen=True)
class Config:
    """size: words in a shingle. words: 64-bit words of the fingerprint. threshold: bits that linked fingerprints may
    differ in. partitions: numbers of partitions that are compared; a partition has at most 16 bits, so its histogram
    at most 65,536 values. refine: a bucket with more fingerprints is divided by further exact pieces of the other bits."""

    size: int = 4
    words: int = 1
    threshold: int = 4
    partitions: tuple[int, ...] = (4, 5)
    refine: int = 2048

    @property
    def bits(self) -> int:
        return 64 * self.words

    @property
    def columns(self) -> list[str]:
        return [f"fp{k}" for k in range(self.words)]


SEED = 42
#: A key with more rows than this is dealt out as pairs of blocks.
BLOCK = 16384
#: Relative costs of a row with a key, and of a pair that is compared.
ROW_COST, PAIR_COST = 1000.0, 3.0


def fingerprint(text: bytes | None, size: int = 4, seed: int = SEED) -> int:
    """Signed 64 bits; zero for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[size - 1 :] if len(words) >= size else ends[-1:]
    cut = [joined[i:k] for i, k in zip(starts[:n].tolist(), last.tolist(), strict=True)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(seed)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = np.ascontiguousarray(h[i : i + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    over = counts * 2 > n
    return int(np.packbits(over, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, config: Config) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, fp0 ...), one row for each row; null and empty texts have zeros."""

    def kernel(batches):
        for b in batches:
            texts = as_bytes(b.column("text"))
            fps = [pa.array([fingerprint(t, config.size, SEED + k) for t in texts], pa.int64()) for k in range(config.words)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *fps], ["doc_id", *config.columns])

    return map_arrow(docs.select(ids(docs), "text"), kernel, ", ".join(["doc_id long", *(f"{c} long" for c in config.columns)]))


def values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of each fingerprint (a row of 64-bit words), packed."""
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((fps[:, b >> 6] >> U(b & 63)) & U(1)).astype(np.int64) << k
    return out


def unpacked(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")


def _fps(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.stack([np.asarray(batch.column(c)).astype(np.int64).view(np.uint64) for c in columns], 1)


def group_bits(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m partitions of the bits, correlated bits in one. together: how often two bits are both set, over n fingerprints."""
    mean = together.diagonal() / n
    cov = together / n - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    corr = np.abs(cov / np.outer(dev, dev))
    np.fill_diagonal(corr, 0)
    bits = len(together)
    left, out = list(range(bits)), []
    for k in range(m):
        width = bits // m + (k < bits % m)
        own = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < width:
            best = max(left, key=lambda b: (corr[b, own].sum(), -b))
            own.append(best)
            left.remove(best)
        out.append(sorted(own))
    return out


def masks(width: int, t: int) -> list[int]:
    return [sum(1 << b for b in some) for some in combinations(range(width), t)] if t >= 0 else []


def masked_counts(hist: np.ndarray, mask: int) -> np.ndarray:
    """How many fingerprints equal each value outside mask."""
    at, out = np.arange(len(hist)), hist
    b = 0
    while mask >> b:
        if mask >> b & 1:
            out = out + out[at ^ (1 << b)]
        b += 1
    return out


@dataclass
class Plan:
    config: Config
    bits: list[list[int]]
    thresholds: list[int]
    crowded: list[list[np.ndarray]]  # by partition and mask: which values more than config.refine fingerprints have
    most: int  # fingerprints of one value
    cost: float

    def keys(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, row of fps, slot): all pairs within the threshold share a key. slot: partition * 1000 + mask."""
        out_k, out_r, out_s, row, pieces = [], [], [], np.arange(len(fps)), self.config.threshold + 1
        for i, (bits, t) in enumerate(zip(self.bits, self.thresholds, strict=True)):
            v = values(fps, bits) if t >= 0 else None
            rest = [b for j, other in enumerate(self.bits) if j != i for b in other]
            for j, mask in enumerate(masks(len(bits), t)):
                key = mix((v & ~mask).astype(np.uint64) * A + U(i * 1000 + j))
                large = self.crowded[i][j][v]
                out_k.append(key[~large])
                out_r.append(row[~large])
                out_s.append(np.full(len(out_r[-1]), i * 1000 + j, np.int32))
                if large.any():
                    for p in range(pieces):  # one of these pieces is equal in each pair
                        piece = values(fps[large], rest[p::pieces]).astype(np.uint64)
                        out_k.append(mix(key[large] + piece * A + U(p + 1)))
                        out_r.append(row[large])
                        out_s.append(np.full(len(out_r[-1]), i * 1000 + j, np.int32))
        return np.concatenate(out_k), np.concatenate(out_r), np.concatenate(out_s)

    def first_key(self, slots: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Whether the key of that slot is the first that a pair shares. apart: the xor of its fingerprints, a row for each pair.

        A pair is linked at its first key alone: members of a large group share a hundred keys, and would be linked at each.
        """
        part, alive = slots // 1000, np.ones(len(slots), bool)
        for i, (bits, t) in enumerate(zip(self.bits, self.thresholds, strict=True)):
            at = np.flatnonzero(alive & (part >= i)) if t >= 0 else ()
            if not len(at):
                continue
            word = np.zeros(self.config.words, np.uint64)
            for b in bits:
                word[b >> 6] |= U(1 << (b & 63))
            d = np.bitwise_count(apart[at] & word).sum(1)
            own = part[at] == i
            alive[at] = np.where(own, (d > 0) | (slots[at] % 1000 == 0), d > t)
        return alive


def allocate(bits: list[list[int]], hists: list[np.ndarray], config: Config) -> Plan:
    """Thresholds of least cost: dynamic programming over the partitions on counted rows and candidate pairs."""
    m, n = len(bits), float(hists[0].sum())
    options = []
    for own, hist in zip(bits, hists, strict=True):
        costs = {-1: 0.0}
        for t in range(3):
            found = [float((masked_counts(hist, k).astype(np.float64) * hist).sum() / 2) for k in masks(len(own), t)]
            costs[t] = ROW_COST * n * len(found) + PAIR_COST * sum(found)
        options.append(costs)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for costs in options:
        now: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t, c in costs.items():
                if total + t not in now or cost + c < now[total + t][0]:
                    now[total + t] = (cost + c, [*chosen, t])
        best = now
    cost, chosen = best[config.threshold - m + 1]
    counts = [[masked_counts(h, k) for k in masks(len(own), t)] for own, h, t in zip(bits, hists, chosen, strict=True)]
    return Plan(config, bits, chosen, [[c > config.refine for c in own] for own in counts], max(int(c.max()) for own in counts for c in own), cost)


def make_plan(unique: DataFrame, config: Config) -> Plan | None:
    """Counts over all distinct fingerprints; what the driver gets is bounded by the bits, not by the rows."""
    width, columns = config.bits, config.columns

    def together(batches):
        total, n = np.zeros((width, width)), 0
        for b in batches:
            own = unpacked(_fps(b, columns)).astype(np.float32)
            total += own.T @ own
            n += len(own)
        counts = [n, *total.ravel().astype(np.int64).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(counts)), pa.int32()), pa.array(counts, pa.int64())], ["at", "n"])

    rows = unique.select(*columns)
    got = map_arrow(rows, together, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(1 + width * width)
    found[np.asarray(got.column("at"))] = np.asarray(got.column("n"))
    n = int(found[0])
    if n < 2:
        return None
    layouts = [group_bits(found[1:].reshape(width, width), n, m) for m in config.partitions]

    def histograms(batches):
        sums = [[np.zeros(1 << len(own), np.int64) for own in layout] for layout in layouts]
        for b in batches:
            fps = _fps(b, columns)
            for layout, own_sums in zip(layouts, sums, strict=True):
                for own, h in zip(layout, own_sums, strict=True):
                    v, c = np.unique(values(fps, own), return_counts=True)
                    h[v] += c
        for x, own_sums in enumerate(sums):
            for i, h in enumerate(own_sums):
                at = np.flatnonzero(h)
                place = pa.array(np.full(len(at), x * 100 + i, np.int32))
                yield pa.RecordBatch.from_arrays([place, pa.array(at.astype(np.int32)), pa.array(h[at])], ["place", "at", "n"])

    counted = map_arrow(rows, histograms, "place int, at int, n long").groupBy("place", "at").agg(F.sum("n").alias("n")).toArrow()
    place, at, count = (np.asarray(counted.column(k)) for k in ("place", "at", "n"))
    plans = []
    for x, layout in enumerate(layouts):
        hists = []
        for i, own in enumerate(layout):
            h = np.zeros(1 << len(own), np.int64)
            mine = place == x * 100 + i
            h[at[mine]] = count[mine]
            hists.append(h)
        plans.append(allocate(layout, hists, config))
    return min(plans, key=lambda p: p.cost)


def near_pairs(columns: list[np.ndarray], threshold: int):
    """(i, k) arrays of the pairs among all given fingerprints, in tiles; the first word rules most of them out."""
    n, rows, wide = len(columns[0]), 128, 1024
    apart, bits = np.empty((rows, wide), np.uint64), np.empty((rows, wide), np.uint8)
    for a in range(0, n, rows):
        b = min(a + rows, n)
        for c in range(a, n, wide):
            d = min(c + wide, n)
            x, y = apart[: b - a, : d - c], bits[: b - a, : d - c]
            np.bitwise_xor(columns[0][a:b, None], columns[0][None, c:d], out=x)
            np.bitwise_count(x, out=y)
            i, k = np.nonzero(y <= threshold)
            i, k = i + a, k + c
            later = i < k
            i, k = i[later], k[later]
            if len(columns) > 1:
                total = sum(np.bitwise_count(w[i] ^ w[k]).astype(np.int64) for w in columns)
                i, k = i[total <= threshold], k[total <= threshold]
            if len(i):
                yield i, k


#: Runs of a key with fewer rows than this are compared together, larger ones in tiles.
SMALL_RUN = 48


def links(keys: np.ndarray, fps: np.ndarray, threshold: int, slots: np.ndarray | None = None, plan: Plan | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as row numbers, of the links between fingerprints that share a key. keys are sorted; rows may repeat.

    With slots and plan, of the links of which it is the first key.
    """
    n = len(fps)
    labels, pend_a, pend_b, size = np.arange(n), [], [], 0
    columns = [np.ascontiguousarray(fps[:, k]) for k in range(fps.shape[1])]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if n else np.zeros(0, np.int64)
    length = np.diff(np.append(begin, n))

    def add(i, k):
        nonlocal labels, pend_a, pend_b, size
        if plan is not None:
            first = plan.first_key(slots[i], fps[i] ^ fps[k])
            i, k = i[first], k[first]
        pend_a.append(i)
        pend_b.append(k)
        size += len(i)
        if size > 1 << 20:
            flush()

    def flush():
        nonlocal labels, pend_a, pend_b, size
        if pend_a:
            labels = local_roots(n, np.concatenate(pend_a), np.concatenate(pend_b), labels)
        pend_a, pend_b, size = [], [], 0

    small = length < SMALL_RUN
    rest = np.repeat(begin + length, length)[np.repeat(small, length)]  # where each row's run ends
    at, d = np.flatnonzero(np.repeat(small, length)), 0
    while len(at):
        d += 1
        on = at + d < rest
        at, rest = at[on], rest[on]
        apart = sum(np.bitwise_count(c[at] ^ c[at + d]).astype(np.int64) for c in columns)
        near = at[apart <= threshold]
        if len(near):
            add(near, near + d)
    for s, m in zip(begin[~small].tolist(), length[~small].tolist(), strict=True):
        for i, k in near_pairs([c[s : s + m] for c in columns], threshold):
            add(i + s, k + s)
    flush()
    linked = np.flatnonzero(labels != np.arange(n))
    return linked, labels[linked]


def near_edges(unique: DataFrame, plan: Plan) -> DataFrame:
    """unique (node, fp0 ...) -> (a, b): links between distinct fingerprints, enough of them to connect all that are linked."""
    config, columns = plan.config, plan.config.columns

    def keyed(batches):
        for b in batches:
            k, row, slot = plan.keys(_fps(b, columns))
            kept = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(slot), *kept.columns], ["key", "slot", *kept.schema.names])

    fields = ["node", *columns]
    rows = map_arrow(unique.select(*fields), keyed, "key long, slot int, " + ", ".join(f"{c} long" for c in fields))
    if plan.most > min(BLOCK, config.refine):
        # What is still large after the division is dealt out as pairs of blocks, so that no task holds all of it.
        hot = materialise(rows.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "hot")
        n = hot.count()
        if n:
            rows = rows.join(F.broadcast(hot) if n <= BROADCAST_ROWS else hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            key = F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
            rows = rows.select(key.alias("key"), "slot", *fields)

    def solve(keys, slots, nodes, fps):
        a, b = links(keys, fps, config.threshold, slots, plan)
        a, b = nodes[a], nodes[b]
        return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    def kernel(batches):
        held, size = [], 0
        for b in batches:
            held.append((np.asarray(b.column("key")), np.asarray(b.column("slot")), np.asarray(b.column("node")), _fps(b, columns)))
            size += b.num_rows
            if size > 1 << 17:
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on
                if cut:
                    yield solve(*(c[:cut] for c in cols))
                held, size = [tuple(c[cut:] for c in cols)], len(cols[0]) - cut
        if size:
            yield solve(*(np.concatenate(c) for c in zip(*held, strict=True)))

    n = max(8, int(unique.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return map_arrow(rows.repartition(n, "key").sortWithinPartitions("key"), kernel, "a long, b long")


def near_duplicates(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """docs (doc_id, text; further columns are ignored) -> (doc_id, fp0 ..., component_id), one row for each row.

    component_id is the smallest doc_id whose fingerprint can be reached over links of at most config.threshold bits. Texts
    without words have fingerprint 0 and link like others. Rows without a doc_id get a component like others but are
    never its smallest; a component of only such rows has none. Repeated rows get equal results.
    doc_id: whole numbers, ValueError for others.
    """
    columns = config.columns
    node = F.col("fp0") if config.words == 1 else F.xxhash64(*columns)
    fps = materialise(fingerprints(docs, config).withColumn("node", node), "fingerprints")
    unique = materialise(fps.groupBy("node", *columns).agg(F.min("doc_id").alias("first")), "unique")
    plan = make_plan(unique, config)
    out = ["doc_id", *columns, "component_id"]
    if plan is None:
        return skew_join(fps, unique.select("node", F.col("first").alias("component_id")), ["node"], "inner").select(*out)
    edges = materialise(near_edges(unique, plan), "near", 1 << 14)
    roots = components(edges)
    rooted = materialise(unique.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = skew_join(rooted, least, ["root"], "inner").select("node", "component_id")
    return skew_join(fps, classes, ["node"], "inner").select(*out)


#: Fingerprints of sets of five-word shingles: what differs in so few bits is linked first (see shingles.py).
FIVE_WORDS = Config(size=5, threshold=6, partitions=(4, 5, 6))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")
