"""Removal of byte strings that occur more than once, by blockwise suffix sorting with a difference cover.

Only suffixes of which the first LENGTH bytes may occur elsewhere are sorted. Of each LENGTH-byte window the K-byte
string of least hash is its anchor; equal windows have equal anchors at equal places, so an anchor whose string occurs
once needs no look. The windows of one anchor stand side by side, in a context. Contexts that are equal as a whole are
counted and not sorted. The others meet by anchor, a bounded block at a time: in a block, positions of a difference
cover (of a period V) get ranks by prefix doubling; the suffixes of a bucket (same anchor string, same distance from
it) are sorted by the bytes before the next cover position and, as ties are long, by that position's rank; windows that
equal a neighbour in that order are repeated. Where an anchor has more contexts than a block takes, as at the edge of a
common passage, its contexts are divided by the distance of their windows from the anchor, and the parts meet by all
bytes that the windows of a part share: parts that are alone or equal as a whole need no sorting, and what is left of a
group is divided again until it fits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tacgrid.llm.base import as_bytes, chunked, ids, map_arrow, materialise, skew_join, table
from tacgrid.llm.textkernels import U, mix

LENGTH = 400
K = 96
#: A perfect difference set: any two distances modulo V have a common shift into it.
V, COVER = 31, np.array([0, 1, 3, 8, 12, 18])
#: Bytes of contexts that are sorted together.
BLOCK = 4 << 20
#: Contexts that are sorted as one group; larger groups are divided, into so many parts at a time.
TOGETHER, PARTS = 256, 4
#: Bytes of texts looked at together; places within a piece take PLACE_BITS bits.
PIECE, PLACE_BITS = 1 << 19, 20

_BASE = U(0x9E3779B97F4A7C15) | U(1)
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        inverse = U(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            out = np.ones(n, np.uint64)
            out[1:] = base
            _powers[name] = np.cumprod(out)
    return _powers["up"][:n], _powers["down"][:n]


def gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    up, down = _power_tables(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + U(1)) * up, out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: len(buf) - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours."""
    n = len(x) - w + 1
    rows = -(-len(x) // w)
    full = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    grid = full.reshape(rows, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of each anchor: text, first window, number of windows, distance of the anchor from it, hash, digest of the context."""
    pieces: list[tuple[int, int, int]] = []  # text, begin, number of windows
    for i, t in enumerate(texts):
        for begin in range(0, len(t) - LENGTH + 1, PIECE):
            pieces.append((i, begin, min(PIECE, len(t) - LENGTH + 1 - begin)))
    out: list[tuple[np.ndarray, ...]] = []
    digests: list[bytes] = []
    for lo, hi in chunked([p[2] + LENGTH - 1 for p in pieces], PIECE):
        own = pieces[lo:hi]
        data = b"".join(texts[i][b : b + n + LENGTH - 1] for i, b, n in own)
        h = gram_hashes(np.frombuffer(data, np.uint8), K)
        key = (h >> U(PLACE_BITS) << U(PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
        least = sliding_min(key, LENGTH - K + 1)
        first = np.cumsum([0, *(n + LENGTH - 1 for _, _, n in own)])[:-1]
        counts = np.array([n for _, _, n in own])
        window = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
        place = (least[window] & U((1 << PLACE_BITS) - 1)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        size = np.diff(np.append(begin, len(place)))
        start, at = window[begin], place[begin]
        piece = np.searchsorted(first, start, "right") - 1
        text = np.array([p[0] for p in own])[piece]
        shift = np.array([p[1] for p in own])[piece] - first[piece]
        digests += [xxhash.xxh3_128_digest(data[s:e], seed) for s, e, seed in zip(start.tolist(), (start + size + LENGTH - 1).tolist(), (at - start).tolist(), strict=True)]
        out.append((text, start + shift, size, at - start, h[at]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
    return *(np.concatenate(c) for c in zip(*out, strict=True)), np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def words_at(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as big-endian numbers. buf ends in eight spare bytes."""
    n = len(buf) - 8
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out = (out << U(8)) | buf[k : k + n].astype(np.uint64)
    return out


def dense_ranks(*keys: np.ndarray) -> np.ndarray:
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def cover_ranks(words: np.ndarray, n: int) -> np.ndarray:
    """Ranks of the suffixes at cover positions below n, by LENGTH bytes or more. n is a multiple of V."""
    at = (np.arange(0, n, V)[:, None] + COVER).ravel()
    ranks = dense_ranks(words[at], words[at + 8], words[at + 16], words[at + 24])
    depth, step = V, len(COVER)
    while depth < LENGTH:
        beyond = np.full(len(ranks), -1, np.int64)
        beyond[:-step] = ranks[step:]
        pair = (ranks.astype(np.uint64) << U(32)) | (beyond + 1).astype(np.uint64)
        ranks = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        depth, step = 2 * depth, 2 * step
    return ranks


def repeated_windows(contexts: list[bytes], anchor: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
    """For each context, which of its windows equal one of another context of the same group.

    anchor: the anchor's place in the context; equal windows have it at equal places.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    counts = sizes - LENGTH + 1
    base, at, parts = np.zeros(len(contexts), np.int64), 0, []
    for i, c in enumerate(contexts):  # anchors go to multiples of V, so windows of one bucket have the same residue
        gap = int(-(at + int(anchor[i])) % V)
        parts += [b"\0" * gap, c]
        base[i] = at + gap
        at += gap + len(c)
    n = -(-(at + 1) // V) * V
    buf = np.frombuffer(b"".join([*parts, b"\0" * (n - at + 1024)]), np.uint8)
    words = words_at(buf)
    ranks = cover_ranks(words, n)

    owner = np.repeat(np.arange(len(contexts)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = base[owner] + inside
    bucket = group[owner] * (1 << 20) + (anchor[owner] - inside)
    residue = np.arange(V)
    ahead = np.array([min((c - r) % V for c in COVER.tolist()) for r in residue.tolist()])
    gap = ahead[start % V]
    shift = (U(64) - U(8) * np.minimum(gap, 8).astype(np.uint64)) % U(64)
    head = np.where(gap > 0, words[start] >> shift, U(0))
    more = np.maximum(gap - 8, 0)
    tail = np.where(more > 0, words[start + 8] >> ((U(64) - U(8) * more.astype(np.uint64)) % U(64)), U(0))
    nearest = start + gap
    index = np.full(V, -1)
    index[COVER] = np.arange(len(COVER))
    rank = ranks[(nearest // V) * len(COVER) + index[nearest % V]]
    order = np.lexsort((rank, tail, head, bucket))
    x, y = order[:-1], order[1:]
    alive = np.flatnonzero((bucket[x] == bucket[y]) & (head[x] == head[y]) & (tail[x] == tail[y]))
    for k in range(0, LENGTH, 8):
        k = min(k, LENGTH - 8)
        alive = alive[words[start[x[alive]] + k] == words[start[y[alive]] + k]]
    flags = np.zeros(len(owner), bool)
    flags[x[alive]] = flags[y[alive]] = True
    return np.split(flags, np.cumsum(counts)[:-1])


KEY = ["_d", "_t", "_u"]


def keyed(docs: DataFrame) -> DataFrame:
    """Rows are known by doc_id and 128 bits of the text; rows alike in both have equal results."""
    text = (F.xxhash64("text").alias("_t"), F.xxhash64(F.lit(1), "text").alias("_u"))
    return docs.select(F.coalesce(ids(docs), F.lit(-(2**63))).alias("_d"), *text, "doc_id", "text")


def find_anchors(docs: DataFrame) -> DataFrame:
    def kernel(batches):
        for b in batches:
            texts = [t or b"" for t in as_bytes(b.column("text"))]
            for i, k in chunked([len(t) for t in texts], 4 * PIECE):
                text, start, n, place, h, digest = anchors(texts[i:k])
                at = pa.array(text + i)
                cols = [*(b.column(k).take(at) for k in KEY), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(h.view(np.int64)), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy())], [*KEY, "start", "n", "place", "h", "c1", "c2"])

    return map_arrow(docs.select(*KEY, "text"), kernel, "_d long, _t long, _u long, start int, n int, place int, h long, c1 long, c2 long")


def cut_contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted contexts, as parts of all their windows. wanted: h, c1, c2, size, KEY, start, n, place."""
    fields = ["h", "c1", "c2", "size", "start", "n", "place"]
    lists = wanted.groupBy(*KEY).agg(F.collect_list(F.struct(*fields)).alias("w"))
    joined = docs.join(lists, KEY, "inner").select("w", "text")

    def kernel(batches):
        for b in batches:
            offsets = np.asarray(b.column("w").offsets)
            flat = b.column("w").values
            cols = {f: np.asarray(flat.field(f)) for f in fields}
            for i, text in enumerate(as_bytes(b.column("text"))):
                lo, hi = int(offsets[i]), int(offsets[i + 1])
                for x, y in chunked((cols["n"][lo:hi] + LENGTH - 1).tolist(), BLOCK):
                    own = slice(lo + x, lo + y)
                    cut = [text[s : s + n + LENGTH - 1] for s, n in zip(cols["start"][own].tolist(), cols["n"][own].tolist(), strict=True)]
                    none = pa.array(np.zeros(y - x, np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(cols["h"][own]), *(pa.array(cols[f][own]) for f in fields[:4]), none, pa.array(cols["place"][own]), pa.array(cut, pa.binary())], ["g", *fields[:4], "w0", "place", "context"])

    return map_arrow(joined, kernel, "g long, h long, c1 long, c2 long, size long, w0 int, place int, context binary")


def sort_parts(parts: DataFrame) -> DataFrame:
    """parts (g, h, c1, c2, w0, place, context), groups of bounded size by g -> (h, c1, c2, w0, n, flags).

    w0: the part's first window in its context, n: its windows, flags: bits of the repeated ones, for parts that have any.
    """

    def solve(g, h, c1, c2, w0, place, data):
        group = np.cumsum(np.concatenate([[0], g[1:] != g[:-1]]))
        found = repeated_windows(data, place.astype(np.int64), group)
        some = [i for i, f in enumerate(found) if f.any()]
        sizes = pa.array(np.array([len(found[i]) for i in some], np.int32))
        flags = pa.array([np.packbits(found[i]).tobytes() for i in some], pa.binary())
        return pa.RecordBatch.from_arrays([*(pa.array(c[some]) for c in (h, c1, c2, w0)), sizes, flags], ["h", "c1", "c2", "w0", "n", "flags"])

    def kernel(batches):
        names = ("g", "h", "c1", "c2", "w0", "place")
        held, data, size = [[] for _ in names], [], 0
        for b in batches:
            for k, name in enumerate(names):
                held[k].append(np.asarray(b.column(name)))
            data += b.column("context").to_pylist()
            size += b.column("context").nbytes
            if size > BLOCK:
                cols = [np.concatenate(c) for c in held]
                cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last group may go on
                if cut:
                    yield solve(*(c[:cut] for c in cols), data[:cut])
                held, data = [[c[cut:]] for c in cols], data[cut:]
                size = sum(map(len, data))
        if data:
            yield solve(*(np.concatenate(c) for c in held), data)

    n = max(8, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return map_arrow(parts.repartition(n, "g").sortWithinPartitions("g"), kernel, PIECES)


PIECES = "h long, c1 long, c2 long, w0 int, n int, flags binary"


def divide(parts: DataFrame, width: int) -> DataFrame:
    """Parts whose windows lie within width distances from the anchor, and their digests.

    g: of the bytes that all windows of those distances have in common; o1, o2: of all bytes of the part.
    """

    def kernel(batches):
        for b in batches:
            out = {k: [] for k in ("g", "o1", "o2", "h", "c1", "c2", "w0", "place", "context")}
            for h, c1, c2, w0, place, data in zip(*(b.column(c).to_pylist() for c in ("h", "c1", "c2", "w0", "place", "context")), strict=True):
                n = len(data) - LENGTH + 1
                for low in range((place - n + 1) // width * width, place + 1, width):
                    first, last = max(0, place - low - width + 1), min(n - 1, place - low)  # windows at distances from low on
                    own = data[first : last + LENGTH]
                    shared = data[place - low : place - low - width + 1 + LENGTH]
                    out["g"].append(int(np.uint64(xxhash.xxh3_64_intdigest(shared, low) ^ (h & (1 << 64) - 1)).view(np.int64)))
                    o1, o2 = np.frombuffer(xxhash.xxh3_128_digest(own, place - first), np.int64).tolist()
                    for k, v in zip(("o1", "o2", "h", "c1", "c2", "w0", "place", "context"), (o1, o2, h, c1, c2, w0 + first, place - first, own), strict=True):
                        out[k].append(v)
            kinds = {"w0": pa.int32(), "place": pa.int32(), "context": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], list(out))

    return map_arrow(parts, kernel, "g long, o1 long, o2 long, h long, c1 long, c2 long, w0 int, place int, context binary")


def settle(parts: DataFrame) -> DataFrame:
    """The repeated windows of the contexts of cut_contexts: (h, c1, c2, w0, n, flags); flags null: all n windows."""
    found = sort_parts(parts.where(F.col("size") <= TOGETHER))
    large = parts.where(F.col("size") > TOGETHER)
    width = LENGTH - K + 1
    while large.limit(1).count():
        width = -(-width // PARTS)
        pieces = materialise(divide(large, width), "pieces")
        kinds = pieces.groupBy("g", "o1", "o2").agg(F.count("*").alias("times"), F.min(F.struct("h", "c1", "c2")).alias("one"))
        groups = kinds.groupBy("g").agg(F.count("*").alias("size"))
        known = materialise(skew_join(kinds, groups, ["g"], "inner").where("size > 1 OR times > 1"), "kinds")
        joined = materialise(skew_join(pieces, known, ["g", "o1", "o2"], "inner"), "divided")
        equal = joined.where("times > 1").select("h", "c1", "c2", "w0", (F.octet_length("context") - (LENGTH - 1)).alias("n"), F.lit(None).cast("binary").alias("flags"))
        rest = joined.where((F.col("size") > 1) & (F.struct("h", "c1", "c2") == F.col("one"))).select("g", "h", "c1", "c2", "size", "w0", "place", "context")
        found = found.union(equal).union(sort_parts(rest.where(F.col("size") <= TOGETHER)))
        large = rest.where(F.col("size") > TOGETHER)
    return found


def drop_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text; further columns are ignored) -> doc_id, n_bytes, kept (binary), spans, one row for each row.

    spans: begin, end, begin, end ... of the removed runs of bytes (end exclusive, maximal). A byte goes if a LENGTH-byte
    string that covers it starts anywhere else, in the same or another row; repeated rows are other rows. Null texts count
    as empty. Texts under LENGTH bytes stay whole. kept needn't be UTF-8: a cut can fall inside a character.
    doc_id: whole numbers, ValueError for others.
    """
    docs = keyed(docs)
    found = materialise(find_anchors(docs), "anchors")
    contexts = found.groupBy("h", "c1", "c2").agg(F.count("*").alias("times"), *(F.first(c).alias(c) for c in (*KEY, "start", "n", "place")))
    contexts = materialise(contexts, "contexts")
    several = contexts.groupBy("h").agg(F.count("*").alias("contexts")).where("contexts > 1").select("h", F.col("contexts").alias("size"))
    wanted = skew_join(contexts, several, ["h"], "inner")
    cut = materialise(cut_contexts(docs, wanted), "cut")
    whole = contexts.where("times > 1").select("h", "c1", "c2", F.lit(0).alias("w0"), "n", F.lit(None).cast("binary").alias("flags"))
    result = materialise(settle(cut).union(whole), "flags")
    hits = skew_join(found.drop("n"), result, ["h", "c1", "c2"], "inner")
    lists = hits.groupBy(*KEY).agg(F.collect_set(F.struct((F.col("start") + F.col("w0")).alias("start"), "n", "flags")).alias("hits"))
    joined = docs.join(lists, KEY, "left").select("doc_id", "text", "hits")

    def kernel(batches):
        for b in batches:
            kept, spans, sizes = [], [], []
            for text, hits in zip(as_bytes(b.column("text")), b.column("hits").to_pylist(), strict=True):
                text = text or b""
                sizes.append(len(text))
                if not hits:
                    kept.append(text)
                    spans.append([])
                    continue
                edge = np.zeros(len(text) + 1, np.int64)
                for x in hits:
                    if x["flags"] is None:
                        edge[x["start"]] += 1
                        edge[x["start"] + x["n"] - 1 + LENGTH] -= 1
                    else:
                        at = x["start"] + np.flatnonzero(np.unpackbits(np.frombuffer(x["flags"], np.uint8))[: x["n"]])
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + LENGTH, -1)
                gone = np.cumsum(edge) > 0  # the last place lies behind the text
                change = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)))
                spans.append(change.tolist())
                kept.append(np.frombuffer(text, np.uint8)[~gone[:-1]].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.int64()))], ["doc_id", "n_bytes", "kept", "spans"])

    return map_arrow(joined, kernel, "doc_id long, n_bytes long, kept binary, spans array<long>")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        (F.size("spans") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
