"""Prefix tries of conversations, packed as double arrays.

Distinct conversations are sorted turn by turn, so that a node's members lie side by side. Stretches of that order are the
shards. A shard numbers its turns densely and packs its trie into BASE and CHECK: the child of state s by turn t is
BASE[s] + t where CHECK of that is s. Conversations walk through it, level by level, and aggregates go back up. A node
can reach over a shard's border only if it lies on the shard's first or last conversation; what shards tell of such nodes
is merged globally, and what they counted twice below them is put right along the merged nodes' ancestors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tacgrid.llm.base import BROADCAST_ROWS, map_arrow, materialise, skew_join, table

#: Turns of a shard, which is one conversation at least.
SHARD_TURNS = 1 << 17
#: Conversations are dealt out by this many first turns; those alike so far are sorted, a stream, in one task.
DEAL_TURNS = 32
#: Ids of conversations that end at a node are joined by ranges of this many.
ID_RANGE = 1 << 14
#: Places of a double array that a node with several children tries before it goes behind the last used one.
TRIES = 24
WORD = r"[^\x20\x09-\x0D]+"
NOTHING = hashlib.sha256(b"").hexdigest()
ROOT = hashlib.md5(b"").digest()


def turn_key(role: Column, text: Column) -> Column:
    """128 bits that name a turn; the role's length keeps role and text apart."""
    return F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))


def conversations(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) -> conv_id, path (keys of turns in order), words (of each text); rows without conv_id go."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    n = F.regexp_count(text, F.lit(WORD)).cast("long")
    each = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"), role.alias("c"), turn_key(role, text).alias("d"), n.alias("e"))
    ordered = F.sort_array(F.collect_list(each))
    return rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(ordered.alias("t")).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("t.d").alias("path"), F.col("t.e").alias("words"))


def rebuilt(own: DataFrame, heads: Column, period: int) -> DataFrame:
    """Each conversation with its first `heads` turns taken from the conversation before whose id is a multiple of period."""
    first = own.where(F.col("conv_id") % period == 0).select(F.col("conv_id").alias("_of"), F.slice("path", 1, 3).alias("_path"), F.slice("words", 1, 3).alias("_words"))
    joined = own.withColumn("_of", F.col("conv_id") - F.col("conv_id") % period).join(first, "_of", "left").withColumn("_h", heads)
    rest = lambda c: F.slice(c, F.col("_h") + 1, F.greatest(F.size(c) - F.col("_h"), F.lit(0)))
    both = lambda c, kind: F.concat(F.slice(F.coalesce(f"_{c}", F.array().cast(kind)), F.lit(1), F.col("_h")), rest(c)).alias(c)
    return joined.select("conv_id", both("path", "array<binary>"), both("words", "array<long>"))


def spliced_heads(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % 4).cast("int")


def digests(members: DataFrame) -> DataFrame:
    """members (key, conv_id) -> key, ends: the SHA-256 of the ids in order, comma-joined, 32 bytes.

    Ids come joined by ranges; a key's ranges pass through one task as a stream, none is gathered.
    """
    ranges = members.groupBy("key", F.floor(F.col("conv_id") / ID_RANGE).alias("range")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    texts = ranges.select("key", "range", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if state is not None:
                        done.append((key, state.digest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.binary())], names=["key", "ends"])
            done = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.digest()], pa.binary())], names=["key", "ends"])

    return map_arrow(texts.repartition("key").sortWithinPartitions("key", "range").select("key", "ids"), kernel, "key binary, ends binary")


class DoubleArray:
    """A trie over numbers from 0 on: state 0 is the root, BASE[s] + t the child of s by t where CHECK tells s."""

    def __init__(self, room: int) -> None:
        self.base, self.check = np.zeros(room, np.int64), np.full(room, -1, np.int64)
        self.check[0] = 0
        self.top, self.hole = 1, 1  # behind the last used place; nothing is free before hole

    def _grow(self, room: int) -> None:
        if room > len(self.base):
            more = max(room, 2 * len(self.base)) - len(self.base)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def put(self, state: int, turns: np.ndarray) -> None:
        """Children of a state by several turns, in order: the first fit among a few free places, else behind the last used one."""
        span = int(turns[-1] - turns[0]) + 1
        self._grow(self.top + span + 1)
        free = self.hole + np.flatnonzero(self.check[self.hole : self.top] < 0)[:TRIES]
        away = turns - turns[0]
        self._grow(int(free[-1]) + span + 1 if len(free) else 0)
        at = next((int(p) for p in free if (self.check[p + away] < 0).all()), self.top)
        self.base[state] = at - turns[0]
        self.check[at + away] = state
        self.top = max(self.top, at + span)

    def put_single(self, states: np.ndarray, turns: np.ndarray) -> None:
        """One child each: any free place will do."""
        n = len(states)
        if not n:
            return
        free = self.hole + np.flatnonzero(self.check[self.hole : self.top] < 0)[:n]
        new = n - len(free)
        self._grow(self.top + new + 1)
        free = np.concatenate([free, np.arange(self.top, self.top + new)])
        self.top += new
        self.base[states] = free - turns
        self.check[free] = states
        self.hole = int(free[-1]) + 1

    def step(self, states: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Children, -1 where there is none."""
        to = self.base[states] + turns
        inside = (to > 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == states), to, -1)


class Shard:
    """The trie of some distinct conversations in order, and the aggregates of its nodes."""

    def __init__(self, turns: np.ndarray, words: np.ndarray, length: np.ndarray, count: np.ndarray, least: np.ndarray) -> None:
        """turns: 16 bytes each, conversations one after another; length: turns of each; count: its copies; least: their least id."""
        _, dense = np.unique(turns, return_inverse=True)
        begin = np.cumsum(length) - length
        trie = DoubleArray(2 * len(turns) + 16)
        state = np.zeros(len(length), np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # nodes and their parents, by depth from 1
        first: list[np.ndarray] = []
        d = 0
        while True:
            own = np.flatnonzero(length > d)
            if not len(own):
                break
            at, turn = state[own], dense[begin[own] + d]
            new = np.concatenate([[True], (at[1:] != at[:-1]) | (turn[1:] != turn[:-1])])  # members lie side by side
            parent, by = at[new], turn[new]
            edge = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
            many = np.diff(np.append(edge, len(parent)))
            for a, m in zip(edge[many > 1].tolist(), many[many > 1].tolist(), strict=True):
                trie.put(int(parent[a]), np.sort(by[a : a + m]))
            trie.put_single(parent[edge[many == 1]], by[edge[many == 1]])
            to = trie.step(at, turn)
            assert (to >= 0).all(), "a conversation left the trie"
            state[own] = to
            self.levels.append((to[new], parent))
            first.append(begin[own][new] + d)
            d += 1
        room = len(trie.check)
        self.trie, self.end = trie, state
        self.n, self.least, self.words = np.zeros(room, np.int64), np.full(room, np.iinfo(np.int64).max), np.zeros(room, np.int64)
        self.children, self.leaves, self.saved = (np.zeros(room, np.int64) for _ in range(3))
        np.add.at(self.n, state, count)
        np.minimum.at(self.least, state, least)
        for (node, parent), place in zip(reversed(self.levels), reversed(first), strict=True):
            self.words[node] = words[place]
            self.leaves[node] += self.children[node] == 0
            self.saved[node] += (self.n[node] - 1) * self.words[node]
            np.add.at(self.n, parent, self.n[node])
            np.minimum.at(self.least, parent, self.least[node])
            np.add.at(self.children, parent, 1)
            np.add.at(self.leaves, parent, self.leaves[node])
            np.add.at(self.saved, parent, self.saved[node])
        self.leaves[0] += self.children[0] == 0


NODES = "depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, parent_conv_id long, ends binary, key binary, parent_key binary"


def path_keys(turns: np.ndarray) -> list[bytes]:
    """A key for each prefix of a conversation, the empty one first."""
    h, out = hashlib.md5(b""), [ROOT]
    for i in range(len(turns)):
        h.update(turns[i : i + 1].tobytes())
        out.append(h.digest())
    return out


def shard_nodes(turns: np.ndarray, words: np.ndarray, length: np.ndarray, count: np.ndarray, least: np.ndarray, ends: list[bytes]) -> pa.RecordBatch:
    """All nodes as this shard sees them; key and parent_key where node and parent may be shared with other shards."""
    s = Shard(turns, words, length, count, least)
    nodes = np.concatenate([[0], *(n for n, _ in s.levels)]).astype(np.int64)
    parents = np.concatenate([[-1], *(p for _, p in s.levels)]).astype(np.int64)
    depth = np.repeat(np.arange(len(s.levels) + 1), [1, *(len(n) for n, _ in s.levels)])
    key_of: dict[int, bytes] = {}
    begin = np.cumsum(length) - length
    for c in {0, len(length) - 1}:
        own = turns[begin[c] : begin[c] + length[c]]
        dense_state, keys = int(s.end[c]), path_keys(own)
        for k in reversed(keys):
            key_of[dense_state] = k
            dense_state = int(s.trie.check[dense_state])
    end_of = dict(zip(s.end.tolist(), ends, strict=True))
    parent_known = np.where(parents >= 0, s.least[np.maximum(parents, 0)], -1)
    listed, above = nodes.tolist(), parents.tolist()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(depth), pa.array(s.least[nodes]), pa.array(s.n[nodes]), pa.array(s.children[nodes]), pa.array(s.leaves[nodes]), pa.array(s.saved[nodes]), pa.array(s.words[nodes]),
            pa.array([None if p < 0 else v for p, v in zip(above, parent_known.tolist(), strict=True)], pa.int64()),
            pa.array([end_of.get(n) for n in listed], pa.binary()), pa.array([key_of.get(n) for n in listed], pa.binary()), pa.array([key_of.get(p) for p in above], pa.binary()),
        ],
        names=[c.split()[0] for c in NODES.split(", ")],
    )


def shards(paths: DataFrame, shard_turns: int) -> DataFrame:
    """paths (path, words, n, least, ends), all paths different -> NODES, by shards of the paths in order."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            path = t.column("path").combine_chunks()
            turns = np.frombuffer(b"".join(path.flatten().to_pylist()), "V16")
            length = np.array([len(p) for p in path.to_pylist()], np.int64)
            words = t.column("words").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            return shard_nodes(turns, words, length, t.column("n").to_numpy(), t.column("least").to_numpy(), t.column("ends").to_pylist())

        for batch in batches:
            held.append(batch)
            size += sum(len(p) for p in batch.column("path").to_pylist()) + len(batch)
            if size >= shard_turns:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    own = paths.select("path", "words", "n", "least", "ends")
    return map_arrow(own.repartitionByRange(F.slice("path", 1, DEAL_TURNS)).sortWithinPartitions("path"), kernel, NODES)


def merged(edges: DataFrame) -> DataFrame:
    """What several shards tell of a node -> key, its true values, and the corrections it asks of itself and those above.

    Children that are shared themselves were counted by each shard; a shard in which a node has no child took it for a leaf;
    each shard saved one copy less of its words.
    """
    each = edges.groupBy("key", "parent_key", "depth").agg(
        F.count("*").alias("shards"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.max("words").alias("words"), F.max("ends").alias("ends"), F.count_if(F.col("n_children") == 0).alias("bare"),
    )
    every_bare = F.col("bare") == F.col("shards")
    return each.where("shards > 1").withColumns({"leaf_fix": F.when(every_bare, 1).otherwise(0) - F.col("bare"), "saved_fix": (F.col("shards") - 1) * F.col("words")})


def settle(shared: DataFrame) -> DataFrame:
    """merged() with all corrections applied: sums over the shared nodes below, by pointers that double their reach."""
    fewer = shared.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.sum(F.col("shards") - 1).alias("twice"))
    now = materialise(shared.join(fewer, "key", "left").withColumn("n_children", F.col("n_children") - F.coalesce("twice", F.lit(0))).drop("twice"), "shared-nodes")
    deepest = now.agg(F.max("depth")).first()[0] or 0
    sums = now.select("key", F.col("parent_key").alias("up"), "leaf_fix", "saved_fix")
    reach = 1
    while reach <= deepest:
        below = sums.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.sum("leaf_fix").alias("l"), F.sum("saved_fix").alias("s"))
        ups = sums.select(F.col("key").alias("up"), F.col("up").alias("up2"))
        more = sums.join(below, "key", "left").join(ups, "up", "left")
        sums = materialise(more.select("key", F.col("up2").alias("up"), (F.col("leaf_fix") + F.coalesce("l", F.lit(0))).alias("leaf_fix"), (F.col("saved_fix") + F.coalesce("s", F.lit(0))).alias("saved_fix")), "shared-sums")
        reach *= 2
    fixed = now.drop("leaf_fix", "saved_fix").join(sums.select("key", "leaf_fix", "saved_fix"), "key")
    return fixed.withColumns({"n_leaves": F.col("n_leaves") + F.col("leaf_fix"), "saved_tokens": F.col("saved_tokens") + F.col("saved_fix")})


OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(members: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """members (conv_id, path, words; conv_id once each) -> a row for each node, OUT. No members: no rows."""
    keyed = materialise(members.withColumn("key", F.unhex(F.md5(F.array_join(F.transform("path", F.hex), "")))), "conversations", 4096)
    distinct = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("path").alias("path"), F.first("words").alias("words"))
    paths = materialise(distinct.join(digests(keyed.select("key", "conv_id")), "key"), "paths", 4096)  # read twice: for the bounds of ranges too
    nodes = materialise(shards(paths, shard_turns), "trie-nodes", 4096)
    shared = materialise(settle(merged(nodes.where("key IS NOT NULL"))), "shared")
    few = shared.count() <= BROADCAST_ROWS
    near = F.broadcast if few else lambda df: df
    names = shared.select("key", F.col("conv_id").alias("_conv"))
    alone = nodes.where("key IS NULL").drop("key").unionByName(nodes.where("key IS NOT NULL").join(near(shared.select("key")), "key", "left_anti").drop("key"))
    columns = ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "parent_conv_id", "ends", "parent_key"]
    merged_rows = shared.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns)
    inside = alone.where("parent_key IS NULL").select(*columns)
    below = alone.where("parent_key IS NOT NULL").select(*columns).unionByName(merged_rows.where("parent_key IS NOT NULL"))
    above = names.select(F.col("key").alias("parent_key"), "_conv")
    joined = below.join(F.broadcast(above), "parent_key", "left") if few else skew_join(below, above, ["parent_key"], "left")
    told = joined.withColumn("parent_conv_id", F.coalesce("_conv", "parent_conv_id")).select(*columns)
    whole = inside.unionByName(merged_rows.where("parent_key IS NULL")).unionByName(told)
    return whole.select(*(F.col(c).cast("long").alias(c) for c in OUT[:-1]), F.coalesce(F.lower(F.hex("ends")), F.lit(NOTHING)).alias("ends_sha256"))


def conversation_trie(rows: DataFrame, period: int = 20, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """rows (conv_id, turn, role, text; further columns are ignored) -> a row for each node of the trie of rebuilt conversations.

    Turns go by turn, null first; equal turns by role, then by a hash of the text; repeated rows are turns of their own. Null
    roles and texts are empty. Rows without conv_id go; conv_id is a whole number. A conversation c is rebuilt: its first h
    turns (h from 0 to 3, by its id) are those of c - c % period, as far as there are any. A node is a distinct sequence of
    first turns; the root has none. Gives conv_id (least member), depth, parent_conv_id (root: null), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256 (of the ids that end here). A conversation's keys of turns, 16 bytes each, are one row.
    No conversation: no rows.
    """
    return trie(rebuilt(conversations(rows), spliced_heads(F.col("conv_id")), period), shard_turns)


OP12_SQL = r"""WITH own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(concat(length(coalesce(role, '')), ':', role, text))) AS i FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base FROM own),
bits AS (SELECT conv_id, base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * length(CAST(conv_id AS VARCHAR))), lambda k: k % 8 * 256 + CASE WHEN k % 8 = 0 THEN ascii(substr(CAST(conv_id AS VARCHAR), CAST(k // 8 + 1 AS INT), 1)) ELSE 0 END)),
    lambda c, k: CASE WHEN xor(c, k & 255) & 1 = 1 THEN xor(xor(c, k & 255) >> 1, 3988292384::BIGINT) ELSE xor(c, k & 255) >> 1 END), 4294967295::BIGINT) % 4 AS h FROM ids),
turns AS (SELECT b.conv_id, 0 AS part, o.i, o.role, o.text FROM bits b JOIN own o ON o.conv_id = b.base AND o.i <= b.h
  UNION ALL SELECT b.conv_id, 1, o.i, o.role, o.text FROM bits b JOIN own o ON o.conv_id = b.conv_id AND o.i > b.h),
rebuilt AS (SELECT i.conv_id, coalesce(t.path, []) AS path FROM ids i LEFT JOIN
  (SELECT conv_id, list({'r': role, 't': text} ORDER BY part, i) AS path FROM turns GROUP BY conv_id) t USING (conv_id)),
pre AS (SELECT conv_id, unnest(range(len(path) + 1)) AS depth, path FROM rebuilt),
nodes AS (SELECT path[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(path) = depth), '') AS ends FROM pre GROUP BY ALL),
sized AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(p[depth].t, '[^\x20\x09-\x0D]+')) END AS own FROM nodes),
kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM sized WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT s.*, coalesce(k.n, 0) AS n_children FROM sized s LEFT JOIN kids k USING (p)),
up AS (SELECT p[1:a] AS p, own, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf FROM (SELECT *, unnest(range(depth + 1)) AS a FROM full_)),
sums AS (SELECT p, sum(own) AS saved, sum(leaf) AS leaves FROM up GROUP BY p)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN sums s USING (p) LEFT JOIN nodes q ON f.depth > 0 AND q.p = f.p[1:f.depth - 1]"""


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))
