"""Token counts of byte-level BPE by a compiled finite-state transducer.

A vocabulary with its merges becomes a deterministic transducer over bytes. A state is what the future of a prefix
depends on: the places where a token that reaches beyond the prefix may begin, the token that ends at each (or another one
that the same tokens may follow), and how many tokens less there were at that place. A transition says how many tokens more a prefix has with one byte more, so that a
text's count is a sum over transitions. A state's transitions are compiled when a text first takes them.

Texts are cut into words by a local rule on classes of characters: whether a token begins at a character depends on four
characters before it and one after. A byte at which a word begins leads from any state to where it leads from the start.
All texts of a batch are cut into chunks that run side by side. A chunk's state map takes entry states to the exit state
and the tokens emitted; maps hold the entries that the chunks before lead to. They are composed by a parallel prefix scan.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from tacgrid.llm.base import as_bytes, chunked, map_arrow, plainly, table

#: Bytes of a chunk, of a block that is looked at at once, and around it where a longer text is cut.
CHUNK, BLOCK, MARGIN = 128, 1 << 20, 24
#: States beyond this many are forgotten before the next block; they are compiled again when needed.
MAX_STATES = 1 << 17
#: Tokens below a place, up to which places are told apart by the tokens that may follow instead of by the token before.
FEW = 64
#: More tokens than this are over the limit.
LIMIT = 512
OTHER, LETTER, NUMBER, SPACE = range(4)
#: A transition is state << SHIFT | tokens + ZERO.
SHIFT, ZERO = 7, 64
NEVER = 1 << 60
BLANKS = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Endings that are words of their own after an apostrophe at which a word begins.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def class_table(cut) -> np.ndarray:
    """Letter, number, white space or other of each code point, as the library sees them.

    cut: what its file's library gives for the words of a string; versions of Unicode differ, so all points are put to it.
    """
    out = np.zeros(0x110000, np.uint8)
    kinds, samples = {"L": LETTER, "N": NUMBER}, {LETTER: "a", NUMBER: "1", OTHER: "!"}
    for c in range(0x110000):
        out[c] = kinds.get(unicodedata.category(chr(c))[0], OTHER)
    out[list(BLANKS)] = SPACE
    supposed = out.copy()
    for kind, sample in samples.items():
        points = np.flatnonzero(supposed == kind)
        points = points[(points < 0xD800) | (points >= 0xE000)]
        text = sample + "".join(map(chr, points))
        for _, (begin, end) in cut(text)[1:]:
            out[points[begin - 1 : end - 1]] = next((k for k, s in samples.items() if len(cut(s + text[begin])) == 1), SPACE)
    return out


class Grammar:
    """Tokens and merges of a vocabulary; as large as the vocabulary, whatever the texts.

    split: the two parts of each token (-1: a byte). rank: when it is made. Tokens that the merges don't make of their own
    bytes are in no tokenised text and left out.
    """

    def __init__(self, spec: dict) -> None:
        model, alphabet = spec["model"], byte_alphabet()
        pre = spec.get("pre_tokenizer") or {}
        if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("byte-level BPE without normalisation and prefix space is asked for")
        if model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError("dropout, ignored merges and marked subwords aren't known")
        added = spec.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take in blanks or stand alone aren't known")
        self.added = sorted((t["content"].encode() for t in added), key=len, reverse=True)
        self.text = {i: bytes(alphabet[c] for c in s) for s, i in model["vocab"].items() if all(c in alphabet for c in s)}
        ids = {s: i for s, i in model["vocab"].items()}
        self.byte = {self.text[i][0]: i for i in self.text if len(self.text[i]) == 1}
        if len(self.byte) < 256:
            raise ValueError("a byte has no token")
        self.split: dict[int, tuple[int, int]] = {i: (-1, -1) for i in self.byte.values()}
        self.rank: dict[int, int] = {i: -1 for i in self.byte.values()}
        self.merge: dict[tuple[int, int], int] = {}
        self.spines: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
        for k, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merge.setdefault((ids[left], ids[right]), k)
        for (a, b), k in self.merge.items():
            made = ids[s] if (s := self._name(model, a, b)) in ids else None
            if made is None or made in self.split or a not in self.split or b not in self.split or max(self.rank[a], self.rank[b]) >= k:
                continue
            if self.first_cross(a, b) == (k, True):
                self.split[made], self.rank[made] = (a, b), k

    def _name(self, model: dict, a: int, b: int) -> str:
        if not hasattr(self, "_names"):
            self._names = {i: s for s, i in model["vocab"].items()}
        return self._names[a] + self._names[b]

    def spine(self, token: int, side: int) -> tuple[list[int], list[int]]:
        """The tokens that hold the last (side 1) or first byte (0), from the byte to the token itself, and when each is merged."""
        out = self.spines.get((token, side))
        if out is None:
            own = [token]
            while self.split[own[-1]][side] >= 0:
                own.append(self.split[own[-1]][side])
            own.reverse()
            out = self.spines[token, side] = (own, [*(self.rank[t] for t in own[1:]), NEVER])
        return out

    def first_cross(self, a: int, b: int) -> tuple[int, bool]:
        """When the first merge over the border of a and b would happen, and whether both are whole by then.

        Of equal merges the left one comes first.
        """
        (xs, grow_x), (ys, grow_y) = self.spine(a, 1), self.spine(b, 0)
        i = j = 0
        while True:
            gx, gy = grow_x[i], grow_y[j]
            cross = self.merge.get((xs[i], ys[j]), NEVER)
            if cross < gx and cross <= gy:
                return cross, gx == gy == NEVER
            if gx == gy == NEVER:
                return NEVER, True
            if gx <= gy:
                i += 1
            else:
                j += 1


class Transducer:
    """Transitions by state and byte, compiled as they are met. State 0 is the start of a word."""

    def __init__(self, grammar: Grammar) -> None:
        self.grammar = grammar
        self.child: dict[int, int] = {}
        self.token = [-1]
        self.below: list[list[int]] = [[]]
        for t in grammar.split:
            node = 0
            for b in grammar.text[t]:
                at = node << 8 | b
                if at not in self.child:
                    self.child[at] = len(self.token)
                    self.below[node].append(len(self.token))
                    self.token.append(-1)
                    self.below.append([])
                node = self.child[at]
            self.token[node] = t
        self.size = [0] * len(self.token)  # tokens below each node; nodes come after what is above them
        for node in range(len(self.token) - 1, -1, -1):
            self.size[node] = sum(self.size[n] + (self.token[n] >= 0) for n in self.below[node])
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.table = np.full((1024, 256), -1, np.int32)
        self.valid: dict[tuple[int, int], bool] = {}
        self.alike: dict[tuple[int, int], int | None] = {}
        self.first: dict[tuple, int] = {}

    def follows(self, before: int, token: int) -> bool:
        key = (before, token)
        out = self.valid.get(key)
        if out is None:
            if len(self.valid) > MAX_STATES:
                self.valid.clear()
            out = self.valid[key] = self.grammar.first_cross(before, token)[0] == NEVER
        return out

    def like(self, node: int, before: int) -> int | None:
        """A token that the tokens below a node follow exactly where they follow before; None if none of them does.

        Where many are below, before itself is taken.
        """
        if before < 0 or self.size[node] > FEW:
            return before
        key = (node, before)
        if key not in self.alike:
            found, stack = [], list(self.below[node])
            while stack:
                n = stack.pop()
                if self.token[n] >= 0 and self.grammar.first_cross(before, self.token[n])[0] == NEVER:
                    found.append(n)
                stack += self.below[n]
            self.alike[key] = self.first.setdefault((node, *found), before) if found else None
        return self.alike[key]

    def compile(self, state: int, byte: int) -> None:
        """A state is ((place in the tree of tokens, token before, tokens there less tokens now), ...); the first is the end."""
        last, gain, open_ = None, 0, []
        for node, before, less in self.states[state]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            token = self.token[node]
            if token >= 0 and (before < 0 or self.follows(before, token)):
                assert last is None, "two tokenisations"
                last, gain = token, less + 1
            if self.below[node] and (before := self.like(node, before)) is not None:
                open_.append((node, before, less))
        assert last is not None, "no tokenisation"
        after = ((0, last, 0), *((node, before, less - gain) for node, before, less in open_))
        to = self.number.get(after)
        if to is None:
            to = self.number[after] = len(self.states)
            self.states.append(after)
            if to >= len(self.table):
                self.table = np.concatenate([self.table, np.full(self.table.shape, -1, np.int32)])
        self.table[state, byte] = to << SHIFT | gain + ZERO

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out = self.table[state, byte]
        missing = np.flatnonzero(out < 0)
        if len(missing):
            for key in np.unique(state[missing].astype(np.int64) << 8 | byte[missing]).tolist():
                self.compile(key >> 8, key & 255)
            out[missing] = self.table[state[missing], byte[missing]]
        return out

    def run(self, data: np.ndarray, fresh: np.ndarray, begin: np.ndarray, length: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and tokens of lanes over data; fresh: whether a word begins at a byte."""
        order = np.argsort(-length, kind="stable")
        at, left, state = begin[order].copy(), length[order], entry[order].astype(np.int32)
        count = np.zeros(len(order), np.int64)
        active = int(np.searchsorted(-left, 0))
        for k in range(int(left[0]) if len(left) else 0):
            while active and left[active - 1] <= k:
                active -= 1
            own = at[:active] + k
            got = self.step(np.where(fresh[own], 0, state[:active]), data[own])
            state[:active] = got >> SHIFT
            count[:active] += (got & (1 << SHIFT) - 1) - ZERO
        exits, counts = np.empty(len(order), np.int32), np.empty(len(order), np.int64)
        exits[order], counts[order] = state, count
        return exits, counts


def beginnings(data: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether a word begins at each byte of UTF-8 data. first: where texts begin (bytes, in order; the first is 0).

    A run of letters, of numbers or of other characters is a word, with the one space before it, if there is one. Of white
    space before a word the last character is a word of its own or, a space, part of the next one.
    """
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(lead):
        return np.zeros(len(data), bool)
    b = data[lead].astype(np.int32)
    more = lambda k: data[np.minimum(lead + k, len(data) - 1)].astype(np.int32) & 0x3F
    code = np.where(b < 0x80, b, 0)
    if (b >= 0x80).any():
        two = (b & 0x1F) << 6 | more(1)
        three = (b & 0x0F) << 12 | more(1) << 6 | more(2)
        four = (b & 0x07) << 18 | more(1) << 12 | more(2) << 6 | more(3)
        code = np.select([b < 0x80, b < 0xE0, b < 0xF0], [b, two, three], four)
    kind = classes[code]
    n = len(code)
    head = np.zeros(n + 4, bool)  # a text begins here; all is over at n
    head[np.searchsorted(lead, first)] = True
    head[n:] = True
    blank = kind == SPACE
    before = np.concatenate([[OTHER], kind[:-1]])
    space_before = np.concatenate([[False], code[:-1] == 32])
    after_word = np.concatenate([~blank[1:], [False]]) & ~head[1 : n + 1]
    start = np.where(blank, (before != SPACE) | after_word, np.where(before == SPACE, ~space_before, before != kind)) | head[:n]
    quotes = np.flatnonzero(start & (code == 39))
    if len(quotes):
        start = np.concatenate([start, np.zeros(4, bool)])
        wide = np.concatenate([code, np.zeros(4, code.dtype)])
        for ending in ENDINGS:
            hit = quotes
            for k, c in enumerate(ending, 1):
                hit = hit[(wide[hit + k] == ord(c)) & ~head[hit + k]]
            start[hit + 1] = False
            start[hit + len(ending) + 1] = True
        start = start[:n]
    out = np.zeros(len(data), bool)
    out[lead[start]] = True
    return out


def scan(to: np.ndarray, count: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Tokens from the start of each chunk's text to its end, by composing maps over ever longer stretches.

    to[k, j]: which entry of chunk k + 1 the j-th entry of chunk k leads to; first: the first chunk of each chunk's text, whose
    only entry is the 0th.
    """
    to, count = to.copy(), count.copy()
    k = np.arange(len(to))
    reach = 1
    while reach < len(to):
        own = k[k - reach >= first]
        if not len(own):
            break
        earlier = to[own - reach]
        count_new = count[own - reach] + np.take_along_axis(count[own], earlier, 1)
        to_new = np.take_along_axis(to[own], earlier, 1)
        to[own], count[own] = to_new, count_new
        reach *= 2
    return count[:, 0]


def count_pieces(machine: Transducer, data: np.ndarray, fresh: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Tokens of the texts data[begin:end], which aren't empty; a word begins at each begin."""
    n_chunks = -(-(end - begin) // CHUNK)
    last = np.cumsum(n_chunks) - 1
    text = np.repeat(np.arange(len(begin)), n_chunks)
    first = (last - n_chunks + 1)[text]
    at = begin[text] + (np.arange(len(text)) - first) * CHUNK
    size = np.minimum(at + CHUNK, end[text]) - at
    places = np.flatnonzero(fresh)
    nearest = np.searchsorted(places, at)
    head = np.minimum(np.where(nearest < len(places), places[np.minimum(nearest, max(len(places) - 1, 0))] - at if len(places) else size, size), size)
    whole = head < size  # a word begins inside
    exits, body = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
    exits[whole], body[whole] = machine.run(data, fresh, (at + head)[whole], (size - head)[whole], np.zeros(int(whole.sum()), np.int32))

    # Entries of each chunk: where the one before may lead. A chunk without a beginning is also run from the start, as a guess.
    entries: list[list[int]] = [[0] for _ in at]
    known: dict[tuple[int, int], tuple[int, int]] = {}
    todo = [(int(k), 0) for k in np.flatnonzero(~whole)]
    for k in np.flatnonzero(whole[:-1] & (first[1:] != np.arange(1, len(at)))):
        if head[k + 1]:
            entries[k + 1] = [int(exits[k])] if whole[k + 1] else [0, int(exits[k])]
            todo.append((int(k) + 1, int(exits[k])))
    while todo:
        todo = [x for x in dict.fromkeys(todo) if x not in known]
        if not todo:
            break
        own = np.array([k for k, _ in todo], np.int64)
        out, tokens = machine.run(data, fresh, at[own], head[own], np.array([e for _, e in todo], np.int32))
        more = []
        for (k, e), x, c in zip(todo, out.tolist(), tokens.tolist(), strict=True):
            known[k, e] = (x, c)
            if not whole[k] and k + 1 < len(at) and first[k + 1] != k + 1 and head[k + 1]:
                if x not in entries[k + 1]:
                    entries[k + 1].append(x)
                more.append((k + 1, x))
        todo = more
    width = max(map(len, entries))
    to, count = np.zeros((len(at), width), np.int64), np.zeros((len(at), width), np.int64)
    count[whole] = body[whole, None]
    busy = np.flatnonzero((head > 0) | ~whole)
    for k in busy.tolist():
        for j, e in enumerate(entries[k]):
            x, c = known.get((k, e), (int(exits[k]), 0))
            count[k, j] = c + int(body[k])
            if k + 1 < len(at) and first[k + 1] != k + 1:
                y = int(exits[k]) if whole[k] else x
                to[k, j] = entries[k + 1].index(y) if head[k + 1] else 0
    for k in np.flatnonzero(whole[:-1] & (head[:-1] == 0) & (first[1:] != np.arange(1, len(at))) & (head[1:] > 0)).tolist():
        to[k, :] = entries[k + 1].index(int(exits[k]))
    return scan(to, count, first)[last]


class Counter:
    """Counts tokens of texts; holds the transducer of a vocabulary."""

    def __init__(self, spec: dict, classes: np.ndarray) -> None:
        self.grammar, self.classes = Grammar(spec), classes
        self.machine = Transducer(self.grammar)
        self.added = re.compile(b"|".join(map(re.escape, self.grammar.added))) if self.grammar.added else None

    def parts(self, text: bytes) -> tuple[list[bytes], int]:
        """What lies between added tokens, and how many of these there are."""
        if self.added is None:
            return [text], 0
        parts = self.added.split(text)
        return parts, len(parts) - 1

    def fresh(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """beginnings(), a block at a time; what is around a block decides on its edges."""
        if len(data) <= 2 * BLOCK:
            return beginnings(data, first, self.classes)
        out = np.zeros(len(data), bool)
        for a in range(0, len(data), BLOCK):
            z = min(a + BLOCK, len(data))
            low, high = max(a - MARGIN, 0), min(z + MARGIN, len(data))
            while low and (data[low] & 0xC0) == 0x80:
                low -= 1
            while high < len(data) and (data[high] & 0xC0) == 0x80:
                high += 1
            own = first[(first >= low) & (first < high)] - low
            out[a:z] = beginnings(data[low:high], own, self.classes)[a - low : z - low]
        return out

    def count(self, texts: list[bytes]) -> list[int]:
        if len(self.machine.states) > MAX_STATES:
            self.machine.forget()
        pieces, owner, out = [], [], [0] * len(texts)
        for i, t in enumerate(texts):
            parts, out[i] = self.parts(t)
            pieces += [p for p in parts if p]
            owner += [i for p in parts if p]
        if pieces:
            size = np.array([len(p) for p in pieces], np.int64)
            end = np.cumsum(size)
            data = np.frombuffer(b"".join(pieces), np.uint8)
            got = count_pieces(self.machine, data, self.fresh(data, end - size), end - size, end)
            for i, n in zip(owner, got.tolist(), strict=True):
                out[i] += n
        return out


#: Where a Python worker keeps compiled vocabularies from task to task: functions arrive anew with every task.
KEPT = "_tacgrid_token_counters"


def kept_counter(packed: bytes, classes: bytes) -> Counter:
    kept = sys.__dict__.setdefault(KEPT, {})
    key = (zlib.crc32(packed), len(packed))
    if key not in kept:
        kept.clear()
        kept[key] = Counter(json.loads(zlib.decompress(packed)), np.frombuffer(zlib.decompress(classes), np.uint8))
    return kept[key]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """docs (doc_id, text; any id type, further columns are ignored) -> doc_id, n_bytes, n_tokens, over_limit, a row for each row.

    vocabulary: a tokenizer file (JSON, byte-level BPE), read once by the driver; a few MB go to the executors. Counts are those
    of the file's own library, without begin and end tokens; strings of added tokens inside texts are such tokens. Null texts
    are empty: no bytes, no tokens. Null ids, repeated rows and empty tables stay what they are. Texts of any length are
    counted whole; one text is in one task, in blocks. A vocabulary of another kind raises ValueError.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    Grammar(spec)  # wrong kinds are told here, not by a task
    cut = Tokenizer.from_file(vocabulary).pre_tokenizer.pre_tokenize_str
    packed, classes = zlib.compress(json.dumps(spec).encode()), zlib.compress(class_table(cut).tobytes())
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((packed, classes))
    own = plainly(docs.select("doc_id", "text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_counter(*sent.value)
        for batch in batches:
            texts = [t or b"" for t in as_bytes(batch.column(1))]
            sizes = [len(t) for t in texts]
            tokens: list[int] = []
            for a, z in chunked(sizes, BLOCK):
                tokens += counter.count(texts[a:z])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return map_arrow(own, kernel, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
