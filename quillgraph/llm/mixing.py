"""Language-model scoring by online logistic mixing of hashed-context bit predictors.

A text is its lower-cased words and an end. The most frequent tokens are symbols of a Huffman code made
from the training counts; any other word is an escape and then its bytes and a stop, in a second Huffman
code. So a text is a sequence of binary decisions, a few for each word, and every text has a probability.

For each decision several contexts (the node of the code with nothing, the end of the previous word, that
word, and so on) are hashed into tables of counts of zeros and ones. Each count pair gives a log odds; these are
summed with weights that a gate (the depth in the code, the place in the word) selects, and the sum is
refined by a small adaptive map from gate and log odds to what was found there. Training documents are dealt into
shards by hash; a task goes through a shard once, in the shard's own order: each block is predicted from the counts so far, weights and map learn from the
errors, then the counts learn the block. The shards' counts and maps are summed, their weights averaged.

Scoring reads the model only, so a score depends on the training documents and the text alone.
Training text is all of it, whatever its size; the tables' sizes are parameters, and the counts of
tokens that do not fit the broadcast head are joined by a shuffle.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize, most_frequent
from quillgraph.llm.kernels import BLOCK_BYTES, NOT_SPACE, Words, blocks, concat_ranges, mix

CONTEXTS = 5
#: Symbols so frequent that the last one seen tells the language.
ANCHORS = 64
GATES = 32
BUCKETS = 25
STOP = 256
#: Words or letters whose decisions are in memory at once; what is learned of a block does not depend on it but for rounding.
OWNERS = 1 << 14
#: Depths whose nodes below one node share a group of slots, 2**LEVELS in a row, so that they are near one another in memory.
LEVELS = 4


@dataclass(frozen=True)
class Mixing:
    #: Tokens with a code of their own, at most.
    symbols: int = 1 << 16
    #: Slots of each context's table, as a power of two. A table has two 4-byte counts a slot.
    slot_bits: int = 20
    #: Tokens whose counts are broadcast, at most (20 bytes each); the others' are joined.
    head: int = 1 << 19
    rate: float = 0.25
    prior: float = 0.4
    #: Bytes of words in a training shard; a shard is learned by one task, in an order of its own.
    shard_bytes: int = 48 << 20
    #: Slots in a row of the tables' shuffle.
    row_slots: int = 1 << 14


@dataclass
class Code:
    """Huffman code: of symbol i the decisions first[i] .. first[i] + length[i] - 1, each a node and a bit."""

    first: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray

    @cached_property
    def both(self) -> np.ndarray:
        """Node * 2 + bit of each decision, as one lookup of few bytes."""
        return (self.node * 2 + self.bit).astype(np.int32)

    @staticmethod
    def of(counts: np.ndarray) -> Code:
        n = len(counts)
        if n == 1:
            return Code(np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        heap = [(int(c), i) for i, c in enumerate(counts.tolist())]
        heapq.heapify(heap)
        parent, side = [0] * (2 * n - 1), [0] * (2 * n - 1)
        for made in range(n, 2 * n - 1):
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x] = parent[y] = made
            side[y] = 1
            heapq.heappush(heap, (a + b, made))
        nodes, bits, length = array("i"), array("b"), []
        root = 2 * n - 2
        for i in range(n):
            path = []
            while i != root:
                path.append((root - parent[i], side[i]))
                i = parent[i]
            nodes.extend(x for x, _ in reversed(path))
            bits.extend(x for _, x in reversed(path))
            length.append(len(path))
        size = np.array(length, np.int64)
        return Code(np.cumsum(size) - size, size, np.array(nodes, np.int64), np.array(bits, np.int8).astype(bool))


@dataclass
class Model:
    #: Hashes of the head's tokens, ascending, their counts, and their symbols (-1: none).
    tokens: np.ndarray
    counts: np.ndarray
    symbol: np.ndarray
    whole: bool  # whether the head is all tokens
    words: Code  # the last two symbols are the end of a text and the escape
    letters: Code  # of bytes and STOP
    total: int
    distinct: int
    ends: int
    tables: np.ndarray | None = None  # log odds, CONTEXTS x slots
    weights: np.ndarray | None = None  # 2 x GATES x (CONTEXTS + 1)
    refined: np.ndarray | None = None  # log odds, 2 x GATES x BUCKETS

    def root(self, bits: int) -> np.ndarray:
        """Table slots of the words' nodes alone."""
        return _slots(np.uint64(11), np.arange(len(self.words.length), dtype=np.uint64) * _NODE, bits)

    @cached_property
    def starts(self) -> np.ndarray:
        """By the first bits of a hash: the first token whose hash is not below them."""
        bits = max(1, len(self.tokens).bit_length())
        return np.searchsorted(self.tokens, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes among the tokens; -1 for none."""
        last = len(self.tokens) - 1
        if last < 0:
            return np.full(len(h), -1)
        at = np.minimum(self.starts.take((h >> np.uint64(65 - len(self.starts).bit_length())).view(np.int64)), last).astype(np.int64)
        there = self.tokens.take(at)
        left = np.flatnonzero((there < h) & (at < last))
        while len(left):
            at[left] += 1
            there[left] = self.tokens.take(at[left])
            left = left[(there[left] < h[left]) & (at[left] < last)]
        return np.where(there == h, at, -1)


_NODE, _SLOT = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def _slots(context: np.ndarray | np.uint64, key: np.ndarray, bits: int) -> np.ndarray:
    """Table slots of the nodes with these keys in a context."""
    h = context + key
    h *= _SLOT
    h >>= np.uint64(64 - bits)
    return h.view(np.int64)


@dataclass
class Part:
    """Some symbols (words or letters), those with the longest codes first, so that the ones with a decision of a given
    depth are the first few. own: their places in the block's stream; gate: None if it is the depth; contexts: hashes
    of each; None if the node is all there is, its slots are then Model.root."""

    code: Code
    own: np.ndarray
    first: np.ndarray
    many: list[int]  # symbols with a decision at each depth
    gate: np.ndarray | None
    contexts: list[np.ndarray | None]

    def steps(self) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """By depth, of each symbol with a decision there: node * 2 + bit, the bit, and the place in the group of slots."""
        both = [self.code.both.take(self.first[:n] + depth) for depth, n in enumerate(self.many)]
        bits = [b & 1 for b in both]
        places: list[np.ndarray] = []
        for depth, n in enumerate(self.many):
            if depth % LEVELS == 0:
                place = np.ones(n, np.int64)
            else:
                place = place[:n] * 2
                place += bits[depth - 1][:n]
            places.append(place)
        return both, bits, places

    def read(self, tables: np.ndarray, alone: np.ndarray, bits: int, out: np.ndarray, add=None) -> Iterator[tuple[np.ndarray, np.ndarray, int | np.ndarray]]:
        """By depth: the bits of the symbols with a decision there, what the contexts' tables hold on it (and ones), and the
        gate, one for all or each. add(context, slots, bits) is called for each; context -1 is the node alone, slots are then
        node * 2 + bit."""
        both, bit, place = self.steps()
        ends = np.cumsum([0, *self.many]).tolist()
        keys = []
        for b in both[::LEVELS]:
            key = (b >> 1).astype(np.uint64)
            key *= _NODE
            keys.append(key)
        for i, c in enumerate(self.contexts):
            if c is None:
                for d, b in enumerate(both):
                    alone.take(b >> 1, out=out[i, ends[d] : ends[d + 1]], mode="clip")
                    if add:
                        add(-1, b.astype(np.int64), bit[d])
                continue
            for level, key in enumerate(keys):
                base = _slots(c[: len(key)], key, bits)
                depths = range(level * LEVELS, min((level + 1) * LEVELS, len(both)))
                slots = [base[: len(place[d])] ^ place[d] for d in depths]
                for d, s in zip(depths, slots):
                    tables[i].take(s, out=out[i, ends[d] : ends[d + 1]], mode="clip")
                if add:
                    for d, s in zip(depths, slots):
                        add(i, s, bit[d])
        for d, b in enumerate(bit):
            yield b, out[:, ends[d] : ends[d + 1]], min(d, GATES - 1) if self.gate is None else self.gate[: len(b)]


def _room(held: np.ndarray | None, part: Part) -> np.ndarray:
    """Ones for the contexts' inputs of a part and a constant, in the array held if it has room."""
    n = sum(part.many)
    return held if held is not None and held.shape[1] >= n else np.ones((CONTEXTS + 1, 2 * n), np.float32)


def _hash(*parts) -> np.ndarray:
    h = np.zeros(1, np.uint64)
    for p in parts:
        h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(29))
    return h


def _parts(code: Code, symbol: np.ndarray, gate: np.ndarray | None, contexts: list[np.ndarray | None]) -> Iterator[Part]:
    """The decisions of symbols, some symbols at a time. Without a gate it is the depth in the code."""
    for a in range(0, len(symbol), OWNERS):
        z = slice(a, a + OWNERS)
        size = code.length[symbol[z]]
        own = np.argsort((-size).astype(np.int16), kind="stable")
        many = len(own) - np.cumsum(np.bincount(size))
        own += a
        yield Part(code, own, code.first[symbol[own]], many[:-1].tolist(), None if gate is None else gate[own], [None if c is None else c[own] for c in contexts])


def _decisions(w: Words, place: np.ndarray, model: Model) -> list[tuple[np.ndarray, Iterator[Part]]]:
    """The documents of a block's words and their decisions in parts, then those of its letters."""
    n_docs = len(w.counts)
    escape = len(model.words.length) - 1
    symbol = np.where(place >= 0, model.symbol[place] if len(model.symbol) else -1, -1)
    rare = np.flatnonzero(symbol < 0)
    symbol[rare] = escape
    # The tokens, then the ends; the one before each, and the last anchor before each, within the document.
    doc = np.concatenate([w.document(), np.arange(n_docs)])
    all_symbols = np.concatenate([symbol, np.full(n_docs, escape - 1)])
    where = np.concatenate([np.arange(len(w.hash)), w.bounds[1:]])
    begin = w.bounds[doc]
    last = w.end - 1
    ending = np.zeros(len(w.hash) + 1, np.uint64)
    ending[1:] = (w.data[last].astype(np.uint64) << np.uint64(8) | w.data[np.maximum(last - 1, w.start)]) + np.uint64(1)
    previous = np.where(where > begin, ending[where], np.uint64(0))
    word = np.where(where > begin, np.concatenate([np.zeros(1, np.uint64), w.hash])[where], np.uint64(0))
    seen = np.zeros(len(w.hash) + 1, np.int64)
    seen[1:] = np.maximum.accumulate(np.where(symbol < ANCHORS, np.arange(1, len(w.hash) + 1), 0))
    at = seen[where]
    anchor = np.where(at > begin, symbol[np.maximum(at - 1, 0)] + 1 if len(symbol) else 0, 0).astype(np.uint64)
    contexts = [None, _hash(anchor, 1), _hash(anchor, previous >> np.uint64(8), 2), _hash(previous, 3), _hash(word, 8)]
    words = doc, _parts(model.words, all_symbols, None, contexts)
    # Letters of rare words, each with a stop.
    length = w.end[rare] - w.start[rare]
    letter_word = np.repeat(np.arange(len(rare)), length + 1)
    position = concat_ranges(np.zeros(len(rare), np.int64), length + 1)
    at = w.start[rare][letter_word] + position
    letter = np.where(position == length[letter_word], STOP, w.data[np.minimum(at, len(w.data) - 1)].astype(np.int64))
    back = np.zeros(len(at), np.uint64)
    orders = []
    for k in range(1, 6):
        back = back << np.uint64(9) | np.where(position >= k, w.data[np.maximum(at - k, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        orders.append(back)
    contexts = [_hash(orders[0], anchor[rare][letter_word], 4), _hash(orders[1], anchor[rare][letter_word], np.minimum(position, 15), 5), _hash(orders[2], 6), _hash(orders[3], 9), _hash(orders[4], 7)]
    letters = w.document()[rare][letter_word], _parts(model.letters, letter, np.minimum(position, GATES - 1), contexts)
    return [words, letters]


def _mixed(inputs: np.ndarray, weights: np.ndarray, gate: int | np.ndarray) -> np.ndarray:
    """Log odds."""
    of = (lambda i: weights[gate, i]) if isinstance(gate, int) else (lambda i: weights[:, i].take(gate))
    z = inputs[0] * of(0)
    z += of(CONTEXTS)
    for i in range(1, CONTEXTS):
        z += inputs[i] * of(i)
    return np.clip(z, -12, 12, out=z)


def _cell(z: np.ndarray, gate: int | np.ndarray) -> np.ndarray:
    return gate * BUCKETS + (z + np.float32(12.5)).astype(np.int64)


_COUNTS = "kind byte, key long, n long"


def _count(batches) -> Iterator[pa.RecordBatch]:
    """kind 0: a token's hash and count; 1: a byte (or STOP) and its count in words; 2: documents."""
    letters = np.zeros(257, np.int64)
    documents = 0
    held, size = [], 0

    def flush(parts):
        key = np.sort(np.concatenate(parts))
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        n = np.diff(np.append(begin, len(key)))
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(begin), np.int8)), pa.array(key[begin].view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])

    for batch in batches:
        documents += batch.num_rows
        for block in blocks(batch.column(0)) if batch.num_rows else ():
            w = block.words(NOT_SPACE)
            letters[:256] += np.bincount(w.data[NOT_SPACE[w.data]], minlength=256)
            letters[STOP] += len(w.hash)
            held.append(w.hash)
            size += len(w.hash)
            if size >= 4_000_000:
                yield flush(held)
                held, size = [], 0
    if held:
        yield flush(held)
    used = np.flatnonzero(letters)
    key, n = np.append(used, 0), np.append(letters[used], documents)
    kind = np.append(np.ones(len(used), np.int8), np.int8(2))
    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])


_PART = "part int, row int, zeros binary, ones binary"


#: Weights are averaged as multiples of 1 / STEP, whose sums are exact in whatever order.
STEP = 1024


class _Learner:
    """One shard's counts, weights and map."""

    def __init__(self, model: Model, rule: Mixing):
        self.m, self.rule, self.slots = model, rule, 1 << rule.slot_bits
        self.counts = np.zeros((CONTEXTS, self.slots, 2), np.int32)
        self.weights = np.zeros((2, GATES, CONTEXTS + 1), np.float32)
        self.weights[:, :, :CONTEXTS] = 0.5
        self.seen = np.zeros((2, GATES), np.float64)
        self.found = np.zeros((2, 2, GATES * BUCKETS), np.int64)
        self.odds = np.zeros((CONTEXTS, self.slots), np.float32)
        self.bent = np.zeros((2, GATES, CONTEXTS + 1))
        self.turn = 0
        self.root = model.root(rule.slot_bits)
        self.room: np.ndarray | None = None
        self.one = np.ones(OWNERS, np.int32)  # of the counts' own type, without which add.at is slow

    def learn(self, block) -> None:
        m, rule = self.m, self.rule
        w = block.words(NOT_SPACE)
        steep = self.turn % 8 == 0  # the curvature changes slowly
        alone, rooted = self.odds[0].take(self.root), np.zeros(2 * len(self.root), np.int32)

        def add(context: int, slots: np.ndarray, bit: np.ndarray) -> None:
            if context < 0:
                np.add.at(rooted, slots, self.one[: len(slots)])
            else:
                slots *= 2
                slots += bit
                np.add.at(self.counts[context].reshape(-1), slots, self.one[: len(slots)])

        for stream, (_, parts) in enumerate(_decisions(w, m.find(w.hash), m)):
            # Sums over the block: weights and odds stay until it ends.
            weights, bent = self.weights[stream], self.bent[stream]
            number = np.zeros(GATES, np.int64)
            slope, curved = np.zeros((2, GATES, CONTEXTS + 1))
            for part in parts:
                self.room = _room(self.room, part)
                for bit, inputs, gate in part.read(self.odds, alone, rule.slot_bits, self.room, add):
                    n = len(bit)
                    z = _mixed(inputs, weights, gate)
                    p = 1 / (1 + np.exp(-z))
                    error = bit.astype(np.float32) - p
                    curve = p * (1 - p) if steep else p
                    cell = _cell(z, 0 if isinstance(gate, int) else gate) * 2 + bit
                    if isinstance(gate, int):
                        number[gate] += n
                        slope[gate] += np.einsum("ij,j->i", inputs, error)
                        if steep:
                            curved[gate] += np.einsum("ij,ij,j->i", inputs, inputs, curve)
                        self.found[:, stream, gate * BUCKETS : (gate + 1) * BUCKETS] += np.bincount(cell, minlength=BUCKETS * 2).reshape(-1, 2).T
                        continue
                    number += np.bincount(gate, minlength=GATES)
                    for i, s in enumerate(inputs):
                        slope[:, i] += np.bincount(gate, error if i == CONTEXTS else error * s, GATES)
                        if steep:
                            curved[:, i] += np.bincount(gate, curve if i == CONTEXTS else curve * s * s, GATES)
                    self.found[:, stream] += np.bincount(cell, minlength=GATES * BUCKETS * 2).reshape(-1, 2).T
            if not number.any():
                continue
            if steep:
                bent[:] = curved / np.maximum(number, 1)[:, None]
            weights += (rule.rate * slope / (bent * number[:, None] + 50.0)).clip(-0.2, 0.2)
            self.seen[stream] += number
        np.add.at(self.counts[0].reshape(-1), np.repeat(self.root * 2, 2) + np.tile([0, 1], len(self.root)), rooted)
        prior = np.float32(rule.prior)
        for i in range(CONTEXTS):
            pair = self.counts[i].astype(np.float32) + prior
            np.log(pair[:, 1] / pair[:, 0], out=self.odds[i])
        self.turn += 1

    def rows(self) -> Iterator[pa.RecordBatch]:
        step = min(self.rule.row_slots, self.slots)
        part, row, a, b = [], [], [], []
        for i in range(CONTEXTS):
            for k in range(0, self.slots, step):
                if self.counts[i, k : k + step].any():
                    part.append(i)
                    row.append(k // step)
                    a.append(self.counts[i, k : k + step, 0].astype("<i4").tobytes())
                    b.append(self.counts[i, k : k + step, 1].astype("<i4").tobytes())
        part += [CONTEXTS, CONTEXTS + 1]
        row += [0, 0]
        a += [self.found[0].astype("<f8").tobytes(), (np.rint(self.weights.astype(np.float64) * STEP) * self.seen[:, :, None]).astype("<f8").tobytes()]
        b += [self.found[1].astype("<f8").tobytes(), np.repeat(self.seen[:, :, None], CONTEXTS + 1, 2).astype("<f8").tobytes()]
        for k in range(0, len(part), 64):
            e = k + 64
            yield pa.RecordBatch.from_arrays([pa.array(part[k:e], pa.int32()), pa.array(row[k:e], pa.int32()), pa.array(a[k:e], pa.binary()), pa.array(b[k:e], pa.binary())], ["part", "row", "zeros", "ones"])


def _by_shard(batches) -> Iterator[tuple[int, pa.Array]]:
    """Shards' texts in pieces that end with the text that reaches BLOCK_BYTES, wherever batches begin and end."""
    held: list[pa.Array] = []
    size, last = 0, None
    for batch in batches:
        shard, text = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).fill_null(b"")
        length = pc.binary_length(text).to_pylist()
        begin = 0
        for i, s in enumerate(shard):
            if s != last:
                if i > begin:
                    held.append(text.slice(begin, i - begin))
                if held:
                    yield last, pa.concat_arrays(held)
                held, size, begin, last = [], 0, i, s
            size += length[i]
            if size >= BLOCK_BYTES:
                held.append(text.slice(begin, i + 1 - begin))
                yield last, pa.concat_arrays(held)
                held, size, begin = [], 0, i + 1
        if begin < len(shard):
            held.append(text.slice(begin))
    if held:
        yield last, pa.concat_arrays(held)


def _learn(model, rule: Mixing):
    """Rows (shard, text) in order of shard to each shard's model. part 0 .. CONTEXTS - 1: rows of the tables; CONTEXTS: the
    map; CONTEXTS + 1: weights (times STEP) times decisions of each gate, and those decisions."""

    def run(batches):
        learner, last = None, None
        for shard, texts in _by_shard(batches):
            if learner is None or shard != last:
                if learner is not None:
                    yield from learner.rows()
                learner, last = _Learner(model.value, rule), shard
            for block in blocks(texts):
                learner.learn(block)
        if learner is not None:
            yield from learner.rows()

    return run


def _add(prior: float):
    """Sums of equal (part, row); a task has few of them, however many it reads. Of the tables what goes on is
    the log odds, an eighth of the counts' bytes."""

    def run(batches):
        total: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for part, row, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
                kind, wide = ("<f8", "<f8") if part >= CONTEXTS else ("<i4", "<i8")
                x, y = np.frombuffer(a, kind), np.frombuffer(b, kind)
                if (part, row) in total:
                    total[part, row][0] += x
                    total[part, row][1] += y
                else:
                    total[part, row] = [x.astype(wide), y.astype(wide)]
        for (part, row), (zeros, ones) in total.items():
            if part < CONTEXTS:
                zeros, ones = np.log((ones + prior) / (zeros + prior)).astype("<f4"), ones[:0]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([row], pa.int32()), pa.array([zeros.tobytes()], pa.binary()), pa.array([ones.tobytes()], pa.binary())], ["part", "row", "zeros", "ones"])

    return run


def fit(texts: DataFrame, rule: Mixing = Mixing()) -> tuple[Model, DataFrame]:
    """The model of texts (id, text), and the count of every token's hash. Null is the empty text. Texts are dealt into shards
    by id and text, and a shard has one order, so the model depends on the rows alone, not on how they are partitioned."""
    spark = texts.sparkSession
    counted = materialize(texts.select("text").mapInArrow(_count, _COUNTS).groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    tokens = counted.filter("kind = 0").select(F.col("key").alias("token"), "n")
    few = {(r["kind"], r["key"]): r["n"] for r in counted.filter("kind > 0").collect()}  # at most 258 rows
    ends = few.get((2, 0), 0)
    distinct, words = tokens.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    head = most_frequent(tokens, "token", "n", rule.head).toArrow()
    key, count = head["token"].to_numpy().view(np.uint64), head["n"].to_numpy()
    order = np.lexsort((key, -count))
    key, count = key[order], count[order]
    k = min(rule.symbols, len(key))
    letters = np.array([few.get((1, i), 0) for i in range(257)], np.int64)
    rest = int(words - count[:k].sum())
    code = Code.of(np.concatenate([count[:k], [ends + 1, max(rest, distinct // 2) + 1]]))
    order = np.argsort(key)
    symbol = np.where(order < k, order, -1)
    del head
    model = Model(key[order], count[order], symbol.astype(np.int32), distinct <= rule.head, code, Code.of(letters + 1), int(words + ends), int(distinct + (ends > 0)), int(ends))
    told = Model(**{**model.__dict__})
    kept = symbol >= 0  # training needs the symbols' tokens only
    told.tokens, told.counts, told.symbol = told.tokens[kept], told.counts[kept], symbol[kept]
    sent = spark.sparkContext.broadcast(told)
    shards = max(1, -(-int(letters[:STOP].sum()) // rule.shard_bytes))
    dealt = texts.select(F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int").alias("shard"), "text", F.xxhash64("text", "id").alias("turn"), "id")
    ordered = dealt.repartitionById(min(shards, 1 << 15), "shard").sortWithinPartitions("shard", "turn", "id").select("shard", "text")
    rows = ordered.mapInArrow(_learn(sent, rule), _PART).repartition("part", "row").mapInArrow(_add(rule.prior), _PART).toArrow()  # as large as the tables
    slots, step = 1 << rule.slot_bits, min(rule.row_slots, 1 << rule.slot_bits)
    model.tables = np.zeros((CONTEXTS, slots), np.float32)
    model.weights = np.full((2, GATES, CONTEXTS + 1), 0.5, np.float32)
    model.refined = np.tile(np.arange(BUCKETS) - 12.0, (2, GATES, 1)).astype(np.float32)
    for part, row, a, b in zip(*(rows.column(i).to_pylist() for i in range(4))):
        if part < CONTEXTS:
            model.tables[part, row * step : (row + 1) * step] = np.frombuffer(a, "<f4")
        elif part == CONTEXTS:
            z, o = (np.frombuffer(x, "<f8").reshape(2, GATES, BUCKETS) for x in (a, b))
            # Each cell starts as 20 decisions of its own log odds.
            p = 1 / (1 + np.exp(-(np.arange(BUCKETS) - 12.0)))
            model.refined = np.log((o + 20 * p) / (z + 20 * (1 - p))).astype(np.float32)
        else:
            s, n = (np.frombuffer(x, "<f8").reshape(2, GATES, CONTEXTS + 1) for x in (a, b))
            model.weights = np.where(n > 0, s / STEP / np.maximum(n, 1), 0.5).astype(np.float32)
    return model, tokens


_SCORED = "kind byte, rid long, doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base double, score double, token long, n long"


def _score(model, rule: Mixing):
    """kind 0: a row's sums over the head's tokens; kind 1: a token of the row that is not in the head."""

    def rows(kind, size, **have):
        names = [x.split()[0] for x in _SCORED.split(", ")]
        kinds = {"byte": pa.int8(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
        columns = []
        for x in _SCORED.split(", "):
            name, t = x.split()
            v = have.get(name)
            columns.append(pa.array(np.full(size, kind, np.int8)) if name == "kind" else pa.nulls(size, kinds[t]) if v is None else v if isinstance(v, pa.Array) else pa.array(v, kinds[t]))
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        m: Model = model.value
        scale = np.log10(m.total + 0.5 * (m.distinct + 1)) if m.total else np.log10(0.5)
        alone, room = m.tables[0].take(m.root(rule.slot_bits)), None
        for batch in batches:
            rid = batch.column(0)
            for block in blocks(batch.column(3)) if batch.num_rows else ():
                n_docs = len(block.rows)
                w = block.words(NOT_SPACE)
                place = m.find(w.hash)
                doc = w.document()
                known = place >= 0
                count = np.where(known, m.counts[place] if len(m.counts) else 0, 0)
                settled = known if not m.whole else np.ones(len(known), bool)
                base = np.bincount(doc[settled], np.log10(count[settled] + 0.5) - scale, n_docs) + np.log10(m.ends + 0.5) - scale
                n_known = np.bincount(doc[known], minlength=n_docs) + (m.ends > 0)
                score = np.zeros(n_docs)
                for stream, (owner, parts) in enumerate(_decisions(w, place, m)):
                    bits = np.zeros(len(owner))
                    for part in parts:
                        lost = np.zeros(len(part.own))
                        room = _room(room, part)
                        for bit, inputs, gate in part.read(m.tables, alone, rule.slot_bits, room):
                            z = _mixed(inputs, m.weights[stream], gate)
                            if isinstance(gate, int):
                                z += m.refined[stream, gate].take(_cell(z, 0))
                            else:
                                z += m.refined[stream].reshape(-1).take(_cell(z, gate))
                            z *= np.float32(0.5) - bit.astype(np.float32)  # the sign of a one is turned
                            lost[: len(bit)] += np.log(1 + np.exp(z))
                        bits[part.own] = lost
                    score -= np.bincount(owner, bits, n_docs) / np.log(10)
                take = pa.array(block.rows)
                n_bytes = pa.array((np.diff(block.bounds) - 1).astype(np.int64))
                yield rows(0, n_docs, rid=rid.take(take), doc_id=batch.column(1).take(take), held_out=batch.column(2).take(take), n_tokens=w.counts + 1, n_known=n_known, n_bytes=n_bytes, base=base, score=score)
                if not m.whole:
                    left = np.flatnonzero(~known)
                    order = left[np.lexsort((w.hash[left], doc[left]))]
                    h, d = w.hash[order], doc[order]
                    begin = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, np.int64)
                    n = np.diff(np.append(begin, len(h)))
                    yield rows(1, len(begin), rid=rid.take(pa.array(block.rows[d[begin]])), token=h[begin].view(np.int64), n=n.astype(np.int64))

    return run


def score(docs: DataFrame, rule: Mixing = Mixing(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte (null for an
    empty text) of each row. A row is held out if crc32 of its id as text is 1 modulo 5; the model learns
    from all other rows.

    Null and empty texts are an end alone. A null id is not held out. Repeated rows count and are scored each.
    Without training rows nothing is known and the model is uniform. An empty table gives no rows. Other
    columns are not used.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))
    thin = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).cast("string").alias("text"))
    model, tokens = fit(thin.filter("not held_out").select(F.col("doc_id").alias("id"), "text"), rule)
    sent = spark.sparkContext.broadcast(model)
    scored = materialize(thin.mapInArrow(_score(sent, rule), _SCORED), "scored")
    rows = scored.filter("kind = 0")
    if not model.whole:
        base = F.log10(F.coalesce(tokens["n"], F.lit(0)) + 0.5) - F.lit(float(np.log10(model.total + 0.5 * (model.distinct + 1))))
        tail = (
            scored.filter("kind = 1").select("rid", "token", F.col("n").alias("times")).join(tokens, "token", "left")
            .groupBy("rid").agg(F.sum(F.col("times") * base).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("also"))
        )
        rows = rows.join(tail, "rid", "left").withColumns({"base": F.col("base") + F.coalesce("more", F.lit(0.0)), "n_known": F.col("n_known") + F.coalesce("also", F.lit(0))})
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("n_bytes"))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", bits.alias("bits_per_byte"))


def brute_force(docs: list[tuple[int, str | None]]) -> dict[int, tuple[bool, int, int, int, float]]:
    """The base columns by their definition, for tests."""
    import math
    import re
    import zlib
    from collections import Counter

    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or "")), None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in tokens}
    c = Counter(x for d, ts in tokens.items() if not held[d] for x in ts)
    total = sum(c.values())
    return {d: (held[d], len(ts), sum(c[x] > 0 for x in ts), total, sum(math.log10((c[x] + 0.5) / (total + 0.5 * (len(c) + 1))) for x in ts)) for d, ts in tokens.items()}
