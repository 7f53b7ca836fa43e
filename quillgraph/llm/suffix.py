"""Suffix arrays by external induced sorting.

The text's S* suffixes are sorted first: their substrings are sorted by one induction over arbitrary
starts, named, and the string of names is sorted by the same procedure, recursively; a string of names
that fits the memory is sorted by rank doubling instead. Then two scans induce the order of all other
suffixes. What a scan induces goes into a priority queue by first symbol and arrival: `SymbolQueue`
holds it in memory up to a bound and beyond it in a file. Tuples in the queue are a suffix's position
and the length of the prefix it shares with the one before it in its bucket, which follows from the
range minimum over the tuples that were scanned between their two inducers. So ranks, positions and
common-prefix values all come from sequential passes, each a few vectorised steps a batch.

Common-prefix values are capped (at most 255), which is all that finding repeats of a given length
needs; the order of suffixes is exact at least up to the cap.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from dataclasses import dataclass

import numpy as np

from quillgraph.llm.kernels import RangeHash, mix


@dataclass(frozen=True)
class Memory:
    #: Symbols of a string of names that is sorted in memory.
    names: int = 8 << 20
    #: Bytes that a queue holds in memory.
    queue: int = 4 << 20


class SymbolQueue:
    """A priority queue of (symbol, arrival): pop(c) takes all of symbol c in the order of arrival.
    Chunks beyond the memory go to one temporary file in the order of writing, and are read back by
    their place when their symbol's turn comes; each is written and read once."""

    def __init__(self, memory: int):
        self.memory, self.held = memory, 0
        self.chunks: dict[int, list] = defaultdict(list)
        self.file = None
        self.spilled = 0

    def push(self, symbol: int, position: np.ndarray, shared: np.ndarray | None) -> None:
        self.chunks[symbol].append((position, shared))
        self.held += position.nbytes + (0 if shared is None else shared.nbytes)

    def settle(self) -> None:
        """Moves what is in memory to the file if it is beyond the bound."""
        if self.held <= self.memory:
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="suffix-queue-")
        self.file.seek(0, 2)
        for chunks in self.chunks.values():
            for k, (position, shared) in enumerate(chunks):
                if isinstance(position, np.ndarray):
                    at = self.file.tell()
                    self.file.write(position.tobytes())
                    if shared is not None:
                        self.file.write(shared.tobytes())
                    chunks[k] = (at, (len(position), position.dtype, shared is not None))
                    self.spilled += 1
        self.held = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray | None] | None:
        chunks = self.chunks.pop(symbol, None)
        if not chunks:
            return None
        positions, shares = [], []
        for position, shared in chunks:
            if isinstance(position, np.ndarray):
                self.held -= position.nbytes + (0 if shared is None else shared.nbytes)
            else:
                n, kind, both = shared
                self.file.seek(position)
                position = np.frombuffer(self.file.read(n * kind.itemsize), kind)
                shared = np.frombuffer(self.file.read(n), np.uint8) if both else None
            positions.append(position)
            shares.append(shared)
        if len(positions) == 1:
            return positions[0], shares[0]
        return np.concatenate(positions), None if shares[0] is None else np.concatenate(shares)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _smaller_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (type S). Past the end is a symbol below all."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1]) if text.dtype.kind != "u" or text.itemsize > 4 else np.where(text[1:] > text[:-1], 1, np.where(text[1:] < text[:-1], -1, 0))
    step[-1] = -1
    changes = np.flatnonzero(step)
    return np.repeat(step[changes] > 0, np.diff(np.concatenate([[-1], changes])))


def _range_minima(d: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """min(d[first..last]) of each pair, both included, first <= last."""
    width = last - first + 1
    level = np.frexp(width.astype(np.float64))[1] - 1
    out = np.empty(len(first), d.dtype)
    table, k = d, 0
    top = int(level.max()) if len(level) else -1
    order = np.argsort(level.astype(np.uint8), kind="stable")
    edges = np.searchsorted(level[order], np.arange(top + 2))
    while k <= top:
        at = order[edges[k] : edges[k + 1]]
        if len(at):
            out[at] = np.minimum(table[first[at]], table[last[at] - (1 << k) + 1])
        k += 1
        if k <= top:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
    return out


class _Inducer:
    """Takes the scanned suffixes in order and queues what they induce."""

    def __init__(self, text: np.ndarray, small: np.ndarray, want_small: bool, queue: SymbolQueue, sigma: int, cap: int):
        self.text, self.small, self.want, self.queue, self.cap = text, small, want_small, queue, cap
        # Of each symbol: the least common prefix among those scanned since its last entry; 255 at first, then
        # an entry is the first of its bucket.
        self.least = np.full(sigma, 255, np.uint8) if cap else None
        self.begun = np.zeros(sigma, bool) if cap else None

    def scan(self, position: np.ndarray, shared: np.ndarray | None) -> None:
        before = position - 1
        at = np.flatnonzero(position > 0)
        at = at[self.small[before[at]] == self.want]
        symbol = self.text[before[at]]
        order = np.argsort(symbol, kind="stable")
        at, symbol = at[order], symbol[order]
        if len(at) == 0:
            if self.cap and len(shared):
                np.minimum(self.least, shared.min(), out=self.least)
            return
        turn = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
        begin = np.concatenate([[0], turn])
        end = np.concatenate([turn, [len(at)]])
        kinds = symbol[begin].astype(np.int64)
        out = None
        if self.cap:
            value = np.empty(len(at), np.uint8)
            later = np.ones(len(at), bool)
            later[begin] = False
            follow = np.flatnonzero(later)
            if len(follow):
                value[follow] = _range_minima(shared, at[follow - 1] + 1, at[follow])
            up_to = np.minimum.accumulate(shared)
            value[begin] = np.minimum(self.least[kinds], up_to[at[begin]])
            out = np.minimum(value.astype(np.int16) + 1, self.cap).astype(np.uint8)
            out[begin[~self.begun[kinds]]] = 0
            self.begun[kinds] = True
            np.minimum(self.least, up_to[-1], out=self.least)
            last = at[end - 1]
            after = np.minimum.accumulate(shared[::-1])[::-1]
            self.least[kinds] = np.where(last + 1 < len(shared), after[np.minimum(last + 1, len(shared) - 1)], 255)
        target = before[at]
        for c, a, b in zip(kinds.tolist(), begin.tolist(), end.tolist()):
            self.queue.push(c, target[a:b], None if out is None else out[a:b])
        self.queue.settle()


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix lengths of suffix pairs, up to cap, by comparing symbols of those that agree so far."""
    out = np.zeros(len(a), np.uint8)
    live = np.arange(len(a))
    n = len(text)
    for k in range(cap):
        x, y = a[live] + k, b[live] + k
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        live = live[text[x] == text[y]]
        if not len(live):
            break
        out[live] = k + 1
    return out


def _induce(text: np.ndarray, small: np.ndarray, starts: np.ndarray, shared: np.ndarray | None, cap: int, memory: Memory):
    """Buckets (symbol, positions, shared) in ascending order of the suffixes, from the S* suffixes `starts`
    in their order. The last symbol's suffix follows the end of the text, which is the least of all."""
    n = len(text)
    sigma = int(text.max()) + 1
    first_symbols = text[starts].astype(np.int64)
    edges = {}
    if len(starts):
        turn = np.flatnonzero(first_symbols[1:] != first_symbols[:-1]) + 1
        for a, b in zip([0, *turn.tolist()], [*turn.tolist(), len(starts)]):
            edges[int(first_symbols[a])] = (a, b)
    present = np.flatnonzero(np.bincount(text, minlength=sigma)).tolist()
    large_queue = SymbolQueue(memory.queue)
    forward = _Inducer(text, small, False, large_queue, sigma, cap)
    forward.scan(np.array([n]), np.zeros(1, np.uint8) if cap else None)
    large: dict[int, tuple] = {}
    single = lambda p, q: _common(text, np.array([p]), np.array([q]), cap)
    for c in present:
        got = []
        while (batch := large_queue.pop(c)) is not None:
            got.append(batch)
            forward.scan(*batch)
        if got:
            large[c] = (np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got]) if cap else None)
        if c in edges:
            a, b = edges[c]
            part = None
            if cap:
                part = shared[a:b].copy()
                part[0] = single(large[c][0][-1], starts[a])[0] if got else 0
            forward.scan(starts[a:b], part)
    large_queue.close()
    small_queue = SymbolQueue(memory.queue)
    backward = _Inducer(text, small, True, small_queue, sigma, cap)
    buckets = []
    for c in reversed(present):
        got = []
        while (batch := small_queue.pop(c)) is not None:
            got.append(batch)
            backward.scan(*batch)
        down = np.concatenate([x for x, _ in got]) if got else np.zeros(0, np.int64)
        down_shared = np.concatenate([x for _, x in got]) if got and cap else None
        up, up_shared = large.pop(c, (np.zeros(0, np.int64), np.zeros(0, np.uint8)))
        meet = 0
        if cap and len(down) and len(up):
            meet = single(up[-1], down[-1])[0]
        if len(up):
            # From above: the first comes after the least S suffix of the bucket, each other after its upper neighbour.
            step = None
            if cap:
                step = np.empty(len(up), np.uint8)
                step[0] = meet
                step[1:] = up_shared[:0:-1]
            backward.scan(up[::-1], step)
        rising = None
        if cap:
            rising = np.empty(len(down), np.uint8)
            if len(down):
                rising[0] = meet
                rising[1:] = down_shared[:0:-1]
            rising = np.concatenate([up_shared, rising])
        buckets.append((np.concatenate([up, down[::-1]]), rising))
    small_queue.close()
    return buckets[::-1]


def _doubling(names: np.ndarray) -> np.ndarray:
    """The suffix array of a string in memory, by doubling ranks."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    rank = np.empty(n, np.int64)
    value = names[order]
    rank[order] = np.cumsum(np.concatenate([[0], value[1:] != value[:-1]])) + 1
    k = 1
    while rank[order[-1]] < n and k < n:
        second = np.zeros(n, np.int64)
        second[:-k] = rank[k:]
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        value = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], value[1:] != value[:-1]])) + 1
        k *= 2
    return order


def _sorted_starts(text: np.ndarray, small: np.ndarray, starts: np.ndarray, memory: Memory) -> np.ndarray:
    """The S* suffixes in order."""
    if len(starts) < 2:
        return starts
    by_symbol = starts[np.argsort(text[starts], kind="stable")]
    is_start = np.zeros(len(text), bool)
    is_start[starts] = True
    order = np.concatenate([b[is_start[b]] for b, _ in _induce(text, small, by_symbol, None, 0, memory)])
    # Equal S* substrings get equal names: same length and same symbols up to the next start.
    end = np.empty(len(text) + 1, np.int64)
    end[starts] = np.concatenate([starts[1:] + 1, [len(text)]])
    hashes = RangeHash(mix(text.astype(np.uint64) + np.uint64(1)))
    key = hashes.of(order, end[order])
    size = end[order] - order
    differs = np.concatenate([[True], (key[1:] != key[:-1]) | (size[1:] != size[:-1])])
    # The one that reaches the end of the text differs from all others.
    at_end = np.flatnonzero(order == starts[-1])
    differs[at_end] = True
    if at_end[0] + 1 < len(order):
        differs[at_end[0] + 1] = True
    names = np.cumsum(differs) - 1
    if names[-1] == len(starts) - 1:
        return order
    name = np.empty(len(text), np.int64)
    name[order] = names
    reduced = name[starts]
    return starts[suffix_order(reduced, memory)]


def suffix_order(text: np.ndarray, memory: Memory = Memory()) -> np.ndarray:
    """Positions of the suffixes in ascending order; non-negative integer symbols."""
    if len(text) <= memory.names:
        return _doubling(text)
    small = _smaller_types(text)
    starts = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order = _sorted_starts(text, small, starts, memory)
    return np.concatenate([b for b, _ in _induce(text, small, order, None, 0, memory)])


def suffix_array(text: np.ndarray, cap: int, memory: Memory = Memory()) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all suffixes in ascending order, and what each shares with the one before it, up to
    cap (at most 254). Symbols are non-negative integers. The empty text gives empty arrays."""
    if len(text) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    small = _smaller_types(text)
    starts = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order = _sorted_starts(text, small, starts, memory)
    shared = np.concatenate([np.zeros(1, np.uint8), _common(text, order[:-1], order[1:], cap)]) if len(order) else np.zeros(0, np.uint8)
    buckets = _induce(text, small, order, shared, cap, memory)
    for _, common in buckets:
        common[0] = 0
    return np.concatenate([b for b, _ in buckets]), np.concatenate([s for _, s in buckets])
