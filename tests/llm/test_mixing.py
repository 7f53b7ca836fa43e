"""The mixing model's decisions, walked by depth, against the same by symbol."""

import numpy as np
import pytest

from quillgraph.llm import mixing


@pytest.mark.parametrize("symbols", [2, 3, 60])
def test_decisions_by_depth(symbols, monkeypatch):
    """Each symbol's decisions are those of its code; slots are one for a node in a context, and those of four depths are of one
    group of 16, which is near one another in memory."""
    monkeypatch.setattr(mixing, "OWNERS", 100)
    r = np.random.default_rng(2)
    code = mixing.Code.of(np.sort(r.geometric(0.02, symbols) ** 3)[::-1])
    symbol = r.integers(0, symbols, 350)
    context = r.integers(0, 9, 350).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    tables = np.arange(2 * 4096, dtype=np.float32).reshape(2, 4096)  # a slot holds its own number
    alone = np.arange(symbols, dtype=np.float32)
    got, slot_of = {}, {}
    for part in mixing._parts(code, symbol, None, [None, context]):
        added = []
        for depth, (bit, inputs, gate) in enumerate(part.read(tables, alone, 12, mixing._room(None, part), lambda *x: added.append([y if isinstance(y, int) else y.copy() for y in x]))):
            assert gate == min(depth, mixing.GATES - 1) and inputs[mixing.CONTEXTS].min() == 1
            assert (added[depth][0], added[len(part.many) + depth][0]) == (-1, 1)
            assert (added[depth][1] == inputs[0] * 2 + bit).all() and (added[len(part.many) + depth][1] == inputs[1] - 4096).all()
            for own, b, node, slot in zip(part.own.tolist(), bit.tolist(), inputs[0].astype(int).tolist(), (inputs[1] - 4096).astype(int).tolist()):
                got.setdefault(own, []).append((node, b))
                assert slot_of.setdefault((int(context[own]), node), slot) == slot
    assert slot_of or symbols < 2
    for i, x in enumerate(symbol.tolist()):
        z = slice(code.first[x], code.first[x] + code.length[x])
        assert got.get(i, []) == list(zip(code.node[z].tolist(), code.bit[z].tolist()))
        path = [slot_of[int(context[i]), n] for n in code.node[z].tolist()]
        for a in range(0, len(path), 4):
            assert len({s >> 4 for s in path[a : a + 4]}) == 1 and len(set(path[a : a + 4])) == len(path[a : a + 4])


def test_find():
    r = np.random.default_rng(4)
    for n in (0, 1, 2, 1000):
        tokens = np.unique(np.concatenate([r.integers(0, 1 << 64, n, np.uint64), np.arange(n // 10, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(n // 10, dtype=np.uint64)]))
        empty = np.zeros(0, np.int64)
        model = mixing.Model(tokens, empty, empty, True, mixing.Code.of(np.ones(2, int)), mixing.Code.of(np.ones(2, int)), 0, 0, 0)
        place = {t: i for i, t in enumerate(tokens.tolist())}
        asked = np.concatenate([tokens, tokens + np.uint64(1), tokens - np.uint64(1), r.integers(0, 1 << 64, 50, np.uint64)])
        assert model.find(asked).tolist() == [place.get(x, -1) for x in asked.tolist()]
