"""The encoder's table of words: the library's ids whatever is evicted, and what it keeps in memory."""

import gc
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm import tokens
from quillgraph.llm.kernels import blocks
from quillgraph.llm.queries import TOKENIZER


def texts():
    r = random.Random(8)
    bits = ["a", "Éa", "ñ", "x.", "don't", "\n", " ", " ", " ", "\n", "  ", "\t", "\0", "<|endoftext|>", "12", "日本", "e" * 23, "é" * 12, "q" * 24, "w" * 25, "0f44d48ffab2b14b64", "…", " ", "_", "(b)", "ab\0"]
    found = ["", " ", "\n", "a\n\nb", "a", None, "w" * 3000, "a \0", "a \0\0"]
    return found + ["".join(r.choice(bits if i % 2 else bits[:9] + bits[15:20]) for _ in range(r.randrange(40))) for i in range(3000)]


@pytest.mark.parametrize("most, ids", [(2, True), (2, False), (3000, True)])
def test_ids_are_the_library_s(most, ids):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    rows = texts()
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in rows]
    held = tokens.Encoder(TOKENIZER, most, ids)
    for size in (1 << 20, 3000, 50):
        sizes, flat = zip(*(held.encode(b) for b in blocks(pa.array(rows), size)))
        assert np.concatenate(sizes).tolist() == [len(x) for x in want]
        assert np.concatenate(flat).tolist() == ([x for y in want for x in y] if ids else [])


def test_memory_for_a_word():
    """300,000 different words through an encoder of lengths that keeps 20,000."""
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghijklmnop", k=9)) for _ in range(300_000)]
    rows = pa.array([" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)])
    held = tokens.Encoder(TOKENIZER, 1000, ids=False)
    for block in blocks(rows.slice(0, 20)):
        held.encode(block)
    tracemalloc.start()
    try:
        held = tokens.Encoder(TOKENIZER, 20_000, ids=False)
        for block in blocks(rows):
            held.encode(block)
        gc.collect()
        assert tracemalloc.get_traced_memory()[0] < 20e6
    finally:
        tracemalloc.stop()


def test_words_stay_known():
    """Of 6,500 words through an encoder that keeps 2,600 (dicts in two generations held 5,200 and so none of these), most are
    not encoded again the second time."""
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghijklmnop", k=9)) for _ in range(6500)]
    rows = pa.array(["x " + " ".join(words[i : i + 10]) for i in range(0, len(words), 10)])
    held = tokens.Encoder(TOKENIZER, 2600)
    calls = []
    plain = held.tokenize
    held.tokenize = lambda s: calls.append(s) or plain(s)
    for block in blocks(rows, 5000):
        held.encode(block)
    assert len(calls) >= 6500
    calls.clear()
    for block in blocks(rows, 5000):
        held.encode(block)
    assert len(calls) < 3000
