"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of `width` words. A window occurs in a document only if all of its
shingles do (containment 1), so by the prefix principle one shingle of each window has to be joined:
with shingles ordered by rarity among the items, the rarest one. A document's shingles meet these
necessary tokens; a match at some place fixes where the window would start, the document's bounds
there decide whether it can fit (length and position), and what fits is compared word for word.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.kernels import ALNUM, Words, blocks, concat_ranges


@dataclass(frozen=True)
class Containment:
    #: Words of a window; a shorter item that has words is one window.
    width: int = 10
    #: Words of a shingle.
    shingle: int = 5
    #: Bytes of item text that are broadcast at once. A larger benchmark is joined in as many blocks
    #: as it takes, each against all documents.
    block_bytes: int = 8 << 20


@dataclass
class _Index:
    """Of one block of items. tokens: sorted necessary tokens by shingle size; for each token its windows
    (first .. last) with the shingle's place in the window. Windows hold their words' bytes."""

    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    size: np.ndarray
    hash: np.ndarray
    text: list[bytes]
    items: list[list[int]]
    names: list[str]


def _index(items: list[tuple[str, str | None]], rule: Containment) -> _Index:
    windows: dict[tuple[bytes, ...], int] = {}
    owners: list[list[int]] = []
    names = sorted({x for x, _ in items})
    place = {x: i for i, x in enumerate(names)}
    column = pa.array([t for _, t in items], pa.large_string())
    for block in blocks(column):
        w = block.words(ALNUM)
        raw = w.data.tobytes()
        for i in range(len(block.rows)):
            spans = range(w.bounds[i], w.bounds[i + 1])
            own = [raw[w.start[j] : w.end[j]] for j in spans]
            size = min(rule.width, len(own))
            for a in range(len(own) - size + 1 if own else 0):
                key = windows.setdefault(tuple(own[a : a + size]), len(windows))
                if key == len(owners):
                    owners.append([])
                owners[key].append(place[items[block.rows[i]][0]])
    joined = [b" ".join(x) for x in windows]
    found: dict[int, list[tuple[int, int, int]]] = {}
    sizes, hashes = np.array([len(x) for x in windows], np.int64), np.zeros(len(windows), np.uint64)
    shingles: list[np.ndarray] = []
    first = 0
    for block in blocks(pa.array(joined, pa.large_binary())):
        w = block.words(ALNUM)
        hashes[first : first + len(block.rows)] = w.ranges.of(w.bounds[:-1], w.bounds[1:])
        for i in range(len(block.rows)):
            n = min(rule.shingle, int(w.counts[i]))
            at = np.arange(w.bounds[i], w.bounds[i + 1] - n + 1)
            shingles.append(w.ranges.of(at, at + n))
        first += len(block.rows)
    # Rarity: how many windows have the shingle.
    often = Counter(x for s in shingles for x in set(s.tolist()))
    for key, s in enumerate(shingles):
        at, token = min(enumerate(s.tolist()), key=lambda x: (often[x[1]], x[1], x[0]))
        found.setdefault(min(rule.shingle, int(sizes[key])), []).append((token, key, at))
    tables = {}
    for n, rows in found.items():
        rows.sort()
        token = np.array([x[0] for x in rows], np.uint64)
        unique, start = np.unique(token, return_index=True)
        tables[n] = (unique, np.append(start, len(rows)), np.array([x[1] for x in rows]), np.array([x[2] for x in rows]))
    return _Index(tables, sizes, hashes, joined, [sorted(set(x)) for x in owners], names)


def _matches(w: Words, index: _Index) -> tuple[np.ndarray, np.ndarray]:
    """First word and window of each occurrence."""
    starts, keys = [], []
    for n, (tokens, bounds, windows, offsets) in index.tables.items():
        at, hashes = w.shingles(n)
        # A small bitmap by low bits turns nearly all shingles away before the search.
        bitmap = np.zeros(1 << 20, bool)
        bitmap[(tokens & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        near = np.flatnonzero(bitmap[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        slot = np.searchsorted(tokens, hashes[near])
        slot[slot == len(tokens)] = 0
        same = tokens[slot] == hashes[near]
        near, slot = near[same], slot[same]
        count = bounds[slot + 1] - bounds[slot]
        entry = concat_ranges(bounds[slot], count)
        key, first = windows[entry], np.repeat(at[near], count) - offsets[entry]
        shingle_at = np.repeat(at[near], count)
        document = np.searchsorted(w.bounds, shingle_at, "right") - 1
        # Length and position: the whole window lies within the document.
        fits = (first >= w.bounds[document]) & (first + index.size[key] <= w.bounds[document + 1])
        first, key = first[fits], key[fits]
        same = w.ranges.of(first, first + index.size[key]) == index.hash[key]
        starts.append(first[same])
        keys.append(key[same])
    first = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    exact = np.fromiter(
        (b" ".join(w.data[w.start[j] : w.end[j]].tobytes() for j in range(f, f + index.size[k])) == index.text[k] for f, k in zip(first.tolist(), key.tolist())),
        bool,
        len(first),
    )
    return first[exact], key[exact]


def _item_blocks(items: DataFrame, id_col: str, text: str, rule: Containment) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of bounded size; an item is never split."""
    block: list[tuple[str, str | None]] = []
    held = 0
    for row in items.select(F.col(id_col).cast("string"), F.col(text)).toLocalIterator():
        block.append((row[0] or "", row[1]))
        held += len(row[1] or "")
        if held >= rule.block_bytes:
            yield block
            block, held = [], 0
    yield block


SCHEMA = "n_words long, n_hit long, items array<string>, spans array<struct<first:long,count:long>>"


def contain(docs: DataFrame, items: DataFrame, rule: Containment = Containment(), text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with _dc, a struct of n_words, n_hit, items (ids of items of which a window occurs, sorted as
    strings) and spans (maximal runs of hit words).

    Null and empty texts have no words and no hits; an item without words has no window. Equal items, and
    equal documents, are each counted. Null item ids count as the id ''. Without items nothing is hit. Columns _dc
    and _text of docs are replaced; any others stay.
    """
    spark = docs.sparkSession
    parts = [spark.sparkContext.broadcast(_index(x, rule)) for x in _item_blocks(items, item_id, item_text, rule)]

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            n_words, n_hit, found, spans = [], [], [], []
            for block in blocks(batch.column(batch.num_columns - 1)):
                w = block.words(ALNUM)
                edges = np.zeros(len(w.hash) + 1, np.int64)
                names: list[set[str]] = [set() for _ in block.rows]
                for part in parts:
                    index = part.value
                    first, key = _matches(w, index)
                    np.add.at(edges, first, 1)
                    np.add.at(edges, first + index.size[key], -1)
                    for d, k in set(zip((np.searchsorted(w.bounds, first, "right") - 1).tolist(), key.tolist())):
                        names[d].update(index.names[i] for i in index.items[k])
                hit = np.cumsum(edges[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(hit)])
                n_words += w.counts.tolist()
                n_hit += (total[w.bounds[1:]] - total[w.bounds[:-1]]).tolist()
                found += [sorted(x) for x in names]
                for i in range(len(block.rows)):
                    own = hit[w.bounds[i] : w.bounds[i + 1]] if n_hit[i - len(block.rows)] else hit[:0]
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                    spans.append([{"first": int(a), "count": int(b - a)} for a, b in zip(turn[::2], turn[1::2])])
            columns = [
                pa.array(n_words, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array(found, pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("count", pa.int64())]))),
            ]
            struct = pa.StructArray.from_arrays(columns, ["n_words", "n_hit", "items", "spans"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], struct], [*batch.schema.names[:-1], "_dc"])

    kept = [c for c in docs.columns if c not in ("_dc", "_text")]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add("_dc", T.StructType.fromDDL(SCHEMA))
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def contaminated(docs: DataFrame, items: DataFrame, rule: Containment = Containment(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contain(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), items, rule)
    return found.select(
        "doc_id",
        F.col("_dc.n_words").alias("n_words"),
        F.col("_dc.n_hit").alias("n_hit"),
        F.size("_dc.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_dc.items", ","), 256).alias("items_sha256"),
        (F.col("_dc.n_hit") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[str, str | None]], width: int = 10) -> dict[int, tuple[int, int, int, str]]:
    """The definition, word by word, for tests: n_words, n_hit, n_items, items_sha256 by document."""
    import re

    def split(t):
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    out = {}
    for doc, text in docs:
        own = split(text)
        hit, names = set(), set()
        for item, t in items:
            w = split(t)
            n = min(width, len(w))
            for a in range(len(w) - n + 1 if w else 0):
                for b in range(len(own) - n + 1):
                    if own[b : b + n] == w[a : a + n]:
                        hit.update(range(b, b + n))
                        names.add(item)
        out[doc] = (len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest())
    return out


#: The definition in SQL: windows of every item meet windows of the same size of every document.
ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k
        FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dn AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, dn.n, i, item_id FROM dn JOIN win ON dn.n = win.n AND dn.k = win.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS names FROM m GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h ON dw.doc_id = h.doc_id LEFT JOIN t ON dw.doc_id = t.doc_id
"""
