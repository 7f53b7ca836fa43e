"""Exact removal of repeated byte strings of a corpus by sharded suffix arrays.

Every `length`-byte window belongs to the shard of its least hashed k-gram (its minimizer), a property
of its bytes alone, so all occurrences of a window meet in one shard. Consecutive windows with the same
minimizer form a segment, so a shard holds strings little longer than a window, not single windows.

1. Documents are cut into segments. Within a batch, equal segments are settled at once: all but the
   first are repeats. So what a batch sends to a shard is each different segment once, however
   often a passage repeats in it.
2. In a shard, equal segments are settled alike. Segments that share a minimizer but differ go on.
3. The bytes of these are fetched from the documents and meet again by minimizer; an external
   induced sorting of each shard's segments gives its suffix array and common prefixes, and windows
   of a run with a common prefix of `length` are the same string: all but the first are repeats.
   A minimizer with more bytes of different segments than a task should hold is split by window
   instead: of each batch every different window goes once to the shard of its own hash.
4. The repeats' spans return to their documents.

Segments are compared by 64-bit hash within a minimizer, and so are a split minimizer's windows; suffixes byte
by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillgraph.llm.common import delete, materialize, scratch
from quillgraph.llm.kernels import BYTE_VALUES, RangeHash, blocks, concat_ranges
from quillgraph.llm.suffix import Memory, suffix_array


@dataclass(frozen=True)
class Repeats:
    #: Bytes of a repeated string, 254 at most.
    length: int = 100
    #: Bytes of a k-gram.
    gram: int = 32
    #: Segments that a batch gathers before it settles and sends them.
    batch: int = 600_000
    #: Bytes that are sorted together, besides those of the last minimizer.
    shard_bytes: int = 2 << 20
    #: Bytes of a minimizer's different segments beyond which it is split by window.
    hot_bytes: int = 8 << 20
    memory: Memory = Memory()


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each `width` consecutive values, by start."""
    if len(x) < width:
        return x[:0]
    have, out = 1, x
    while 2 * have <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    return op(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def _segments(block, rule: Repeats) -> tuple[np.ndarray, ...]:
    """document (in the block), start in the block, windows, minimizer, hash, inner (the minimizer is found
    twice or more, so that windows can repeat inside) of each segment."""
    data, bounds = block.data, block.bounds
    k, length = rule.gram, rule.length
    width = length - k + 1
    values = RangeHash(BYTE_VALUES[data])
    gram = values.all(k)
    least = _slide(gram, width, np.minimum)
    n = len(least)  # windows by start
    count = np.maximum(np.diff(bounds) - 1 - length + 1, 0)
    has = np.flatnonzero(count)
    if not len(has) or n == 0:
        e = np.zeros(0, np.int64)
        return e, e, e, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    start, count = bounds[has], count[has]
    valid = np.zeros(n + 1, bool)
    mark = np.zeros(n + 1, np.int8)
    mark[start] = 1
    mark[start + count] -= 1
    valid = np.cumsum(mark, dtype=np.int8).view(bool)[:n]
    turn = np.zeros(n, bool)
    turn[1:] = least[1:] != least[:-1]
    turn[start] = True
    at = np.flatnonzero(turn & valid)
    doc = np.searchsorted(start, at, "right") - 1
    end = np.append(at[1:], n)
    end = np.minimum(end, (start + count)[doc])
    windows = end - at
    key = least[at]
    content = values.of(at, end + length - 1)
    # Places of minimizers; two of equal value, the next one at most `width` on (farther and a window between them
    # has neither, which ends the segment), make windows repeat inside, perhaps.
    most = _slide(least, width, np.maximum)  # by first window; the k-gram at start + width - 1 is in all of them
    place = np.flatnonzero(gram[width - 1 : width - 1 + len(most)] == most) + width - 1
    edge = np.concatenate([np.arange(min(width - 1, len(gram))), np.arange(width - 1 + len(most), len(gram))])
    place = np.unique(np.concatenate([place, edge]))
    place = place[np.argsort(gram[place], kind="stable")]  # next to each place the next one of its value
    near = np.flatnonzero((gram[place[1:]] == gram[place[:-1]]) & (place[1:] - place[:-1] <= width))
    inner = np.zeros(len(at), bool)
    if len(near):
        a = np.searchsorted(at, np.maximum(place[near + 1] - width + 1, 0), "right") - 1
        b = np.searchsorted(at, place[near], "right")
        a = np.maximum(a, 0)
        span = np.maximum(b - a, 0)
        which = concat_ranges(a, span)
        same = key[which] == np.repeat(gram[place[near]], span)
        inner[which[same]] = True
    return has[doc], at, windows, key, content, inner


#: Rows between the steps. kind 0: a segment; 1: windows that repeat an earlier one; 2: a segment of a minimizer to be split.
_ROW = "kind byte, key long, content long, seq long, start int, windows int"


def _rows(kind, key, content, seq, start, windows) -> pa.RecordBatch:
    n = len(seq)
    full = lambda x, t: np.full(n, x, t) if np.isscalar(x) else x.astype(t)
    as_long = lambda x: np.zeros(n, np.int64) if x is None else x.view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(full(kind, np.int8)), pa.array(as_long(key)), pa.array(as_long(content)), pa.array(full(seq, np.int64)), pa.array(full(start, np.int32)), pa.array(full(windows, np.int32))],
        ["kind", "key", "content", "seq", "start", "windows"],
    )


def _joined(seq: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with those that touch or overlap joined."""
    order = np.lexsort((start, seq))
    seq, start, windows = seq[order], start[order].astype(np.int64), windows[order].astype(np.int64)
    if not len(seq):
        return seq, start, windows
    # Within a document windows stay below 2**31, so a running maximum over shifted values stays within documents.
    shift = np.cumsum(np.concatenate([[0], seq[1:] != seq[:-1]])) << 32
    far = np.maximum.accumulate(start + windows + shift)
    begin = np.flatnonzero(np.concatenate([[True], (start + shift)[1:] > far[:-1]]))
    end = np.append(begin[1:], len(seq)) - 1
    return seq[begin], start[begin], (far[end] - shift[end]) - start[begin]


def _settle(key, content, seq, start, windows) -> tuple[np.ndarray, np.ndarray]:
    """Order of segments by (key, content, place), and which begin a group of equal ones."""
    order = np.lexsort((start, seq, content, key))
    k, c, w = key[order], content[order], windows[order]
    first = np.ones(len(order), bool)
    first[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (w[1:] != w[:-1])
    return order, first


def _cut(rule: Repeats):
    def flush(parts) -> Iterator[pa.RecordBatch]:
        seq, start, windows, key, content, inner = (np.concatenate(x) for x in zip(*parts))
        order, first = _settle(key, content, seq, start, windows)
        own = order[first]
        again = order[~first]
        yield _rows(0, key[own], content[own], seq[own], start[own], np.where(inner[own], -windows[own], windows[own]))
        if len(again):
            yield _rows(1, None, None, *_joined(seq[again], start[again], windows[again]))

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for block in blocks(batch.column(1)):
                doc, at, windows, key, content, inner = _segments(block, rule)
                if not len(doc):
                    continue
                parts.append((ids[block.rows[doc]], (at - block.bounds[doc]).astype(np.int32), windows.astype(np.int32), key, content, inner))
                held += len(doc)
                if held >= rule.batch:
                    yield from flush(parts)
                    parts, held = [], 0
        if parts:
            yield from flush(parts)

    return run


def _meet(rule: Repeats):
    """Of one shard of minimizers: repeats as they are, those of equal segments, and as kind 0 or 2 the different
    segments of a minimizer that has several, or one with its minimizer twice inside."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        kind, key, content, seq, start, windows = (t[c].to_numpy() for c in t.column_names)
        done = kind == 1
        segment = np.flatnonzero(~done)
        key, content, s_seq, s_start, signed = key[segment], content[segment], seq[segment], start[segment], windows[segment]
        inner, s_windows = signed < 0, np.abs(signed)
        order, first = _settle(key, content, s_seq, s_start, s_windows)
        again = order[~first]
        joined = _joined(np.concatenate([seq[done], s_seq[again]]), np.concatenate([start[done], s_start[again]]), np.concatenate([windows[done], s_windows[again]]))
        if len(joined[0]):
            yield _rows(1, None, None, *joined)
        own = order[first]
        k = key[own]
        alone = np.ones(len(own), bool)
        same = k[1:] == k[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        go = own[~alone | inner[own]]
        if len(go):
            k = key[go]
            begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.add.reduceat(s_windows[go].astype(np.int64) + rule.length - 1, begin)
            hot = np.repeat(size > rule.hot_bytes, np.diff(np.append(begin, len(go))))
            yield _rows(np.where(hot, 2, 0), k.copy(), None, s_seq[go], s_start[go], s_windows[go])

    return run


def _fetch(length: int):
    """Bytes of the wanted segments of each document: (seq, text, wanted) to (key, seq, start, bytes)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            text = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            wanted = batch.column(2)
            bounds = wanted.offsets.to_numpy()
            fields = wanted.values
            key, start, windows = (fields.field(i).to_numpy() for i in range(3))
            offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
            raw = text.buffers()[2]
            count = np.diff(bounds)
            used = slice(int(bounds[0]), int(bounds[-1]))
            key, start, windows = key[used], start[used].astype(np.int64), windows[used].astype(np.int64)
            seq = np.repeat(batch.column(0).to_numpy(), count)
            base = np.repeat(offsets[:-1], count) + start
            data = np.frombuffer(raw, np.uint8)
            for a in range(0, len(key), 50_000):
                b = min(a + 50_000, len(key))
                size = windows[a:b] + length - 1
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                chunk = data[concat_ranges(base[a:b], size)]
                binary = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(chunk)])
                yield pa.RecordBatch.from_arrays([pa.array(key[a:b]), pa.array(seq[a:b]), pa.array(start[a:b].astype(np.int32)), binary], ["key", "seq", "start", "bytes"])

    return run


def _split(rule: Repeats):
    """Each window of the segments, by its own hash: of a batch the first of equal ones as kind 0, the others as
    repeats. So a window goes to its shard once from a batch, however many segments hold it."""

    def run(batches):
        for batch in batches:
            for rows in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                raw = rows.column(3)
                offsets = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, raw.offset * 4).astype(np.int64)
                data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                windows = np.diff(offsets) - rule.length + 1
                at = concat_ranges(offsets[:-1] - offsets[0], windows)
                h = RangeHash(BYTE_VALUES[data]).all(rule.length)[at]
                key, seq, start = (np.repeat(rows.column(i).to_numpy(), windows) for i in range(3))
                start = start + concat_ranges(np.zeros(len(windows), np.int64), windows)
                one = np.ones(len(at), np.int64)
                order, first = _settle(h, key, seq, start, one)
                own, again = order[first], order[~first]
                yield _rows(0, h[own], key[own], seq[own], start[own], one[own])
                if len(again):
                    yield _rows(1, None, None, *_joined(seq[again], start[again], one[again]))

    return run


def _sort_segments(rule: Repeats, seq: np.ndarray, start: np.ndarray, raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """seq and place of the windows that repeat an earlier one of these segments."""
    raw = raw.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    begin = offsets[:-1] - offsets[0] + np.arange(len(size))  # with one separator after each
    text = np.zeros(len(data) + len(size), np.uint16)
    inside = np.ones(len(text), bool)
    inside[begin + size] = False
    text[inside] = data
    text[inside] += 1
    order, shared = suffix_array(text, rule.length, rule.memory)
    group = np.cumsum(shared < rule.length)
    segment = np.searchsorted(begin, order, "right") - 1
    within = order - begin[segment]
    whole = within + rule.length <= size[segment]
    group, segment, within = group[whole], segment[whole], within[whole]
    often = np.bincount(group)[group] > 1
    group, segment, within = group[often], segment[often], within[often]
    s, at = seq[segment], start[segment] + within
    order = np.lexsort((at, s, group))
    group, s, at = group[order], s[order], at[order]
    later = np.zeros(len(group), bool)
    later[1:] = group[1:] == group[:-1]
    return s[later], at[later]


def _sort_shard(rule: Repeats):
    """Rows come sorted by minimizer. Minimizers are taken together up to shard_bytes; those over hot_bytes are not among them."""

    def sort(parts) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        raw = t["bytes"].combine_chunks()
        if isinstance(raw, pa.ChunkedArray):
            raw = raw.chunk(0)
        seq, at = _sort_segments(rule, t["seq"].to_numpy(), t["start"].to_numpy().astype(np.int64), raw)
        if len(seq):
            yield _rows(1, None, None, *_joined(seq, at, np.ones(len(seq), np.int64)))

    def run(batches):
        parts, held, last = [], 0, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            key = batch.column(0).to_numpy()
            size = np.diff(np.frombuffer(batch.column(3).buffers()[1], np.int32, batch.num_rows + 1, batch.column(3).offset * 4)).cumsum()
            turns = np.flatnonzero(key[1:] != key[:-1]) + 1
            if last is not None and key[0] != last:
                turns = np.concatenate([[0], turns])
            a = done = 0
            for c in turns.tolist():
                here = int(size[c - 1]) if c else 0
                if held + here - done >= rule.shard_bytes:
                    if c > a:
                        parts.append(batch.slice(a, c - a))
                    if parts:
                        yield from sort(parts)
                    parts, held, a, done = [], 0, c, here
            if a < batch.num_rows:
                parts.append(batch.slice(a))
                held += int(size[-1]) - done
            last = key[-1]
        if parts:
            yield from sort(parts)

    return run


def repeated_windows(docs: DataFrame, rule: Repeats = Repeats()) -> DataFrame:
    """seq, start, windows: runs of window starts, in bytes, that repeat an earlier window. docs has seq
    (a different long in each row; the order of documents) and text."""
    # Written before the caller joins it with the texts, so that no shuffle of texts or segments is still on disk then.
    with scratch() as made:
        found = materialize(_windows(docs, rule), "repeats", keep=True)
    for path in made:
        delete(docs.sparkSession, path)
    return found


def _windows(docs: DataFrame, rule: Repeats) -> DataFrame:
    by = ["key", "kind", F.when(F.col("kind") == 1, F.col("seq"))]
    found = materialize(docs.select("seq", "text").mapInArrow(_cut(rule), _ROW).repartition(*by).mapInArrow(_meet(rule), _ROW), "segments")

    def pieces(kind: int) -> DataFrame:
        wanted = found.filter(F.col("kind") == kind).groupBy("seq").agg(F.collect_list(F.struct("key", "start", "windows")).alias("wanted"))
        return docs.join(wanted, "seq").select("seq", "text", "wanted").mapInArrow(_fetch(rule.length), "key long, seq long, start int, bytes binary")

    repeats = found.filter("kind = 1").unionByName(pieces(0).repartition("key").sortWithinPartitions("key").mapInArrow(_sort_shard(rule), _ROW))
    if not found.filter("kind = 2").isEmpty():
        repeats = repeats.unionByName(pieces(2).mapInArrow(_split(rule), _ROW).repartition(*by).mapInArrow(_meet(rule), _ROW).filter("kind = 1"))
    return repeats.select("seq", "start", "windows")


def with_order(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """_row (a struct of all columns but the text), id, text and seq: a different long in each row, ascending with the id.
    Where ids are unique and not null, seq is the id. Else rows are ordered by (id, hash of the text), a null
    id first, equal rows in any order, and numbered: ranges of ids are sorted, and each range starts with
    the count of the earlier ones."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    ids = d.groupBy("id").count().agg(F.max("count"), F.count_if(F.col("id").isNull())).first()
    if (ids[0] or 1) == 1 and not ids[1]:
        return d.withColumn("seq", F.col("id"))
    keys = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    ordered = materialize(d.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("place", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ordered.withColumn("part", part).join(before, "part").select("_row", "id", "text", (F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("seq"))


def _apply(length: int, keep: bool):
    def run(batches):
        for batch in batches:
            for rows in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                n_bytes, removed, spans, digest, kept = [], [], [], [], []
                for text, runs in zip(rows.column(1).cast(pa.binary()).to_pylist(), rows.column(2)):
                    raw = text or b""
                    n_bytes.append(len(raw))
                    gone = np.zeros(0, bool)
                    if runs.is_valid and len(runs.values):
                        start, windows = (runs.values.field(i).to_numpy() for i in (0, 1))
                        cover = np.zeros(len(raw) + 1, np.int32)
                        np.add.at(cover, start, 1)
                        np.add.at(cover, start + windows + length - 1, -1)
                        gone = np.cumsum(cover[:-1]) > 0
                        raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    removed.append(int(gone.sum()))
                    spans.append(int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum()))
                    digest.append(hashlib.sha256(raw).hexdigest())
                    kept.append(raw if keep else None)
                out = [pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays([*rows.columns[3:], *out], [*rows.schema.names[3:], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, rule: Repeats = Repeats(), id_col: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256; if keep, also kept (binary: the remaining bytes, which
    need not be valid UTF-8, as a span may begin or end within a character) and _row, the input row but its text.

    Null and empty texts have no bytes. Rows with equal ids are different documents, ordered by a hash of
    their text; an equal row after the first loses all its repeated strings. An empty table gives no rows.
    Columns of any names may be there besides.
    """
    ordered = with_order(docs, id_col, text)
    runs = repeated_windows(ordered, rule).groupBy("seq").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    passed = ["id", "_row"] if keep else ["id"]
    joined = ordered.join(runs, "seq", "left").select("seq", "text", "runs", *passed)
    schema = T.StructType([joined.schema[c] for c in passed] + T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").fields)
    found = joined.mapInArrow(_apply(rule.length, keep), schema)
    return found if keep else found.drop("kept")


def brute_force(docs: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple[int, int, int, str]]:
    """The definition, window by window, for tests."""
    seen: set[bytes] = set()
    out = {}
    for doc, text in sorted(docs, key=lambda x: x[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out
