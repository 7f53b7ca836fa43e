"""Token ids in ORC: integer run-length encoded lists in stripes, with row indexes and a Bloom filter
on the document id, so that readers take stripes in parallel and skip those that can't match.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from collections.abc import Callable
from dataclasses import dataclass
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillgraph.llm.kernels import Block, blocks, concat_ranges


@dataclass(frozen=True)
class OrcLayout:
    stripe_bytes: int = 16 << 20
    rows_per_index: int = 1000
    bloom_fpp: float = 0.01
    #: Documents in a file at most; a file is read by one or more tasks, a stripe by one.
    docs_per_file: int = 1 << 17


#: White space, and what some Unicode version takes for it. A single space or line feed between two other
#: characters ends a token of the byte-level pattern; a space starts the next one, a line feed is one.
#: So what stands between such places is encoded alike on its own.
_BLANK = r"\s\x1c-\x1f\x85\u180e\u200b-\u200f\u2028-\u202f\u2060-\u206f\ufeff"
_CUT = re.compile(rf"(?<=[^{_BLANK}])(?= [^{_BLANK}])")
_ODD = re.compile(rf"[{_BLANK}]")


#: A Latin word and ASCII punctuation after it: two tokens of the pattern, with a space before the first one
#: or not. (An apostrophe could start a contraction, so it is not among these.)
_SIMPLE = re.compile("([a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,!?;:$%&#*()]*)")


class Recent(dict):
    """A cache of two generations, filled by make() as keys are asked for. turn() makes the newer one the
    older at `most` entries; what is asked for again moves back."""

    def __init__(self, most: int, make: Callable[[str], bytes | None]):
        super().__init__()
        self.most, self.make, self.old = most, make, {}

    def __missing__(self, key: str) -> bytes | None:
        value = self.old.get(key, self)
        if value is self:
            value = self.make(key)
        self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


#: Bytes of a word and ids of it that the table of words has room for.
WORD_BYTES, WORD_IDS = 24, 8
#: Words that are looked up at once.
LOOKUPS = 1 << 14
_ID = attrgetter("id")
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class WordTable:
    """Ids by word in flat arrays: 33 bytes a word, and WORD_IDS ids unless only their numbers are kept. A word is found
    by its whole bytes in one of two places that its hash names; a new one takes an empty place of these, or one
    word's place. There are as many places as 160 bytes for each of `most` hold, a power of two, as the words that
    come once fill them as well. Ids of words that are not in the table (yet) are appended to the same array for as
    long as they are read."""

    def __init__(self, most: int, kind: type | None):
        wide = 33 + (0 if kind is None else WORD_IDS * np.dtype(kind).itemsize)
        self.bits = max(4, (160 * most // wide).bit_length() - 1)
        size = 1 << self.bits
        self.keys = np.zeros((size, 4), np.uint64)  # the bytes, and length and kind; 0 there: an empty place
        self.n = np.zeros(size, np.int8)
        self.own = 0 if kind is None else size * WORD_IDS
        self.ids = np.zeros(self.own + (1 << 16), kind or np.int32)
        self.turn = 0

    def find(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys and places of words, and which of them are missing. WORD_BYTES bytes must follow the last word in data."""
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        key = np.empty((len(start), 4), np.uint64)
        for k in range(3):
            key[:, k] = eight[start + 8 * k] & _MASK[np.clip(length - 8 * k, 0, 8)]
        key[:, 3] = length * 4 + kind + 1
        h = key[:, 3] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(3):
            h += key[:, k]
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        h *= np.uint64(0x9FB21C651E98DF25)
        place = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.flatnonzero(~self._holds(place, key))
        other = place[left] ^ 1
        there = self._holds(other, key[left])
        place[left[there]] = other[there]
        missing = np.zeros(len(start), bool)
        missing[left[~there]] = True
        missing |= length > WORD_BYTES
        return key, place, np.flatnonzero(missing)

    def _holds(self, place: np.ndarray, key: np.ndarray) -> np.ndarray:
        row = self.keys.take(place, 0)
        same = row[:, 3] == key[:, 3]
        for k in range(3):
            same &= row[:, k] == key[:, k]
        return same

    def append(self, ids: np.ndarray) -> int:
        """Where they begin in self.ids."""
        if self.own + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.own], np.zeros(2 * len(ids), self.ids.dtype)])
        self.ids[self.own : self.own + len(ids)] = ids
        return self.own

    def put(self, key: np.ndarray, place: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """Words of at most WORD_BYTES and WORD_IDS, their ids from at on; n is -1 for one without."""
        self.turn ^= 1
        full = self.keys[place, 3] > 0
        place = np.where(full & ((self.keys[place ^ 1, 3] == 0) | (self.turn == 1)), place ^ 1, place)
        place, first = np.unique(place, return_index=True)
        self.keys[place], self.n[place] = key[first], n[first]
        if self.own:
            size = np.maximum(n[first], 0)
            self.ids[concat_ranges(place * WORD_IDS, size)] = self.ids[concat_ranges(at[first], size)]


class Encoder:
    """Ids of whole texts, as the library's defaults give them (so a special token's string is that token), as
    little-endian 32-bit integers; only their numbers unless ids is True. No special token's string may hold white
    space, as texts are cut there.

    Words, with a space or a line feed before them or nothing, are encoded by the tokenizer once and kept for a while.
    Texts with other white space than single spaces and line feeds are cut at the spaces that are safe.
    """

    def __init__(self, tokenizer_path: str, most: int = 450_000, ids: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        if odd := [x.content for x in self.tokenizer.get_added_tokens_decoder().values() if _ODD.search(x.content) or x.lstrip or x.rstrip or x.single_word]:
            raise ValueError(f"texts can't be cut safely with the special tokens {odd}")
        self.tokenize = self.tokenizer.model.tokenize
        self.line = self._any("\n")
        # The byte-level form of the letters of simple words.
        form = ByteLevel(add_prefix_space=False, use_regex=False)
        self.form = {c: form.pre_tokenize_str(chr(c))[0][0] for c in [0x20, *range(0x41, 0x250)] if chr(c).isalpha() or c == 0x20}
        self.space = self.form[0x20]
        self.marks = {"": b""}
        top = max(self.tokenizer.get_vocab().values(), default=0)
        self.ids = ids
        self.table = WordTable(most, (np.uint16 if top < 1 << 16 else np.int32) if ids else None)
        #: By word, its bytes: the ids after a space, after a line feed (and of that) and at the start of a text; None where
        #: its ends aren't safe. These hold what the table has no room for, and what is new to it.
        self.kinds = [Recent(most // 32, make) for make in (lambda w: self._word(w.decode(), " "), self._after_line, lambda w: self._word(w.decode(), ""))]
        self.stems = Recent(most // 8, self._stem)
        self.other = Recent(most // 32, self._any)

    def _any(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<i4").tobytes()

    def _stem(self, s: str) -> bytes:
        return array("i", map(_ID, self.tokenize(s))).tobytes()

    def _after_line(self, w: bytes) -> bytes | None:
        ids = self._word(w.decode(), "")
        return None if ids is None else self.line + ids

    def _word(self, w: str, before: str) -> bytes | None:
        if m := _SIMPLE.fullmatch(w):
            stem, mark = m.groups()
            if not stem.isascii():
                stem = stem.translate(self.form)
            if before:
                stem = self.space + stem
            if mark not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks = {"": b""}
                self.marks[mark] = self._any(mark)
            return self.stems[stem] + self.marks[mark]
        return self._any(before + w) if w and not _ODD.search(w) else None

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each of a block's texts, and all their ids one after another (none if they aren't asked for)."""
        collecting = gc.isenabled()
        gc.disable()  # the lists of words below make no cycles
        try:
            return self._encode(block)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        data = np.concatenate([block.data, np.zeros(WORD_BYTES + 8, np.uint8)])
        raw = block.data.tobytes()
        end = np.flatnonzero((block.data == 0x20) | (block.data == 0x0A))  # of each word; a space follows each text
        start = np.concatenate([[0], end[:-1] + 1])
        bounds = np.searchsorted(start, block.bounds)
        length = end - start
        kind = (block.data[start - 1] == 0x0A).astype(np.int64)
        kind[bounds[:-1]] = 2
        text = np.repeat(np.arange(len(block.rows)), np.diff(bounds))
        odd = np.zeros(len(block.rows), bool)
        odd[text[length == 0]] = True
        n = np.zeros(len(start), np.int64)
        words = np.flatnonzero(~odd[text])
        found = [np.zeros(0, np.int32)]
        for a in range(0, len(words), LOOKUPS):
            part = words[a : a + LOOKUPS]
            n[part], some = self._look(data, raw, start[part], length[part], kind[part])
            found.append(some)
        odd[text[n < 0]] = True
        sums = np.concatenate([[0], np.cumsum(np.maximum(n, 0))])[bounds]
        sizes = np.diff(sums)
        flat = np.concatenate(found)
        if odd.any():
            pieces, begin = [], 0
            for i in np.flatnonzero(odd).tolist():
                own = b"".join(map(self.other.__getitem__, _CUT.split(raw[block.bounds[i] : block.bounds[i + 1] - 1].decode())))
                if self.ids:
                    pieces += [flat[sums[begin] : sums[i]], np.frombuffer(own, "<i4")]
                sizes[i], begin = len(own) // 4, i + 1
            flat = np.concatenate([*pieces, flat[sums[begin] :]]) if self.ids else flat
        return sizes, flat

    def _look(self, data: np.ndarray, raw: bytes, start: np.ndarray, length: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each word, -1 if its ends aren't safe, and the ids."""
        for kept in (*self.kinds, self.stems, self.other):
            kept.turn()
        table = self.table
        key, place, new = table.find(data, start, length, kind)
        n, at = table.n.take(place).astype(np.int64), place * WORD_IDS
        begin = start[new]
        later, line, first = (x.__getitem__ for x in self.kinds)
        made = [(later if k == 0 else line if k == 1 else first)(raw[s:e]) for s, e, k in zip(begin.tolist(), (begin + length[new]).tolist(), kind[new].tolist())]
        size = np.fromiter((-1 if x is None else len(x) // 4 for x in made), np.int64, len(made))
        n[new] = size
        at[new] = table.append(np.frombuffer(b"".join([x or b"" for x in made]), "<i4")) + np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
        some = table.ids[concat_ranges(at, np.maximum(n, 0))].astype(np.int32) if self.ids else table.ids[:0]
        fits = new[(length[new] <= WORD_BYTES) & (size <= WORD_IDS)]
        table.put(key[fits], place[fits], at[fits], n[fits])
        return n, some


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(tokenizer_path: str, most: int = 450_000, ids: bool = True) -> Encoder:
    """One encoder for each worker process, which tasks share; most: words that it keeps (some 300 bytes each)."""
    if (tokenizer_path, ids) not in _encoders:
        _encoders[tokenizer_path, ids] = Encoder(tokenizer_path, most, ids)
    return _encoders[tokenizer_path, ids]


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """doc_id, ids (array of int): each whole text's ids and end_id after them; null is the empty text."""

    def run(batches):
        held = encoder(tokenizer_path)
        for batch in batches:
            # Few documents at a time, so that what is held is a small multiple of the longest text.
            for block in blocks(batch.column(1)):
                sizes, ids = held.encode(block)
                ends = np.cumsum(sizes)
                offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).astype(np.int32)
                rows = batch.column(0).slice(int(block.rows[0]), len(block.rows))
                yield pa.RecordBatch.from_arrays([rows, pa.ListArray.from_arrays(offsets, np.insert(ids, ends, end_id))], ["doc_id", "ids"])

    # Nothing but the id and the text leaves the scan, whatever other columns there are.
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def write_orc(docs: DataFrame, path: str, tokenizer_path: str, layout: OrcLayout = OrcLayout(), id_col: str = "doc_id", text: str = "text") -> None:
    """Writes ids in ascending document id. The texts, not the ids, are shuffled into id ranges; each range
    is sorted, encoded and written by one task."""
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = thin.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    (
        encode(ordered, tokenizer_path)
        .write.option("orc.stripe.size", layout.stripe_bytes)
        .option("orc.row.index.stride", layout.rows_per_index)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", layout.bloom_fpp)
        .option("maxRecordsPerFile", layout.docs_per_file)
        .option("compression", "zstd")
        .orc(path)
    )


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def read_orc(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The documents, or those with an id from first to last: the bounds are pushed to the reader, which
    skips files, stripes and row groups by their statistics and Bloom filters."""
    found = spark.read.schema(SCHEMA).orc(path)
    if first is not None and first == last:
        return found.filter(F.col("doc_id") == first)
    if first is not None:
        found = found.filter(F.col("doc_id") >= first)
    return found if last is None else found.filter(F.col("doc_id") <= last)


def digest(stored: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), and the columns
    after these two of `stored`, from its doc_id and ids."""
    rest = [x for x in stored.columns if x not in ("doc_id", "ids")]

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = np.fromiter((zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())), np.int64, batch.num_rows)
            out = [batch.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums)]
            yield pa.RecordBatch.from_arrays([*out, *(batch.column(i + 2) for i in range(len(rest)))], ["doc_id", "n_tokens", "ids_crc32", *rest])

    kinds = "".join(f", {x} {stored.schema[x].dataType.simpleString()}" for x in rest)
    return stored.select("doc_id", "ids", *rest).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long" + kinds)


def token_index(spark: SparkSession, path: str, scratch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each stored document, from the files. start counts the ids of
    all documents before it: files hold id ranges, so it is the sum of earlier files and of earlier
    documents in the file. scratch() stores the thin digest for its two uses.

    Equal ids are ordered by their ids' checksum (then by length); a null id comes first.
    """
    thin = scratch(digest(read_orc(spark, path).withColumn("file", F.input_file_name())))
    files = thin.groupBy("file").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.sum("n_tokens").alias("file_tokens"))
    # A few numbers a file: this window is over as many rows as there are files.
    before = Window.orderBy(F.col("least").asc_nulls_first(), F.col("most").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("file_tokens").over(before), F.lit(0)).alias("file_start"))
    inside = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "ids_crc32", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    return (
        thin.withColumn("earlier", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(starts, "file")
        .select("doc_id", (F.col("file_start") + F.col("earlier")).cast("long").alias("start"), "n_tokens", "ids_crc32")
    )


def token_lengths(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", most: int = 450_000) -> DataFrame:
    """doc_id, n_tokens of each row, with the end id; null is the empty text. most: words that a worker keeps."""

    def run(batches):
        held = encoder(tokenizer_path, most, ids=False)
        for batch in batches:
            for block in blocks(batch.column(1)):
                rows = batch.column(0).slice(int(block.rows[0]), len(block.rows))
                yield pa.RecordBatch.from_arrays([rows, pa.array(held.encode(block)[0] + 1)], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
