"""Variable-capacity best-fit packing of token sequences into training sequences.

Several sequence lengths are permitted. A document longer than the longest is cut into pieces of that
length and a rest. Pieces are dealt at random into groups of bounded size, and each group is packed
on its own: longest first, into the open bin that it leaves fullest; where none has room, a bin of the
length whose cost for each token that it can be expected to hold is least is opened. At the end every
bin is downsized to the shortest permitted length that holds what is in it.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Packing:
    lengths: tuple[int, ...] = (512, 1024, 2048, 4096)
    #: A bin's cost is its length plus this much, for what each sequence costs whatever its length.
    fixed_cost: float = 16.0
    #: Mean tokens of a group. A group is packed in one task; the loss is about one bin a group.
    group_tokens: int = 1 << 20

    def cost(self, length: int) -> float:
        return length + self.fixed_cost


def best_fit(sizes: list[int], rule: Packing) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the length of each bin. Pieces are at most the longest length."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    ascending = sorted(sizes)
    below = [0]  # tokens of the k shortest pieces
    for x in ascending:
        below.append(below[-1] + x)
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    used: list[int] = []
    free: list[tuple[int, int]] = []  # (room, -bin) of open bins, ascending
    for done, i in enumerate(order):
        size = sizes[i]
        k = bisect_left(free, (size, -len(used) - 1))
        if k < len(free):
            room, b = free.pop(k)
            b = -b
        else:
            left = len(sizes) - done - 1  # what comes later are the `left` shortest pieces

            def each(length: int) -> tuple[float, int]:
                room = length - size
                fit = min(left, bisect_left(ascending, room + 1))
                return rule.cost(length) / (size + min(room, below[fit])), length

            length = min(each(x) for x in rule.lengths if x >= size)[1]
            b, room = len(used), length
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if room > size:
            insort(free, (room - size, -b))
    final = [next(x for x in rule.lengths if x >= n) for n in used]
    return bins, offsets, final


def pack(docs: DataFrame, n_tokens: Column, rule: Packing = Packing(), id_col: str = "doc_id") -> DataFrame:
    """One row for each piece: bin_id (long), capacity, bin_used, bin_offset, doc_id, piece, start (its first
    token in the document), length.

    A document of zero or null tokens has no piece. Repeated ids are packed each. An empty table gives no
    rows. Nothing is cut but documents longer than the longest length. docs is read twice, so it should be
    a stored table.
    """
    top = rule.lengths[-1]
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), n_tokens.cast("long").alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    groups = max(1, math.ceil(total / rule.group_tokens))
    pieces = (
        sized.filter("n > 0")
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / top).cast("int"))))
        .select("doc_id", F.col("piece").cast("long").alias("piece"), F.least(F.lit(top).cast("long"), F.col("n") - F.col("piece") * top).alias("length"), F.col("n"))
        .withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "n"), F.lit(groups)))
    )

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by([("group", "ascending"), ("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        group = t["group"].to_numpy()
        edges = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(group)]):
            part = t.slice(a, b - a).combine_chunks()
            sizes = part["length"].to_pylist()
            bins, offsets, final = best_fit(sizes, rule)
            bins = np.array(bins, np.int64)
            capacity = np.array(final, np.int64)
            used = np.bincount(bins, np.array(sizes, float), len(final)).astype(np.int64)
            piece = part["piece"].to_numpy()
            out = {
                "bin_id": (int(group[a]) << 32) + bins,
                "capacity": capacity[bins],
                "bin_used": used[bins],
                "bin_offset": np.array(offsets, np.int64),
                "doc_id": part["doc_id"],
                "piece": piece,
                "start": piece * top,
                "length": part["length"],
            }
            yield from pa.table(out).combine_chunks().to_batches()

    schema = "bin_id long, capacity long, bin_used long, bin_offset long, doc_id long, piece long, start long, length long"
    return pieces.drop("n").repartition(min(groups, 1 << 15), "group").mapInArrow(run, schema)
