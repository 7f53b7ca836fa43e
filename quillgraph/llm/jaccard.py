"""Exact n-gram Jaccard join by adaptive multi-match prefixes, down to connected components.

A document is the set of its word shingles. All sets are ordered by the same total order, rare shingles
first. If two sets are similar enough, their l-prefixes (the first n - ceil(t n) + l shingles) share at
least l shingles, for every l up to ceil(t n). Each document takes the l that suits what its prefix would
cost: where the shingles of its prefix are frequent it is lengthened, and a pair then has to share as many
prefix shingles as the smaller of its two l before it is verified on the whole texts.

Copies and near copies make groups in which every pair shares prefix shingles. No pair list of a group is made:
equal sets are one class; then candidates of a shingle are compared with one of them (a star), links
merge components, and so on with another star; at last pairs between documents that are still in
different components are compared. There a frequent (hot) shingle lists only pairs that share no colder
prefix shingle, and those need enough hot ones: variants of one text that differ too much have too few,
so most of their pairs are never listed. Candidates whose prefixes share enough are verified on their whole
sets, each exactly. Pairs within a component need no check, as the result is the components, so no
link between components is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.common import delete, materialize, most_frequent, scratch
from quillgraph.llm.components import connected_components
from quillgraph.llm.kernels import NOT_SPACE, blocks, concat_ranges, mix
from quillgraph.llm.repeats import with_order


@dataclass(frozen=True)
class Similarity:
    words: int = 5
    percent: int = 80
    #: Partners that a prefix must be expected to save for each shingle that lengthens it.
    worth: int = 64
    #: A shingle is counted where a batch of documents has it so often. Counts only order shingles.
    often: int = 2
    #: So many of the most frequent shingles are told to all tasks (16 bytes each).
    told: int = 1 << 20
    #: Prefix entries of a shingle from which it is hot: a pair that shares colder ones is found by those.
    hot: int = 64
    #: Prefix entries of a shingle that one task compares at a time; more are dealt into tiles.
    tile: int = 1 << 14
    #: Star rounds before all pairs between components are compared, if those are still many: more than
    #: `many` for each prefix entry.
    stars: int = 2
    many: int = 4

    def need(self, n):
        """Least overlap of a set of n with any similar set."""
        return (self.percent * n + 99) // 100

    def overlap(self, both):
        """Least overlap of two similar sets with so many shingles together."""
        return -((-self.percent * both) // (100 + self.percent))


def _sets(block, rule: Similarity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document (in the block) and hash of each shingle, sorted, each once; the sets' sizes."""
    w = block.words(NOT_SPACE)
    at, h = w.shingles(rule.words)
    doc = np.searchsorted(w.bounds, at, "right") - 1
    few = np.flatnonzero((w.counts > 0) & (w.counts < rule.words))
    if len(few):
        # A sequence shorter than a shingle is one; its length is part of the hash.
        short = mix(w.ranges.of(w.bounds[few], w.bounds[few + 1]) + w.counts[few].astype(np.uint64))
        doc, h = np.concatenate([doc, few]), np.concatenate([h, short])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    return doc, h, np.bincount(doc, minlength=len(block.rows))


def _prints(doc, h, n) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    ends = np.concatenate([[0], np.cumsum(n)])

    def sums(v):
        total = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(v, out=total[1:])
        return np.diff(total[ends])

    return sums(mix(h)).view(np.int64), sums(mix(h ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)


_PROFILE = "kind byte, seq long, id long, n long, fp long, fp2 long"


def _profile(rule: Similarity):
    """kind 0: a document's place, id, set size and fingerprints. kind 1: a shingle (seq) and how many documents
    of some blocks have it (n), if often."""

    def run(batches):
        def rows(kind, a, i, n, b, c):
            as_array = lambda x: x if isinstance(x, pa.Array) else pa.array(x)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), as_array(a), as_array(i), pa.array(n.astype(np.int64)), pa.array(b), pa.array(c)], ["kind", "seq", "id", "n", "fp", "fp2"])

        held, size = [], 0

        def flush():
            h = np.sort(np.concatenate(held))
            begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            count = np.diff(np.append(begin, len(h)))
            much = count >= rule.often
            zero = np.zeros(int(much.sum()), np.int64)
            return rows(1, h[begin[much]].view(np.int64), zero, count[much], zero, zero)

        for batch in batches:
            for block in blocks(batch.column(2)) if batch.num_rows else ():
                doc, h, n = _sets(block, rule)
                take = pa.array(block.rows)
                yield rows(0, batch.column(0).take(take), batch.column(1).take(take), n, *_prints(doc, h, n))
                held.append(h)
                size += len(h)
                if size >= 4_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


#: size_pos: set size << 32 | place in the set's order. Salt 0: the shingle is not dealt by salt.
_PREFIX = "token long, salt int, doc long, fp long, size_pos long, ell int"


def _lengths(often: np.ndarray, n: np.ndarray, rule: Similarity) -> np.ndarray:
    """l of each set: where the partners that are expected to share l shingles of its prefix (those of all its
    shingles, by l) and what l more shingles cost are least together; need(n) at most."""
    ell = np.minimum(n, 1)
    begin = np.cumsum(n) - n
    total = np.concatenate([[0], np.cumsum(np.maximum(often - 1, 0))])
    need = rule.need(n)
    base = n - need
    # Up to 2 * worth partners no longer prefix can be worth it.
    many = np.flatnonzero((n > 0) & (total[begin + np.where(n > 0, base + 1, 0)] - total[begin] > 2 * rule.worth))
    if len(many):
        count = need[many]
        own = np.repeat(np.arange(len(many)), count)
        longer = concat_ranges(np.ones(len(many), np.int64), count)
        first = begin[many][own]
        cost = (total[first + base[many][own] + longer] - total[first]) / longer + rule.worth * longer
        starts = np.cumsum(count) - count
        least = np.minimum.reduceat(cost, starts)
        at = np.flatnonzero(cost == least[own])
        ell[many] = longer[at[np.concatenate([[True], own[at][1:] != own[at][:-1]])]]
    return ell


def _prefixes(rule: Similarity, frequent):
    """The prefix entries of each different set of some blocks."""

    def run(batches):
        known, counts = frequent.value
        bitmap = np.zeros(1 << 22, bool)
        bitmap[(known & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        sent: set[int] = set()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column(0)
            for block in blocks(batch.column(1)):
                doc, h, n = _sets(block, rule)
                fp = _prints(doc, h, n)[0]
                often = np.zeros(len(h), np.int64)
                if len(known):
                    near = np.flatnonzero(bitmap[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
                    slot = np.minimum(np.searchsorted(known, h[near]), len(known) - 1)
                    hit = known[slot] == h[near]
                    often[near[hit]] = counts[slot[hit]]
                    order = np.lexsort((h, often, doc))
                    h, often = h[order], often[order]
                begin = np.cumsum(n) - n
                ell = _lengths(often, n, rule)
                size = np.where(n > 0, n - rule.need(n) + ell, 0)
                # One entry list for each different set of this task is enough: the others are of its class.
                fresh = np.zeros(len(n), bool)
                for i, f in enumerate(fp.tolist()):
                    if n[i] and f not in sent:
                        sent.add(f)
                        fresh[i] = True
                if len(sent) > 2_000_000:
                    sent.clear()
                size = np.where(fresh, size, 0)
                which = concat_ranges(begin, size)
                own = np.repeat(np.arange(len(n)), size)
                if not len(which):
                    continue
                salts = -(-often[which] // rule.tile)
                salt = np.where(salts > 1, 1 + (fp[own].view(np.uint64) % np.maximum(salts, 1).astype(np.uint64)).astype(np.int64), 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[which].view(np.int64)),
                        pa.array(salt.astype(np.int32)),
                        ids.take(pa.array(block.rows[own])),
                        pa.array(fp[own]),
                        pa.array(n[own].astype(np.int64) << 32 | which - begin[own]),
                        pa.array(ell[own].astype(np.int32)),
                    ],
                    [x.split()[0] for x in _PREFIX.split(", ")],
                )

    return run


def _held(batches) -> list[np.ndarray] | None:
    """The columns of a partition's rows. A partition has whole tiles, so a shingle brings rows for one tile at most
    unless it is among the less frequent of all: then it has fewer than all shingles / `told`."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return None
    t = pa.Table.from_batches(got)
    return [t[c].to_numpy() for c in t.column_names]


def _possible(n, pos, place, i, j, rule: Similarity) -> np.ndarray:
    """Length and position: whether entries i and j of one shingle can be of similar sets. What both share up to
    this shingle is at most the smaller place; what they share after it is at most the smaller rest."""
    a, b = n[i], n[j]
    bound = np.minimum(place[i], place[j]) + np.minimum(a - pos[i], b - pos[j]) - 1
    return (np.minimum(a, b) * 100 >= np.maximum(a, b) * rule.percent) & (bound >= rule.overlap(a + b))


_PAIRS = "a long, b long, least int"


def _least(n, ell, i, j, rule: Similarity) -> np.ndarray:
    """The fewest shingles that two prefixes must share: as many as the smaller l; and what both share beyond the
    prefix that ends first is at most the rest of its set, so the prefixes must share what then is missing
    to a sufficient overlap."""
    rest = np.maximum(rule.need(n[i]) - ell[i], rule.need(n[j]) - ell[j])
    return np.maximum(np.minimum(ell[i], ell[j]), rule.overlap(n[i] + n[j]) - rest)


def _pair_rows(doc, least, i, j) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, with what its prefixes must share."""
    a, b = np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])
    order = np.lexsort((b, a))
    a, b, least = a[order], b[order], least[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new], least[new].astype(np.int32)


def _star(group, doc, component, seed: int):
    """Each entry with the first of its group: by id in round 0, by a hash of id and round later."""
    score = doc if seed == 0 else mix(doc.view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    order = np.lexsort((score, group))
    t = group[order]
    begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    size = np.diff(np.append(begin, len(t)))
    pivot = order[np.repeat(begin, size)]
    use = (component[pivot] != component[order]) & (pivot != order)
    return pivot[use], order[use]


_SHARED = "kind byte, a long, b long, n int, pos int, ell int, hot boolean"


def _shared(rule: Similarity):
    """Of some shingles' prefix entries: those of shingles that different sets have (kind 0: a is the shingle),
    and the first star's pairs (kind 1, ell: what their prefixes must share)."""

    def rows(kind, a, b, n, pos, ell, hot):
        k = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int8)), pa.array(a), pa.array(b), *(pa.array(x.astype(np.int32)) for x in (n, pos, ell)), pa.array(hot)], [x.split()[0] for x in _SHARED.split(", ")])

    def run(batches):
        got = _held(batches)
        if got is None:
            return
        order = np.lexsort((got[2], got[3], got[1], got[0]))
        token, salt, doc, fp, size_pos, ell = (x[order] for x in got)
        turn = np.ones(len(token), bool)
        turn[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
        first = turn.copy()
        first[1:] |= fp[1:] != fp[:-1]
        token, salt, doc, size_pos, ell, turn = (x[first] for x in (token, salt, doc, size_pos, ell, turn))
        group = np.cumsum(turn) - 1
        size = np.bincount(group)[group]
        several = (size > 1) | (salt > 0)
        token, salt, doc, size_pos, ell, group, size = (x[several] for x in (token, salt, doc, size_pos, ell, group, size))
        if not len(token):
            return
        n, pos, ell = size_pos >> 32, size_pos & 0xFFFFFFFF, ell.astype(np.int64)
        yield rows(0, token, doc, n, pos, ell, (size > rule.hot) | (salt > 0))
        i, j = _star(group, doc, doc, 0)
        ok = _possible(n, pos, pos + 1, i, j, rule)
        i, j = i[ok], j[ok]
        if len(i):
            a, b, least = _pair_rows(doc, _least(n, ell, i, j, rule), i, j)
            zero = np.zeros(len(a), np.int32)
            yield rows(1, a, b, zero, zero, least, np.zeros(len(a), bool))

    return run


_PLACED = ("token", "cell", "side", "doc", "n", "ell", "pos", "hot", "component", "place", "met")


def _across(rule: Similarity, seed: int | None):
    """Candidate pairs of some shingles' tiles between components: of a star, or all (seed None).

    place, met: how many of the document's prefix shingles up to this one, and in all, other documents have; of a
    hot shingle only the hot ones are counted, as a pair that shares a colder one is found by that. Of a hot
    shingle a pair is a candidate only once as many hot ones have passed as the pair must share."""

    def passing(n, ell, pos, hot, place, met, doc, component, side, i, j):
        ok = (component[i] != component[j]) & ((side[i] != side[j]) | (side[i] < 0))
        i, j = i[ok], j[ok]
        ok = _possible(n, pos, place, i, j, rule)
        i, j = i[ok], j[ok]
        least = _least(n, ell, i, j, rule)
        ok = (np.minimum(met[i], met[j]) >= least) & (~hot[i] | (np.minimum(place[i], place[j]) >= least))
        return i[ok], j[ok], least[ok]

    def run(batches):
        got = _held(batches)
        if got is None:
            return
        order = np.lexsort((got[8], got[1], got[0]))
        token, cell, side, doc, n, ell, pos, hot, component, place, met = (x[order] for x in got)
        n, ell, pos = n.astype(np.int64), ell.astype(np.int64), pos.astype(np.int64)
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])
        group = np.cumsum(new) - 1
        part_new = new.copy()
        part_new[1:] |= component[1:] != component[:-1]
        part = np.flatnonzero(part_new)
        part_size = np.diff(np.append(part, len(token)))
        several = np.bincount(group[part])[group] > 1
        # The largest component of a group starts no pairs, so that its own are never listed.
        largest = np.zeros(group[-1] + 1, np.int64)
        np.maximum.at(largest, group[part], part_size)
        at = np.flatnonzero(part_size == largest[group[part]])
        only = np.zeros(len(part), bool)
        only[at[np.concatenate([[True], group[part[at]][1:] != group[part[at]][:-1]])]] = True
        last = np.repeat(only, part_size)
        order = np.lexsort((n, last, group))
        order = order[several[order]]
        if not len(order):
            return
        doc, n, ell, pos, hot, component, place, met, side, group, last = (x[order] for x in (doc, n, ell, pos, hot, component, place, met, side, group, last))
        if seed is not None:
            spans = [_star(group, doc, component, seed)]
        else:
            # Sizes of partners that an entry can have at all: a range of its group's entries in order of size.
            key = (group.astype(np.int64) * 2 + last) << 32 | n
            most = np.minimum(n * 100 // rule.percent, (100 + rule.percent) * (place + n - pos - 1) // rule.percent - n)
            start, own = np.flatnonzero(~last), group.astype(np.int64) * 2 << 32
            end = np.searchsorted(key, own[start] | np.maximum(most[start], 0), "right")
            other = own[start] | np.int64(1) << 32
            begin2 = np.searchsorted(key, other | rule.need(n[start]), "left")
            end2 = np.searchsorted(key, other | np.maximum(most[start], 0), "right")
            starts = np.concatenate([start, start])
            first = np.concatenate([start + 1, begin2])
            count = np.maximum(np.concatenate([end - start - 1, end2 - begin2]), 0)
            keep = count > 0
            starts, first, count = starts[keep], first[keep], count[keep]
            edges = np.unique(np.searchsorted(np.cumsum(count), np.arange(0, int(count.sum()) + 1_000_000, 1_000_000), "left"))
            edges = np.unique(np.concatenate([[0], edges, [len(starts)]])) if len(starts) else []
            spans = ((np.repeat(starts[a:b], count[a:b]), concat_ranges(first[a:b], count[a:b])) for a, b in zip(edges[:-1], edges[1:]))
        for i, j in spans:
            i, j, least = passing(n, ell, pos, hot, place, met, doc, component, side, i, j)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _pair_rows(doc, least, i, j)], ["a", "b", "least"])

    return run


def _set_rows(rule: Similarity):
    """(doc, text) to (doc, its shingles)."""

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(1)) if batch.num_rows else ():
                _, h, n = _sets(block, rule)
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(block.rows)), pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64)))], ["doc", "tokens"])

    return run


def _with_both(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """pairs with `both`: how many of the tokens of a and b are the same, and `sizes`."""
    one, two = (tokens.select(F.col("doc").alias(x), F.col("tokens").alias(f"_{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").select(*pairs.columns, F.size(F.array_intersect("_a", "_b")).alias("both"), (F.size("_a") + F.size("_b")).alias("sizes"))


def _links(pairs: DataFrame, prefixes: DataFrame, texts: DataFrame, rule: Similarity) -> DataFrame:
    """The pairs (a, b, least) whose prefixes share enough shingles and which are similar, exactly. Only the sets of
    documents in pairs of the first kind are made."""
    enough = materialize(_with_both(pairs.distinct(), prefixes).filter("both >= least").select("a", "b"), "pairs")
    wanted = enough.select(F.col("a").alias("doc")).union(enough.select("b")).distinct()
    sets = materialize(texts.join(wanted, "doc", "left_semi").select("doc", "text").mapInArrow(_set_rows(rule), "doc long, tokens array<long>"), "sets")
    return materialize(_with_both(enough, sets).filter(F.col("both") * (100 + rule.percent) >= F.col("sizes") * rule.percent).select("a", "b"), "links")


def _frequent(profile: DataFrame, rule: Similarity):
    """The most frequent shingles, ascending, and their counts: at most `told` of them, to be broadcast.
    Which ones these are changes the order of shingles, so the work, not the result."""
    counts = materialize(profile.filter("kind = 1").groupBy("seq").agg(F.sum("n").alias("n")), "frequent")
    rows = most_frequent(counts, "seq", "n", rule.told).toArrow()
    key = rows["seq"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], rows["n"].to_numpy()[order]


def _tiled(placed: DataFrame, sizes: DataFrame, rule: Similarity, cross: bool) -> DataFrame:
    """Entries with cell and side. A shingle of up to `tile` entries is one cell. A larger one's entries are dealt into
    t tiles; for a star each tile is a cell, for all pairs each two tiles are one (and each tile with itself),
    so that a cell has 2 * tile entries or so and every pair meets in just one."""
    big = sizes.filter(F.col("s") > rule.tile).select("token", F.ceil(F.col("s") / rule.tile).cast("int").alias("tiles"))
    dealt = placed.join(big, "token", "left").withColumn("own", F.when(F.col("tiles").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc"), F.col("tiles"))).cast("int"))
    if not cross:
        return dealt.withColumns({"cell": F.col("own").cast("long"), "side": F.lit(-1)}).select(*_PLACED)
    k, own = F.col("k"), F.col("own")
    met = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tiles"), F.lit(1)) - 1)))
    cell = F.least(k, own).cast("long") * (1 << 31) + F.greatest(k, own)
    return met.withColumns({"cell": cell, "side": F.when(k == own, -1).when(own < k, 0).otherwise(1)}).select(*_PLACED)


def similar_components(docs: DataFrame, rule: Similarity = Similarity(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row.

    Null, empty and blank texts have no shingles and no links; fewer words than a shingle are one. Equal texts
    are linked. Rows that share an id are one node with the links of all of them, each with its own n_shingles. A row
    with a null id is linked with nothing and has a null component. An empty table gives no rows. Other
    columns are not used, whatever their names. Shingles are compared by 64-bit hash.
    """
    with scratch() as made:
        found = materialize(_components(docs, rule, id_col, text), "similar", keep=True)
    for path in made:
        delete(docs.sparkSession, path)
    return found


def _components(docs: DataFrame, rule: Similarity, id_col: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    thin = with_order(given, "doc_id", "text").select(F.col("seq").alias("doc"), "id", "text")  # a different doc in each row, ascending with the id
    profile = materialize(thin.select("doc", "id", "text").mapInArrow(_profile(rule), _PROFILE), "profile")
    nodes = profile.filter("kind = 0").select(F.col("seq").alias("doc"), "id", "n", "fp", "fp2")
    classes = materialize(nodes.filter("n > 0 and id is not null").groupBy("fp", "fp2", "n").agg(F.min("doc").alias("a"), F.count(F.lit(1)).alias("members")).filter("members > 1"), "classes")
    copies = nodes.filter("id is not null").join(classes, ["fp", "fp2", "n"]).filter("doc > a").select("a", F.col("doc").alias("b"))
    repeated = nodes.filter("id <> doc").select("id").distinct()  # none, unless rows had to be numbered
    same_id = nodes.join(repeated, "id", "left_semi").groupBy("id").agg(F.min("doc").alias("a")).join(nodes, "id").filter("doc > a").select("a", F.col("doc").alias("b"))

    frequent = spark.sparkContext.broadcast(_frequent(profile, rule))
    entries = thin.filter("id is not null").select("doc", "text").mapInArrow(_prefixes(rule, frequent), _PREFIX).repartition("token", "salt")
    shared = materialize(entries.mapInArrow(_shared(rule), _SHARED), "shared")
    prefix = shared.filter("kind = 0").select(F.col("a").alias("token"), F.col("b").alias("doc"), "n", "pos", "ell", "hot")
    own = Window.partitionBy("doc")  # a document's prefix
    so_far = own.orderBy("pos")
    hot = F.col("hot").cast("int")
    counted = lambda over: F.when(F.col("hot"), F.sum(hot).over(over)).otherwise(F.count(F.lit(1)).over(over)).cast("long")
    ranked = materialize(prefix.withColumn("place", counted(so_far)).withColumn("met", counted(own)), "ranked")
    prefixes = materialize(ranked.groupBy("doc").agg(F.collect_list("token").alias("tokens")), "prefixes")
    texts = materialize(thin.join(prefixes.select("doc"), "doc", "left_semi").select("doc", "text"), "texts")

    first = _links(shared.filter("kind = 1").select("a", "b", F.col("ell").alias("least")), prefixes, texts, rule)
    links = materialize(first.unionByName(copies).unionByName(same_id), "links")
    entries_n = ranked.count()
    for seed in range(1, rule.stars + 2):
        found = materialize(connected_components(links, "a", "b"), "components")
        placed = materialize(ranked.join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc")), "placed")
        parts = placed.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"))
        sizes = materialize(parts.groupBy("token").agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("q")).filter("s * s > q"), "sizes")
        across = sizes.agg(F.sum(F.col("s").cast("double") * F.col("s") - F.col("q"))).first()[0] or 0
        if across == 0:
            break
        last = across / 2 <= rule.many * entries_n or seed == rule.stars + 1
        cells = _tiled(placed.join(sizes.select("token"), "token", "left_semi"), sizes, rule, last).repartition("token", "cell")
        pairs = cells.mapInArrow(_across(rule, None if last else seed), _PAIRS)
        links = materialize(links.unionByName(_links(pairs, prefixes, texts, rule)), "links")
        if last:
            found = materialize(connected_components(links, "a", "b"), "components")
            break
    # A component's least doc has its least id.
    least = found.withColumnRenamed("node", "doc")
    ids = least.select(F.col("component").alias("doc")).distinct().join(nodes.select("doc", F.col("id").alias("component_id")), "doc").withColumnRenamed("doc", "component")
    member = least.join(ids, "component").select("doc", "component_id")
    return nodes.join(member, "doc", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def brute_force(docs: list[tuple[int | None, str | None]], words: int = 5, percent: int = 80) -> list[tuple[int | None, int, int | None]]:
    """The definition over all pairs of rows, for tests: id, n_shingles and component_id of each row, in their order."""
    import re

    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    rows = [(d, s) for (d, _), s in zip(docs, sets) if d is not None and s]
    for i, (x, one) in enumerate(rows):
        for y, two in rows[i + 1 :]:
            if 100 * len(one & two) >= percent * len(one | two):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return [(d, len(s), None if d is None else find(d)) for (d, _), s in zip(docs, sets)]
