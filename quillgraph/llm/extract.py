"""Main text of HTML pages by markup and a suffix array of each host.

Markup decides where it speaks: menus, headers, footers, asides, forms, adverts, notices and comments are
left out, and where a page has an article (or a main element), its blocks are the text. What is left of
other pages is a stream of tokens. The streams of a host's pages are one string: runs of `run` tokens or
more that are found on several pages and a share of the host's pages are boilerplate; what they cover is
removed, and each block keeps its other runs. Equal streams of a host are one page, so copies of a page do
not remove each other, nor does what two pages quote.

The host's suffix array is dealt by minimizer: every window of `run` tokens belongs to the shard of its
least hashed k-gram and its host, so all occurrences meet there, whatever the number of the host's pages.
A batch sends each different segment once, so boilerplate on every page of a host is few rows, with the
pages' places in them.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize
from quillgraph.llm.kernels import RangeHash, concat_ranges, mix
from quillgraph.llm.repeats import _slide
from quillgraph.llm.suffix import suffix_array

#: Comments, tags and other markup. A quote opens an attribute's value right after = only; where such a value never
#: ends, the tag does at the next >. Markup that the page's end cuts off goes too.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*+)(?:((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>|([^>]*+)(?:>|\Z))"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([A-Za-z:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")

#: Elements by what they do to text.
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
LEFT_OUT = frozenset("head nav footer aside form button select menu dialog iframe noscript template svg canvas object audio video map math".split())
#: Words of class, id or role values that name what is no main text.
MARKS = frozenset(
    "ad ads adv advert advertisement adverts adslot adsense banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar aside comment comments commentlist reply replies respond discussion menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar share sharing social "
    "reviews related recommended newsletter subscribe subscription signup login pagination pager toolbar search widget widgets disclaimer contentinfo complementary".split()
)
#: Words that may stand beside a mark in a name: footer-inner is a footer, comments-open is none.
BESIDE = frozenset("area bar block bottom box col column container global id inner item items left link links list outer page panel reader right row section site slot top unit user wrap wrapper zone".split())
_MARK = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


def _is_mark(name: str) -> bool:
    """Whether a class or id names what is no main text: a mark, with nothing beside it but such words."""
    words = [x.lower() for x in _MARK.split(name) if x]
    return not MARKS.isdisjoint(words) and all(x in MARKS or x in BESIDE for x in words)
ARTICLE, MAIN, OPEN = 3, 2, 1


@dataclass(frozen=True)
class Boilerplate:
    #: Tokens of a repeated run at least.
    run: int = 8
    #: A run is boilerplate on so many different pages of its host, and on such a share of them, at least.
    pages: int = 3
    share: float = 0.1
    gram: int = 4
    #: Segments that a batch gathers before it sends them.
    batch: int = 200_000
    shard_tokens: int = 1 << 20


def _marked(attributes: str) -> tuple[bool, bool]:
    """Whether an element's class, id or role names what is no main text, and whether its role is main."""
    bad = main = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "aria-label"):
            bad |= name != "aria-label" and any(_is_mark(x) for x in value.split())
            main |= name == "role" and value.lower() == "main"
        elif name == "itemprop":
            main |= value.lower() == "articlebody"
        elif name == "hidden":
            bad = True
    return bad, main


def page_blocks(page: str | None) -> list[tuple[int, str]]:
    """Blocks of text in page order, each with where it stands (ARTICLE, MAIN or OPEN); those that the markup
    leaves out are not among them. Null is the empty page. Anything is accepted as HTML."""
    page = page or ""
    blocks: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # tag, left out, level
    opened: Counter[str] = Counter()  # tags on the stack
    places: list[int] = []  # of block elements on the stack

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        if places and places[-1] == len(stack):
            places.pop()
        return tag

    def flush():
        if text:
            joined = _SPACE.sub(" ", html_lib.unescape("".join(text))).strip()
            if joined:
                blocks.append((level, joined))
            text.clear()

    level, out, at = OPEN, False, 0
    raw_end = -1
    for m in _TAG.finditer(page):
        if m.start() < raw_end:
            at = max(at, m.end())
            continue
        if m.start() > at and not out:
            text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if not opened[tag]:
                if tag in BLOCK:
                    flush()
                continue
            ended = [pop()]
            while ended[-1] != tag:
                ended.append(pop())
            if not BLOCK.isdisjoint(ended):
                flush()
        else:
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                raw_end = close.start() if close else len(page)
                at = raw_end
                continue
            if tag == "br":
                text.append(" ")
                continue
            if tag in BLOCK:
                flush()
                # An open p, or an open item of the same list, ends here.
                if places and (stack[places[-1]][0] == "p" or stack[places[-1]][0] == tag == "li"):
                    for _ in range(len(stack) - places[-1]):
                        pop()
                if tag == "body":
                    while opened["head"]:
                        pop()
            attributes = m[3] if m[3] is not None else m[4]
            if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
                continue
            before = stack[-1] if stack else ("", False, OPEN)
            bad, main = _marked(attributes) if "=" in attributes or "hidden" in attributes else (False, False)
            if tag in ("html", "body"):
                bad = False
            bad |= tag in LEFT_OUT or tag == "header" and before[2] == OPEN
            place = ARTICLE if tag == "article" or main and "itemprop" in attributes else MAIN if tag == "main" or main else OPEN
            if tag in BLOCK:
                places.append(len(stack))
            opened[tag] += 1
            stack.append((tag, before[1] or bad, max(before[2], place)))
        after = stack[-1] if stack else ("", False, OPEN)
        # An inline element that is left out doesn't end the block that it stands in.
        if after[2] != level or after[1] != out and tag in BLOCK:
            flush()
        out, level = after[1], after[2]
    if not out and at < len(page):
        text.append(page[at:])
    flush()
    return blocks


def main_level(blocks: list[tuple[int, str]]) -> int:
    """The level that is the page's main text: of articles and what else a main element holds the longer one (so teasers of
    other articles lose to a text), else what is open; 0 without blocks."""
    held = Counter()
    for level, text in blocks:
        held[level] += len(text)
    if held[ARTICLE] and held[ARTICLE] >= held[MAIN]:
        return ARTICLE
    return MAIN if held[MAIN] else max(held, default=0)


_PARSED = "rid long, page_id {id}, url string, host string, level int, blocks array<string>, open array<string>"


def _parse(batches) -> Iterator[pa.RecordBatch]:
    """The blocks of the highest level of each page, and its open blocks."""
    for batch in batches:
        for rows in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            levels, kept, left = [], [], []
            for page in rows.column(4).to_pylist():
                found = page_blocks(page)
                best = main_level(found)
                levels.append(best)
                kept.append([t for x, t in found if x == best] if best > OPEN else [])
                left.append([t for x, t in found if x == OPEN])
            yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(levels, pa.int32()), pa.array(kept, pa.list_(pa.string())), pa.array(left, pa.list_(pa.string()))], ["rid", "page_id", "url", "host", "level", "blocks", "open"])


_SEGMENT = "key long, need long, tokens array<long>, pages array<long>, starts array<int>"
_RUN = "page long, start int, windows int"


def _token_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _deal(rule: Boilerplate):
    """Segments of the different pages' open token streams by minimizer and host. A batch sends a segment once,
    with the places where it is found and the number of pages that make a run of its host boilerplate."""
    width = rule.run - rule.gram + 1

    def send(held: dict) -> Iterator[pa.RecordBatch]:
        columns = zip(*((key, need, tokens.view(np.int64), [p for p, _ in places], [x for _, x in places]) for (key, _), (tokens, need, places) in held.items()))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds)], ["key", "need", "tokens", "pages", "starts"])

    def run(batches):
        held: dict = {}
        n = 0
        for batch in batches:
            for page, host, blocks, need in zip(*(batch.column(i).to_pylist() for i in range(4))):
                tokens = _token_hashes([w for b in blocks for w in b.split(" ")])
                if len(tokens) < rule.run:
                    continue
                least = _slide(RangeHash(tokens).all(rule.gram), width, np.minimum)
                begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
                end = np.append(begin[1:], len(least))
                salt = _token_hashes([host or ""])
                keys = mix(least[begin] ^ salt).view(np.int64).tolist()
                for key, a, b in zip(keys, begin.tolist(), end.tolist()):
                    part = tokens[a : b + rule.run - 1]
                    held.setdefault((key, part.tobytes()), (part, need, []))[2].append((page, a))
                    n += 1
                if n >= rule.batch:
                    yield from send(held)
                    held, n = {}, 0
        if held:
            yield from send(held)

    return run


def _sort(rule: Boilerplate):
    """Rows sorted by key. The suffix array of some keys' segments: windows of `run` tokens that stand on as
    many different pages of the host as make them boilerplate."""

    def settle(rows: list) -> Iterator[pa.RecordBatch]:
        size = np.array([len(r[2]) + 1 for r in rows])
        flat = np.concatenate([np.append(np.array(r[2], np.int64), 0) for r in rows])
        ends = np.cumsum(size)
        begin = ends - size
        value, symbol = np.unique(flat, return_inverse=True)
        symbol = symbol + 1
        symbol[ends - 1] = 0
        order, shared = suffix_array(symbol, rule.run)
        group = np.cumsum(shared < rule.run)
        segment = np.searchsorted(begin, order, "right") - 1
        whole = order + rule.run <= ends[segment] - 1
        group, segment, order = group[whole], segment[whole], order[whole]
        # Hosts with the same words have different keys, and are kept apart.
        key = np.unique(np.array([r[0] for r in rows]), return_inverse=True)[1]
        group = np.unique(group * (len(rows) + 1) + key[segment], return_inverse=True)[1]
        # The pages of each window's segments; a page counts once.
        count = np.array([len(r[3]) for r in rows])
        place = concat_ranges((np.cumsum(count) - count)[segment], count[segment])
        page = np.concatenate([np.array(r[3], np.int64) for r in rows])[place]
        start = np.concatenate([np.array(r[4], np.int64) for r in rows])[place] + np.repeat(order - begin[segment], count[segment])
        need = np.array([r[1] for r in rows])[np.repeat(segment, count[segment])]
        group = np.repeat(group, count[segment])
        by = np.lexsort((page, group))
        new = np.ones(len(by), bool)
        new[1:] = (group[by][1:] != group[by][:-1]) | (page[by][1:] != page[by][:-1])
        often = np.bincount(group[by][new])[group] >= need if len(group) else np.zeros(0, bool)
        if often.any():
            n = int(often.sum())
            yield pa.RecordBatch.from_arrays([pa.array(page[often]), pa.array(start[often].astype(np.int32)), pa.array(np.ones(n, np.int32))], ["page", "start", "windows"])

    def run(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if row[0] != last and size >= rule.shard_tokens:
                    yield from settle(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2]) + len(row[3])
                last = row[0]
        if rows:
            yield from settle(rows)

    return run


def _unique_runs(rule: Boilerplate):
    def run(batches):
        for batch in batches:
            kept = []
            for blocks, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = [b.split(" ") for b in blocks]
                gone = np.zeros(sum(map(len, words)), bool)
                for r in runs or ():
                    gone[r["start"] : r["start"] + r["windows"] + rule.run - 1] = True
                at, out = 0, []
                for w in words:
                    rest = [x for x, g in zip(w, gone[at : at + len(w)].tolist()) if not g]
                    at += len(w)
                    if rest:
                        out.append(" ".join(rest))
                kept.append(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.list_(pa.string()))], ["rid", "blocks"])

    return run


def main_text(pages: DataFrame, rule: Boilerplate = Boilerplate(), id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row.

    Character references are decoded, white space within a block is one space, blocks are joined by two line
    feeds. Null and empty pages, and pages without text of their own, have the empty text. A null url is a host
    of its own. Repeated rows, and open pages of a host with the same words, count as one page, and each has its
    text. A host of fewer different pages than `pages` has no boilerplate. An empty table gives no rows. Other columns are not used.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://([^/?#]*)", 1))
    thin = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.col(html).alias("html"))
    parsed = materialize(thin.mapInArrow(_parse, _PARSED.format(id=thin.schema["page_id"].dataType.simpleString())), "parsed")
    parsed = parsed.withColumn("page", F.xxhash64("host", F.array_join("open", " ")))
    streams = materialize(parsed.filter(F.size("open") > 0).select("page", "host", "open").dropDuplicates(["page"]), "streams")
    need = F.greatest(F.lit(rule.pages), F.ceil(F.count(F.lit(1)) * rule.share)).cast("long").alias("need")
    dealt = streams.join(streams.groupBy("host").agg(need), "host").select("page", "host", "open", "need").mapInArrow(_deal(rule), _SEGMENT)
    sorted_ = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_sort(rule), _RUN)
    runs = sorted_.groupBy("page").agg(F.collect_set(F.struct("start", "windows")).alias("runs"))
    # Pages without an article: what is unique on their host. The others need no join.
    without = parsed.filter((F.col("level") <= OPEN) & (F.size("open") > 0))
    unique = without.select("page", "rid", "open").join(runs, "page", "left").select("rid", "open", "runs").mapInArrow(_unique_runs(rule), "rid long, blocks array<string>")
    columns = ["page_id", "url", "blocks"]
    decided = parsed.filter((F.col("level") > OPEN) | (F.size("open") == 0)).select(*columns)
    found = decided.unionByName(without.drop("blocks").join(unique, "rid").select(*columns))
    text = F.array_join("blocks", "\n\n")
    return found.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
