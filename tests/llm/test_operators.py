"""Each corpus operator against its brute-force version, with nulls, empty and repeated rows, and empty tables."""

import dataclasses
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate, extract, jaccard, mixing, packing, quality, repeats, shards, tokens, urls
from quillgraph.llm.common import most_frequent, ship
from quillgraph.llm.components import connected_components
from quillgraph.llm.queries import TOKENIZER
from quillgraph.llm.suffix import Memory, suffix_array

DOC = "doc_id long, text string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def corpus(seed: int, n: int = 60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["Über,", "naïve.", "the", "of"]
    base = [[r.choice(words) for _ in range(r.randint(0, 90))] for _ in range(8)]
    out = []
    for i in range(n):
        b = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            if b:
                b[r.randrange(len(b))] = r.choice(words)
        out.append((i, None if i == 3 else "" if i == 4 else " \n" if i == 5 else (" " if i % 7 else "\n").join(b)))
    return out


def frame(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema).repartition(3)


def test_suffix_array_in_memory_and_external():
    r = random.Random(1)
    for _ in range(300):
        t = np.array([r.randint(0, r.choice([1, 3, 9])) for _ in range(r.randint(1, 50))] * r.choice([1, 2]))
        text = t.tolist()
        order = sorted(range(len(text)), key=lambda i: text[i:])
        for memory in (Memory(), Memory(2, 16)):
            got, shared = suffix_array(t, 10, memory)
            assert got.tolist() == order
            for k in range(1, len(order)):
                a, b = text[order[k - 1] :], text[order[k] :]
                same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                assert shared[k] == min(same, 10)
    assert len(suffix_array(np.zeros(0, np.int64), 10)[0]) == 0


def test_suffix_dedup(spark):
    docs = corpus(2) + [(100, "ab" * 150), (101, "x" * 130 + "é" + "x" * 130), (102, "x" * 400)]
    for rule in (repeats.Repeats(), repeats.Repeats(batch=5, shard_bytes=200, memory=Memory(8, 64))):
        got = {r[0]: tuple(r)[1:] for r in repeats.remove_repeats(frame(spark, docs), rule, keep=False).collect()}
        assert got == repeats.brute_force(docs)
    assert repeats.remove_repeats(frame(spark, []), keep=False).count() == 0
    twice = repeats.remove_repeats(frame(spark, [(1, "y" * 50 + "z" * 100)] * 2 + [(None, "q")]), keep=False).collect()
    assert sorted(r["n_removed"] for r in twice) == [0, 1, 150] or sorted(r["n_removed"] for r in twice)[0] == 0


JACCARD_RULES = ({"worth": 0, "stars": 1, "many": 0, "hot": 2, "tile": 4}, {"worth": 1, "stars": 1, "many": 10**9, "hot": 1, "told": 10})


def near_copies(seed, n=160):
    """Variants of a text that is not among them, each with some words changed, so that most pairs fall short."""
    r = random.Random(seed)
    base = [f"b{r.randrange(400)}" for _ in range(70)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            at = r.randrange(len(w))
            w[at : at + r.choice([0, 1, 2])] = [r.choice(["x", "y", f"u{i}"])]
        out.append((1000 + i, " ".join(w)))
    return out


@pytest.mark.parametrize("change", JACCARD_RULES)
def test_jaccard(spark, change):
    rule = dataclasses.replace(jaccard.Similarity(), **change)
    docs = corpus(3, 120) + near_copies(1)
    got = jaccard.similar_components(frame(spark, docs), rule).collect()
    assert sorted(map(tuple, got)) == sorted(jaccard.brute_force(docs))


def test_jaccard_odd_rows(spark):
    assert jaccard.similar_components(frame(spark, [])).count() == 0
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, long), (3, long + " end"), (4, ""), (5, None), (6, " \t")]
    # One id with different texts: links of either text count, whatever the order of rows.
    one, two = ("one two three four five six seven eight nine ten eleven twelve".split(), "p q r s t u v w x y z aa bb cc".split())
    rows += [(10, " ".join(one)), (10, " ".join(two)), (11, " ".join(one[:-1])), (12, " ".join(two[1:])), (13, "none of these at all here")]
    docs = frame(spark, [(*x, "e", 1, "b", 0) for x in rows], "doc_id long, text string, _row string, seq long, fp string, `a.b` long")
    got = sorted(map(tuple, jaccard.similar_components(docs).collect()), key=repr)
    assert got == sorted(jaccard.brute_force(rows), key=repr)
    assert {d: c for d, _, c in got}[12] == 10 and {d: c for d, _, c in got}[3] == 2


def test_most_frequent(spark):
    for counts in ([5] * 50, [200_000 + i for i in range(40)], [1, 2, 3], [], [10**12, 1, 1, 1, 1, 7, 7]):
        table = spark.createDataFrame([(i, c) for i, c in enumerate(counts)], "key long, n long")
        for limit in (0, 1, 3, 6, 45, 100):
            got = [r["n"] for r in most_frequent(table, "key", "n", limit).collect()]
            assert sorted(got, reverse=True) == sorted(counts, reverse=True)[:limit]


def test_components(spark):
    """Chains, cycles, hubs and repeated edges, by one task and by rounds."""
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(200, 201 + i) for i in range(30)] + [(200, 201)] * 3 + [(7, 7), (300, 301)]
    edges += [(400 + r.randrange(60), 400 + r.randrange(60)) for _ in range(40)]
    r.shuffle(edges)
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(len(edges)):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    table = frame(spark, edges, "a long, b long")
    for local in (0, 2_000_000):
        assert {x["node"]: x["component"] for x in connected_components(table, "a", "b", local_edges=local).collect()} == root
    assert connected_components(table.limit(0), "a", "b", local_edges=0).count() == 0


def test_decontamination(spark):
    docs = corpus(4)
    items = [("a", docs[10][1]), ("b", "The OF"), ("c", None), ("d", docs[20][1]), ("e", docs[10][1])]
    got = decontaminate.contaminated(frame(spark, docs), frame(spark, items, "item_id string, text string")).collect()
    assert {r[0]: tuple(r)[1:5] for r in got} == decontaminate.brute_force(docs, items)
    small = decontaminate.contaminated(frame(spark, docs), frame(spark, items, "item_id string, text string"), decontaminate.Containment(block_bytes=1)).collect()
    assert sorted(small) == sorted(got)
    assert not any(r["contaminated"] for r in decontaminate.contaminated(frame(spark, docs), frame(spark, [], "item_id string, text string")).collect())


def test_mixing_base_scores(spark):
    docs = corpus(5)
    want = mixing.brute_force(docs)
    for rule in (mixing.Mixing(slot_bits=12), mixing.Mixing(slot_bits=12, head=20, symbols=10)):
        for r in mixing.score(frame(spark, docs), rule).collect():
            assert tuple(r)[1:5] == want[r["doc_id"]][:4]
            assert abs(r["base_score"] - want[r["doc_id"]][4]) < 1e-6
            assert r["score"] < 0
    assert mixing.score(frame(spark, []), mixing.Mixing(slot_bits=12)).count() == 0


def test_mixing_is_a_function_of_the_table(spark):
    """Scores are the same however the rows are partitioned, with several shards and blocks."""
    docs = corpus(5, 150)
    rule = mixing.Mixing(slot_bits=12, shard_bytes=9000)
    table = spark.createDataFrame(docs, DOC)
    got = [{r["doc_id"]: r["score"] for r in mixing.score(table.repartition(n), rule).collect()} for n in (1, 5)]
    assert got[0].keys() == got[1].keys() and all(abs(got[0][d] - got[1][d]) < 1e-9 for d in got[0])


def test_mixing_blocks_by_shard():
    import pyarrow as pa

    texts = [b"x" * n for n in (5, 2_000_000, 7, 0, 600_000, 600_000, 9, 1)]
    shards = [0, 0, 0, 1, 1, 1, 1, 2]
    whole = [(s, t.to_pylist()) for s, t in mixing._by_shard([pa.record_batch([pa.array(shards), pa.array(texts)], ["shard", "text"])])]
    cut = [pa.record_batch([pa.array(shards[i : i + 3]), pa.array(texts[i : i + 3])], ["shard", "text"]) for i in range(0, 8, 3)]
    assert whole == [(s, t.to_pylist()) for s, t in mixing._by_shard(cut)]
    assert [s for s, _ in whole] == [0, 0, 1, 1, 2] and sum((t for _, t in whole), []) == texts


def test_tokens_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = corpus(6) + [(200, "a  b\t<|endoftext|> it's 12\n\nx"), (202, "a <|endoftext|> b"), (203, "x<|endoftext|>y\n<|endoftext|>\nz  <|endoftext|> w <|endoftext|>"), (201, " lead nbsp ")]
    tokens.write_orc(frame(spark, docs), f"file://{tmp_path}/t", TOKENIZER)
    plain = Tokenizer.from_file(TOKENIZER)
    want = {d: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for d, t in docs}
    assert {r[0]: r[1] for r in tokens.read_orc(spark, f"file://{tmp_path}/t").collect()} == want
    assert [r[0] for r in tokens.read_orc(spark, f"file://{tmp_path}/t", 20, 20).collect()] == [20]
    at = 0
    for r in tokens.token_index(spark, f"file://{tmp_path}/t", lambda df: df).orderBy("doc_id").collect():
        ids = np.array(want[r["doc_id"]], "<u4")
        assert tuple(r) == (r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_packing(spark):
    rule = packing.Packing(lengths=(8, 16, 32), group_tokens=200)
    sizes = [(i, random.Random(i).choice([1, 3, 7, 15, 31, 32, 33, 100])) for i in range(200)] + [(300, 0), (301, None)]
    rows = packing.pack(frame(spark, sizes, "doc_id long, n long"), F.col("n"), rule).collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc[r["doc_id"]] = by_doc.get(r["doc_id"], 0) + r["length"]
        by_bin.setdefault(r["bin_id"], []).append(r)
    assert by_doc == {d: n for d, n in sizes if n}
    for members in by_bin.values():
        at = 0
        for r in sorted(members, key=lambda x: x["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["length"]
        assert members[0]["bin_used"] == at and members[0]["capacity"] == min(x for x in rule.lengths if x >= at)
    assert sum(m[0]["capacity"] for m in by_bin.values()) < 1.15 * sum(by_doc.values())


def test_quality_hosts(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, good + str(i) if i % 2 else good, "ok") for i in range(40)] + [(100 + i, "bad" if i else good, "spam") for i in range(60)] + [(None, None, None)]
    got = {r["doc_id"]: r for r in quality.judge(frame(spark, rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i]["kept"] for i in range(40))
    assert not got[100]["base_failed"] and got[100]["host_rejected"] and not got[100]["kept"]
    assert got[None]["n_words"] == 0 and not got[None]["kept"]
    assert quality.judge(frame(spark, [], "doc_id long, text string, source string")).count() == 0


def test_url_aliases(spark):
    pages = frame(spark, [(1, "http://a.com/en/1"), (2, "http://b.net/x"), (3, "http://example.com/en/7"), (4, None), (5, "nothing"), (6, "https://X.Example.NET/de/80?q#f")], "page_id long, url string")
    edges = frame(spark, [("http://b.net/x", "http://a.com/en/1"), ("http://example.com/en/7", "http://a.com/en/1")], "url_a string, url_b string")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge_urls(pages, edges).collect()}
    assert got[1][2:] == ("com/en/", "block") and got[2][2:] == (None, "block") and got[3][2:] == ("example.com/en/7", "allow")
    assert got[4] == got[5] == ("", "", None, "allow") and got[6] == ("x.example.net", "/de/80", "example.net/de/8", "block")
    html = frame(spark, [("http://a.com/d/x", '<link href="/y" rel="canonical"><meta http-equiv=refresh content="0; url=http://b.org/z">')], "url string, html string")
    assert sorted(r[1] for r in urls.link_edges(html).collect()) == ["http://a.com/y", "http://b.org/z"]
    quiet = [
        '<!-- <link rel=canonical href="/c"> -->', '<script>var x = \'<link rel="canonical" href="/s">\'; dislocation = "/n"; a.location = "/m"</script>',
        '<div data-location="/d" location="/l">location = "/t"</div>', "<noscript><meta http-equiv=refresh content='0;url=/q'></noscript>", None,
    ]
    loud = ['<script type="x">window.location.href = "/w"</script>', '<script>if (a) location="/v"</script>']
    table = frame(spark, [(f"http://h.com/{i}", x) for i, x in enumerate(quiet + loud + loud)] + [(None, loud[0])], "url string, html string")
    assert sorted({r[1] for r in urls.link_edges(table).collect()}) == ["http://h.com/v", "http://h.com/w"]
    assert urls.judge_urls(pages.limit(0), edges).count() == 0
    # A chain, a cycle and a hub: a block at any end reaches all of them but what is allowed.
    chain = [(f"http://c.x/{i}", f"http://c.x/{i + 1}") for i in range(6)] + [("http://c.x/6", "http://c.x/0"), ("http://c.x/3", "http://s.org/es/1")] + [("http://c.x/5", f"http://k.x/{i}") for i in range(9)]
    many = frame(spark, [(i, u) for i, u in enumerate([*(f"http://c.x/{i}#top" for i in range(7)), *(f"http://k.x/{i}" for i in range(9)), "http://else.x/"])] + [(0, "http://c.x/0#top")], "page_id long, url string")
    got = urls.judge_urls(many, frame(spark, chain, "url_a string, url_b string")).collect()
    assert len(got) == 18 and {r["page_id"] for r in got if r["verdict"] == "allow"} == {16}


def test_extraction(spark):
    bar = "welcome to the site of many long and boring menus"
    rows = [(i, f"http://h.org/{i}", f"<body><div>{bar}</div><div>own{i} text{i} of{i} page{i} here{i}<br>more{i}</div></body>") for i in range(9)]
    rows += [(20, "http://h.org/a", "<nav>n</nav><article><h1>T &amp; U</h1><p>one<b>two</b><p>three<aside>no</aside><div class='comments'>no</div></article><footer>f</footer>"), (21, None, None), (22, "x", "")]
    for rule in (extract.Boilerplate(), extract.Boilerplate(batch=3, shard_tokens=4)):
        got = {r["page_id"]: r["text"] for r in extract.main_text(frame(spark, rows, "page_id long, url string, html string"), rule).collect()}
        assert got[4] == "own4 text4 of4 page4 here4 more4"
        assert got[20] == "T & U\n\nonetwo\n\nthree" and got[21] == got[22] == ""


@pytest.mark.parametrize(
    "page, want",
    [
        ('<article><p class="a>hello</p></article>', ["hello"]),
        ("<article><a title=don't href=x>link</a> text it's</article>", ["link text it's"]),
        ('<article><p title="a > b" data-x=\'c > d\'>one</p></article>', ["one"]),
        ("<article>cut <b", ["cut"]),
        ('<article class="post comments-open"><div class="has-sidebar">all<div class="sidebar-left">no</div></div></article>', ["all"]),
        ('<article>x<div class="user-reviews">no</div><div id="adSlot">no</div><div class="article-header"><h1>T</h1></div></article>', ["x", "T"]),
        ('<article>one <span class="ad">no</span> block</article>', ["one block"]),
        ("<main>a long text of its own<article>teaser</article></main>", ["a long text of its own"]),
        ("<main>path<article>the article that it is</article></main>", ["the article that it is"]),
        ("<article>" + "<b>" * 30_000 + "<p>deep</p>" * 3 + "</i>" * 30_000 + "</article>", ["deep"] * 3),
        ("<article>" + "<div>" * 20_000 + "deep" + "</div>" * 20_000 + "</article>", ["deep"]),
    ],
)
def test_page_blocks(page, want):
    from time import process_time

    began = process_time()
    blocks = extract.page_blocks(page)
    assert [t for x, t in blocks if x == extract.main_level(blocks)] == want
    assert process_time() - began < 3


def test_extraction_odd_tables(spark):
    schema = "page_id long, url string, html string, rid string, host string, blocks long, `a.b` long"
    assert extract.main_text(frame(spark, [], schema)).count() == 0
    rows = [(1, "http://h.org/1", "<article>same</article>", "r", "h", 1, 2)] * 3 + [(None, None, "<main>" + "long text " * 50_000 + "</main>", None, None, None, None)]
    got = extract.main_text(frame(spark, rows, schema)).collect()
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in got) == [("1", 4)] * 3 + [("None", 499_999)]


def test_shards(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", shards.Tiers(target_bytes=1 << 20, least_bytes=1 << 10, arrival_rows=5))
    a, b = frame(spark, corpus(8)), frame(spark, [(i + 1000, t) for i, t in corpus(9)])
    assert store.append(a) == 1 and store.append(b) == 2 and store.append(b.limit(0)) == 3
    before, files = sorted(map(tuple, store.read().collect()), key=str), len(store.manifest()["shards"])
    assert store.compact_all() >= 1 and len(store.manifest()["shards"]) < files
    assert sorted(map(tuple, store.read().collect()), key=str) == before
    stale = store.manifest()
    store.append(b)
    with pytest.raises(shards.ConcurrentCommit):
        store._commit(stale, [], stale["schema"])
    assert json.loads(store.manifest()["schema"])["type"] == "struct"
    # Two writers of one version: one commits, the other is told, and its manifest doesn't replace the first.
    from threading import Barrier, Thread

    base, gate, told = store.manifest(), Barrier(4), []

    def commit(k):
        gate.wait()
        try:
            told.append((k, store._commit(base, base["shards"][:k], base["schema"])))
        except shards.ConcurrentCommit:
            told.append((k, None))

    writers = [Thread(target=commit, args=(k,)) for k in range(4)]
    [x.start() for x in writers], [x.join() for x in writers]
    won = [k for k, v in told if v]
    assert len(told) == 4 and len(won) == 1 and len(store.manifest()["shards"]) == len(base["shards"][: won[0]])
