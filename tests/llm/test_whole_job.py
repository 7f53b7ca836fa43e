"""Cases in which an operator once did less than its whole job."""

import random

import pytest

from quillgraph.llm import extract, mixing, repeats
from quillgraph.llm.common import ship

DOC = "doc_id long, text string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def test_suffix_dedup_periods(spark):
    """Periods about the 69 k-grams of a window, at the start, in the middle and at the end of a block."""
    r = random.Random(7)
    line = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    texts = []
    for period in range(67, 72):
        for before, after in ((0, 0), (0, 300), (300, 0), (300, 300)):
            texts.append(line(before) + line(period) * 4 + line(after))
    rows = list(enumerate(texts))
    alone = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), DOC)
    for docs in (alone, alone.coalesce(1)):
        got = {x[0]: tuple(x)[1:] for x in repeats.remove_repeats(docs, keep=False).collect()}
        assert got == repeats.brute_force(rows)


def test_mixing_learns_from_the_previous_word(spark):
    """Words that end alike are followed by different words: only the previous word itself tells which."""
    r = random.Random(3)
    stems = [a + b + c for a in "bcdfghklmn" for b in "aeiou" for c in "lmnrst"]
    pairs = [(x + "ing", y + "ed") for x, y in zip(stems, r.sample(stems, len(stems)))]
    texts = [" ".join(w for p in r.choices(pairs, k=200) for w in p) for _ in range(250)]
    mixed = [" ".join(w for p in r.choices(pairs, k=200) for w in (p[0], r.choice(pairs)[1])) for _ in range(10)]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate(mixed)], DOC)
    got = [(x["doc_id"], x["held_out"], x["bits_per_byte"]) for x in mixing.score(rows, mixing.Mixing(slot_bits=16)).collect()]
    alike = [b for d, held, b in got if held and d < 1000]
    other = [b for d, held, b in got if d >= 1000]
    assert alike and sum(alike) / len(alike) < 0.8 * sum(other) / len(other)


def extraction_brute_force(rows, rule):
    """page_id -> text of open pages (page_id, url, [blocks]), window by window."""
    host = lambda u: u.split("/")[2]
    words = {p: " ".join(blocks).split(" ") for p, _, blocks in rows}
    pages, found = {}, {}
    for p, u, _ in rows:
        pages.setdefault(host(u), set()).add(tuple(words[p]))
        for i in range(len(words[p]) - rule.run + 1):
            found.setdefault((host(u), tuple(words[p][i : i + rule.run])), set()).add(tuple(words[p]))
    out = {}
    for p, u, blocks in rows:
        gone = set()
        for i in range(len(words[p]) - rule.run + 1):
            if len(found[host(u), tuple(words[p][i : i + rule.run])]) >= max(rule.pages, rule.share * len(pages[host(u)])):
                gone.update(range(i, i + rule.run))
        at, kept = 0, []
        for b in blocks:
            n = len(b.split(" "))
            rest = [x for i, x in enumerate(words[p][at : at + n], at) if i not in gone]
            at += n
            if rest:
                kept.append(" ".join(rest))
        out[p] = "\n\n".join(kept)
    return out


def test_extraction_counts_different_pages(spark):
    """Copies of an open page keep their text, as does a quotation of two pages; menus go."""
    r = random.Random(5)
    say = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    menu, quote, twice = say(10), say(12), say(30)
    rows = []
    for h in ("a.org", "b.org"):
        for i in range(40):
            blocks = [menu] if i % 3 else []
            blocks += [say(20)] + ([quote] if i in (4, 5) else []) + ([menu + " " + say(2) + " " + menu] if i == 7 else [])
            rows.append((len(rows), f"http://{h}/{i}", blocks))
        rows += [(len(rows) + k, f"http://{h}/same?utm_source={k}", [menu, twice]) for k in range(6)]
    page = lambda blocks: "<body>" + "".join(f"<div>{b}</div>" for b in blocks) + "</body>"
    table = spark.createDataFrame([(p, u, page(b)) for p, u, b in rows], "page_id long, url string, html string").repartition(3)
    for rule in (extract.Boilerplate(), extract.Boilerplate(batch=3, shard_tokens=4), extract.Boilerplate(share=0.8)):
        got = {x["page_id"]: x["text"] for x in extract.main_text(table, rule).collect()}
        assert got == extraction_brute_force(rows, rule)
    assert twice in extract.main_text(table).filter("page_id = 40").first()["text"]


def test_suffix_dedup_splits_a_hot_minimizer(spark):
    """A line that many documents have with other words about it is split by window; the result is the same."""
    r = random.Random(11)
    say = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    line, passage, around = say(90), say(104), say(40)
    rows = []
    for i in range(120):
        a, b = (around, say(40)) if i % 5 == 0 else (say(60), say(60))
        rows.append((i, a + (line if i % 2 else passage) + b + (say(69) * 3 if i % 17 == 0 else "")))
    rows += [(200, line * 4), (201, "é" * 200), (202, None)]
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    for hot in (0, 2000, 1 << 20):
        rule = repeats.Repeats(batch=300, hot_bytes=hot)
        got = {x[0]: tuple(x)[1:] for x in repeats.remove_repeats(docs, rule, keep=False).collect()}
        assert got == repeats.brute_force(rows)

    order = docs.filter("text is not null").withColumnRenamed("doc_id", "seq")
    sent = order.select("seq", "text").mapInArrow(repeats._cut(repeats.Repeats(hot_bytes=2000)), repeats._ROW).repartition("key")
    met = sent.mapInArrow(repeats._meet(repeats.Repeats(hot_bytes=2000)), repeats._ROW).filter("kind <> 1")
    size = {(x["kind"], x["key"]): x["n"] for x in met.groupBy("kind", "key").agg({"windows": "sum", "*": "count"}).selectExpr("kind", "key", "`sum(windows)` + 99 * `count(1)` as n").collect()}
    assert max(n for (kind, _), n in size.items() if kind == 0) <= 2000 < max(n for (kind, _), n in size.items() if kind == 2)
