"""Behaviour of the document-vault operators on small hand-made notes."""

from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import duplicates, facts, links, maintenance, roles, search
from quillgraph.plans.index import VaultIndex

NOTE = """---
tags:
- alpha
- "beta/x"
kind: [one, two]
---
# Title #
- [x] done #todo/now
* [ ] open
~~~
# no [[nope]] #no
```
~~~
See [[Other|alias]] and ![[embed]] and [[Dir/Other#Part]].
## Sub
text
"""


def notes(spark, rows):
    return spark.createDataFrame([(p, t, float(i)) for i, (p, t) in enumerate(rows)], "path string, text string, mtime double")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_facts(spark):
    n = notes(spark, [("a.md", NOTE), ("e.md", ""), ("z.md", None)])
    assert rows(facts.headings(n)) == [("a.md", 7, 1, "Title"), ("a.md", 15, 2, "Sub")]
    assert rows(facts.tasks(n)) == [("a.md", 8, True, "done #todo/now"), ("a.md", 9, False, "open")]
    assert [(r[3], r[4]) for r in rows(facts.wikilinks(n))] == [("Other", "alias"), ("Dir/Other", None)]
    assert [(r[1], r[3]) for r in rows(facts.tags(n))] == [(3, "#alpha"), (4, "#beta/x"), (8, "#todo/now")]
    assert rows(facts.frontmatter(n)) == [("a.md", "kind", "one"), ("a.md", "kind", "two"), ("a.md", "tags", "alpha"), ("a.md", "tags", "beta/x")]
    assert rows(facts.read_section(n, "Sub")) == [("a.md", "## Sub\ntext")]


def test_open_fence_and_open_frontmatter_reach_to_the_end(spark):
    n = notes(spark, [("a.md", "# A\n```\n# B"), ("b.md", "---\nk: v\n# C")])
    assert [r[3] for r in rows(facts.headings(n))] == ["A"]
    assert rows(facts.frontmatter(n)) == [("b.md", "k", "v"), ]


def test_links(spark):
    n = notes(spark, [("P/s.md", "[[x]] [[P/x]] [[gone]] [[#H]]"), ("P/x.md", "1"), ("Q/x.md", "2"), ("Q/y.md", "[[s]]")])
    r = {(x["path"], x["target"]): (x["status"], x["resolved_path"], x["preferred_path"]) for x in VaultIndex(n).links.collect()}
    assert r[("P/s.md", "x")] == ("ambiguous", None, "P/x.md")
    assert r[("P/s.md", "P/x")] == ("resolved", "P/x.md", None)
    assert r[("P/s.md", "gone")][0] == r[("P/s.md", "")][0] == "missing"
    assert r[("Q/y.md", "s")] == ("resolved", "P/s.md", None)
    assert rows(links.shortest_links(n))[1] == ("P/x.md", "[[P/x]]")


def test_canonical(spark):
    n = notes(spark, [("Inbox/a.md", "same"), ("Areas/a.md", "same"), ("b.md", "other")])
    ix = VaultIndex(n)
    (r,) = duplicates.canonical_reasons(ix.members).collect()
    assert r["canonical_path"] == "Areas/a.md" and "preferred over inbox paths" in r["reasons"]


def test_roles(spark):
    n = notes(spark, [("Projects/P/a.md", "---\nnote_role: Umbrella\n---\n"), ("b.md", "---\nnote_role: odd\n---\n"), ("c.md", "- [[a]]")])
    ix = VaultIndex(n)
    assert rows(ix.note_roles) == [("Projects/P/a.md", "umbrella"), ("b.md", "source"), ("c.md", "source")]
    assert rows(roles.role_invalid(ix.metadata)) == [("b.md", "odd")]
    assert rows(roles.role_missing(ix.docs, ix.metadata)) == [("c.md", "umbrella")]


def test_search_matches_sqlite(spark):
    import sqlite3

    texts = [("a/one.md", "kimchi and rice\n# Soup"), ("b/two.md", "rice rice café"), ("c.md", "foo_bar rice"), ("d.md", "Rice and beans and kimchi and rice")]
    docs = VaultIndex(notes(spark, texts)).docs.persist()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE s USING fts5(path UNINDEXED, path_text, title, headings, tags, tasks, body, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO s VALUES (?, ?, ?, ?, ?, ?, ?)", [tuple(r[c] for c in ("path", "path_text", "title", "headings", "tags", "tasks", "body")) for r in docs.collect()])
    for q in ("rice", "kimchi rice", "foo_bar", "cafe", "kimch"):
        match = " ".join(f'"{t}"' for t in search.query_tokens(q))
        want = db.execute("SELECT path, bm25(s) FROM s WHERE s MATCH ? ORDER BY bm25(s), path", (match,)).fetchall()
        got = [(r["path"], r["score"]) for r in search.search(docs, q).collect()]
        assert [p for p, _ in got] == [p for p, _ in want]
        assert all(abs(x - y) < 1e-9 for (_, x), (_, y) in zip(got, want))


def test_incremental_tables(spark):
    old = VaultIndex(notes(spark, [("a.md", "1"), ("b.md", "2"), ("c.md", "3")])).files
    new = VaultIndex(notes(spark, [("a.md", "1"), ("x.md", "9"), ("c.md", "changed")])).files
    delta = {r["path"]: (r["change"], r["reparse"]) for r in maintenance.scan_delta(new, old).collect()}
    assert delta == {"a.md": ("unchanged", False), "b.md": ("deleted", False), "c.md": ("changed", True), "x.md": ("new", True)}
    d = maintenance.scan_delta(new, old)
    kept = maintenance.cascade_delete(old, d.filter("change = 'deleted'"))
    merged = maintenance.upsert(kept, new.join(d.filter("change in ('new', 'changed')"), "path", "left_semi"))
    assert rows(merged.select("path", "sha256")) == rows(new.select("path", "sha256"))


def test_text_helpers(spark):
    df = spark.createDataFrame([("# Head #\nx", "a/b.c/d.md"), ("\n plain text", "e"), ("", ".hidden")], "t string, p string")
    assert [r[0] for r in df.select(T.extract_title(F.col("t"))).collect()] == ["Head", "plain text", "Untitled"]
    assert [r[0] for r in df.select(T.stem(F.col("p"))).collect()] == ["d", "e", ".hidden"]
    assert T.glob_regex("*.md") == r"(?s)^.*\.md$"
