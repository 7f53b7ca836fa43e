"""Semantic findings against all pairs and one loop, inspection of duplicates, empty directories."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import duplicates, maintenance, semantic
from quillgraph.plans.index import VaultIndex
from quillgraph.sources import vault

NAMES = ["plan", "plan old", "Weekly plan review", "weekly plan review", "notes", "todo links", "2024", "alpha beta", "beta alpha", "Alpha Beta gamma delta", "archive plan", "x"]


def vault_rows(seed):
    r = random.Random(seed)
    vocabulary = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows, base = {}, r.sample(vocabulary, 20)
    for i in range(120):
        folder = r.choice(["Projects/A/", "Projects/B/", "Areas/C/", "Archive/", "Areas/archive/D/", ""])
        base = r.sample(vocabulary, 20) if r.random() < 0.2 else [r.choice(vocabulary) if r.random() < 0.15 else w for w in base]
        text = f"---\nnote_role: {'umbrella' if i % 17 == 0 else 'source'}\n---\n" + (" ".join(base) if i % 19 else "- [[plan]]")
        if i % 11 == 0 and rows:
            text = r.choice(sorted(rows.values()))
        rows[folder + r.choice(NAMES) + r.choice(["", "", " two", f" q{i}"]) + ".md"] = text
    return [(p, t, 0.0) for p, t in rows.items()]


def alike(a, b):
    words = lambda s: {w.casefold() for w in __import__("re").findall(r"[^\W_]+", s) if any(c.isalpha() for c in w)}
    x, y = words(a), words(b)
    if not x or not y:
        return float(" ".join(a.casefold().split()) == " ".join(b.casefold().split()) != "")
    return max(len(x & y) / len(x), len(x & y) / len(y))


def brute(rows, total):
    """rows: path -> (dir, stem, sha, key, generic, terms)."""
    df = {}
    for x in rows.values():
        for t in x[5]:
            df[t] = df.get(t, 0) + 1
    limit = max(5, math.ceil(total * 0.1))
    idf = {t: math.log((total + 1) / (d + 1)) + 1 for t, d in df.items()}
    terms = {p: {t for t in x[5] if df[t] <= limit} for p, x in rows.items()}
    norm = {p: math.sqrt(sum(idf[t] ** 2 for t in s)) for p, s in terms.items()}
    seen, out = set(), set()
    for p in sorted(rows):
        d, stem, sha, key, generic, _ = rows[p]
        scores = []
        for q in rows:
            d2, stem2, sha2, key2, _, _ = rows[q]
            titled = key != "" and not generic and key == key2
            if q == p or sha == sha2 or not (titled or terms[p] & terms[q]):
                continue
            score = 0
            if d == d2:
                like = max(alike(stem, stem2), alike(key, key2))
                if like >= 0.85:
                    score = round(round(like * 100, 6)) + 20 * (key != "" and key == key2) + 15 * (stem.casefold() == stem2.casefold())
            else:
                score = 70 * titled + 50 * (key != "" and not generic and key == stem2.casefold())
                both = terms[p] & terms[q]
                if min(len(terms[p]), len(terms[q])) >= 6 and len(both) >= 2:
                    cosine = sum(idf[t] ** 2 for t in both) / norm[p] / norm[q]
                    if round(cosine, 9) >= 0.55:
                        score += round(round(cosine * 100, 6))
            scores.append((-score, q))
        for score, q in sorted(scores)[:3]:
            pair = tuple(sorted((p, q)))
            if -score >= 55 and pair not in seen:
                seen.add(pair)
                out.add((*pair, p, -score))
                break
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_semantic_duplicates(spark, tmp_path, seed):
    ix = VaultIndex(spark.createDataFrame(vault_rows(seed), "path string, text string, mtime double"))
    compared = semantic.compared(ix.docs, ix.note_roles, ix.files).cache()
    rows = {x["path"]: (x["dir"], x["stem"], x["sha256"], x["title_key"], x["generic"], set(x["terms"])) for x in compared.collect()}
    assert rows and not any("rchive/" in p for p in rows)
    got = semantic.findings(semantic.chosen(semantic.scored_candidates(compared), f"file://{tmp_path}")).collect()
    want = brute(rows, len(rows))
    assert len(want) > 10 and {(x["path"], x["other"], x["seed"], x["score"]) for x in got} == want and len(got) == len(want)
    assert all(x["id"] == "semantic_duplicate:" + hashlib.sha1(f"{x['path']}|{x['other']}".encode()).hexdigest()[:12] for x in got)


def test_choices_along_a_chain(spark, tmp_path):
    """Each note's best is the one before it, so what each takes hangs on all before."""
    names = [f"n{i:02d}" for i in range(12)]
    edges = [(names[i], names[j], s) for i in range(12) for j, s in ((i - 1, 90), (i + 1, 80)) if 0 <= j < 12]
    got = {x[0]: x[1] for x in semantic.chosen(spark.createDataFrame(edges, "seed string, path string, score int"), f"file://{tmp_path}").collect()}
    seen, want = set(), {}
    for s in names:
        for _, c in sorted((-score, path) for seed, path, score in edges if seed == s):
            if frozenset((s, c)) not in seen:
                seen.add(frozenset((s, c)))
                want[s] = c
                break
    assert got == want
    none = semantic.chosen(spark.createDataFrame([], "seed string, path string, score int"), f"file://{tmp_path}")
    assert none.collect() == []


def test_inspect_duplicates(spark):
    body = "# Title\nsome shared words about rivers and mountains"
    rows = [("Inbox/a.md", body, 3.0), ("Projects/P/a.md", body, 1.0), ("Areas/b.md", body + " too", 1.0), ("Areas/c.md", body + " too", 2.0), ("z.md", "nothing alike", 0.0)]
    ix = VaultIndex(spark.createDataFrame(rows, "path string, text string, mtime double"))
    sha = hashlib.sha256(body.encode()).hexdigest()
    for key in ("Inbox/a.md", "Projects/P/a.md", f"sha256:{sha[:12]}", f"sha256: {sha[:12].upper()}"):
        got = [tuple(r) for r in duplicates.inspect_duplicates(key, ix.files, ix.members, ix.docs).select("kind", "path", "reasons").orderBy("kind").collect()]
        assert got == [("canonical", "Projects/P/a.md", ""), ("exact", "Inbox/a.md", ""), ("similar", "Areas/c.md", "exact duplicate canonicalized from Areas/b.md")]
    alone = duplicates.inspect_duplicates("z.md", ix.files, ix.members, ix.docs)
    assert alone.filter("kind <> 'similar'").count() == 0
    for key, error in (("sha256:", ValueError), ("sha256:0000", ValueError), ("none.md", FileNotFoundError)):
        with pytest.raises(error):
            duplicates.inspect_duplicates(key, ix.files, ix.members, ix.docs)
    assert [r["n"] for r in duplicates.group_examples(ix.files).collect()] == [2, 2] and duplicates.group_examples(ix.files, 1).count() == 1


def test_empty_directories(spark, tmp_path):
    for d in ("Inbox", "Projects/empty", "Projects/full", "Misc/deep", ".git/x", "Areas/skip/me", "Areas/node_modules/y"):
        (tmp_path / d).mkdir(parents=True)
    (tmp_path / "Projects/full/n.md").write_text("x")
    found = vault.directories(spark, str(tmp_path))
    assert {r["path"]: r["children"] for r in found.collect()}["Projects/"] == 2
    sources = spark.createDataFrame([("Projects/full/n.md",)], "path string")
    got = maintenance.empty_directories(found, sources, ("Areas/skip",)).orderBy("path").collect()
    assert [(r["severity"], r["path"], r["summary"]) for r in got] == [("low", "Misc/deep/", "Empty unclassified directory"), ("medium", "Projects/empty/", "Empty project directory")]
    assert maintenance.empty_directories(found.filter(F.lit(False)), sources).count() == 0
