"""Semantic candidates over the whole text, against all pairs."""

import math
import random

from pyspark.sql import functions as F

from quillgraph.operators import duplicates
from quillgraph.plans.index import VaultIndex
from quillgraph.plans.queries import QUERIES, whole_semantic_rows


def test_body_terms_and_close_pairs(spark):
    r = random.Random(4)
    vocabulary = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, base = [], []
    for i in range(60):
        words = r.sample(vocabulary, 30) if i % 3 == 0 else [r.choice(vocabulary) if r.random() < 0.3 else w for w in base]
        base = words
        rows.append((f"d{i % 4}/n{i}.md", f"---\ntags: [x]\nkind: hidden{i}\n---\n# start{i}\n" + " ".join(words), float(i)))
    ix = VaultIndex(spark.createDataFrame(rows, "path string, text string, mtime double"))
    terms = whole_semantic_rows(ix).cache()
    sets = {}
    for path, term in terms.collect():
        sets.setdefault(path, set()).add(term)
    assert "kind" not in sets["d0/n0.md"] and set(rows[0][1].split("\n")[-1].split()) <= sets["d0/n0.md"]
    df = {}
    for s in sets.values():
        for t in s:
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log((len(sets) + 1) / (d + 1)) + 1 for t, d in df.items() if d <= max(5, math.ceil(len(sets) * 0.1))}
    norm = {p: math.sqrt(sum(idf[t] ** 2 for t in s if t in idf)) for p, s in sets.items()}
    for least in (0.1, 0.3, 0.55):
        want = {}
        for a in sets:
            for b in sets:
                both = sum(idf[t] ** 2 for t in sets[a] & sets[b] if t in idf)
                if a < b and both and round(both / norm[a] / norm[b], 9) >= least:
                    want[a, b] = round(both / norm[a] / norm[b], 6)
        got = {(x["path_a"], x["path_b"]): x["cosine"] for x in duplicates.close_pairs(terms, least).select("path_a", "path_b", F.round("cosine", 6).alias("cosine")).collect()}
        assert want and got == want
    assert "semantic_candidates_body" in QUERIES


def test_small_notes_meet_no_other(spark):
    """Notes of too few terms count in the weights, but no pair of theirs is made."""
    rows = [(f"s{i}", t) for i in range(40) for t in ("alpha", "beta")] + [(f"d{i}", f"w{j}") for i in range(4) for j in range(i, i + 7)] + [(f"x{i}", f"only{i}") for i in range(400)]
    terms = spark.createDataFrame(rows, "path string, term string")
    made = duplicates.cosines(terms).collect()
    want = sorted(tuple(x) for x in made if min(x["size_a"], x["size_b"]) >= 6)
    assert want and len(made) > 40 * 39 / 2
    assert sorted(map(tuple, duplicates.cosines(terms, least_size=6).collect())) == want
