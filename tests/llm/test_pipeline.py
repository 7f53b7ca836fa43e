"""Stages of the corpus pipeline against brute force, with nulls and repeated rows."""

import random

import corpus_pipeline as pipeline
from quillgraph.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(9)
    say = lambda n: [f"w{r.randrange(900)}" for _ in range(n)]
    base, passage = say(60), " ".join(say(40))
    texts = []
    for i in range(40):
        near = list(base)
        near[i] = "other"
        texts.append(" ".join(near) if i % 8 == 0 else " ".join(say(50)) + (f" {passage}é" if i % 5 == 1 else ""))
    rows = [(i, t, "en", f"h{i % 3}", len(t)) for i, t in enumerate(texts)]
    return rows + [(50, None, "en", None, None), (51, "", "de", "h0", 0), (None, texts[0], "en", "h1", len(texts[0]))]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_near_duplicates(spark):
    rows = corpus()
    component = {d: c for d, _, c in jaccard.brute_force([(d, t) for d, t, *_ in rows])}
    want = [x for x in rows if x[0] is None or component[x[0]] == x[0]]
    assert len(want) < len(rows)
    for given in (rows, rows + [rows[0], rows[3]]):
        assert sorted_rows(pipeline.near_duplicates(spark, table(spark, given), "")) == sorted(want, key=repr)


def test_repeated_passages(spark):
    rows = [x for x in corpus() if x[0] is not None]
    seen, want = set(), []
    for d, text, lang, source, n in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        kept = bytes(b for b, g in zip(raw, gone) if not g).decode(errors="ignore")
        if not any(gone):
            want.append((d, text or "", lang, source, n))
        elif kept.strip(" \t\n\r"):
            want.append((d, kept, lang, source, len(kept)))
    assert any(a[1] != b[1] for a, b in zip(want, rows) if a[0] == b[0])
    got = [(d, t or "", *rest) for d, t, *rest in sorted_rows(pipeline.repeated_passages(spark, table(spark, rows), ""))]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_decontamination(spark, tmp_path):
    rows = corpus()
    item = rows[1][1]
    spark.createDataFrame([("a", item), ("b", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    windows = lambda t: {tuple(w[i : i + 10]) for w in [(t or "").lower().split()] for i in range(len(w) - 9)}
    clean = [x for x in rows if not windows(x[1]) & windows(item)]
    got = sorted_rows(pipeline.decontamination(spark, table(spark, rows), str(tmp_path)))
    assert {x[0] for x in got} >= {x[0] for x in clean} and 1 not in {x[0] for x in got}


def test_quality_rules(spark):
    """Against the operator's SQL, with null hosts, texts and ids, repeated rows and a clashing column."""
    import duckdb
    import pandas as pd

    from quillgraph.llm import quality

    r = random.Random(4)
    good = lambda: " ".join(f"w{r.randrange(900)}" for _ in range(60))
    rows = [(i, good(), "en", "fine", i) for i in range(30)] + [(100 + i, "short" if i % 6 else good(), "en", "spam", i) for i in range(40)]
    rows += [(200, None, "en", "fine", 0), (201, "", "en", None, 0), (202, good(), None, None, None), (203, "a b c " * 40, "en", "fine", 0)]
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])
    db = duckdb.connect()
    db.register("documents", documents)
    kept = {x[0] for x in db.execute(f"SELECT doc_id FROM ({quality.ORACLE_SQL}) WHERE kept").fetchall()}
    assert 0 in kept and not {100, 101, 106, 200, 201, 203} & kept and 202 in kept
    docs = spark.createDataFrame([(*x, "e") for x in rows], SCHEMA + ", base_failed string").repartition(3)
    assert sorted_rows(pipeline.quality_rules(spark, docs, "")) == sorted((x for x in rows if x[0] in kept), key=repr)
    twice = [(None, rows[0][1], "en", "fine", 1)] * 2 + rows[:3] * 2
    assert sorted_rows(pipeline.quality_rules(spark, table(spark, twice), "")) == sorted(twice, key=repr)
    assert pipeline.quality_rules(spark, table(spark, []), "").count() == 0


def test_packing_stage(spark):
    """Pieces of each document follow one another up to its tokens as the library counts them, and the end."""
    from tokenizers import Tokenizer

    rows = [x for x in corpus() if x[0] is not None] + [(60, "long words " * 5000, "en", "h", 1)]
    plain = Tokenizer.from_file(pipeline.TOKENIZER)
    want = {d: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for d, t, *_ in rows}
    got = {}
    for x in pipeline.best_fit_packing(spark, table(spark, rows), "").orderBy("doc_id", "start").collect():
        assert x["start"] == got.get(x["doc_id"], 0)
        got[x["doc_id"]] = x["start"] + x["length"]
    assert got == want


def test_run(spark, tmp_path):
    """The whole pipeline gives what its stages give one after another, and scopes of paths end as they began."""
    from quillgraph.llm.common import scratch

    with scratch() as outer:
        with scratch():
            pass
        with scratch() as inner:
            inner.append("b")
        outer.append("a")
    assert outer == ["a"]
    rows = corpus()
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", rows[1][1]), ("b", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), SCHEMA if name != "best_fit_packing" else None)
    want = sorted_rows(docs)
    assert len(want) > 5
    for _ in range(2):
        assert sorted_rows(pipeline.run(spark, str(tmp_path))) == want
