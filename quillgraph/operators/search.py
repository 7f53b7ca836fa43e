"""BM25 search over positional postings: a query's tokens are phrases, all or any of which have to match."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions.folding import search_fold

COLUMNS = ("path_text", "title", "headings", "tags", "tasks", "body")
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


#: Folders of the postings.
PARTS = 64


def part_of(term):
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def _tokens(c):
    return T.tokens(search_fold(c))


def postings(docs: DataFrame) -> DataFrame:
    """path, col, pos, term of every token of the indexed columns, and part, by a hash of the term."""
    parts = F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).alias("t")) for i, c in enumerate(COLUMNS)])
    each = docs.select("path", F.explode(parts).alias("c"))
    found = each.select("path", F.col("c.col").alias("col"), F.posexplode(_tokens(F.col("c.t"))).alias("pos", "term"))
    return found.withColumn("part", part_of(F.col("term")))


def lengths(docs: DataFrame) -> DataFrame:
    """path, doc_len: tokens of the indexed columns."""
    sizes = [F.size(_tokens(F.col(c))) for c in COLUMNS]
    return docs.select("path", sum(sizes[1:], sizes[0]).cast("long").alias("doc_len")).filter("doc_len > 0")


def phrases(spark: SparkSession, tokens: list[str]) -> DataFrame:
    """phrase, term, off, size of the query's tokens: _ - / make a phrase of several terms. The terms are
    folded as the index is. A token without a letter or digit is none."""
    rows: list[tuple[int, str, int, int]] = []
    for i, t in enumerate(dict.fromkeys(tokens)):
        words = [x for x in re.findall(r"[^\W_]+", t.lower())]
        rows += [(i, w, k, len(words)) for k, w in enumerate(words)]
    made = spark.createDataFrame(rows, "phrase int, term string, off int, size int")
    return made.withColumn("term", search_fold(F.col("term")))


def query_tokens(query: str) -> list[str]:
    return [t for t in re.findall(r"[\w/-]+", query.lower()) if t.strip("-_/")]


def bm25(postings_: DataFrame, length: DataFrame, n_docs: DataFrame, wanted: DataFrame, every: bool) -> DataFrame:
    """path, score (less is better) of the documents that match all phrases, or any. n_docs has a row for each document. The
    phrases (a query's tokens) are broadcast; of the postings only their terms' parts are read."""
    parts = [r[0] for r in wanted.select(part_of(F.col("term"))).distinct().collect()]  # PARTS rows at most
    hits = postings_.filter(F.col("part").isin(parts)).join(F.broadcast(wanted), "term")
    found = hits.groupBy("path", "phrase", "col", (F.col("pos") - F.col("off")).alias("at")).agg(F.count(F.lit(1)).alias("k"), F.first("size").alias("size")).filter("k = size")
    per = found.groupBy("path", "phrase").agg(F.count(F.lit(1)).alias("f"))
    numbers = per.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    corpus = n_docs.agg(F.count(F.lit(1)).alias("n_docs")).join(length.agg(F.sum("doc_len").alias("total")), F.lit(True))
    idf = numbers.join(corpus, F.lit(True)).select(
        "phrase", (F.col("total") / F.col("n_docs")).alias("avg"), F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)).alias("raw")
    ).withColumn("idf", F.when(F.col("raw") <= 0, F.lit(LEAST_IDF)).otherwise(F.col("raw")))
    # One row for each phrase of the query.
    scored = per.join(F.broadcast(idf), "phrase").join(length, "path")
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg")))
    out = scored.groupBy("path").agg((-F.sum(part)).alias("score"), F.count(F.lit(1)).alias("matched"))
    if every:
        out = out.join(F.broadcast(wanted.agg(F.countDistinct("phrase").alias("asked"))), F.col("matched") == F.col("asked"))
    return out.select("path", "score")


def search(docs: DataFrame, query: str, limit: int = 10, index: DataFrame | None = None, length: DataFrame | None = None) -> DataFrame:
    """path, score, snippet of the best matches; none for a limit or query of nothing. index and length: stored
    postings and lengths of docs."""
    tokens = query_tokens(query)
    if limit <= 0 or not tokens:
        return docs.limit(0).select("path", F.lit(0.0).alias("score"), F.lit("").alias("snippet"))
    wanted = phrases(docs.sparkSession, tokens)
    best = bm25(postings(docs) if index is None else index, lengths(docs) if length is None else length, docs, wanted, True).orderBy("score", "path").limit(limit)
    terms = [search_fold(F.lit(t)) for x in tokens for t in re.findall(r"[^\W_]+", x)]
    words = F.split(F.trim(F.regexp_replace("body", rf"[{T.SPACE}]+", " ")), " ")
    hit = lambda w: F.arrays_overlap(T.tokens(search_fold(w)), F.array(*terms))
    first = F.coalesce(F.array_min(F.filter(F.transform(words, lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull())), F.lit(0))
    start = F.greatest(first - 8, F.lit(0))
    shown = F.transform(F.slice(words, start + 1, F.lit(18)), lambda w: F.when(hit(w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.array_join(shown, " "), F.when(start + 18 < F.size(words), "...").otherwise(""))
    return best.join(docs.select("path", "body"), "path").select("path", "score", cut.alias("snippet")).orderBy("score", "path")
