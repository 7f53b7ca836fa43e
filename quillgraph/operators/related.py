"""Notes related to a note by weighted evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import search as S
from quillgraph.operators.links import backlinks
from quillgraph.operators.roles import path_role


def lexical_pool(docs: DataFrame, note: str, index: DataFrame, length: DataFrame, pool: int = 40) -> DataFrame:
    """path, overlap (sorted shared terms) of the best lexical candidates: any of the note's first eight search
    terms by BM25, the first `pool` of them."""
    terms = T.search_terms(F.concat_ws(" ", "title", "headings", "tags"))
    # One note's terms come to the driver, as a query's do.
    own = docs.filter(F.col("path") == note).select(F.array_sort(terms).alias("t")).first()
    mine = list(own["t"]) if own else []
    tokens = [t for t in mine[:8] if t.strip("-_/")]
    if len(mine) < 2 or not tokens:
        return docs.limit(0).select("path", F.array().cast("array<string>").alias("overlap"))
    wanted = S.phrases(docs.sparkSession, tokens)
    best = S.bm25(index, length, docs, wanted, False).filter(F.col("path") != note).orderBy("score", "path").limit(pool)
    shared = F.array_sort(F.array_intersect(terms, F.array(*[F.lit(x) for x in mine])))
    return best.join(docs, "path").select("path", shared.alias("overlap"))


def related(note: str, notes: DataFrame, docs: DataFrame, resolved: DataFrame, tags: DataFrame, canonical_map: DataFrame, index: DataFrame, length: DataFrame, limit: int = 10) -> DataFrame:
    """path, score, reasons of the notes with most evidence, each duplicate standing for its canonical copy."""
    role = path_role(F.col("path"))
    own_role = path_role(F.lit(note))
    ev = lambda df, score, reason: df.select("path", score.alias("score") if not isinstance(score, int) else F.lit(score).alias("score"), reason.alias("reason") if not isinstance(reason, str) else F.lit(reason).alias("reason"))
    out = resolved.filter(F.col("path") == note)
    parts = [
        ev(out.filter("resolved_path is not null").select(F.col("resolved_path").alias("path")), 100, "outgoing link"),
        ev(out.filter("status = 'ambiguous'").select(F.col("preferred_path").alias("path")), 60, "ambiguous link preferred candidate"),
        ev(backlinks(resolved).filter(F.col("path") == note).select(F.col("source").alias("path")), 90, "backlink"),
    ]
    mine = tags.filter(F.col("path") == note).select("tag").distinct()
    shared = tags.filter(F.col("path") != note).join(mine, "tag").select("path", "tag").distinct()
    parts.append(ev(shared, F.when(F.col("tag").startswith("#todo/"), 5).otherwise(20), F.concat(F.lit("shared tag "), F.col("tag"))))
    folder = note.rpartition("/")[0]
    if folder:
        near = notes.filter(F.col("path").startswith(folder + "/") & (F.col("path") != note)).select("path")
        few = near.agg(F.count(F.lit(1)).alias("n")).filter("n <= 5")
        parts.append(ev(near.join(F.broadcast(few), F.lit(True)).filter(own_role.isNull() | (own_role != "resource")), 5, "same folder"))
    lexical = lexical_pool(docs, note, index, length).filter(F.size("overlap") >= 2)
    same_role = own_role.isNotNull() & (role == own_role)
    parts.append(ev(lexical, F.least(F.size("overlap"), F.lit(4)) * 8 + F.when(same_role, 8).otherwise(0), F.concat(F.lit("shared title/heading terms: "), F.array_join(F.slice("overlap", 1, 4), ", "))))
    evidence = parts[0]
    for p in parts[1:]:
        evidence = evidence.unionByName(p)
    evidence = evidence.filter(F.col("path") != note)
    placed = evidence.join(canonical_map, "path", "left").withColumn("to", F.coalesce("canonical_path", "path"))
    own = canonical_map.filter((F.col("path") == note) & (F.col("canonical_path") != note)).select(F.col("canonical_path").alias("to"), F.lit(115).alias("score"), F.lit("exact duplicate canonical candidate").alias("reason"))
    total = placed.select("to", "score", "reason").unionByName(own).filter(F.col("to") != note).groupBy("to").agg(F.sum("score").alias("score"), F.array_join(F.array_sort(F.collect_set("reason")), "\n").alias("reasons"))
    return total.filter("score >= 10").select(F.col("to").alias("path"), "score", "reasons").orderBy(F.desc("score"), "path").limit(limit)
