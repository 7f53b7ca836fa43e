"""The link graph: which note a link means, backlinks, degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T


def preferred(source: Column, candidates: Column) -> Column:
    """Of an array of paths the one with the longest common leading parts with source, then the same top
    folder, then the smallest."""
    src = F.split(source, "/")

    def score(p):
        same = F.zip_with(src, F.split(p, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
        run = F.aggregate(
            same,
            F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")),
            lambda acc, x: F.struct((acc["n"] + F.when(acc["go"] & x, 1).otherwise(0)).alias("n"), (acc["go"] & x).alias("go")),
            lambda acc: acc["n"],
        )
        return F.struct((-run).alias("n"), (-F.get(same, F.lit(0)).cast("int")).alias("top"), p.alias("p"))

    return F.array_min(F.transform(candidates, score))["p"]


def resolve(links: DataFrame, notes: DataFrame) -> DataFrame:
    """links with resolved_path, preferred_path, status and candidates: the note at that path, else the only
    note of that stem, else ambiguous or missing. Two equi-joins on the target; candidates are an array for
    each stem, joined once."""
    pages = notes.groupBy(F.lower(T.without_suffix(F.col("path"))).alias("key")).agg(F.max("path").alias("page"))
    stems = notes.groupBy(F.lower(T.stem(F.col("path"))).alias("stem_key")).agg(F.array_sort(F.collect_set("path")).alias("candidates"))
    bare = F.lower(F.regexp_replace(T.strip(F.col("target")), r"\.md$", ""))
    keyed = links.withColumn("key", bare).withColumn("stem_key", T.stem(F.col("key")))
    found = keyed.join(pages, "key", "left").join(stems, "stem_key", "left")
    many = F.col("page").isNull() & (F.size("candidates") > 1)
    resolved = F.coalesce("page", F.when(F.size("candidates") == 1, F.get("candidates", F.lit(0))))
    return found.select(
        *links.columns,
        resolved.alias("resolved_path"),
        F.when(many, preferred(F.col("path"), F.col("candidates"))).alias("preferred_path"),
        F.when(resolved.isNotNull(), "resolved").when(many, "ambiguous").otherwise("missing").alias("status"),
        F.when(many, F.col("candidates")).alias("candidates"),
    )


def backlinks(resolved: DataFrame) -> DataFrame:
    """path, source, line, target: each link with the note that it means or would prefer."""
    ends = F.explode(F.array_distinct(F.filter(F.array("resolved_path", "preferred_path"), lambda x: x.isNotNull())))
    return resolved.select(ends.alias("path"), F.col("path").alias("source"), "line", "seq", "target")


def degrees(notes: DataFrame, resolved: DataFrame) -> DataFrame:
    """path, out_links, back_links of every note."""
    out = resolved.groupBy("path").agg(F.count(F.lit(1)).alias("out_links"))
    back = backlinks(resolved).groupBy("path").agg(F.count(F.lit(1)).alias("back_links"))
    joined = notes.select("path").join(out, "path", "left").join(back, "path", "left")
    return joined.select("path", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("out_links", "back_links")])


def shortest_links(notes: DataFrame) -> DataFrame:
    """path, link: [[stem]] where no other note has the stem, else the path without its suffix."""
    stem = T.stem(F.col("path"))
    shared = notes.groupBy(T.fold(stem).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    keyed = notes.select("path", stem.alias("stem"), T.fold(stem).alias("k")).join(shared, "k")
    return keyed.select("path", F.when(F.col("n") == 1, F.concat(F.lit("[["), F.col("stem"), F.lit("]]"))).otherwise(F.concat(F.lit("[["), T.without_suffix(F.col("path")), F.lit("]]"))).alias("link"))
