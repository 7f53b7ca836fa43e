"""Profiles of the vault's folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import text as T
from quillgraph.operators.roles import ROLE_ROOTS, path_role


def profile_of(files: DataFrame) -> DataFrame:
    """role, profile, path: the inbox as a whole; in other roots each child folder, and files right under the
    root; a root without child folders as a whole."""
    root = F.lit(None).cast("string")
    for role, r in ROLE_ROOTS:
        root = F.when(path_role(F.col("path")) == role, F.lit(r)).otherwise(root)
    placed = files.select("path", path_role(F.col("path")).alias("role"), root.alias("root")).filter("role is not null")
    rest = F.substring(F.col("path"), F.length("root") + 1, F.lit(1 << 30))
    placed = placed.withColumn("first", F.substring_index(rest, "/", 1)).withColumn("nested", rest.contains("/"))
    nested_roots = placed.groupBy("root").agg(F.bool_or("nested").alias("has_folders"))
    child = F.concat("root", "first", F.when(F.col("nested"), "/").otherwise(""))
    profile = F.when((F.col("role") == "inbox") | ~F.col("has_folders"), F.col("root")).otherwise(child)
    return placed.join(F.broadcast(nested_roots), "root").select("role", profile.alias("profile"), "path")


def profiles(files: DataFrame) -> DataFrame:
    """role, profile, note_count, representatives (its five first notes)."""
    members = profile_of(files)
    w = Window.partitionBy("role", "profile").orderBy("path")
    first = members.withColumn("r", F.row_number().over(w)).filter("r <= 5").groupBy("role", "profile").agg(F.array_join(F.array_sort(F.collect_list("path")), "\n").alias("representatives"))
    return members.groupBy("role", "profile").agg(F.count(F.lit(1)).alias("note_count")).join(first, ["role", "profile"])


def _top(counted: DataFrame, value: str, k: int) -> DataFrame:
    w = Window.partitionBy("profile").orderBy(F.desc("n"), value)
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_tags(files: DataFrame, tags: DataFrame, k: int = 5) -> DataFrame:
    """profile, tag, n, rank."""
    members = profile_of(files).select("profile", "path")
    return _top(tags.select("path", "tag").join(members, "path").groupBy("profile", "tag").agg(F.count(F.lit(1)).alias("n")), "tag", k)


def top_terms(files: DataFrame, docs: DataFrame, k: int = 8) -> DataFrame:
    """profile, term, n, rank: by the number of notes with the term in path, title, headings or tags."""
    members = profile_of(files).select("profile", "path")
    terms = docs.select("path", F.explode(T.lower_terms(F.concat_ws(" ", "path_text", "title", "headings", "tags"))).alias("term"))
    return _top(terms.join(members, "path").groupBy("profile", "term").agg(F.count(F.lit(1)).alias("n")), "term", k)
