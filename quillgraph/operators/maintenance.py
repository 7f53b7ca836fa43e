"""Change detection, incremental tables and the data-quality report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.operators.roles import REQUIRED_ROOTS, dir_source_counts, path_role

#: Fixed values.
TOOLING = ("__pycache__", "node_modules", ".venv", "venv", ".git", ".hg", ".svn")


def scan_delta(current: DataFrame, previous: DataFrame) -> DataFrame:
    """path, change (new, changed, unchanged, deleted), reparse: from files' metadata; content hashes decide
    whether a changed file has to be parsed again."""
    c = current.select("path", F.struct("size_bytes", "mtime").alias("meta"), "sha256")
    p = previous.select("path", F.struct("size_bytes", "mtime").alias("old_meta"), F.col("sha256").alias("old_sha"))
    joined = c.join(p, "path", "full_outer")
    change = F.when(F.col("old_meta").isNull(), "new").when(F.col("meta").isNull(), "deleted").when(F.col("meta") == F.col("old_meta"), "unchanged").otherwise("changed")
    again = F.col("meta").isNotNull() & (F.col("old_sha").isNull() | ((change == "changed") & (F.col("sha256") != F.col("old_sha"))))
    return joined.select("path", change.alias("change"), F.coalesce(again, F.lit(False)).alias("reparse"))


def scan_counters(delta: DataFrame) -> DataFrame:
    count = lambda *kinds: F.count_if(F.col("change").isin(*kinds))
    return delta.agg(count("new", "changed", "unchanged").alias("file_count"), count("new", "changed").alias("changed_count"), count("deleted").alias("deleted_count"), count("unchanged").alias("unchanged_count"))


def drift(current: DataFrame, indexed: DataFrame, examples: int = 10) -> DataFrame:
    """change, n, examples (first paths): added, deleted and changed files against the index."""
    delta = scan_delta(current, indexed).select(F.when(F.col("change") == "new", "added").otherwise(F.col("change")).alias("change"), "path")
    counted = delta.groupBy("change").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("change").orderBy("path")
    first = delta.filter("change <> 'unchanged'").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= examples).groupBy("change").agg(F.array_join(F.array_sort(F.collect_list("path")), "\n").alias("examples"))
    return counted.join(first, "change", "left").select("change", "n", F.coalesce("examples", F.lit("")).alias("examples"))


def upsert(previous: DataFrame, changed: DataFrame, key: str = "path") -> DataFrame:
    """previous with the rows of changed in place of those with their keys."""
    return previous.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed)


def cascade_delete(child: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    """Facts of files that are still there."""
    return child.join(gone.select(key).distinct(), key, "left_anti")


def severity_rank(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)


def report(*rules: DataFrame) -> DataFrame:
    """type, severity, path, summary of all rules' findings, the most severe first."""
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out.orderBy(severity_rank(F.col("severity")), "path", "type", "summary")


def finding(df: DataFrame, kind: str, severity: str, path: str, summary: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.col(path).alias("path"), summary.alias("summary"))


def empty_directories(directories: DataFrame, sources: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """type, severity, path, summary of directories (path, children) with nothing in them and no source file (path)
    below. Excluded ones, required roots, and those in or below hidden or tooling directories are left out."""
    bare = F.trim(F.trim(F.col("path")), F.lit("/"))
    keyed = directories.filter((F.col("children") == 0) & (bare != "")).select(F.concat(bare, F.lit("/")).alias("path"))
    tooling = F.exists(F.split("path", "/"), lambda x: x.startswith(".") | x.isin(*TOOLING))
    wanted = keyed.filter(~tooling & ~F.col("path").isin(*REQUIRED_ROOTS)).distinct()
    for pattern in exclude:
        if pattern.strip("/"):
            wanted = wanted.filter(~F.col("path").startswith(pattern.strip("/") + "/"))
    left = wanted.join(dir_source_counts(sources).select(F.col("dir").alias("path")), "path", "left_anti")
    role = path_role(F.col("path"))
    placed = role.isin("area", "project", "resource")
    severity = F.when(placed, "medium").otherwise("low").alias("severity")
    summary = F.when(placed, F.concat(F.lit("Empty "), role, F.lit(" directory"))).otherwise("Empty unclassified directory")
    return left.select(F.lit("empty_directory").alias("type"), severity, "path", summary.alias("summary"))
