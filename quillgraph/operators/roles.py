"""Roles of paths and notes, and paths' parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T

#: Fixed values.
ROLE_ROOTS = (("inbox", "Inbox/"), ("project", "Projects/"), ("area", "Areas/"), ("resource", "Resources/"))
ROLE_VALUES = ("source", "umbrella")
ROLE_RANK = {"resource": 4, "project": 4, "area": 4, "inbox": 2}
REQUIRED_ROOTS = ("Inbox/", "Projects/", "Areas/", "Resources/", "Archive/")
ROLE_KEY = "note_role"


def path_role(path: Column, roots: tuple[tuple[str, str], ...] = ROLE_ROOTS) -> Column:
    """The role of the longest root that holds the path, or null."""
    found = F.lit(None).cast("string")
    for role, root in sorted(roots, key=lambda x: len(x[1])):
        found = F.when((path == root.rstrip("/")) | path.startswith(root), F.lit(role)).otherwise(found)
    return found


def role_rank(role: Column) -> Column:
    found = F.lit(3)
    for name, rank in ROLE_RANK.items():
        found = F.when(role == name, F.lit(rank)).otherwise(found)
    return found


def markers(metadata: DataFrame, role_key: str = ROLE_KEY) -> DataFrame:
    """path, value (folded and stripped) of each role marker."""
    return metadata.filter(F.lower("key") == role_key).select("path", T.fold(T.strip(F.col("value"))).alias("value"))


def note_roles(notes: DataFrame, metadata: DataFrame, role_key: str = ROLE_KEY) -> DataFrame:
    """path, role: the first valid marker, else source."""
    valid = markers(metadata, role_key).filter(F.col("value").isin(*ROLE_VALUES)).groupBy("path").agg(F.min("value").alias("marked"))
    return notes.select("path").join(valid, "path", "left").select("path", F.coalesce("marked", F.lit("source")).alias("role"))


def role_invalid(metadata: DataFrame, role_key: str = ROLE_KEY) -> DataFrame:
    """path, invalid_values: notes with a marker that is no role."""
    wrong = markers(metadata, role_key).filter(~F.col("value").isin(*ROLE_VALUES))
    return wrong.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("invalid_values"))


def role_missing(docs: DataFrame, metadata: DataFrame, role_key: str = ROLE_KEY) -> DataFrame:
    """path, role_hint of search documents without any marker."""
    from quillgraph.operators.facts import umbrella_document

    return docs.join(markers(metadata, role_key).select("path").distinct(), "path", "left_anti").select("path", F.when(umbrella_document(), "umbrella").otherwise("source").alias("role_hint"))


def archived(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda x: T.fold(x).isin("archive", "archives"))


def para_ancestors(paths: DataFrame) -> DataFrame:
    """path, ancestor, depth: folders below Projects, Areas and Resources that hold the path."""
    parts = F.split(T.parent(F.col("path")), "/")
    inside = paths.filter(F.get(parts, F.lit(0)).isin("Projects", "Areas", "Resources") & (F.size(parts) >= 2))
    each = inside.select("path", parts.alias("parts"), F.explode(F.sequence(F.lit(2), F.size(parts))).alias("n"))
    return each.select("path", F.concat(F.array_join(F.slice("parts", F.lit(1), F.col("n")), "/"), F.lit("/")).alias("ancestor"), (F.col("n") - 1).alias("depth"))


def dir_source_counts(paths: DataFrame) -> DataFrame:
    """dir, direct_count, total_count of notes directly in and anywhere below each folder."""
    parts = F.split(T.parent(F.col("path")), "/")
    inside = paths.filter(F.col("path").contains("/"))
    each = inside.select(parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"))
    dirs = each.select(F.concat(F.array_join(F.slice("parts", F.lit(1), F.col("n")), "/"), F.lit("/")).alias("dir"), (F.col("n") == F.size("parts")).alias("direct"))
    return dirs.groupBy("dir").agg(F.count_if("direct").alias("direct_count"), F.count(F.lit(1)).alias("total_count"))
