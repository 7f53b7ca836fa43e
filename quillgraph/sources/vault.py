"""Folders of notes as DataFrames.

Spark's file reader leaves out names that start with a dot or an underscore, and files of no bytes; such notes
are not read.
Other exclusions and patterns are filters on the listing, so that only what is kept is opened.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T


@dataclass(frozen=True)
class VaultConfig:
    root: str
    exclude: tuple[str, ...] = (".obsidian/", ".trash/", "Archive/")
    patterns: tuple[str, ...] = ("*.md", "*.canvas", "*.json", "*.yml", "*.yaml", "*.csv")


def listing(spark: SparkSession, config: VaultConfig) -> DataFrame:
    """path (relative), extension, size_bytes, mtime, is_markdown; contents are not read."""
    root = config.root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://", 1)[-1].lstrip("/")
    path = F.regexp_replace(F.col("path"), rf"^[A-Za-z]+:/*\Q{base}\E/", "")
    files = found.select(path.alias("path"), F.col("length").alias("size_bytes"), F.unix_micros("modificationTime").cast("double").alias("micros"), "content")
    kept = files.filter(~T.excluded(F.col("path"), config.exclude) & T.matches_patterns(F.col("path"), config.patterns))
    ext = F.lower(T.suffix(F.col("path")))
    return kept.select("path", ext.alias("extension"), "size_bytes", (F.col("micros") / 1e6).alias("mtime"), ext.isin(".md", ".markdown").alias("is_markdown"), "content")


def inventory(listed: DataFrame) -> DataFrame:
    """The files table with content hashes and whether a note is empty."""
    text = note_text(F.col("content"))
    return listed.select("path", "extension", "size_bytes", "mtime", F.sha2("content", 256).alias("sha256"), (F.col("is_markdown") & (T.strip(text) == "")).alias("is_empty_note"), "is_markdown")


def note_text(content):
    """Bytes as text: bad bytes replaced, line ends as line feeds."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def notes(listed: DataFrame) -> DataFrame:
    """path, text, mtime of Markdown files."""
    return listed.filter("is_markdown").select("path", note_text(F.col("content")).alias("text"), "mtime")


def directories(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), children: every directory below the root and how many entries it has, hidden ones too. The
    driver lists them, as it does for a read."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, left = [], [("", top)]
    while left:
        name, path = left.pop()
        entries = fs.listStatus(path)
        if name:
            found.append((name, len(entries)))
        left += [(f"{name}{e.getPath().getName()}/", e.getPath()) for e in entries if e.isDirectory()]
    return spark.createDataFrame(found, "path string, children int")
