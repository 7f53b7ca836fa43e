"""Shared plumbing of the corpus operators: tables, shared scratch space, column helpers."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that end a word.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="quillgraph-code-")) / "quillgraph.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or in a local
    session without that setting a temporary folder, which is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scopes = threading.local()


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Gathers the paths of the tables that materialize() writes inside, for the caller to delete() them once
    nothing reads them any more; those written with keep=True belong to the next scope outside."""
    stack = _scopes.__dict__.setdefault("stack", [])
    made: list[str] = []
    stack.append(made)
    try:
        yield made
    finally:
        # By identity: lists of equal paths, as of two scopes that are still empty, are different scopes.
        del stack[next(i for i, x in enumerate(stack) if x is made)]


def materialize(df: DataFrame, name: str, by: list[str] | None = None, keep: bool = False) -> DataFrame:
    """Writes df once to the shared folder and reads it back, which cuts its lineage: a lost
    executor costs a reread of files, never a recomputation. keep: as the result of a scratch() scope."""
    spark = df.sparkSession
    path = new_path(spark, name)
    stack = _scopes.__dict__.get("stack", [])
    if len(stack) > keep:
        stack[-1 - keep].append(path)
    writer = df.write
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)
    # What was shuffled for it is no longer needed; Spark deletes it when the driver's collector finds it unused.
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row: a lambda's argument is never inlined
    into the lambdas below it, as a projected column can be."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The maximal runs of characters other than the six ASCII spaces; none for null."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def _kth_largest(df: DataFrame, value: Column, k: int) -> int:
    """The largest v that at least k rows reach; values are from 0 to 2**63 - 1 and there are k rows. Twelve bits a
    time: each pass counts rows by the next digits of those that agree so far, at most 4096 rows in the driver."""
    v = df.select(value.cast("long").alias("v"))
    above, prefix = 0, 0
    shift = max(0, int(v.agg(F.max("v")).first()[0]).bit_length() - 12)
    while True:
        digits = sorted(((r[0], r[1]) for r in v.groupBy(F.shiftright("v", shift).alias("d")).count().collect()), reverse=True)
        for prefix, n in digits:  # noqa: B007
            if above + n >= k:
                break
            above += n
        if shift == 0:
            return prefix
        v = v.filter(F.shiftright("v", shift) == prefix)
        shift = max(0, shift - 12)


def most_frequent(counts: DataFrame, key: str, n: str, limit: int) -> DataFrame:
    """The `limit` rows of the highest counts n (all rows if there are no more than that); of those that tie at the
    end the ones whose key has the highest hash. Both cuts are found digit by digit, so nothing is sorted or
    gathered in one task; keys are different longs."""
    if counts.count() <= limit:
        return counts
    if limit < 1:
        return counts.limit(0)
    least = _kth_largest(counts, F.col(n), limit)
    more = counts.filter(F.col(n) > least)
    ties = counts.filter(F.col(n) == least)
    wanted = limit - more.count()
    if ties.count() <= wanted:
        return more.unionByName(ties)
    tie = F.xxhash64(key).bitwiseAND((1 << 63) - 1)
    return more.unionByName(ties.filter(tie >= _kth_largest(ties, tie, wanted)))
