"""The persisted index of a vault: versions of its notes table and the tables derived from it, as Parquet.

Notes are dealt into buckets by their path. A refresh compares files by size and time with the last version; only
files that differ are hashed, and only those with another hash are parsed. Buckets without a change are taken over
as they are; the others are written anew. A version is committed by creating its manifest, which must not be there yet,
so of two writers one fails. Older versions' files stay until vacuum(), so their readers are not disturbed.
"""

from __future__ import annotations

import json
import tempfile
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import facts, maintenance
from quillgraph.sources.atomic import AlreadyThere, create_once

SCHEMA_VERSION = 1


class StaleIndex(Exception):
    """Another writer committed the version first, or the stored tables are of another schema."""


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in a local session without it a temporary folder, which is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def file_row(text: Column) -> tuple[Column, Column]:
    """size_bytes and sha256 of a note's text."""
    return F.octet_length(text).alias("size_bytes"), F.sha2(text.cast("binary"), 256).alias("sha256")


class VaultStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        folder = self._at(f"{self.path}/manifests")
        return sorted(int(name[1:-5]) for f in self._fs.listStatus(folder) if (name := f.getPath().getName()).startswith("v")) if self._fs.exists(folder) else []

    def meta(self, version: int | None = None) -> dict | None:
        """version, previous, schema, scanned_at, the scan's counters and each bucket's folder; None if nothing is stored."""
        have = self.versions()
        if version is None:
            if not have:
                return None
            version = have[-1]
        read = self.spark.read.option("wholetext", "true").text(f"{self.path}/manifests/v{version}.json")
        found = json.loads(read.first()[0])
        if found["schema"] != SCHEMA_VERSION:
            raise StaleIndex(f"version {version} has schema {found['schema']}, this is {SCHEMA_VERSION}")
        return found

    def notes(self, version: int | None = None) -> DataFrame | None:
        """path, text, mtime and other columns of the source, size_bytes, sha256, the parsed facts; None if nothing is
        stored. Readers prune what they don't use."""
        meta = self.meta(version)
        if meta is None:
            return None
        schema = self.spark.read.parquet(f"{self.path}/empty").schema
        folders = [f"{self.path}/{x}" for x in meta["folders"].values()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def refresh(self, source: DataFrame) -> dict:
        """Brings the index to the state of source (path, text, mtime, other columns) and returns the new version's meta. Paths
        are unique and not null. A file whose size and time are as stored is neither hashed nor parsed; one that was only
        touched keeps its facts. No change at all still commits a version, with its counters."""
        meta, at = self.meta(), time.time()
        version = (meta["version"] if meta else 0) + 1
        current = source.withColumn("size_bytes", F.octet_length("text"))
        bucket = F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")
        written = f"data/v{version}"
        if meta is None:
            parsed = facts.parse(current.withColumn("sha256", file_row(F.col("text"))[1]))
            parsed.limit(0).write.mode("ignore").parquet(f"{self.path}/empty")
            affected = list(range(self.buckets))
            fresh = parsed
            counters = None
        else:
            stored = self.notes()
            narrow = ("path", "size_bytes", "mtime")
            hashed = current.join(stored.select(*[F.col(c).alias(f"_{c}") for c in (*narrow, "sha256")]), F.col("path") == F.col("_path"), "left")
            same = (F.col("size_bytes") == F.col("_size_bytes")) & F.col("mtime").eqNullSafe(F.col("_mtime"))
            hashed = hashed.withColumn("sha256", F.when(same, F.col("_sha256")).otherwise(file_row(F.col("text"))[1]))
            delta_path = f"{self.path}/{written}-delta"
            thin = hashed.select(*narrow, "sha256")
            maintenance.scan_delta(thin, stored).write.parquet(delta_path)
            delta = self.spark.read.parquet(delta_path)
            counters = maintenance.scan_counters(delta).first().asDict()
            # At most `buckets` numbers.
            affected = [r[0] for r in delta.filter("change <> 'unchanged'").select(bucket.alias("b")).distinct().collect()]
            old = stored.withColumn("b", bucket).filter(F.col("b").isin(affected)).drop("b")
            again = delta.filter("reparse").select("path")
            touched = delta.filter("change = 'changed' and not reparse").select("path")
            moved = old.drop("mtime").join(current.select("path", "mtime").join(touched, "path", "left_semi"), "path")
            kept = old.join(delta.filter("change = 'unchanged'").select("path"), "path", "left_semi")
            changed = facts.parse(current.join(again, "path", "left_semi").withColumn("sha256", file_row(F.col("text"))[1]))
            fresh = kept.unionByName(moved.select(*kept.columns)).unionByName(changed.select(*kept.columns))
        fresh.withColumn("b", bucket).write.partitionBy("b").parquet(f"{self.path}/{written}")
        folders = {k: v for k, v in (meta["folders"] if meta else {}).items() if int(k) not in set(affected)}
        folders |= {str(b): f"{written}/b={b}" for b in affected if self._fs.exists(self._at(f"{self.path}/{written}/b={b}"))}
        made = {"version": version, "previous": meta["version"] if meta else None, "schema": SCHEMA_VERSION, "scanned_at": at, "folders": folders}
        if counters is None:
            n = self.spark.read.parquet(f"{self.path}/{written}").count() if folders else 0
            counters = {"file_count": n, "changed_count": n, "deleted_count": 0, "unchanged_count": 0}
        self._commit(made | counters)
        return made | counters

    def _commit(self, made: dict) -> None:
        try:
            create_once(self.spark, f"{self.path}/manifests/v{made['version']}.json", json.dumps(made).encode())
        except AlreadyThere as e:
            raise StaleIndex(f"version {made['version']} is there already") from e

    def derived(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        """A table that follows from the last version's notes: written when it is first asked for, then read."""
        path = f"{self.path}/derived/v{self.versions()[-1]}/{name}"
        if not self._fs.exists(self._at(f"{path}/_SUCCESS")):
            writer = df.write.mode("overwrite")
            (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.parquet(path)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes manifests, derived tables and files of all but the last `keep` versions; the number of versions gone."""
        have = self.versions()
        gone, left = have[: max(0, len(have) - keep)], have[max(0, len(have) - keep) :]
        used = {x.split("/b=")[0] for v in left for x in self.meta(v)["folders"].values()}
        for v in gone:
            for place in [f"manifests/v{v}.json", f"derived/v{v}", f"data/v{v}-delta"] + ([f"data/v{v}"] if f"data/v{v}" not in used else []):
                self._fs.delete(self._at(f"{self.path}/{place}"), True)
        return len(gone)


_built: dict[tuple, str] = {}


def stored_notes(spark: SparkSession, key: str, files: str, source: DataFrame) -> VaultStore:
    """The session's index of a source: built when it is first asked for, and again when `files` (a file or folder of
    Parquet) has changed, which its size and time tell."""
    path = spark._jvm.org.apache.hadoop.fs.Path(files)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    stats = fs.listStatus(path)
    stamp = (spark.sparkContext.applicationId, key, len(stats), sum(f.getLen() for f in stats), max([f.getModificationTime() for f in stats], default=0))
    store = VaultStore(spark, _built[stamp]) if stamp in _built else None
    if store is None or not store.versions():
        store = VaultStore(spark, f"{shared_folder(spark)}/vault-{abs(hash(stamp)):x}-{time.time_ns():x}")
        store.refresh(source)
        _built[stamp] = store.path
    return store
