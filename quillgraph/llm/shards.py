"""A table of immutable Parquet shards with size-tiered compaction and versioned manifests.

Arrivals become small shards that are never changed. Compaction merges shards of a similar size into
files of a target size. What the table holds is what its newest manifest lists; a manifest is written
beside and renamed to its version's name, which fails where that version exists, so a commit happens
as a whole or not at all, and of two writers one has to try again. Data moves through DataFrame reads
and writes alone; the driver handles file names, sizes and counts.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.sources.atomic import AlreadyThere, create_once


@dataclass(frozen=True)
class Tiers:
    target_bytes: int = 128 << 20
    #: Shards of a tier that are merged at least; a tier's sizes are within this factor.
    fan_in: int = 4
    #: Below this, sizes are one tier.
    least_bytes: int = 1 << 20
    #: Rows of an arriving shard at most.
    arrival_rows: int = 4096
    #: Merged files that one job writes at most.
    job_files: int = 64

    def tier(self, size: int) -> int:
        return 0 if size <= self.least_bytes else 1 + int(math.log(size / self.least_bytes, self.fan_in))


class ConcurrentCommit(RuntimeError):
    pass


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, tiers: Tiers = Tiers()):
        self.spark, self.root, self.tiers = spark, root.rstrip("/"), tiers
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def version(self) -> int:
        """The newest committed version; 0 for none."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return 0
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        return max((int(x[1:-5]) for x in names if x.startswith("v") and x.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        if v == 0:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{v:010d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, base: dict, shards: list[dict], schema: str | None) -> int:
        version = base["version"] + 1
        content = json.dumps({"version": version, "schema": schema, "shards": shards}).encode()
        try:
            create_once(self.spark, f"{self.root}/manifests/v{version:010d}.json", content)
        except AlreadyThere as e:
            raise ConcurrentCommit(f"version {version} exists") from e
        return version

    def _written(self, folder: str, rows: bool = True) -> list[dict]:
        """The files that a write left in the folder, with bytes and rows. Without rows there may be no file."""
        files = {x.getPath().toString(): x.getLen() for x in self._fs.listStatus(self._path(folder)) if x.getPath().getName().startswith("part-")}
        if not files:
            return []
        counts = self.spark.read.parquet(folder).groupBy(F.col("_metadata.file_name").alias("f")).count().collect()
        count = {r["f"]: r["count"] for r in counts}
        return [{"path": p, "bytes": n, "rows": count.get(p.rpartition("/")[2], 0)} for p, n in sorted(files.items()) if count.get(p.rpartition("/")[2], 0)]

    def append(self, df: DataFrame) -> int:
        """Adds the rows of df as new small shards; returns the version. The first append sets the schema;
        later ones must have its columns, in any order. An empty df commits a version without new shards."""
        base = self.manifest()
        if base["schema"]:
            schema = T.StructType.fromJson(json.loads(base["schema"]))
            df = df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema])
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", self.tiers.arrival_rows).parquet(folder)
        return self._retry(base, [], self._written(folder), base["schema"] or df.schema.json())

    def _retry(self, base: dict, gone: list[dict], new: list[dict], schema: str | None) -> int:
        drop = {x["path"] for x in gone}
        while True:
            if not drop <= {x["path"] for x in base["shards"]}:
                raise ConcurrentCommit("shards to merge are gone")
            try:
                return self._commit(base, [x for x in base["shards"] if x["path"] not in drop] + new, base["schema"] or schema)
            except ConcurrentCommit:
                base = self.manifest()

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Groups to merge: of each tier with at least fan_in shards below the target size, ascending by
        size, as many as fit the target."""
        tiers: dict[int, list[dict]] = {}
        for x in sorted(shards, key=lambda x: (x["bytes"], x["path"])):
            if x["bytes"] < self.tiers.target_bytes // 2:
                tiers.setdefault(self.tiers.tier(x["bytes"]), []).append(x)
        groups = []
        for _, members in sorted(tiers.items()):
            if len(members) < self.tiers.fan_in:
                continue
            group: list[dict] = []
            held = 0
            for x in members:
                if group and held + x["bytes"] > self.tiers.target_bytes:
                    groups.append(group)
                    group, held = [], 0
                group.append(x)
                held += x["bytes"]
            if len(group) > 1:
                groups.append(group)
        return [g for g in groups if len(g) > 1]

    def compact(self) -> bool:
        """Merges what plan() finds and commits; whether there was anything. A group is read and written by
        one task without a shuffle; what it reads is bounded by the target size."""
        base = self.manifest()
        groups = self.plan(base["shards"])[: self.tiers.job_files]
        if not groups:
            return False
        schema = T.StructType.fromJson(json.loads(base["schema"]))
        merged = None
        for g in groups:
            one = self.spark.read.schema(schema).parquet(*[x["path"] for x in g]).coalesce(1)
            merged = one if merged is None else merged.union(one)
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        merged.write.parquet(folder)
        new = self._written(folder)
        gone = [x for g in groups for x in g]
        if sum(x["rows"] for x in new) != sum(x["rows"] for x in gone):
            raise RuntimeError("a merge lost or made rows; nothing was committed")
        self._retry(base, gone, new, base["schema"])
        return True

    def compact_all(self) -> int:
        """Compacts until no tier is due; each round's replaced files go at once. Returns the rounds."""
        rounds = 0
        while self.compact():
            rounds += 1
            self.vacuum(keep=1)
        return rounds

    def vacuum(self, keep: int = 1) -> int:
        """Deletes manifests but the newest `keep`, and files that none of those lists, of versions before
        the newest. Run it when no older version is being read and no append is under way."""
        newest = self.version()
        versions = range(max(1, newest - keep + 1), newest + 1)
        live = {x["path"] for v in versions for x in self.manifest(v)["shards"]}
        gone = 0
        for v in range(versions.start - 1, 0, -1):
            p = self._path(f"{self.root}/manifests/v{v:010d}.json")
            if not self._fs.exists(p):
                break
            for x in self.manifest(v)["shards"]:
                if x["path"] not in live:
                    gone += bool(self._fs.delete(self._path(x["path"]), False))
            self._fs.delete(p, False)
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        m = self.manifest(version)
        if not m["schema"]:
            raise ValueError("nothing was appended yet")
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        if not m["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[x["path"] for x in m["shards"]])


ORACLE_SQL = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"
