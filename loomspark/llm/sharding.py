"""Sharding with size-tiered compaction.

A store is a folder of immutable Parquet shards and of numbered manifests.
An arrival is appended as small shards; when a tier (shards whose sizes share
a power of ``fanout``) holds ``fanout`` shards or more, they are merged into
shards of the target size. Only a manifest makes shards part of the store: it
is written aside and renamed to ``v{n}.json``, which fails if that version is
there already, so a reader always sees one whole version and one of two
writers loses. Shards of a lost attempt are never listed; ``vacuum`` removes
them. Each file to be made is one task that reads as many shards as make up the
target size (the scan packs them, nothing is shuffled), and all merges of a round
are one Spark job.

A store's columns are those of all its arrivals: a shard without one of them
reads as null there. An arrival whose column has another type than before, or
a name that differs only in case, is refused before anything is written.
Nulls, empty and long texts, repeated rows and ties are kept as they are, and
columns of any name; an arrival without rows commits a version without new
shards. The driver handles a line for each shard, never rows: about 100,000
lines at 100 TB in shards of 1 GB, for which ``target_bytes`` is there.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from loomspark.llm._common import hadoop_path, shared_dir


def merged_schema(old: StructType, new: StructType) -> StructType:
    """The columns of both, the old ones first; ValueError if a column's types differ or names differ only in case."""
    known = {f.name.lower(): f for f in old.fields}
    more = []
    for f in new.fields:
        before = known.setdefault(f.name.lower(), f)
        if before is f:
            more.append(StructField(f.name, f.dataType))
        elif (before.name, before.dataType.simpleString()) != (f.name, f.dataType.simpleString()):
            raise ValueError(f"column {f.name} {f.dataType.simpleString()}: the store has {before.name} {before.dataType.simpleString()}")
    return StructType([*old.fields, *more])


class ShardStore:
    def __init__(self, spark: SparkSession, path: str | None = None, target_bytes: int = 128 << 20, fanout: int = 4):
        self.spark, self.target_bytes, self.fanout = spark, target_bytes, fanout
        self.path = path or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
        self._fs, self._root = hadoop_path(spark, self.path)
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    # -- manifests ----------------------------------------------------------------------------

    def version(self) -> int:
        """Of the newest manifest; 0: none."""
        if not self._fs.exists(self._at("manifest")):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("manifest"))]
        return max([int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")], default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._at(f"manifest/v{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, base: dict, shards: list[dict], schema: str | None) -> dict:
        new = {"version": base["version"] + 1, "schema": schema or base["schema"], "shards": shards}
        aside = self._at(f"manifest/_{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        stream.write(json.dumps(new).encode())
        stream.close()
        context = self._hadoop.FileContext.getFileContext(self._root.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        options[0] = self._hadoop.Options.Rename.NONE
        context.rename(aside, self._at(f"manifest/v{new['version']}.json"), options)  # raises if another writer was first
        return new

    # -- writing ------------------------------------------------------------------------------

    def _write(self, df: DataFrame) -> list[dict]:
        """Immutable shards of a data frame's partitions, as lines of a manifest."""
        run = uuid.uuid4().hex[:12]
        df.write.parquet(f"{self.path}/data/{run}")
        out = []
        for s in self._fs.listStatus(self._at(f"data/{run}")):
            name = s.getPath().getName()
            if name.endswith(".parquet") and s.getLen():
                out.append({"file": f"data/{run}/{name}", "bytes": s.getLen()})
        return sorted(out, key=lambda x: x["file"])

    def append(self, df: DataFrame) -> dict:
        base = self.manifest()
        schema = merged_schema(StructType.fromJson(json.loads(base["schema"])) if base["schema"] else StructType(), df.schema)
        return self._commit(base, base["shards"] + self._write(df), schema.json())

    def tier(self, shard: dict) -> int:
        return int(math.log(max(shard["bytes"], 1), self.fanout))

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Runs to merge: shards under the target, of one tier, if there are ``fanout`` of them."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target_bytes // 2:
                tiers.setdefault(self.tier(s), []).append(s)
        return [run for _, run in sorted(tiers.items()) if len(run) >= self.fanout]

    def _packing(self) -> SparkSession:
        """A session of the same application whose scans pack files into partitions of the target size at most."""
        own = self.spark.newSession()
        own.conf.set("spark.sql.files.maxPartitionBytes", str(self.target_bytes))
        own.conf.set("spark.sql.files.openCostInBytes", "0")
        own.conf.set("spark.sql.files.minPartitionNum", "1")
        return own

    def compact(self) -> dict:
        """Merge tier after tier until no run is left; each round commits a version."""
        now = self.manifest()
        while runs := self.plan(now["shards"]):
            gone = {s["file"] for run in runs for s in run}
            merged = self._write(self.read_files(sorted(gone), now["schema"], self._packing()))
            kept = [s for s in now["shards"] if s["file"] not in gone]
            if len(kept) + len(merged) >= len(now["shards"]):
                break  # the files can't get fewer
            now = self._commit(now, kept + merged, None)
        return now

    def vacuum(self, keep_versions: int = 1) -> None:
        """Remove older manifests, and the data that none of the kept ones lists; not while others write."""
        last = self.version()
        listed = {s["file"] for v in range(max(1, last - keep_versions + 1), last + 1) for s in self.manifest(v)["shards"]}
        for v in range(1, last - keep_versions + 1):
            self._fs.delete(self._at(f"manifest/v{v}.json"), False)
        if self._fs.exists(self._at("data")):
            for run in self._fs.listStatus(self._at("data")):
                name = run.getPath().getName()
                if not any(f.startswith(f"data/{name}/") for f in listed):
                    self._fs.delete(run.getPath(), True)

    # -- reading ------------------------------------------------------------------------------

    def read_files(self, files: list[str], schema: str, session: SparkSession | None = None) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        if not files:
            return self.spark.createDataFrame([], kind)
        return (session or self.spark).read.schema(kind).parquet(*[f"{self.path}/{f}" for f in files])

    def read(self, version: int | None = None, shard_column: str | None = None) -> DataFrame:
        """All rows of a version; shard_column: also the shard's name."""
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError("nothing has been appended")
        df = self.read_files([s["file"] for s in m["shards"]], m["schema"])
        if shard_column and m["shards"]:
            df = df.select("*", F.col("_metadata.file_name").alias(shard_column))
        return df
