"""A table of immutable shards with size-tiered compaction and versioned manifests, in DataFrame functions only."""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructField, StructType


def merged_schema(old: str | None, new: StructType) -> StructType:
    """The columns of old (JSON; None: no table yet) and after them those of new that it lacks. ValueError if one has two types or spellings."""
    found = {f.name.lower(): f for f in StructType.fromJson(json.loads(old))} if old else {}
    for f in new:
        there = found.setdefault(f.name.lower(), StructField(f.name, f.dataType, True))
        if (there.name, there.dataType) != (f.name, f.dataType):
            raise ValueError(f"column {f.name} is {f.dataType.simpleString()}, and {there.name} was {there.dataType.simpleString()}")
    return StructType(list(found.values()))


class ShardTable:
    """Rows in runs: folders of Parquet shards that never change. What counts is in the manifest of the highest version.

    A manifest is one small file that lists runs, not rows or shards. It is written under a name of its own and renamed to
    its version; the rename fails if that version exists, so of two writers one wins and the other starts from the new version.
    Readers of a version see all of it or nothing, until `vacuum` deletes that version; merging deletes nothing. Runs that no manifest
    names, such as those of a writer that died, are never read.

    Rows are stored as they are: null or very long values, repeated rows, and columns of any name. A table to which only empty tables
    were appended has no run, but its columns are known.

    target_bytes: of files that merging makes. fan_in: so many runs of one tier are merged into one. Tiers are powers of fan_in
    times first_bytes, so each row is rewritten once per tier at most.
    """

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 64 << 20, fan_in: int = 4, first_bytes: int = 1 << 20):
        self.spark, self.path, self.target_bytes, self.fan_in, self.first_bytes = spark, path.rstrip("/"), target_bytes, fan_in, first_bytes
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))

    def versions(self) -> list[int]:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.path}/manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default of the newest; that of version 0 is empty."""
        version = max([0, *self.versions()]) if version is None else version
        if version == 0:
            return {"version": 0, "runs": [], "schema": None}
        rows = self.spark.read.option("wholetext", True).text(f"{self.path}/manifests/v{version:012d}.json").head(1)
        return json.loads(rows[0][0])

    def _commit(self, version: int, runs: list[dict], schema: str | None) -> bool:
        held = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(held, False)
        out.write(bytearray(json.dumps({"version": version, "runs": runs, "schema": schema}).encode()))
        out.close()
        name = self._path(f"{self.path}/manifests/v{version:012d}.json")
        if not self._fs.exists(name) and self._fs.rename(held, name):
            return True
        self._fs.delete(held, False)
        return False

    def _run(self, folder: str, rows: int) -> dict:
        size = self._fs.getContentSummary(self._path(f"{self.path}/{folder}")).getLength()
        return {"folder": folder, "bytes": size, "rows": rows}

    def _write(self, df: DataFrame) -> dict:
        folder, seen = f"data/{uuid.uuid4().hex}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return self._run(folder, seen.get["rows"])

    def _add(self, runs: list[dict], schema: StructType) -> int:
        while True:
            now = self.manifest()
            if self._commit(now["version"] + 1, [*now["runs"], *runs], merged_schema(now["schema"], schema).json()):
                return now["version"] + 1

    def append(self, df: DataFrame) -> int:
        """Write df as a run of small shards, as its partitions are, and commit it; the new version.

        The table has all columns that any append had: those that a run lacks are null in it. A column of another type than before, or
        whose name differs from an earlier one by case only, raises a ValueError, and nothing is committed.
        """
        merged_schema(self.manifest()["schema"], df.schema)
        return self._add([self._write(df)], df.schema)

    def append_each(self, df: DataFrame, by: str, compact: bool = True) -> int:
        """Append the rows of each value of column `by` as an arrival of its own, in the order of the values, all written by one job over df.

        The column itself isn't stored. Values must be few. Null is the last arrival. Of an empty df only the columns are committed.
        """
        folder, schema = f"data/{uuid.uuid4().hex}", StructType([f for f in df.schema if f.name != by])
        merged_schema(self.manifest()["schema"], schema)
        is_number = isinstance(df.schema[by].dataType, NumericType)
        df.write.option("compression", "zstd").partitionBy(by).parquet(f"{self.path}/{folder}")
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.path}/{folder}")) if x.isDirectory()]
        value = lambda n: n.split("=", 1)[1]
        ranked = [(value(n) == "__HIVE_DEFAULT_PARTITION__", value(n), n) for n in names]
        for _, _, name in sorted(ranked, key=lambda x: (x[0], float(x[1]) if is_number and not x[0] else x[1])):
            rows = self.spark.read.parquet(f"{self.path}/{folder}/{name}").count()
            self._add([self._run(f"{folder}/{name}", rows)], schema)
            if compact:
                self.compact()
        return self.manifest()["version"] if names else self._add([], schema)

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.first_bytes, self.fan_in)) + 1)

    def due(self, runs: list[dict]) -> list[dict]:
        """The oldest fan_in runs of the lowest full tier; none if no tier is full."""
        tiers: dict[int, list[dict]] = {}
        for run in runs:
            tiers.setdefault(self.tier(run["bytes"]), []).append(run)
        return next((tiers[t][: self.fan_in] for t in sorted(tiers) if len(tiers[t]) >= self.fan_in), [])

    def compact(self) -> int:
        """Merge until no tier is full; the newest version. Nothing is deleted.

        A merge reads its runs once and writes files of about target_bytes, without a shuffle. If another writer commits meanwhile,
        the merge is committed on top, as long as its runs are still there.
        """
        while old := self.due(self.manifest()["runs"]):
            files = max(1, math.ceil(sum(r["bytes"] for r in old) / self.target_bytes))
            merged = self._write(self._rows(old, self.manifest()["schema"]).coalesce(files))
            gone = {r["folder"] for r in old}
            while True:
                now = self.manifest()
                if not gone <= {r["folder"] for r in now["runs"]}:
                    break
                stay = [r for r in now["runs"] if r["folder"] not in gone]
                if self._commit(now["version"] + 1, [*stay, merged], now["schema"]):
                    break
        return self.manifest()["version"]

    def vacuum(self, keep_versions: int = 10, grace_seconds: float = 86400) -> list[str]:
        """Delete the manifests older than the newest keep_versions, and what none of the others names, by a writer that died or of old
        versions, if it was last written over grace_seconds ago: a run of a writer at work isn't committed yet. The folders deleted."""
        versions = self.versions()
        named = {r["folder"] for v in versions[-keep_versions:] for r in self.manifest(v)["runs"]}
        before, gone = (time.time() - grace_seconds) * 1000, []
        for v in versions[:-keep_versions]:
            self._fs.delete(self._path(f"{self.path}/manifests/v{v:012d}.json"), False)
        data = self._path(f"{self.path}/data")
        for top in self._fs.listStatus(data) if self._fs.exists(data) else []:
            folder = f"data/{top.getPath().getName()}"
            parts = [f"{folder}/{x.getPath().getName()}" for x in self._fs.listStatus(top.getPath()) if x.isDirectory()]
            used = folder in named or any(p in named for p in parts)
            if top.getModificationTime() < before and folder not in named:
                gone += [p for p in parts if p not in named] if used else [folder]
        for folder in gone:
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)
        return gone

    def _rows(self, runs: list[dict], schema: str) -> DataFrame:
        """Rows of runs; columns that a run lacks are null in its rows."""
        kind = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/{r['folder']}" for r in runs]) if runs else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version. ValueError if nothing was appended yet, as its columns aren't known."""
        found = self.manifest(version)
        if found["schema"] is None:
            raise ValueError(f"nothing in {self.path}")
        return self._rows(found["runs"], found["schema"])
