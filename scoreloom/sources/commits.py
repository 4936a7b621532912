"""Small files that are written whole or not at all: versioned manifests and marks of what is done, on any file system that Spark reaches."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Versions:
    """JSON documents by version in a folder; the highest one counts. Of two writers of one version one wins, by an atomic rename."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._at(self.path)
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def newest(self) -> tuple[int, dict | None]:
        """(version, document); (0, None) if there is none."""
        found = self.versions()
        return (found[-1], self.read(found[-1])) if found else (0, None)

    def read(self, version: int) -> dict:
        return json.loads(self.spark.read.option("wholetext", True).text(self._name(version)).head()[0])

    def commit(self, version: int, document: dict) -> bool:
        """Whether the document is that version's now; False if another one is."""
        held = self._at(f"{self.path}/.{uuid.uuid4().hex}")
        out = self._fs.create(held, False)
        out.write(bytearray(json.dumps(document).encode()))
        out.close()
        name = self._at(self._name(version))
        if not self._fs.exists(name) and self._fs.rename(held, name):
            return True
        self._fs.delete(held, False)
        return False

    def _name(self, version: int) -> str:
        return f"{self.path}/v{version:012d}.json"
