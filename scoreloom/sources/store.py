"""A table with one row per key that batches change: merged by key, and each batch committed once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scoreloom.operators.flow import saved
from scoreloom.sources.commits import Versions

STATE = "respondent_id long, answers string, email string, discord string, unlocked boolean"


class KeyedStore:
    """Rows by key in Parquet folders by a hash of the key. The newest manifest names the folder of each part, and for each stream its
    last batch: a batch that is run again changes nothing, and one that broke off before its commit has changed nothing.

    A batch rewrites the parts that its keys are in and no others; `parts` is fixed when the store is made, for parts of some hundred MB.
    combine(stored, changes) makes the new rows from those stored and at most one change per key; the default is flow.saved, which
    overwrites answers and unlocked and doesn't write a blank email or discord. One stream writes a part at a time: of two writers the
    slower one gets a RuntimeError and runs its batch again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str = STATE, key: str = "respondent_id", parts: int = 64, combine: Callable[[DataFrame, DataFrame], DataFrame] = saved):
        self.spark, self.path, self.key, self.combine = spark, path.rstrip("/"), key, combine
        self.schema, self._manifests = StructType.fromDDL(schema), Versions(spark, f"{path.rstrip('/')}/manifests")
        self.parts = (self._manifests.newest()[1] or {}).get("parts", parts)

    def _part(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default of the newest; none before the first."""
        document = self._manifests.newest()[1] if version is None else self._manifests.read(version)
        return self._rows((document or {"folders": {}})["folders"].values())

    def _rows(self, folders) -> DataFrame:
        names = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(self.schema).parquet(*names) if names else self.spark.createDataFrame([], self.schema)

    def merge(self, changes: DataFrame, batch_id: int, stream: str = "default", order: tuple[str, ...] = ("ts", "event_id")) -> int:
        """Merge changes (the store's columns and those of `order`) as a batch of a stream; the newest version, unchanged if that batch is in it.

        Of several changes of one key the last by `order` counts; what an earlier one says is not merged.
        """
        version, document = self._manifests.newest()
        document = document or {"parts": self.parts, "folders": {}, "batches": {}}
        if document["batches"].get(stream, -1) >= batch_id:
            return version
        own = [f.name for f in self.schema if f.name != self.key]
        last = changes.groupBy(self.key).agg(F.max_by(F.struct(*own), F.struct(*order)).alias("x")).select(self.key, "x.*").withColumn("_part", self._part()).persist()
        try:
            touched = [str(r[0]) for r in last.select("_part").distinct().collect()]  # at most `parts`
            stored = self._rows([document["folders"][p] for p in touched if p in document["folders"]])
            merged = self.combine(stored, last.drop("_part")).select(*self.schema.names).withColumn("_part", self._part())
            folder = f"data/{uuid.uuid4().hex}"
            merged.write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        finally:
            last.unpersist()
        new = document | {"folders": document["folders"] | {p: f"{folder}/_part={p}" for p in touched}, "batches": document["batches"] | {stream: batch_id}}
        if not self._manifests.commit(version + 1, new):
            raise RuntimeError(f"another writer committed version {version + 1} of {self.path}")
        return version + 1

    def sink(self, stream: str = "default", order: tuple[str, ...] = ("ts", "event_id")) -> Callable[[DataFrame, int], None]:
        """For foreachBatch."""

        def write(df: DataFrame, batch_id: int) -> None:
            self.merge(df, batch_id, stream, order)

        return write
