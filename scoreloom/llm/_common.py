"""What several operators share: the shared folder, word counting and Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The session names that folder in spark.checkpoint.dir. Only where it is unset and everything runs on one machine, as in tests, a
    temporary one is made; a cluster without that setting is refused with a ValueError.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="scoreloom-"))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, checkpointed in the shared folder: later uses neither compute it again nor depend on one executor."""
    shared_dir(df.sparkSession, "")
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: for tables that are better kept in columns."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: With this set, Spark removes the shuffle files of an action when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to Python at once, and so many at most within a run: each task holds such a batch of texts on both sides.
BATCH, MOST_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def deleted(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """The intermediate tables of one run, in a folder of the shared one that is deleted, with all of them, at the end of `with`.

    What outlives the run is written elsewhere before. Within `with` the session removes shuffle files after each action (CLEANUP), so what
    isn't in a table of the run is computed again by a second action; and Arrow batches have MOST_ROWS rows at most. An error deletes the folder too.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None):
        self.spark, self.path, self._tables = spark, path or shared_dir(spark, name), []

    def __enter__(self) -> Scratch:
        self._before = {CLEANUP: self.spark.conf.get(CLEANUP, "false"), BATCH: self.spark.conf.get(BATCH)}
        self.spark.conf.set(CLEANUP, "true")
        if not 0 < int(self._before[BATCH]) <= MOST_ROWS:  # 0 and less: no limit
            self.spark.conf.set(BATCH, str(MOST_ROWS))
        return self

    def __exit__(self, *_) -> None:
        for name, value in self._before.items():
            self.spark.conf.set(name, value)
        deleted(self.spark, self.path)

    def part(self) -> Scratch:
        """For tables that are needed in a part of the run only."""
        return Scratch(self.spark, "", f"{self.path}/part-of-{uuid.uuid4().hex}")

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._tables.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Deletes what `written` returned here; other frames are left alone. Nothing that is computed later may read them."""
        for table, path in self._tables:
            if any(table is x for x in tables):
                deleted(self.spark, path)
        self._tables = [x for x in self._tables if not any(x[0] is y for y in tables)]


def quoted(name: str) -> str:
    """A column's name as an expression that means just this column, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def map_arrow(df: DataFrame, run, schema: StructType) -> DataFrame:
    """df.mapInArrow(run, schema) for columns of any name: those that it would take for a path or a quotation have another name inside."""
    plain = {c: f"\u2024{k}" for k, c in enumerate(df.columns) if "." in c or "`" in c}
    inner = StructType([StructField(plain.get(f.name, f.name), f.dataType, f.nullable) for f in schema])
    return df.toDF(*[plain.get(c, c) for c in df.columns]).mapInArrow(run, inner).toDF(*schema.names)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_fields(schema: StructType, fields: str) -> StructType:
    """schema and more fields after it, as a new one."""
    return StructType([*schema, *StructType.fromDDL(fields)])


#: Stands for a null doc_id where rows are matched by it: the smallest.
NULL_ID = -(1 << 63)


#: Rows of one doc_id, or of none, may be very many: they are dealt over so many parts (a power of two) by their texts.
PARTS = 1024


def keyed() -> Column:
    return F.coalesce("doc_id", F.lit(NULL_ID)).alias("key")


def part_of() -> Column:
    # never null, so that no join filters it and all share the exchange of the texts
    return F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(PARTS - 1)).cast("int").alias("part")


def numbered(docs: DataFrame) -> DataFrame:
    """(key, part, text, nth, before): doc_id as key (null: NULL_ID), a hash of the text as part, text (null: empty), and a row's number among
    those of its key and part, by text.

    before is null for the first of them. The texts are dealt by key and part alone and with these columns only, so all that use these rows in
    one query share one exchange of the texts, and the rows of one doc_id are as many tasks' as their texts differ. Rows that repeat both
    doc_id and text meet in one task.
    """
    texts = docs.select(keyed(), part_of(), F.coalesce("text", F.lit("")).alias("text"))
    own = Window.partitionBy("key", "part").orderBy("text")
    return texts.withColumn("nth", F.row_number().over(own)).withColumn("before", F.lag(F.lit(1)).over(own))


def id_of(key: Column) -> Column:
    return F.nullif(key, F.lit(NULL_ID))


#: A key is hot if over FEW rows and over one in SHARES rows have it: there are fewer than SHARES hot keys, whatever the size.
FEW, SHARES = 1000, 1000
#: So many tasks share the rows of a hot key.
SALTS = 32


def hot_keys(counts: DataFrame, keys: list[str]) -> list:
    """The hot keys of counts (keys, n), fewer than SHARES rows."""
    total = counts.agg(F.sum("n")).head(1)[0][0] or 0
    return counts.where(F.col("n") > max(FEW, total // SHARES)).select(*keys).collect()


def joined(rows: DataFrame, info: DataFrame, keys: list[str], how: str = "inner", hot: list | None = None) -> DataFrame:
    """rows with the columns of info, which has one row per key at most, however many rows share a key. how: inner, left or left_semi.

    hot: what hot_keys found; by default it is looked for in rows, which are read once more for that. Rows of a hot key are dealt over
    SALTS tasks by a hash of all their columns, and the key's row of info goes to each of these.
    """
    if hot is None:
        hot = hot_keys(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    if not hot:
        return rows.join(info, keys, how)
    few = F.broadcast(rows.sparkSession.createDataFrame(hot, rows.select(*keys).schema).withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.join(few, keys, "left").withColumn("_salt", salt).drop("_hot")
    spread = info.join(few, keys, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return dealt.join(spread, [*keys, "_salt"], how).drop("_salt")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about `limit` bytes of `column` (or a single row). After the last, Arrow's free memory goes back
    to the system, as workers live on."""
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for start, end in zip(cuts, cuts[1:]):
            yield batch.slice(start, end - start)
    batch = None
    pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and the place where each starts (with the end as the last). Null: empty."""
    column = pa.compute.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]
