"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm._common import NULL_ID, kept, n_words, quoted, shuffle_partitions

#: Expected copies are whole multiples of this share of a copy, so that prefix sums are exact in any order of adding.
UNIT = 1 << 32
#: So many of equal rows are numbered at a time.
BLOCK = 1 << 20


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_copies: float = 2.0) -> DataFrame:
    """One row per source of sizes (source, source_size), with its target.

    Sources in code point order, null last, weigh `weights` in turn and share `share` of all sizes. A target stops at max_copies
    times its source's size; the excess goes to the others by weight until none is above. That is min(limit, level * weight) with
    one level for all: in order of limit / weight, the first source that the level of the rest does not lift over its limit sets it.
    The table has a row per source, not per document, and is ordered as a whole.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("ratio", "source_rank")
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1)
    ranked = (
        sizes.withColumn("source_rank", F.row_number().over(by_name))
        .withColumn("weight", weigh)
        .withColumn("limit", F.col("source_size") * F.lit(float(max_copies)))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("all_sizes", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("stopped", F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("own_level", (F.col("all_sizes") * F.lit(float(share)) - F.col("stopped")) / F.col("rest"))
    )
    level = F.min_by(F.when(F.col("own_level") <= F.col("ratio"), F.col("own_level")), F.when(F.col("own_level") <= F.col("ratio"), F.col("ratio"))).over(
        Window.partitionBy()
    )
    target = F.least(F.col("limit"), F.coalesce(level * F.col("weight"), F.col("limit")))
    return ranked.select("source", "source_rank", "source_size", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A source's random offset, 0 to UNIT - 1: 32 bits of a digest of seed and name, so that reruns agree."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\\N")))), 1, 8), 16, 10).cast("long")


def _keys(of: str = "") -> list[Column]:
    """What tells rows apart, without nulls: doc_id, source and a hash of the text; `of` is a prefix of their columns."""
    doc_id, source, text = (F.col(f"{of}{c}") for c in ("doc_id", "source", "text"))
    named = F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))
    return [F.coalesce(doc_id.cast("long"), F.lit(NULL_ID)).alias("key"), named.alias("named"), F.xxhash64(text).alias("version")]


def _units(docs: DataFrame, size: Column, weights: tuple[float, ...], share: float, max_copies: float, seed: int) -> DataFrame:
    """Equal rows (key, named, version, size, n_rows) with their source's numbers, the copies that each of their rows expects (whole,
    and part in 1 / UNIT), and `before`, the part of a copy at which the first of them starts."""
    spark = docs.sparkSession
    narrow = docs.select(*_keys(), "source", size.alias("size"))
    units = kept(narrow.groupBy("key", "named", "version", "source", "size").agg(F.count("*").alias("n_rows")))
    targets = source_targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size")), weights, share, max_copies)
    expected = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.lit(float(UNIT)))).otherwise(0).cast("long")
    targets = kept(targets.withColumn("whole", F.shiftright(expected, 32)).withColumn("part", expected.bitwiseAND(F.lit(UNIT - 1))))
    ranked = units.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    dealt = ranked.repartitionByRange(shuffle_partitions(spark), "source_rank", "size", "key", "version").withColumn("chunk", F.spark_partition_id())
    chunked = kept(dealt.withColumn("parts", F.col("part") * F.col("n_rows")))
    rest = lambda x: x.bitwiseAND(F.lit(UNIT - 1))  # noqa: E731  only what is over a whole copy counts, so sums stay small
    sums = chunked.groupBy("source_rank", "chunk").agg(rest(F.sum("parts")).alias("chunk_sum"))
    earlier = Window.partitionBy("source_rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select("source_rank", "chunk", F.coalesce(F.sum("chunk_sum").over(earlier), F.lit(0)).alias("begin"))
    within = Window.partitionBy("source_rank", "chunk").orderBy("size", "key", "version").rowsBetween(Window.unboundedPreceding, -1)
    before = rest(F.col("begin") + F.coalesce(F.sum("parts").over(within), F.lit(0)) + offset(F.col("source"), seed))
    return chunked.join(begins, ["source_rank", "chunk"]).withColumn("before", before)


def _copies(nth: Column) -> Column:
    """How often the nth of a unit's rows is taken: whole copies, and one more if its part crosses a whole number."""
    upto = F.col("before") + F.col("part") * nth
    return F.col("whole") + F.shiftright(upto, 32) - F.shiftright(upto - F.col("part"), 32)


def mix(
    docs: DataFrame,
    size: Column | None = None,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    max_copies: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """How many copies of each row the mix takes: (doc_id, source, size, source_size, target, copies), a row for each row of docs.

    Every row of a source expects target / source size copies. Within its source, in order of size, those expectations are summed up
    from a random offset on, and a row is taken once for each whole number that its sum crosses: as often as expected, rounded up or
    down. The order by size keeps the words taken near the target: they differ by at most the largest row.

    The prefix sums run in range partitions of (source, size, doc_id, hash of the text), then the few sums of partitions are added up
    by source: a source with most rows is spread over as many tasks as its rows need. Only parts of a copy are summed, as integers, so
    nothing overflows as long as a partition has fewer than 2**31 rows.

    Equal rows are counted first, and each has its own place in the sums. Null doc_id and source are values like others. A null or
    empty text has size 0. Sources without a word have target 0 and are never taken. An empty table gives no row.
    """
    units = _units(docs, n_words(F.col("text")) if size is None else size, weights, share, max_copies, seed)
    # in two steps, so that no array is longer than BLOCK, however many equal rows there are
    blocks = units.withColumn("block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"), F.lit(BLOCK).cast("long"))))
    each = blocks.withColumn("nth", F.explode(F.sequence("block", F.least("n_rows", F.col("block") + BLOCK - 1))))
    return each.select(F.nullif("key", F.lit(NULL_ID)).alias("doc_id"), "source", "size", "source_size", "target", _copies(F.col("nth")).alias("copies"))


def taken_rows(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_copies: float = 2.0, seed: int = 7) -> DataFrame:
    """The mix itself: each row of docs as often as `mix` takes it, with the columns of docs, whatever their names.

    Rows with one doc_id, source and text are numbered by a hash of all their columns. An empty table gives no row.
    """
    found = _units(docs, n_words(F.col("text")), weights, share, max_copies, seed).select("key", "named", "version", "before", "whole", "part")
    hashed = F.xxhash64(*[F.to_json(F.struct(quoted(f.name))) if re.search("map<|variant", f.dataType.simpleString()) else F.col(quoted(f.name)) for f in docs.schema])
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), hashed.alias("of_row")).select("row", "of_row", *_keys("row."))
    order = Window.partitionBy("key", "named", "version").orderBy("of_row")
    copies = rows.join(found, ["key", "named", "version"]).withColumn("copies", _copies(F.row_number().over(order).cast("long")))
    return copies.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
