"""The text pipeline: language ID, line dedup, near-duplicates, mixing, and encoding with a decoding check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import bpe, language_id, line_dedup, minhash, mixing
from scoreloom.llm._common import WORD, Scratch, quoted

#: A text is told to be in another language than its lang says if its score is higher than those of this share of the held-out documents
#: that are told rightly to be in that language, and no less than SURE. Short texts need no bound of their own, as their scores are lower.
CONTRADICTED, SURE = 0.25, 0.8
#: Of held-out documents whose language is told rightly, this share has lower scores than the one that the bound is set by.
TAIL = 0.01


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a letter whose language is told; the network learns from their own labels, but for the third that is held out.

    Rejected: texts that are null or have no letter; those with a score under the middle between a guess (1 of all languages) and what
    all but TAIL of the held-out documents that are rightly told to be in that language have; and those whose lang is one that was learned while
    the network tells another, surer than it is of CONTRADICTED of those told rightly. A document that has a lang keeps it; one that has none gets
    the predicted one. Where no row has a lang nothing can be told and no row stays; an empty table gives none. A null doc_id is neither learned
    from nor held out; repeated rows stay or go alike, and count as often as they are there in the bounds.
    """
    others = [c for c in docs.columns if c != "text"]  # a text goes to Python and back once, and where only bounds are made, nothing else does
    rows = docs.select(F.struct(*map(quoted, others)).alias("row"), "doc_id", "text", "lang")
    net = language_id.fit(docs.where(~language_id.held_out_of(F.col("doc_id"))))
    found = language_id.predict(rows, net)
    held_out = rows.where(language_id.held_out_of(F.col("doc_id")) & F.col("lang").isNotNull()).select("text", "lang")
    right = language_id.predict(held_out, net).where(F.col("lang") == F.col("lang_pred"))
    guess = 1 / max(len(net.labels), 1)
    by_lang = right.groupBy("lang_pred").agg(F.percentile_approx("score", [TAIL, CONTRADICTED], 10000).alias("q")).collect()  # one row per learned language
    of = lambda k, default: F.coalesce(*[F.when(F.col("lang_pred") == r["lang_pred"], F.lit(r["q"][k])) for r in by_lang], F.lit(default))
    told = (F.col("lang_pred") != "und") & (F.col("score") >= (of(0, guess) + guess) / 2)
    learned = (F.col("lang") != F.col("lang_pred")) & F.col("lang").isin(net.labels)
    other = learned & (F.col("score") >= F.greatest(of(1, 1.0), F.lit(SURE)))
    stay = found.where(told & ~F.coalesce(other, F.lit(False)))
    own = {"lang": F.coalesce("row.lang", "lang_pred").alias("lang"), "text": F.col("text")}
    return stay.select(*[own[c] if c in own else F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that another document has first; what has no word left goes. n_chars is that of the new text."""
    cut = line_dedup.drop_lines(docs).where(F.col("text").rlike(WORD))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*map(quoted, docs.columns))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Null and wordless texts and rows without a doc_id stay; rows that repeat a kept doc_id stay with it. An empty table gives no row.
    """
    return minhash.keep_first(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight takes it.

    A null source is one like others; texts that are null or have no word have no size and are taken with their source's share. An empty table
    gives no row.
    """
    return mixing.taken_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of each row that the mix took; null texts are empty, an empty table gives no row."""
    return bpe.round_trip(docs)


STAGES = [
    ("language_id", identified),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", without_near_duplicates),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: The network and the merges can't be told in SQL; tests compare each stage with plain Python: language ID from the network's scores on (these
#: have a test of their own), the mix by what systematic sampling promises of any stretch of a source.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; each result is written as Parquet to the shared folder and read again.

    What a stage read is deleted when its own result is written, so the last stage's input alone stays.
    """
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        before, docs = docs, tables.written(stage(spark, docs, sf_dir), f"stage-{name}")
        tables.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
