"""SimHash fingerprints of whole texts and permuted block tables that find near ones, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm._common import SPACE, hot_keys, id_of, joined, kept, keyed, numbered, part_of, shuffle_partitions

BITS = 64
LOW = (1 << 32) - 1
LANES = (1 << 32) | 1


def _terms(text: Column) -> Column:
    """The text's adjacent pairs of lower-cased words, the first and last with an empty neighbour; (empty, empty) if it has no word."""
    words = F.split(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), SPACE)
    return F.arrays_zip(F.slice(words, F.lit(1), F.size(words) - 1).alias("left"), F.slice(words, F.lit(2), F.size(words) - 1).alias("right"))


def _fingerprint() -> Column:
    """A set bit wherever the terms' signed votes sum up above zero: where set bits have over half of all weight."""
    bit = lambda ones, k: F.when(ones * 2 > F.col("total"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))
    parts = [x for k in range(32) for x in (bit(F.col(f"v{k}").bitwiseAND(F.lit(LOW)), k), bit(F.shiftrightunsigned(F.col(f"v{k}"), 32), k + 32))]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, fingerprint) of each distinct value of keys in texts; fingerprint is a long of BITS bits.

    Terms are pairs of adjacent words. A term weighs the number of its letters each time it stands in the text, so that pairs of
    short, common words count little. Each term's 64-bit hash votes with its weight for or against every bit. Two bits' votes share
    a long, 32 bits each, so 32 sums carry all 64. Texts without a word have fingerprint 0. The sums are kept per text while its
    terms are read; no term is shuffled.
    """
    pairs = texts.select(*keys, F.inline(_terms(F.coalesce(F.col(text), F.lit("")))).alias("left", "right"))
    weighed = pairs.select(*keys, F.xxhash64("left", "right").alias("h"), (F.char_length("left") + F.char_length("right")).cast("long").alias("w"))
    votes = [F.sum(F.shiftrightunsigned(F.col("h"), k).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"v{k}") for k in range(32)]
    return weighed.groupBy(*keys).agg(F.sum("w").alias("total"), *votes).select(*keys, _fingerprint().alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits."""
    return (F.lit(BITS) - F.bit_count(a.bitwiseXOR(b))) / F.lit(float(BITS))


def spelled(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), BITS // 4, "0")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(radius: int, blocks: int) -> list[int]:
    """One mask for each table: the bits of the blocks that lead there. Fingerprints within radius agree on one of them at least,
    as radius differing bits spoil at most radius blocks and a table leads with all but radius of them."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [_signed(sum(x)) for x in combinations(each, blocks - radius)]


def within_radius(found: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(query, fingerprint, distance) of each distinct fingerprint of `found` within `radius` bits of one of `queries`, itself too.

    Each fingerprint stands in one table for every choice of blocks - radius leading blocks, keyed by those blocks' bits; queries
    look up their own key in every table. A pair is met in the first table that it agrees on only. All that is compared is in the
    join's condition: no pair beyond the radius leaves it. More blocks make longer keys and more tables. Null fingerprints are
    neither found nor looked for.
    """
    masks = block_masks(radius, blocks)
    named = lambda df, name: df.where("fingerprint is not null").select(F.col("fingerprint").alias(name))
    tables = lambda df, name: df.select(name, F.posexplode(F.array(*[F.col(name).bitwiseAND(F.lit(m)) for m in masks])).alias(f"{name}_table", f"{name}_key"))
    a, b = tables(named(queries, "query"), "query").distinct(), tables(named(found, "fingerprint").distinct(), "fingerprint")
    differ = F.col("query").bitwiseXOR(F.col("fingerprint"))
    agreed = reduce(lambda rest, k: F.when(differ.bitwiseAND(F.lit(masks[k])) == 0, k).otherwise(rest), reversed(range(len(masks))), F.lit(-1))
    same = (a["query_table"] == b["fingerprint_table"]) & (a["query_key"] == b["fingerprint_key"])
    return a.join(b, same & (F.bit_count(differ) <= radius) & (agreed == F.col("query_table"))).select("query", "fingerprint", F.bit_count(differ).alias("distance"))


def next_ids(ids: DataFrame) -> DataFrame:
    """(key, n, parts, next_key, next_part): for each distinct key of ids (key, part, n) its largest n and its parts, and the next smaller
    key with its first part; after the smallest the largest.

    Keys are dealt by range; each range looks within itself, and one row per range tells where the next one starts.
    """
    each = ids.groupBy("key").agg(F.max("n").alias("n"), F.collect_set("part").alias("parts"))
    chunks = kept(each.repartitionByRange(shuffle_partitions(ids.sparkSession), "key").withColumn("chunk", F.spark_partition_id()).withColumn("at", F.struct("key", F.array_min("parts").alias("part"))))
    order = Window.partitionBy("chunk").orderBy("key")
    tops = chunks.groupBy("chunk").agg(F.max("at").alias("top"))
    by_chunk = Window.orderBy("chunk")
    tops = tops.select("chunk", F.coalesce(F.lag("top").over(by_chunk), F.max("top").over(Window.partitionBy())).alias("below"))
    found = chunks.withColumn("prev", F.lag("at").over(order)).join(tops, "chunk").withColumn("next", F.coalesce("prev", "below"))
    return found.select("key", "n", "parts", F.col("next.key").alias("next_key"), F.col("next.part").alias("next_part"))


def edited_texts(docs: DataFrame) -> DataFrame:
    """(key, part, nth, n_chars, text, edited) for each row of docs (doc_id, text): the last floor(n_chars / 3) code points replaced
    by the first as many (or all) of the next document in descending doc_id; after the last comes the first.

    A null doc_id counts as the smallest. Rows of one doc_id have the same next document: the next smaller doc_id's first row, by part
    (see `numbered`) and text. One exchange of the texts serves both sides; of the next document only the part in need is dealt.
    """
    rows = numbered(docs)
    ids = docs.select(keyed(), part_of(), F.coalesce(F.char_length("text"), F.lit(0)).alias("n"))
    after = next_ids(ids).select(F.col("key").alias("of"), "parts", "next_key", "next_part", F.floor(F.col("n") / 3).cast("int").alias("m"))
    firsts = rows.where("before is null").join(after, (F.col("key") == F.col("next_key")) & (F.col("part") == F.col("next_part")))
    starts = firsts.select("of", F.explode("parts").alias("of_part"), F.expr("substring(text, 1, m)").alias("start"))
    whole = rows.join(starts, (F.col("key") == F.col("of")) & (F.col("part") == F.col("of_part"))).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("m", F.floor(F.col("n_chars") / 3).cast("int"))
    return whole.select("key", "part", "nth", "n_chars", "text", F.expr("concat(substring(text, 1, cast(n_chars as int) - m), substring(start, 1, m))").alias("edited"))


def edit_test(docs: DataFrame, radius: int = 3, blocks: int = 6, every: int = 50) -> DataFrame:
    """Fingerprints of each row's text and edited text (see `edited_texts`), their likeness, and that to the next document.

    n_near: for doc_ids divisible by `every`, how many rows of docs have a fingerprint within radius of the row's, itself included;
    null for others. Null and empty texts have 0 characters and fingerprint 0. A single row is its own next document. Repeated rows are
    rows of their own. An empty table gives no row. Texts are taken whole, however long: their votes are summed while their terms are read.
    """
    rows = edited_texts(docs)
    keys = ["key", "part", "nth", "n_chars", "edited_sha256", "is_edited"]
    both = F.explode(F.array(F.struct(F.lit(False).alias("is_edited"), F.col("text")), F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("text"))))
    stacked = rows.select("key", "part", "nth", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), both.alias("x")).select(*keys[:-1], "x.is_edited", "x.text")
    voted = fingerprints(stacked, keys)
    of = lambda edited: F.max(F.when(F.col("is_edited") == edited, F.col("fingerprint")))
    found = kept(voted.groupBy(*keys[:-1]).agg(of(False).alias("fingerprint"), of(True).alias("edited")).withColumn("doc_id", id_of(F.col("key"))))
    after = next_ids(found.select("key", "part", F.col("n_chars").alias("n"))).select(F.col("key").alias("of"), "next_key", "next_part")
    next_rows = found.where("nth = 1").select(F.col("key").alias("next_key"), F.col("part").alias("next_part"), F.col("fingerprint").alias("next"))
    next_of = after.join(next_rows, ["next_key", "next_part"]).select(F.col("of").alias("key"), "next")
    beside = joined(found, next_of, ["key"])
    near = within_radius(found, found.where(F.col("doc_id") % every == 0), radius, blocks)
    counted = near.join(found.groupBy("fingerprint").agg(F.count("*").alias("rows")), "fingerprint").groupBy(F.col("query").alias("fingerprint")).agg(F.sum("rows").alias("n_near"))
    hot = hot_keys(found.groupBy("fingerprint").agg(F.count("*").alias("n")), ["fingerprint"])
    asked = F.when(F.col("doc_id") % every == 0, F.col("n_near"))
    return joined(beside, counted, ["fingerprint"], "left", hot).select(
        "doc_id", "n_chars", "edited_sha256", spelled(F.col("fingerprint")).alias("fingerprint"), spelled(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next")).alias("near_next"), asked.alias("n_near"),
    )
