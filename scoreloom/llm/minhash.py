"""Near-duplicates by circulant MinHash, banding and exact Jaccard similarity of whole shingle sets."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm._common import WORD, Scratch, hot_keys, joined, quoted, slices, written

WORDS = re.compile(WORD.encode())
ROWS = 5
#: A pair at the threshold shares no band with at most this chance; nothing else misses a pair.
MISS = 1e-5
#: Coordinates beyond the bands' whose lowest bits make a 128-bit sketch, by which centres of buckets are chosen.
SKETCH = 128
#: Buckets of bands with up to SMALL members are compared pair by pair, those of differences with up to COMPARED; with up to LONG_COMPARED
#: if one member has more than TOLD shingles, as parities tell such sets less well apart.
SMALL, COMPARED, LONG_COMPARED, TOLD = 6, 5000, 500, 2000
#: A set's parities: 64 bits in each of these, of which each says whether an odd number of the set's hashes fall to it. Two sets differ in
#: as many hashes as their parities do in bits, or more.
PARITIES = [f"parity_{k}" for k in range(16)]


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def first_permutation(x: np.ndarray) -> np.ndarray:
    """Sigma: shingle hashes to places on a circle of 2**32, in an order of no meaning."""
    return (_mix64(x ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def second_permutation(x: np.ndarray) -> np.ndarray:
    """Pi: a one-to-one map of the circle's places (each step can be undone)."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def signatures(hashes: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """size coordinates for each set hashes[bounds[k]:bounds[k + 1]] (none empty).

    Coordinate k is the least second permutation over the set's places after the circle is shifted by k: one table of places and
    two permutations stand in for `size` independent ones.
    """
    places = first_permutation(hashes)
    out = np.empty((len(bounds) - 1, size), np.uint32)
    for k in range(size):
        out[:, k] = np.minimum.reduceat(second_permutation(places + np.uint32(k)), bounds[:-1])
    return out


def _lower(text: str) -> bytes:
    return text.encode().lower()


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles, one text after another, and where each begins (with the end).

    Words are runs of anything but ASCII white space, A-Z lower-cased. Fewer words than width: all as one shingle. None: no shingle.
    """
    numbers: dict[bytes, int] = {}
    words = [WORDS.findall(_lower(t)) if t else [] for t in texts]
    flat = [w for x in words for w in x]
    for w in flat:
        if w not in numbers:
            numbers[w] = len(numbers)
    digest = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in numbers), np.uint64)
    hashed = digest[np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))] if flat else np.zeros(0, np.uint64)
    counts = np.fromiter(map(len, words), np.int64, len(words))
    text = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.flatnonzero((nth + width <= counts[text]) | ((nth == 0) & (counts[text] < width)))
    key = np.zeros(len(starts), np.uint64)
    for k in range(width):
        at = starts + k
        inside = nth[starts] + k < counts[text[starts]]
        part = np.where(inside, hashed[np.minimum(at, len(flat) - 1)] if len(flat) else key, np.uint64(0))
        key = _mix64(key * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(k + 1))
    of = text[starts]
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])]) if len(key) else np.zeros(0, bool)
    key, of = key[new], of[new]
    return key, np.searchsorted(of, np.arange(len(texts) + 1))


def _sketched(width: int, n_bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            key, bounds = shingle_sets(batch.column("text").to_pylist(), width)
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            sets = np.concatenate([bounds[:-1][full], bounds[-1:]])
            sign = signatures(key, sets, n_bands * ROWS + SKETCH) if len(full) else np.zeros((0, n_bands * ROWS + SKETCH), np.uint32)
            bands = np.zeros((len(sizes), n_bands), np.uint64)
            for b in range(n_bands):
                h = np.full(len(full), b + 1, np.uint64)
                for r in range(ROWS):
                    h = _mix64(h * np.uint64(0x9E3779B97F4A7C15) + sign[:, b * ROWS + r])
                bands[full, b] = h
            bits = np.zeros((len(sizes), SKETCH), np.uint8)
            bits[full] = sign[:, n_bands * ROWS :] & 1
            halves = np.packbits(bits, axis=1).view(np.int64) if len(sizes) else np.zeros((0, 2), np.int64)
            raw = key.tobytes()
            digests = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("version"), pa.array(sizes.astype(np.int64)), pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, n_bands), pa.int32()), pa.array(bands.ravel().view(np.int64))),
                    pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                ],
                names=["doc_id", "version", "n_shingles", "digest", "bands", "s1", "s2"],
            )

    return run


def parities(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The parities of each set hashes[bounds[k]:bounds[k + 1]], a row of longs."""
    size, n = 64 * len(PARITIES), len(bounds) - 1
    at = np.repeat(np.arange(n), np.diff(bounds)) * size + (hashes % np.uint64(size)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * size) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(n, len(PARITIES))


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            key, bounds = shingle_sets(batch.column("text").to_pylist(), width)
            sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(key.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("cid"), sets, *map(pa.array, parities(key, bounds).T.copy())], names=["cid", "shingles", *PARITIES])

    return run


def components(edges: DataFrame, run: Scratch | None = None) -> DataFrame:
    """(node, component) of every node of edges (a, b): the smallest node that links lead to.

    Rounds of the least label among neighbours, then of that label's own label, until nothing changes: chains halve every round.
    Each round is written as a table of run (by default, one that stays in the shared folder), so neither its plan nor a lost executor's
    work grows, and deleted after the next. Nodes with very many links, and components with very many nodes, are spread over tasks.
    """
    run = run or Scratch(edges.sparkSession, "components")
    both = run.written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    hubs = hot_keys(both.groupBy("b").agg(F.count("*").alias("n")), ["b"])
    labels = run.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")).select("node", "component"), "labels")
    while True:
        other = labels.select(F.col("node").alias("b"), F.col("component").alias("theirs"))
        least = joined(both, other, ["b"], hot=hubs).groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        nearest = F.least("component", F.coalesce("theirs", "component")).alias("component")
        near = run.written(labels.join(least, "node", "left").select("node", F.col("component").alias("before"), nearest), "near")
        root = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = run.written(joined(near, root, ["component"], "left").select("node", "before", F.least("component", F.coalesce("root", "component")).alias("component")), "labels")
        run.drop(near, labels)
        labels = new
        if not new.where("before <> component").take(1):
            run.drop(both)
            return new.select("node", "component")


def _labels_with(labels: DataFrame, links: DataFrame, run: Scratch) -> DataFrame:
    """labels (cid, component) after more links (a, b); what has no link has no row."""
    if not links.take(1):
        return labels
    with run.part() as own:
        ends = links.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        known = own.written(labels.unionByName(ends.join(labels, "cid", "left_anti").withColumn("component", F.col("cid"))), "known")
        at = lambda end: known.select(F.col("cid").alias(end), F.col("component").alias(f"of_{end}"))
        half = own.written(joined(links, at("a"), ["a"]), "half")
        across = joined(half, at("b"), ["b"]).where("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct()
        roots = components(own.written(across, "across"), own).select(F.col("node").alias("component"), F.col("component").alias("root"))
        return run.written(joined(known, roots, ["component"], "left").select("cid", F.coalesce("root", "component").alias("component")), "labels")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid"))


def _alike_in_size(a: str, b: str, percent: int) -> Column:
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def _with_sets(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """pairs, checkpointed, with the sets of both as a_set and b_set, and the parities of a's. One cid may be in very many of them."""
    of = lambda side, name, *more: sets.select(F.col("cid").alias(side), F.col("shingles").alias(name), *more)
    hot_a, hot_b = (hot_keys(pairs.groupBy(x).agg(F.count("*").alias("n")), [x]) for x in (a, b))
    return joined(joined(pairs, of(a, "a_set", *PARITIES), [a], hot=hot_a), of(b, "b_set"), [b], hot=hot_b)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    shared = F.size(F.array_intersect("a_set", "b_set")).cast("long")
    union = F.size("a_set") + F.size("b_set") - shared
    return _with_sets(pairs, sets, "a", "b").where(F.lit(100) * shared >= F.lit(percent) * union).select("a", "b")


def _open(rows: DataFrame, run: Scratch, own: Scratch) -> tuple[DataFrame, list]:
    """The rows (b1, b2, side, cid, component, n_shingles, s1, s2) of buckets that may still hold a link across components, with the
    number n of the bucket's rows and the size of its longest set; and the hot buckets. Of buckets with the same members (by 128 bits), as those of copies with one
    small difference are in most bands, one stays. The result is a table of run; what it takes to make it, of own."""
    members = [F.bit_xor(F.xxhash64("cid", "side", F.lit(k))).alias(f"members_{k}") for k in range(2)]
    sizes = rows.groupBy("b1", "b2").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most"), F.bit_or("side").alias("sides"), F.max("n_shingles").alias("longest"), *members)
    sizes = sizes.where("least < most and sides = 3").groupBy("n", "longest", "members_0", "members_1").agg(F.min(F.struct("b1", "b2")).alias("b"))
    sizes = sizes.select("b.b1", "b.b2", "n", "longest")
    sizes = own.written(sizes, "buckets")
    hot = hot_keys(sizes, ["b1", "b2"])
    return run.written(joined(rows, sizes, ["b1", "b2"], hot=hot), "members"), hot


def _met(small: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides (x_, y_) of a join of small buckets with themselves, and its condition: a pair across components and sides."""
    side = lambda x: small.select("b1", "b2", *[F.col(c).alias(f"{x}_{c}") for c in ("cid", "component", "side", *columns)])
    x, y = side("x"), side("y")
    across = (F.col("x_cid") < F.col("y_cid")) & (F.col("x_component") != F.col("y_component")) & (F.col("x_side").bitwiseOR(F.col("y_side")) == 3)
    return x, y, (x["b1"] == y["b1"]) & (x["b2"] == y["b2"]) & across


def _pairs_of_small(small: DataFrame, percent: int) -> DataFrame:
    x, y, met = _met(small, ["n_shingles"])
    return x.join(y, met & _alike_in_size("x_n_shingles", "y_n_shingles", percent)).select(F.col("x_cid").alias("a"), F.col("y_cid").alias("b"))


def _links_of_small(small: DataFrame, differs: DataFrame, percent: int) -> DataFrame:
    """Links within small buckets of differences, told by the differences alone (see _by_difference); only links leave the join.

    Most pairs are told by their parities before: sets that are linked differ in (100 - p) / (100 + p) of their sizes' sum at most.
    """
    own = differs.select(F.col("centre").alias("b1"), "cid", "tokens", "weight", "room", *PARITIES)
    x, y, met = _met(small.join(own, ["b1", "cid"]), ["n_shingles", "tokens", "weight", "room", *PARITIES])
    apart = reduce(lambda m, n: m + n, [F.bit_count(F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))) for c in PARITIES])
    may = _alike_in_size("x_n_shingles", "y_n_shingles", percent) & (F.lit(100 + percent) * apart <= F.lit(100 - percent) * (F.col("x_n_shingles") + F.col("y_n_shingles")))
    shared = F.size(F.array_intersect("x_tokens", "y_tokens"))
    linked = F.lit(100 + percent) * shared >= F.col("x_weight") + F.col("y_weight") - F.col("x_room")
    return x.join(y, met & may & linked).select(F.col("x_cid").alias("a"), F.col("y_cid").alias("b")).distinct()


def _spokes(large: DataFrame, classes: DataFrame, hot: list, shared: bool, own: Scratch) -> DataFrame:
    """The rows of large buckets, each with its bucket's centre (centre, c_component, c_shingles); the centre's own row is left out. classes:
    (cid, component, n_shingles). shared: whether buckets may take another's centre (see _shared_centres).

    The centre is the member whose sketch is nearest to what most of the bucket's sketches say, bit by bit. Among near copies of one
    text that is the text itself, or what comes closest to it. Counts of two bits share a long.
    """
    lanes, low = F.lit((1 << 32) | 1), F.lit((1 << 32) - 1)
    ones = [F.sum(F.shiftrightunsigned(F.col(c), k).bitwiseAND(lanes)).alias(f"{c}_{k}") for c in ("s1", "s2") for k in range(32)]
    bit = lambda n, k: F.when(n * 2 > F.col("rows"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))

    def most(c: str) -> Column:
        parts = [x for k in range(32) for x in (bit(F.col(f"{c}_{k}").bitwiseAND(low), k), bit(F.shiftrightunsigned(F.col(f"{c}_{k}"), 32), k + 32))]
        return reduce(lambda x, y: x.bitwiseOR(y), parts)

    said = large.groupBy("b1", "b2").agg(F.count("*").alias("rows"), *ones).select("b1", "b2", most("s1").alias("m1"), most("s2").alias("m2"))
    far = F.bit_count(F.col("s1").bitwiseXOR(F.col("m1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("m2")))
    centres = joined(large, said, ["b1", "b2"], hot=hot).groupBy("b1", "b2").agg(F.min(F.struct(far.alias("far"), "cid")).alias("x")).select("b1", "b2", F.col("x.cid").alias("centre"))
    if shared:
        centres = _shared_centres(large, own.written(centres, "centres"), hot)
    of_centre = classes.select(F.col("cid").alias("centre"), F.col("component").alias("c_component"), F.col("n_shingles").alias("c_shingles"))
    return joined(large, centres.join(of_centre, "centre"), ["b1", "b2"], hot=hot).where("cid <> centre")


def _shared_centres(large: DataFrame, centres: DataFrame, hot: list) -> DataFrame:
    """One centre for buckets that have members in common, as a centre needn't be a member: each member knows the centre that most rows have
    among those of its buckets, and each bucket takes the one that most rows have among what its members know. So the members of a family
    that meet in many bands are compared with few centres."""
    sizes = large.select("b1", "b2", "n").distinct()
    weights = centres.join(sizes, ["b1", "b2"]).groupBy("centre").agg(F.sum("n").alias("weight"))
    weighed = centres.join(weights, "centre").select("b1", "b2", F.struct("weight", "centre").alias("known"))
    rows = large.select("b1", "b2", "cid")
    best = joined(rows, weighed, ["b1", "b2"], hot=hot).groupBy("cid").agg(F.max("known").alias("known"))
    return rows.join(best, "cid").groupBy("b1", "b2").agg(F.max("known").alias("known")).select("b1", "b2", F.col("known.centre").alias("centre"))


def _by_difference(spokes: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, run: Scratch, own: Scratch) -> tuple[DataFrame, DataFrame]:
    """Members of large buckets, dealt to buckets of the next step: by what they have differently from their centre. And the differences.

    Let a member lack M of the centre's shingles and have E of its own. Two members that share s of these differences are linked if
    (100 + p) s >= W + W' - (100 - p) |centre|, where W = p E + 100 M; and a member is linked with the centre if W is at most the last
    term. So a pair of which one isn't linked with the centre shares differences, more than W / (100 + p) of each if neither is. And as
    W' is at least p or 100 for each difference that is shared, what is shared weighs W - (100 - p) |centre| at least, where a shingle of
    its own counts 100 and one that it lacks p. In one order of differences for all, the first that two members share is thus where as many
    and as heavy ones are still to come: only these are dealt. Differences that one member alone has don't count. The rarest around the
    centre come first. Nothing is left out: the bounds are exact, and the next step compares what shares a bucket.

    side 3: both not linked with the centre; 1 and 2: one that isn't, and one that is; only buckets with both matter then.
    """
    attributes = ["component", "n_shingles", "s1", "s2"]
    found = own.written(_labelled(spokes.select("centre", "cid", "n_shingles", "s1", "s2").distinct(), labels), "spokes")
    by_centre = found.groupBy("centre").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most"))
    by_centre = own.written(by_centre.where("least < most"), "by-centre")
    hot = hot_keys(by_centre, ["centre"])
    both = _with_sets(own.written(joined(found, by_centre.select("centre"), ["centre"], hot=hot), "compared"), sets, "cid", "centre")
    more, lacks = F.array_except("a_set", "b_set"), F.array_except("b_set", "a_set")
    differs = both.select("centre", "cid", *attributes, *PARITIES, F.size("b_set").alias("size"), more.alias("own"), lacks.alias("lacks"))
    weight, room = (F.lit(percent) * F.size("own") + F.lit(100) * F.size("lacks")).cast("long"), F.lit(100 - percent) * F.col("size")
    near, heavy = F.floor(weight / F.lit(100 + percent)).cast("int"), weight - room
    kind = lambda side, spare, need: F.struct(F.lit(side).alias("side"), spare.alias("spare"), need.cast("long").alias("need"))
    kinds = F.when(weight <= room, F.array(kind(2, near, F.lit(0)))).otherwise(F.array(kind(3, near, heavy), kind(1, F.lit(0), heavy)))
    told = [F.concat("own", "lacks").alias("tokens"), F.size("own").alias("n_own"), weight.alias("weight"), room.cast("long").alias("room"), kinds.alias("kinds")]
    differs = run.written(differs.select("centre", "cid", *attributes, *PARITIES, *told), "differences")
    tokens = differs.select("centre", "cid", "n_own", F.posexplode("tokens").alias("at", "token"))
    tokens = tokens.select("centre", "cid", "token", F.when(F.col("at") < F.col("n_own"), 100).otherwise(percent).cast("long").alias("w"))
    often = own.written(tokens.groupBy("centre", "token").agg(F.count("*").alias("n")).where("n > 1"), "often")
    shared = joined(tokens, often, ["centre", "token"], hot=hot_keys(often, ["centre", "token"])).groupBy("centre", "cid")
    shared = shared.agg(F.sort_array(F.collect_list(F.struct("n", "token", "w"))).alias("shared"), F.sum("w").alias("heavy"))
    both = differs.select("centre", "cid", *attributes, F.inline("kinds")).join(shared, ["centre", "cid"])
    # each is dealt while what comes from it on weighs need or more: while those before weigh heavy - need at most
    step = lambda x, y: F.when(x["before"] <= F.col("heavy") - F.col("need"), F.struct((x["n"] + 1).alias("n"), (x["before"] + y["w"]).alias("before"))).otherwise(x)
    enough = F.aggregate("shared", F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("before")), step, lambda x: x["n"])
    first = F.slice("shared", F.lit(1), F.greatest(F.lit(0), F.least(F.size("shared") - F.col("spare"), enough)))
    dealt = both.select(F.col("centre").alias("b1"), "side", "cid", *attributes, F.explode(first).alias("x"))
    return dealt.withColumn("b2", F.xxhash64(F.col("side") == 3, "x.token")).drop("x"), differs


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs: the smallest doc_id that links lead to, itself included.

    Two documents are linked if 100 * intersection >= percent * union of their sets of `width`-word shingles, confirmed on the full
    sets of 64-bit hashes. Candidates share one of the bands of their signatures; a pair at the threshold shares none with a chance
    of MISS at most, one above it with less. No other step leaves a pair out.

    Equal sets are one class from the start, so copies are never paired. Members of a bucket that no link connects yet are compared
    pair by pair if they are few. In a larger bucket all are compared with its centre only, and then dealt to buckets by what they
    have differently from it (see _by_difference), until no bucket holds two components. So a bucket costs about as many comparisons as
    members, also where all are just below the threshold to each other.

    Null and empty texts have no shingle and link to nothing; neither do rows whose doc_id is null, whose component_id is null.
    All rows of one doc_id share their component, which links of each of their texts lead to. An empty table gives none.
    """
    with Scratch(docs.sparkSession, "minhash") as run:
        return written(_classed(docs, width, percent, run), "near-duplicates")


def _classed(docs: DataFrame, width: int, percent: int, run: Scratch) -> DataFrame:
    """What near_duplicates returns, still to be computed from tables of run."""
    columns = "doc_id long, version long, n_shingles long, digest binary, bands array<long>, s1 long, s2 long"
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("version"))
    sketched = run.written(texts.mapInArrow(_sketched(width, bands_for(percent / 100)), columns), "sketches")
    rows = sketched.where("doc_id is not null and n_shingles > 0").select("doc_id", "version", "digest", "n_shingles", "bands", "s1", "s2")
    firsts = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "version")).alias("first")).select("digest", "first.*")
    key = ["digest", "doc_id", "version"]
    classes = run.written(rows.join(firsts, key, "left_semi").dropDuplicates(key).withColumn("cid", F.monotonically_increasing_id()), "classes")
    placed = run.written(joined(rows.select("doc_id", "digest"), classes.select("digest", "cid"), ["digest"]).select("doc_id", "cid").distinct(), "placed")

    labels = _linked_classes(texts, classes, placed, width, percent, run)
    found = run.written(_labelled(classes.select("cid", "doc_id"), labels), "found")
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = joined(found, least, ["component"]).select("cid", "component_id")
    of_doc = joined(placed, of_class, ["cid"]).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return sketched.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _linked_classes(texts: DataFrame, classes: DataFrame, placed: DataFrame, width: int, percent: int, run: Scratch) -> DataFrame:
    """(cid, component) of the classes that have a link, also by a doc_id with several texts. Each round's tables go when it is over, but for what the next reads."""
    spark = run.spark
    labels = spark.createDataFrame([], "cid long, component long")
    with run.part() as own:
        several = placed.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("last"), F.count("*").alias("n")).where("a < last")
        repeats = joined(placed, several.select("doc_id", "a"), ["doc_id"], hot=hot_keys(several, ["doc_id"])).where("cid <> a").select("a", F.col("cid").alias("b"))
        labels = _labels_with(labels, own.written(repeats, "repeats"), run)
        banded = _labelled(classes, labels).select("cid", "component", "n_shingles", "s1", "s2", F.posexplode("bands").alias("b1", "b2"), F.lit(3).alias("side"))
        opened, hot = _open(banded.withColumn("b1", F.col("b1").cast("long")), run, own)
    wanted = classes.join(opened.select("cid").distinct(), "cid", "left_semi").select("doc_id", "version", "cid")
    wanted = texts.join(wanted, ["doc_id", "version"]).dropDuplicates(["doc_id", "version"]).select("cid", "text")
    sets = run.written(wanted.mapInArrow(_sets(width), "cid long, shingles array<long>, " + ", ".join(f"{c} long" for c in PARITIES)), "sets")
    sizes = classes.select("cid", "n_shingles")
    tried, differs = spark.createDataFrame([], "a long, b long"), None
    while opened.take(1):
        before = [opened, labels, differs]
        most = F.lit(SMALL) if differs is None else F.when(F.col("longest") <= TOLD, COMPARED).otherwise(LONG_COMPARED)
        with run.part() as own:
            small = opened.where(F.col("n") <= most)
            spokes = own.written(_spokes(opened.where(F.col("n") > most), _labelled(sizes, labels), hot, differs is None, own), "spokes")
            with_centre = spokes.where("component <> c_component").where(_alike_in_size("n_shingles", "c_shingles", percent))
            pairs = with_centre.select(F.least("cid", "centre").alias("a"), F.greatest("cid", "centre").alias("b"))
            pairs = pairs.union(_pairs_of_small(small, percent)) if differs is None else pairs
            pairs = run.written(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
            links = _linked(pairs, sets, percent)
            links = own.written(links if differs is None else links.union(_links_of_small(small, differs, percent)), "links")
            tried, labels = tried.union(pairs), _labels_with(labels, links, run)
            if not spokes.take(1):
                break
            dealt, differs = _by_difference(spokes, labels, sets, percent, run, own)
            opened, hot = _open(dealt, run, own)
        run.drop(*[x for x in before if x is not labels])
    run.drop(sets)
    return labels


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """docs without those that a smaller doc_id stands for: one document of each group of near-duplicates stays.

    Rows that repeat the doc_id of a group's first all stay; rows whose doc_id is null stay.
    """
    found = near_duplicates(docs, **how)
    return docs.join(found.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*map(quoted, docs.columns))
