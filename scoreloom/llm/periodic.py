"""Periodic runs of words: suffix classes united by decreasing LCP, as Kruskal's algorithm unites trees."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm._common import WORD, map_arrow, slices, with_fields

RUN = "struct<start: bigint, length: bigint, period: bigint>"


def least_lcp(min_length: int, min_exponent: int) -> int:
    """No run has a pair of places one period apart with a smaller LCP: that is its length less its period."""
    return max(1, min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, min_length + 1)))


def numbered_words(texts: list[str | None]) -> tuple[list[list[bytes]], list[int], np.ndarray]:
    """The words of each text, all of them one after another as numbers, and where each text starts (with the end as the last).

    A text's words have numbers of their own, and one more number that stands nowhere else ends it: nothing matches across texts.
    """
    words, ids, starts, base = [], [], [0], 0
    for text in texts:
        own = (text or "").encode().split()  # of bytes: ASCII white space
        seen: dict[bytes, int] = {}
        ids += [seen.setdefault(w, base + len(seen)) for w in own]
        base += len(seen) + 1
        ids.append(base - 1)
        words.append(own)
        starts.append(len(ids))
    return words, ids, np.array(starts)


def suffix_order(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and the places of those that share `depth` words (a power of two) with the one before.

    By doubling: suffixes that agree in h words are put in order by the rank of what follows these, and those that stand alone take no
    further part.
    """
    order = np.argsort(ids, kind="stable")
    rank, same = np.empty(len(ids), np.int64), np.zeros(len(ids), bool)
    places, new = np.arange(len(ids)), np.diff(ids[order], prepend=-1) != 0
    h = 1
    while len(places):
        rank[order[places]] = np.maximum.accumulate(np.where(new, places, 0))
        if h == depth:
            same[places[~new]] = True
        places = places[~(new & np.append(new[1:], True))]
        suffix = order[places]
        head, tail = rank[suffix], rank[suffix + h] if len(places) else places
        by = np.lexsort((tail, head))
        order[places] = suffix[by]
        new = (np.diff(head[by], prepend=-1) != 0) | (np.diff(tail[by], prepend=-1) != 0)
        h *= 2
    return order, np.flatnonzero(same)


def lcps(ids: list[int], order: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """The LCP of the suffix at each of the places with the one before it, of which `depth` words are known to agree.

    In order of the text, as a suffix has at most one word less in common with its predecessor than the suffix one word before has.
    """
    later, earlier = order[places], order[places - 1]
    by = np.argsort(later)
    found, last, h = [], -2, 0
    for i, j in zip(later[by].tolist(), earlier[by].tolist()):
        h = h - 1 if i == last + 1 and h > depth else depth
        while ids[i + h] == ids[j + h]:
            h += 1
        found.append(h)
        last = i
    out = np.empty(len(places), np.int64)
    out[by] = found
    return out


def _neighbours(parts: list[list[int]]) -> tuple[list[int], list[tuple[int, int]]]:
    """The ordered union of ordered sets, and those of its neighbours that come from different ones."""
    big = max(parts, key=len)
    part = {x: k for k, p in enumerate(parts) if p is not big for x in p}
    if 8 * len(part) < len(big):
        for x in part:
            insort(big, x)
        pairs = set()
        for x in part:
            at = bisect_left(big, x)
            pairs.update(zip(big[max(at - 1, 0) : at + 1], big[max(at - 1, 0) + 1 : at + 2]))
    else:
        big = sorted(x for p in parts for x in p)
        pairs = zip(big, big[1:])
    return big, [(x, y) for x, y in pairs if part.get(x) != part.get(y)]


def seeds(order: np.ndarray, places: np.ndarray, lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(place, place, LCP) of all that become neighbours when classes of suffixes are united in order of decreasing LCP.

    Each class is an ordered set of places in the text under a union-find root. All unions of one LCP are made before neighbours are
    looked for, so a pair that has another member of its class between it is none. Classes of two unite once, so these aren't looked
    at one by one.
    """
    lone = (np.diff(places, prepend=-2) != 1) & (np.diff(places, append=-2) != 1)
    ends = np.sort(np.stack([order[places[lone] - 1], order[places[lone]]]), axis=0)
    yield from zip(*ends.tolist(), lcp[lone].tolist())
    places, lcp = places[~lone], lcp[~lone]
    members = np.union1d(places - 1, places)
    sets: list = [[x] for x in order[members].tolist()]
    root = list(range(len(sets)))
    sizes = [1] * len(sets)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    by = np.argsort(-lcp, kind="stable")
    at, levels = np.searchsorted(members, places[by]).tolist(), lcp[by]
    cuts = [0, *(np.flatnonzero(np.diff(levels)) + 1).tolist(), len(at)]
    for begin, end in zip(cuts, cuts[1:]):
        united: dict[int, list] = {}
        for k in at[begin:end]:
            a, b = find(k - 1), find(k)
            if sizes[a] < sizes[b]:
                a, b = b, a
            united.setdefault(a, [sets[a]]).extend(united.pop(b, None) or [sets[b]])
            root[b], sets[b] = a, None
            sizes[a] += sizes[b]
        for a, parts in united.items():
            sets[a], pairs = _neighbours(parts)
            for x, y in pairs:
                yield x, y, int(levels[begin])


def runs_of(ids: list[int], min_length: int, min_exponent: int) -> np.ndarray:
    """(start, length, period) of each run in numbered_words, by start, then period.

    Neighbours x < y with an LCP of l >= y - x lie in a stretch of period y - x that ends l words after y. If their preceding words
    differ, that stretch begins at x. Each run is found once, by its first two periods: nothing between these has as long an LCP
    with them, as the stretch would then have a smaller period.
    """
    least = least_lcp(min_length, min_exponent)
    depth = 1 << (least.bit_length() - 1)
    order, places = suffix_order(np.array(ids, dtype=np.int64), depth)
    lcp = lcps(ids, order, places, depth)
    enough = lcp >= least
    found = [
        (x, y - x + h, y - x)
        for x, y, h in seeds(order, places[enough], lcp[enough])
        if h >= (min_exponent - 1) * (y - x) and h + y - x >= min_length and ids[x - 1] != ids[y - 1]
    ]
    found = np.array(sorted(found, key=lambda r: (r[0], r[2])), dtype=np.int64)
    return found.reshape(-1, 3)


def stays(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words stay: those that no run has after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def _each(min_length: int, min_exponent: int, columns):
    """Over slices of rows: `columns` makes named arrays from (batch, words, runs of all texts, those runs' bounds, starts, which words stay)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, ids, starts = numbered_words(batch.column("text").to_pylist())
            runs = runs_of(ids, min_length, min_exponent)
            bounds = np.searchsorted(runs[:, 0], starts)
            found = columns(batch, words, runs, bounds, starts, stays(runs, len(ids)))
            yield pa.RecordBatch.from_arrays(list(found.values()), names=list(found))

    return run


def _collapsed(words: list[list[bytes]], starts: np.ndarray, stay: np.ndarray) -> list[bytes]:
    return [b" ".join(own if stay[a : a + len(own)].all() else [w for w, s in zip(own, stay[a:].tolist()) if s]) for own, a in zip(words, starts[:-1].tolist())]


def find_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """docs with the column runs: an array of (start, length, period) by start, then period; empty where there are none.

    A run is a stretch of consecutive words of a text with smallest period q (words q apart are identical), at least min_length words
    and min_exponent times q long, which no neighbouring word extends keeping its period. Words are what ASCII white space parts,
    numbered from 0. min_length and min_exponent are at least 2.

    Rows are taken one by one, without an exchange; a task holds about a megabyte of text, or a single longer one. Null, empty and
    blank texts have no word and so no run; repeated rows have the same runs; an empty table gives no row. Of equal starts, all runs
    are returned. A column of docs that is named runs is replaced.
    """
    docs = docs.drop("runs")

    def columns(batch, words, runs, bounds, starts, stay):
        first = np.repeat(starts[:-1], np.diff(bounds))
        items = pa.StructArray.from_arrays([pa.array(runs[:, 0] - first), pa.array(runs[:, 1]), pa.array(runs[:, 2])], names=["start", "length", "period"])
        return dict(zip(batch.schema.names, batch.columns)) | {"runs": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), items)}

    return map_arrow(docs, _each(min_length, min_exponent, columns), with_fields(docs.schema, f"runs array<{RUN}>"))


def collapse(docs: DataFrame, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """docs with text replaced by its words without those that a run has after its first period, joined by one space; null: empty."""

    def columns(batch, words, runs, bounds, starts, stay):
        texts = pa.array([t.decode() for t in _collapsed(words, starts, stay)], pa.string())
        return dict(zip(batch.schema.names, batch.columns)) | {"text": texts}

    return map_arrow(docs, _each(min_length, min_exponent, columns), docs.schema)


DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def run_digests(docs: DataFrame, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each row of docs (doc_id, text).

    start, length and period are those of the longest run (ties: the smallest start, then period), exponent_milli is 1000 * length /
    period, rounded down; null where there is none. The digests are of every run's `start,length,period` and a line feed, and of the
    text as `collapse` leaves it. doc_id is only passed on; see find_runs for odd rows.
    """

    def columns(batch, words, runs, bounds, starts, stay):
        rows = []
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            own = [(s - int(starts[k]), n, q) for s, n, q in runs[a:b].tolist()]
            best = min(own, key=lambda r: (-r[1], r[0], r[2])) if own else None
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in own)
            rows.append((len(own), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest()))
        found = [pa.array([r[k] for r in rows], pa.int64() if k < 5 else pa.string()) for k in range(6)]
        left = pa.array([hashlib.sha256(t).hexdigest() for t in _collapsed(words, starts, stay)], pa.string())
        return dict(zip([f.split()[0] for f in DIGESTS.split(", ")], [batch.column("doc_id"), *found, left]))

    return docs.select("doc_id", "text").mapInArrow(_each(min_length, min_exponent, columns), DIGESTS)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) where one text in ten has a period from some word on, all by the doc_id's hash; the others are as they were.

    With h the crc32 of the doc_id in decimal and g = h / 10, rounded down: where h % 10 is 0 and there are n > 0 words, each from word
    a = g % n on becomes the word a + (i - a) % p, with p = 1 + (n - a) / (3 + g % 8), rounded down. Rows without a doc_id are left alone.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words, g = F.regexp_extract_all("text", F.lit(f"({WORD})")), F.floor(h / 10).cast("long")

    def periodic(x: Column) -> Column:
        n = F.size(x).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        place = lambda w, i: F.when(i < a, w).otherwise(F.get(x, (a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(F.transform(x, place), " ")).otherwise(F.col("text"))

    # a lambda's own array, so that the words are looked for once, and only where they are needed
    planted = F.get(F.transform(F.array(words), periodic), F.lit(0))
    return docs.withColumn("text", F.when(h % 10 == 0, planted).otherwise(F.col("text")))
