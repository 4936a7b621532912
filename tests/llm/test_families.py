"""Families of near copies, of which most aren't linked with their centre."""

import random

import numpy as np
from pyspark.sql import functions as F

from scoreloom.llm import minhash


def family(n: int, seed: int) -> list[tuple[int, str]]:
    """Copies of one text without some of its lines and with some words replaced."""
    r = random.Random(seed)
    lines = [[f"w{r.randrange(500)}" for _ in range(45)] for _ in range(9)]
    copy = lambda: "\n".join(" ".join(f"{w}{r.choice('abc')}" if r.random() < 0.01 else w for w in x) for x in lines if r.random() > 0.35)
    return [(k, copy()) for k in range(n)]


def components_of(rows: list[tuple[int, str]], percent: int) -> dict[int, int]:
    key, bounds = minhash.shingle_sets([t for _, t in rows], 5)
    sets = [set(key[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]
    least = list(range(len(rows)))

    def root(k: int) -> int:
        while least[k] != k:
            k = least[k]
        return k

    for k, x in enumerate(sets):
        for j in range(k):
            if x and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                a, b = sorted((root(k), root(j)))
                least[b] = a
    return {d: root(k) for k, (d, _) in enumerate(rows)}


def test_members_meet_few_others(spark, monkeypatch):
    met, links_of_small = [], minhash._links_of_small

    def counted(small, *rest):
        met.append(small.groupBy("b1", "b2").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).head()[0])
        return links_of_small(small, *rest)

    monkeypatch.setattr(minhash, "_links_of_small", counted)
    rows = family(150, 1)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert {r.doc_id: r.component_id for r in found} == components_of(rows, 80)
    assert 0 < sum(x or 0 for x in met) <= 3 * len(rows) * len(rows), met


def test_parities_differ_no_more_than_sets():
    r = np.random.default_rng(1)
    pool = r.integers(0, 1 << 63, 5000).astype(np.uint64)
    sets = [np.unique(r.choice(pool, n)) for n in (1, 3, 40, 40, 300, 2000)] + [np.zeros(0, np.uint64), pool[:1000], pool[:1007]]
    found = minhash.parities(np.concatenate(sets), np.cumsum([0, *map(len, sets)])).view(np.uint64)
    for x, a in zip(sets, found):
        for y, b in zip(sets, found):
            assert int(np.bitwise_count(a ^ b).sum()) <= len(np.setxor1d(x, y))
    assert int(np.bitwise_count(found[-1] ^ found[-2]).sum()) == 7 or len(set((pool[1000:1007] % 1024).tolist())) < 7
