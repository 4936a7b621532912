"""Whitening, periodic runs and chat formatting against brute force, with nulls, ties, repeats, empty tables and odd columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("scoreloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from scoreloom.llm import chat, periodic, queries, whitening  # noqa: E402

SF = "/root/testdata/sf0.001"


def brute_runs(w, min_length=6, min_exponent=4):
    found = []
    for q in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if n >= max(min_length, min_exponent * q) and not any(w[i : i + n - r] == w[i + r : i + n] for r in range(1, q)):
                found.append((i, n, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def digest(doc_id, text):
    w = [x.decode() for x in (text or "").encode().split()]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest())


def planted(doc_id, text):
    w = [x.decode() for x in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is None or h % 10 or not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))


def test_runs_by_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(0, 4)):
            n = rng.randint(0, 50)
            w = rng.choices("abcd"[: rng.randint(1, 4)], k=n)
            if n and rng.random() < 0.6:
                a, e = rng.randrange(n), rng.randint(3, 10)
                w = [w[i] if i < a else w[a + (i - a) % (1 + (n - a) // e)] for i in range(n)]
            texts.append(" ".join(w))
        for least in ((6, 4), (2, 2), (9, 3)):
            _, ids, starts = periodic.numbered_words(texts)
            runs = periodic.runs_of(ids, *least).tolist()
            for k, text in enumerate(texts):
                assert [(s - starts[k], n, q) for s, n, q in runs if starts[k] <= s < starts[k + 1]] == brute_runs(text.split(), *least)


def test_large_classes_are_united_in_order():
    rng = random.Random(3)
    phrase = "a b c d e f".split()
    w = [x for k in range(150) for x in [*phrase, *([f"w{rng.randrange(9)}"] * rng.randint(0, 7))]]
    _, ids, _ = periodic.numbered_words([" ".join(w)])
    assert periodic.runs_of(ids, 6, 4).tolist() == [list(r) for r in brute_runs(w)]


def test_runs_of_odd_rows(spark):
    long = " ".join(f"w{k % 379}" for k in range(3000)) + " x" * 50
    texts = [None, "", " \n\t ", "a " * 6, "a\x0ba\x0ca\ra\na\ta", "a b a b a b a b c", "é é é é é é é é", "x x x x", long, "a b a b a b a b c"]
    rows = [(k if k % 4 else None, t, "en", {"k": 1}, "start", "runs") for k, t in enumerate(texts)] + [(1, "a a a a a a", "en", None, None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` map<string,int>, start string, runs string").repartition(3)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, periodic.run_digests(df).collect()), key=key) == sorted([digest(d, t) for d, t, *_ in rows], key=key)
    found = periodic.find_runs(df)
    assert set(found.columns) == set(df.columns)
    for r in found.collect():
        assert [tuple(x) for x in r.runs] == brute_runs([x.decode() for x in (r.text or "").encode().split()])
    left = periodic.collapse(df)
    assert left.columns == df.columns and sorted(r.text for r in left.collect()) == sorted(collapsed(w, brute_runs(w)) for w in ([x.decode() for x in (t or "").encode().split()] for _, t, *_ in rows))
    for operator in (periodic.run_digests, periodic.find_runs, periodic.collapse, periodic.with_planted_periods):
        assert operator(df.limit(0)).collect() == []


def test_periodic_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic(spark, SF).collect()}
    assert got == {d: digest(d, planted(d, t)) for d, t in docs} and sum(r[1] > 0 for r in got.values()) > 5
    odd = spark.createDataFrame([(None, "a b"), (4, None), (4, ""), (10, "a  b\nc d e f g")], "doc_id long, text string")
    assert [r.text for r in periodic.with_planted_periods(odd).collect()] == [planted(r.doc_id, r.text) for r in odd.collect()]


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(5)
    bits = ["<", "|", "s", ">", "/", "\\", "[", "INST]", "/INST]", "\n", "<|end|>\n", "<|turn:", "|>\n", "SYS", "a", "é", "😀", "<<SYS>>", "</s>", "$0"]
    said = lambda: "".join(rng.choices(bits, k=rng.randint(0, 12)))
    role = lambda: rng.choice(["user", "assistant", "assistant", "system", None, said()])
    rows = [(c or None, rng.choice([k, k, None, 3]), role(), rng.choice([said(), said(), None]), "x", "whole") for c in range(60) for k in range(rng.randint(1, 7))]
    rows += rows[:4] + [(99, k, "assistant" if k % 2 else "user", f"turn {k} ", "x", "w") for k in range(2000)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, `a.b` string, whole string").repartition(4)


def spoken(talks):
    out = {}
    for r in talks.collect():
        out.setdefault(r.conv_id, []).append((r.turn is not None, r.turn or 0, (r.role or "").encode(), (r.text or "").encode()))
    return {c: [(x[2].decode(), x[3].decode()) for x in sorted(own)] for c, own in out.items()}


def test_chat_reads_back(talks):
    wanted = {}
    for c, turns in spoken(talks).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        wanted[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {r.conv_id: tuple(r)[1:5] for r in chat.digests(talks).collect()} == wanted


def test_chat_examples(talks):
    turns, got = spoken(talks), {}
    for r in chat.examples(talks.where("conv_id is null or conv_id < 99")).collect():
        got.setdefault(r.conv_id, []).append(r)
    for c, rows in got.items():
        rows.sort(key=lambda r: r.example)
        ends = [k + 1 for k, (role, _) in enumerate(turns[c]) if role == "assistant"]
        assert [r.n_turns for r in rows] == (ends if ends[-1:] == [len(turns[c])] else [*ends, len(turns[c])]) and [r.is_whole for r in rows] == [False] * (len(rows) - 1) + [True]
        for r in rows:
            assert rows[-1].text.startswith(r.text) and not any(x in r.text for x in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))
            assert r.text.count("<|") == 2 * r.n_turns
            role, said = turns[c][r.n_turns - 1]
            if role == "assistant":
                assert r.text[r.loss_start : r.loss_stop].replace("\\\\", "\0").replace("\\", "").replace("\0", "\\") == said
            else:
                assert r.loss_start is None and r.loss_stop is None
    assert chat.examples(talks.limit(0)).collect() == [] and chat.digests(talks.limit(0)).collect() == []


def test_chat_deals_once_and_in_the_jvm(spark):
    plan = queries.op13_chat(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan


def whitened(vectors, wanted=8):
    x = np.floor(1024 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    c = (n * x - sums) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:wanted], u[:, ::-1][:, :wanted]
    return ((n * x - sums) ** 2).sum(axis=1), c @ u / np.sqrt(e), e / np.trace(c.T @ c / n)


def test_whitening_query(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = sorted(vectors)
    deviation, y, explained = whitened([vectors[k] for k in ids])
    rows = queries.op11_whitening(spark, SF).collect()
    assert len(rows) == 8 * len(ids)
    at, got = {k: j for j, k in enumerate(ids)}, np.zeros_like(y)
    for r in rows:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == len(ids) and r.deviation == deviation[at[r.vec_id]] and r.explained == pytest.approx(explained[r.component - 1], rel=1e-10) and r.identity_error < 1e-9
    got *= np.sign((got * y).sum(axis=0))
    assert np.abs(got - y).max() < 1e-6


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [[float(v) for v in rng.normal(size=5) * [1, 2, 3, 4, 5]] for _ in range(40)]
    rows = [(k, v) for k, v in enumerate(good)] + [(0, good[0])] * 3 + [(None, good[1])]
    bad = [(90, None), (91, [1.0, None, 1.0, 1.0, 1.0]), (92, [1.0, float("nan"), 1.0, 1.0, 1.0]), (93, [float("-inf")] * 5), (94, [])]
    schema = "vec_id long, embedding array<double>, n string, x string, `a.b` map<string,int>"
    df = spark.createDataFrame([(k, v, "n", "x", {"k": 1}) for k, v in rows + bad], schema).repartition(3)
    deviation, y, _ = whitened([v for _, v in rows])
    got = whitening.whiten(df).collect()
    key = lambda k, d: (k is None, k or 0, d)
    assert sorted(key(r.vec_id, r.deviation) for r in got if r.component == 1) == sorted(key(k, int(d)) for (k, _), d in zip(rows, deviation)) and len(got) == 5 * len(rows)
    assert sorted(abs(r.whitened) for r in got) == pytest.approx(sorted(np.abs(y).ravel().tolist()), abs=1e-9)
    flat = spark.createDataFrame([(k, [float(k), 2.0 * k, 7.0]) for k in range(9)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(9)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).collect() == [] and whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.where("vec_id > 89")).collect() == []
    with pytest.raises(ValueError):
        whitening.whiten(same.union(flat))
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [0.0])], "vec_id long, embedding array<double>")).collect()


@pytest.mark.parametrize("d", [1, 3, 8, 20, 90])
def test_eigenpairs_of_hard_spectra(d):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    for values in (np.ones(d), 0.5 ** np.arange(d), np.r_[np.full(min(d, 3), 7.0), np.linspace(6.99, 0, d - min(d, 3))], np.r_[1.0, np.zeros(d - 1)], rng.uniform(1, 1.01, d)):
        v = (q * values) @ q.T
        found = whitening.eigenpairs(lambda b, v=v: v @ b, d, 8)
        wanted = np.sort(values)[::-1][: min(d, 8)]
        assert np.abs(found.values - wanted).max() < 1e-13 and np.linalg.norm(v @ found.vectors - found.vectors * found.values, axis=0).max() < 1e-13
        assert np.abs(found.vectors.T @ found.vectors - np.eye(len(wanted))).max() < 1e-13
