"""Language ID by a convolutional network over bytes, trained in numpy on labelled text."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm._common import map_arrow, slices, text_bytes, with_fields

WIDTHS = (2, 3, 4)
FILTERS = 12
WINDOW = 192
EMBEDDED = 8
LETTER = regex.compile(r"\p{L}")


class Network(NamedTuple):
    """pairs[k]: what bytes (a, b) at places 2k and 2k + 1 of a filter add, for all filters at once, as a table over a * 256 + b.

    A filter's answer at a place is the sum of its taps' weights times the bytes' embeddings; both are known per byte, so the
    tables hold that product, and two look-ups give the answers of all filters of up to 4 bytes.
    """

    labels: list[str]
    pairs: tuple[np.ndarray, np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    shift: np.ndarray


def _tables(embedding: np.ndarray, taps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    single = np.einsum("be,tef->tbf", embedding, taps).astype(np.float32)
    return tuple((single[k][:, None] + single[k + 1][None]).reshape(65536, -1) for k in (0, 2))


def _mask() -> np.ndarray:
    """Which taps each filter has: widths 2, 3 and 4 in one block of four."""
    return np.concatenate([np.repeat((np.arange(max(WIDTHS)) < w)[:, None], FILTERS, axis=1) for w in WIDTHS], axis=1)


def train(texts: list[bytes], langs: list[str], epochs: int = 12, seed: int = 11, rate: float = 0.004) -> Network:
    """Fit embedding, filters and softmax by Adam on windows of the texts. Deterministic for the same rows in the same order."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    span = WINDOW + max(WIDTHS) - 1
    rows, wanted = [], []
    for text, lang in zip(texts, langs):
        for at in range(0, max(len(text), 1), WINDOW):
            piece = text[at : at + span]
            if at and len(piece) < WINDOW // 4:
                continue
            rows.append(np.frombuffer(piece.ljust(span, b" "), np.uint8))
            wanted.append(labels.index(lang))
    if not rows:
        return Network(labels, tuple(np.zeros((65536, len(WIDTHS) * FILTERS), np.float32) for _ in "ab"), *(np.zeros(s, np.float32) for s in (len(WIDTHS) * FILTERS, (len(WIDTHS) * FILTERS, 0), 0)))
    x, y = np.stack(rows), np.array(wanted)
    n, f, k = len(x), len(WIDTHS) * FILTERS, len(labels)
    mask = _mask()[:, None, :]
    balance = np.bincount(y, minlength=k)
    weight = (len(y) / (k * balance))[y]
    p = {
        "e": rng.normal(0, 0.5, (256, EMBEDDED)), "t": rng.normal(0, 0.3, (4, EMBEDDED, f)) * mask, "b": np.zeros(f), "w": rng.normal(0, 0.2, (f, k)), "s": np.zeros(k),
    }
    p = {name: v.astype(np.float32) for name, v in p.items()}
    m, v = ({name: np.zeros_like(z) for name, z in p.items()} for _ in "mv")
    step, size = 0, 128
    for epoch in range(epochs):
        order = rng.permutation(n)
        for start in range(0, n, size):
            pick = order[start : start + size]
            bx, by, bw = x[pick], y[pick], weight[pick].astype(np.float32)
            short = rng.random(len(pick)) < 0.25  # some windows are cut short, as those of short texts are
            bx = bx.copy()
            for r in np.flatnonzero(short):
                bx[r, rng.integers(8, span) :] = 32
            emb = p["e"][bx]
            answer = sum(emb[:, t : t + WINDOW] @ p["t"][t] for t in range(4))
            top = answer.argmax(axis=1)
            pooled = np.take_along_axis(answer, top[:, None], axis=1)[:, 0] + p["b"]
            hidden = np.maximum(pooled, 0)
            logits = hidden @ p["w"] + p["s"]
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            d = prob.copy()
            d[np.arange(len(by)), by] -= 1
            d *= bw[:, None] / len(by)
            g = {"w": hidden.T @ d, "s": d.sum(axis=0)}
            dh = (d @ p["w"].T) * (pooled > 0)
            g["b"] = dh.sum(axis=0)
            gt, ge = np.zeros_like(p["t"]), np.zeros_like(p["e"])
            r = np.arange(len(by))[:, None]
            for t in range(4):
                seen = bx[r, top + t]
                gt[t] = np.einsum("rfe,rf->ef", p["e"][seen], dh)
                np.add.at(ge, seen.ravel(), (p["t"][t].T[None] * dh[..., None]).reshape(-1, EMBEDDED))
            g["t"], g["e"] = gt * mask, ge
            step += 1
            for name in p:
                m[name] = 0.9 * m[name] + 0.1 * g[name]
                v[name] = 0.999 * v[name] + 0.001 * g[name] ** 2
                lr = rate * (1 - 0.8 * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                p[name] = (p[name] - lr * m[name] / (np.sqrt(v[name]) + 1e-8)).astype(np.float32)
    return Network(labels, _tables(p["e"], p["t"]), p["b"], p["w"], p["s"])


def scores(net: Network, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each text's share of every label: the mean of log probabilities of all its windows, made to add up to 1.

    Windows of WINDOW places cover each text from end to end; the last is filled up with blanks. They are scored in batches.
    """
    sizes = np.diff(offsets)
    n_windows = np.maximum(1, -(-sizes // WINDOW))
    text = np.repeat(np.arange(len(sizes)), n_windows)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    span = WINDOW + max(WIDTHS) - 1
    padded = np.concatenate([flat, np.full(span, 32, np.uint8)])
    total = np.zeros((len(sizes), len(net.labels)))
    for a in range(0, len(text), 256):
        of, first = text[a : a + 256], offsets[:-1][text[a : a + 256]] + nth[a : a + 256] * WINDOW
        at = first[:, None] + np.arange(span)
        end = offsets[1:][of][:, None]
        x = np.where(at < end, padded[np.minimum(at, len(padded) - 1)], 32).astype(np.int32)
        two = x[:, :-1] * 256 + x[:, 1:]
        answer = np.take(net.pairs[0], two[:, :WINDOW], axis=0)
        answer += np.take(net.pairs[1], two[:, 2 : WINDOW + 2], axis=0)
        hidden = np.maximum(answer.max(axis=1) + net.bias, 0)
        logits = hidden @ net.weights + net.shift
        logits -= logits.max(axis=1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
        np.add.at(total, of, logits)
    total /= n_windows[:, None]
    total = np.exp(total - total.max(axis=1, keepdims=True)) if len(net.labels) else total
    return total / total.sum(axis=1, keepdims=True) if len(net.labels) else total


def training_rows(docs: DataFrame, per_lang: int = 400, chars: int = 1200, langs: int = 200) -> list:
    """A bounded sample of labelled rows of docs (doc_id, text, lang): up to per_lang documents of each of the `langs` most common
    languages, the first by a hash of doc_id and text, and of each `chars` characters from a place that the hash picks as well.

    Each language's different documents are counted first, approximately; then rows under a bound of the hash, by which each language
    gives about one and a half times per_lang of these, are told apart and numbered, and the first per_lang come to the driver, however
    many files and rows there are. Repeated rows count once, so they take no other document's or language's place. Rows without
    doc_id, text or lang aren't sampled. An empty table gives no row.
    """
    digest = F.xxhash64(F.col("doc_id"), F.col("text"))
    start = F.pmod(digest, F.greatest(F.char_length("text") - chars, F.lit(1)).cast("long")).cast("int") + 1
    labelled = docs.where("lang is not null and text is not null and doc_id is not null and length(text) > 0")
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct(digest, 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(langs).collect()
    if not counts:
        return []
    bounds = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 1.5 * per_lang / r["n"])) for r in counts], "lang string, share double")
    cut = labelled.select("lang", "doc_id", digest.alias("digest"), F.substring(F.col("text"), start, F.lit(chars)).alias("text")).join(F.broadcast(bounds), "lang")
    under = F.pmod(F.shiftright("digest", 8), F.lit(1 << 40)) < F.col("share") * F.lit(float(1 << 40))
    different = cut.where(under).dropDuplicates(["lang", "digest"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("digest"))
    return different.withColumn("nth", nth).where(F.col("nth") <= per_lang).orderBy("digest", "lang").collect()


def fit(docs: DataFrame, **how) -> Network:
    """A network fitted on a bounded sample of the rows of docs that have a lang; see training_rows for the bound."""
    rows = training_rows(docs, **how)
    return train([r["text"].encode() for r in rows], [r["lang"] for r in rows])


def held_out_of(doc_id) -> F.Column:
    """Whether a document is kept from learning: crc32 of its doc_id as text, modulo 3, is 1. Null doc_id: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """docs with the columns lang_pred and score (0 to 1), from the whole text of each row alone.

    und with score 0 where the text is null or has no letter, or where nothing was learned. Columns of docs with these names are
    replaced. Repeated rows are predicted alike; an empty table gives no row.
    """
    docs = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text")
            lettered = [bool(t) and LETTER.search(t) is not None for t in texts.to_pylist()]
            share = scores(net, *text_bytes(texts))
            best = share.argmax(axis=1) if net.labels else [0] * len(lettered)
            found = [(net.labels[b], float(share[k, b])) if ok and net.labels else ("und", 0.0) for k, (ok, b) in enumerate(zip(lettered, best))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([min(1.0, y) for _, y in found], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return map_arrow(docs, run, with_fields(docs.schema, "lang_pred string, score double"))
