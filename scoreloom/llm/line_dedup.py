"""Line dedup: hashes of lines in range partitions, first occurrences by a stream over the sorted rows, keep bitmaps as the result."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm._common import kept, quoted, shuffle_partitions

LINES = "h1 long, h2 long, doc_id long, version long, pos int"
#: kind 0: a line that goes; 1: a line of the first document of a partition's first key, to be held against earlier partitions;
#: 2: a key at a partition's edge with the first document that the partition has of it.
SEEN = "kind int, h1 long, h2 long, doc_id long, version long, pos int"


def _line_hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, rows, places = [], [], []
            for row, text in enumerate(batch.column("text")):
                text = text.as_py()
                for pos, line in enumerate(text.split("\n") if text else ()):
                    if len(line) >= min_chars:
                        key = line.strip(" \t\n\x0b\x0c\r")
                        if len(key) >= min_chars:
                            digests.append(xxhash.xxh3_128_digest(key.encode().lower()))
                            rows.append(row)
                            places.append(pos)
            halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column("doc_id").take(take), batch.column("version").take(take), pa.array(places, pa.int32())],
                names=["h1", "h2", "doc_id", "version", "pos"],
            )

    return run


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key, document and position: what goes, and what the partition's edges have. The state is one key."""
    key, first, head = None, None, True
    names = ["h1", "h2", "doc_id", "version", "pos"]

    def out(kind: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        arrays = [pa.array(np.full(len(columns[0]), kind, np.int32)), *(pa.array(c.astype(np.int32 if n == "pos" else np.int64)) for n, c in zip(names, columns))]
        return pa.RecordBatch.from_arrays(arrays, names=["kind", *names])

    def edge(kind_key: tuple[int, int], doc: int) -> pa.RecordBatch:
        return out(2, [np.array([x]) for x in (*kind_key, doc, 0, 0)])

    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, version, pos = (np.asarray(batch.column(n)) for n in names)
        new = np.concatenate([[(int(h1[0]), int(h2[0])) != key], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        starts = np.flatnonzero(new)
        firsts = np.concatenate([[first if first is not None else 0], doc[starts]])
        of_key = np.cumsum(new)
        own_first = firsts[of_key]
        in_head = (of_key == (1 if key is None else 0)) & head
        goes = doc != own_first
        pending = in_head & ~goes
        for kind, mask in ((0, goes), (1, pending)):
            if mask.any():
                yield out(kind, [c[mask] for c in (h1, h2, doc, version, pos)])
        if head and len(starts) > (1 if key is None else 0):  # the first key ends here
            yield edge(*(((int(h1[0]), int(h2[0])), int(own_first[0])) if key is None else (key, first)))
            head = False
        key, first = (int(h1[-1]), int(h2[-1])), int(own_first[-1])
    if key is not None:
        yield edge(key, first)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for places in batch.column("places"):
            places = np.asarray(places.values)
            goes = np.zeros((int(places.max()) // 8 + 1) * 8, bool)
            goes[places] = True
            maps.append(zlib.compress(np.packbits(~goes).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "version", "n_dropped")), pa.array(maps, pa.binary())], names=["doc_id", "version", "n_dropped", "bitmap"])


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, version, n_dropped, bitmap) of each document that loses lines.

    A line's key is the line without white space of ASCII at its ends, A-Z in lower case; keys under min_chars code points stay.
    A key that several documents hold stays only in that with the smallest doc_id, there at every place. bitmap: zlib of packed
    bits, 1 for lines that stay; lines after its last bit stay.

    Keys are 128-bit hashes. Rows are dealt by range of (key, doc_id) and sorted by position as well, so a line that a third of all
    documents hold spreads over many partitions. Each partition streams through its rows with one key as its state, and tells the
    first document of its first and last key; those few rows, two a partition, settle keys that cross partitions.

    version is xxhash64(text): repeated rows of one doc_id are one document, with a bitmap for each of its texts. Rows whose
    doc_id is null take no part. Null and empty texts have one empty line.
    """
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("version"))
    lines = texts.mapInArrow(_line_hashes(min_chars), LINES)
    dealt = lines.repartitionByRange(shuffle_partitions(spark), "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    seen = kept(dealt.mapInArrow(_first_occurrences, SEEN))
    edges = seen.where("kind = 2").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    settled = seen.where("kind = 1").join(edges, ["h1", "h2"]).where("doc_id > first")
    gone = seen.where("kind = 0").select("doc_id", "version", "pos").unionByName(settled.select("doc_id", "version", "pos"))
    by_doc = gone.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("places"))
    return by_doc.withColumn("n_dropped", F.size("places").cast("long")).mapInArrow(_bitmaps, "doc_id long, version long, n_dropped long, bitmap binary")


def kept_lines(text: str | None, bitmap: bytes | None) -> list[str]:
    lines = (text or "").split("\n")
    if bitmap is None:
        return lines
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)).astype(bool)[: len(lines)]
    return [x for x, k in zip(lines, keep) if k] + lines[len(keep) :]


def with_bitmaps(docs: DataFrame, **how) -> DataFrame:
    """(row, doc_id, text, n_dropped, bitmap): each row of docs, its columns other than text as the struct row; n_dropped and bitmap are null
    where nothing goes. So no name of docs clashes with these."""
    maps = keep_bitmaps(docs, **how).select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "n_dropped", "bitmap")
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns if c != "text"]).alias("row"), "doc_id", "text", F.xxhash64("text").alias("version"))
    return rows.join(maps, (F.col("doc_id") == F.col("_id")) & (F.col("version") == F.col("_version")), "left").select("row", "doc_id", "text", "n_dropped", "bitmap")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        totals, digests = [], []
        for text, bitmap in zip(batch.column("text"), batch.column("bitmap")):
            text = text.as_py()
            totals.append((text or "").count("\n") + 1)
            digests.append(hashlib.sha256("\n".join(kept_lines(text, bitmap.as_py())).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(totals, pa.int64()), batch.column("n_dropped").fill_null(0), pa.array(digests)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"]
        )


def line_digests(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each document: its lines before dropping, and what stays, joined by newlines.

    Null and empty texts have one empty line. An empty table gives no row.
    """
    found = with_bitmaps(docs.select("doc_id", "text"), **how).drop("row")
    return found.mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if t.as_py() is None else "\n".join(kept_lines(t.as_py(), b.as_py())) for t, b in zip(batch.column("text"), batch.column("bitmap"))]
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array(texts, pa.string()))


def drop_lines(docs: DataFrame, **how) -> DataFrame:
    """docs with repeated lines cut from their texts; other columns as they are, whatever their names. A text that loses every line
    becomes empty; a null text stays null. An empty table gives no row."""
    found = with_bitmaps(docs, **how)
    return found.mapInArrow(_texts, found.schema).select(*[F.col("text" if c == "text" else f"row.{quoted(c)}").alias(c) for c in docs.columns])
