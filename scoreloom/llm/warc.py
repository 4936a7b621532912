"""WARC archives: writing with revisits and segments, reading with segment reassembly and chunked transfer decoding."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.llm._common import NULL_ID, hot_keys, joined, kept, slices

END = b"\r\n\r\n"
#: Fixed date of the records: archives of the same rows are the same.
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: What reading gives per record. error: null, or why the payload can't be had.
RECORD = "record_id string, record_type string, page_id long, url string, refers_id string, payload_bytes long, payload_digest string, error string"
PARSED = f"{RECORD}, payload binary, origin string, segment int, total long, block binary"


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def _chunked(payload: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(x), x) for x in (payload[k : k + size] for k in range(0, len(payload), size))]
    return b"".join(parts) + b"0" + END


def unchunked(body: bytes) -> bytes:
    """The bytes that a chunked transfer carries; extensions and trailers are passed over. ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no chunk size")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("short chunk")
        parts.append(body[at : at + size])
        at += size + 2


def _clean(url: str | None) -> str | None:
    return None if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def _name(page_id: int | None, digest: str, of_url: int, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{digest}/{of_url}/{nth}')}>"


def _records(segment_bytes: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            out = []
            for row in batch.to_pylist():
                name = _name(row["page_id"], row["digest"], row["of_url"], row["nth"])
                common = [("WARC-Date", DATE), ("WARC-Target-URI", _clean(row["url"])), ("WARC-Page-ID", row["page_id"]), ("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("Content-Type", "application/http;msgtype=response")]
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + END
                if row["refers_to"] is not None:
                    refers = ("WARC-Refers-To", _name(row["refers_to"], row["digest"], row["refers_url"], 1))
                    profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
                    out.append(_record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), refers, profile, *common], head))
                    continue
                block = head + _chunked((row["html"] or "").encode(), chunk_bytes)
                first = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common]
                if len(block) <= segment_bytes:
                    out.append(_record(first, block))
                    continue
                pieces = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
                out.append(_record([*first, ("WARC-Segment-Number", 1)], pieces[0]))
                for k, piece in enumerate(pieces[1:], 2):
                    own = f"<urn:uuid:{uuid.uuid5(SPACE, f'{name}/{k}')}>"
                    total = ("WARC-Segment-Total-Length", len(block) if k == len(pieces) else None)
                    out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k), total], piece))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return run


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 100, segment_bytes: int = 16384, chunk_bytes: int = 4096, records_per_file: int = 4000) -> None:
    """pages (page_id, url, html) as gzipped WARC files in the folder path.

    A page whose payload (html in UTF-8; null: empty) has min_revisit_bytes or more and equals that of a smaller page_id becomes a
    revisit of the smallest such page; all others are responses with a chunked body. Blocks over segment_bytes are cut into
    a first record and continuations. Rows that share page_id, url and payload are told apart by number; a null page_id is never
    revisited and revisits only if others have the payload. An empty table gives an archive without records. The text writer's line end
    closes each record, so a file is the records one after another, of bounded number and size.

    Which page is revisited is found on rows without their payload, and spread over tasks where very many pages have one payload.
    """
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    sized = pages.select("page_id", "url", "html", F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"), digest.alias("digest"))
    keyed = [F.coalesce("page_id", F.lit(NULL_ID)).alias("key"), F.xxhash64("url").alias("of_url"), "digest"]
    narrow = kept(sized.where(F.col("bytes") >= min_revisit_bytes).select("page_id", *keyed).distinct())
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "of_url"))).alias("first")
    again = kept(narrow.groupBy("digest").agg(first, F.count("*").alias("n")).where("n > 1 and first is not null"))
    of = again.select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.of_url").alias("refers_url"))
    revisits = joined(narrow, of, ["digest"], hot=hot_keys(again, ["digest"])).where("page_id is null or page_id > refers_to").drop("page_id")
    nth = F.row_number().over(Window.partitionBy("key", "of_url", "digest").orderBy("page_id"))
    placed = sized.select("page_id", "url", "html", *keyed).join(revisits, ["key", "of_url", "digest"], "left").withColumn("nth", nth)
    records = placed.select("page_id", "url", "html", "digest", "refers_to", "refers_url", "of_url", "nth").mapInArrow(_records(segment_bytes, chunk_bytes), "record binary")
    writer = records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip")
    writer.option("maxRecordsPerFile", records_per_file).text(path)


def _number(headers: dict[str, str], name: str) -> int | None:
    """A header's whole number; None if there is no such header. ValueError if it is something else, or no long."""
    text = headers.get(name)
    if text is not None and not (re.fullmatch(r"-?[0-9]{1,40}", text) and -(1 << 63) <= int(text) < 1 << 63):
        raise ValueError(name)
    return None if text is None else int(text)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, which may be gzipped as a whole or record by record.

    A record whose Content-Length is missing or no number has no block; the next one is looked for.
    """
    while content[:2] == b"\x1f\x8b":
        parts, rest = [], content
        while rest[:2] == b"\x1f\x8b":
            unzip = zlib.decompressobj(31)
            parts.append(unzip.decompress(rest))
            rest = unzip.unused_data
        content = b"".join(parts)
    at = 0
    while at < len(content):
        end = content.find(END, at)
        if end < 0:
            break
        lines = content[at:end].decode("utf-8", "replace").strip().split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        try:
            size = _number(headers, "content-length")
        except ValueError:
            size = None
        if size is None or size < 0:
            yield headers | {"content-length": "?"}, b""
            after = content.find(b"WARC/", start)
            at = after if after >= 0 else len(content)
            continue
        yield headers, content[start : start + size]
        at = start + size + 4


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP message, its transfer framing taken off."""
    head, _, body = block.partition(END)
    chunked = any(k.strip().lower() == b"transfer-encoding" and b"chunked" in v.lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:]))
    return unchunked(body) if chunked else body


def _opened(block: bytes, wanted: str | None) -> tuple[bytes | None, int | None, str | None, str | None]:
    try:
        payload = payload_of(block)
    except ValueError as e:
        return None, None, None, f"chunks: {e}"
    digest = hashlib.sha256(payload).hexdigest()
    return payload, len(payload), digest, None if wanted in (None, f"sha256:{digest}") else "digest"


def _parsed(with_payload: bool):
    names = [x.split()[0] for x in PARSED.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(n, types[t]) for n, t in (x.split() for x in PARSED.split(", "))])

    def row(headers: dict[str, str], block: bytes) -> dict:
        kind, name = headers.get("warc-type"), headers.get("warc-record-id")
        out = dict.fromkeys(names) | {"record_id": name, "record_type": kind, "url": headers.get("warc-target-uri"), "refers_id": headers.get("warc-refers-to")}
        wanted = headers.get("warc-payload-digest")
        try:
            _number(headers, "content-length")
            out["page_id"] = _number(headers, "warc-page-id")
            number, total = (_number(headers, x) for x in ("warc-segment-number", "warc-segment-total-length"))
        except ValueError as e:
            return out | {"error": f"header: {e}"}
        if number is not None:
            return out | {"origin": headers.get("warc-segment-origin-id", name), "segment": number, "total": total, "block": block, "payload_digest": wanted}
        if kind == "response":
            payload, size, digest, error = _opened(block, wanted)
            return out | {"payload_bytes": size, "payload_digest": digest, "error": error, "payload": payload if with_payload else None}
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                some, held = [], 0
                for headers, block in parse(content.as_py()):
                    some.append(row(headers, block))
                    held += len(some[-1]["block"] or some[-1]["payload"] or b"")
                    if held > 1 << 22 or len(some) >= 5000:
                        yield pa.RecordBatch.from_pylist(some, schema=schema)
                        some, held = [], 0
                yield pa.RecordBatch.from_pylist(some, schema=schema)

    return run


def _reassembled(with_payload: bool):
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                blocks, opened = [p["block"] for p in x["parts"]], (None, None, None, None)
                error = "segments" if [p["segment"] for p in x["parts"]] != list(range(1, len(blocks) + 1)) or x["total"] is None else "length" if sum(map(len, blocks)) != x["total"] else None
                if not error:
                    opened = _opened(b"".join(blocks), x["wanted"])
                out.append([x["origin"], "response", x["page_id"], x["url"], None, opened[1], opened[2], error or opened[3], opened[0] if with_payload else None])
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=[*names, "payload"])

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The pages in the WARC files of a folder: RECORD, refers_to and, if asked for, payload.

    Records with a segment number are grouped by the identifier of their origin, wherever they stand, and put in order; error says
    `segments` if one is missing, doubled or the total is unknown, `length` if they don't add up to it, `chunks: ...` if the
    transfer framing is broken, `digest` if the payload isn't what the header says. A revisit takes payload_bytes,
    payload_digest and payload from the response that it refers to, and that one's page_id as refers_to; error is `refers` if
    there is none. error says `header: ...` where a number that a record needs is missing or is none. Each file is read as a whole by
    one task. An empty folder, and archives without records, give no row.
    """
    parsed = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parsed(with_payload), PARSED)
    whole = parsed.where("segment is null and record_type in ('response', 'revisit')")
    parts = parsed.where("segment is not null").groupBy("origin").agg(
        F.max("page_id").alias("page_id"), F.max("url").alias("url"), F.max("payload_digest").alias("wanted"), F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    pieced = parts.mapInArrow(_reassembled(with_payload), f"{RECORD}, payload binary")
    responses = whole.where("record_type = 'response'").select(*pieced.columns).unionByName(pieced)
    of = responses.select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), *[F.col(c).alias(f"_{c}") for c in ("payload_bytes", "payload_digest", "payload", "error")])
    revisits = kept(whole.where("record_type = 'revisit'").select(*RECORD_NAMES))
    hot = hot_keys(revisits.groupBy("refers_id").agg(F.count("*").alias("n")), ["refers_id"])
    revisits = joined(revisits, of, ["refers_id"], "left", hot)
    error = F.coalesce("error", F.when(F.col("_payload_bytes").isNull() & F.col("_error").isNull(), F.lit("refers")).otherwise(F.col("_error")))
    found = revisits.select(
        "record_id", "record_type", "page_id", "url", "refers_id", F.col("_payload_bytes").alias("payload_bytes"), F.col("_payload_digest").alias("payload_digest"), error.alias("error"), F.col("_payload").alias("payload"), "refers_to",
    )
    both = responses.withColumn("refers_to", F.lit(None).cast("long")).unionByName(found)
    return both if with_payload else both.drop("payload")


RECORD_NAMES = [x.split()[0] for x in RECORD.split(", ")]
