"""WARC archives: pages written as records, long ones in segments, and read back by reassembling the segments.

The archives are gzip files of WARC/1.1 records: ``response`` records hold an HTTP response in chunked framing,
``revisit`` records the headers only, with the record that has the equal payload. A block over ``segment`` bytes goes on in
``continuation`` records, which name the first record as origin.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stable

END = b"\r\n\r\n"
URN = "urn:corbel"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing (RFC 9112, 7.1)."""
    parts = [b"%X\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if it is cut short or malformed. Extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        eol = body.find(b"\r\n", at)
        if eol < 0:
            raise ValueError("chunk size missing")
        size = int(body[at:eol].split(b";")[0].strip(), 16)
        if size == 0:
            return b"".join(out)
        data = body[eol + 2 : eol + 2 + size]
        if len(data) < size or body[eol + 2 + size : eol + 4 + size] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(data)
        at = eol + 4 + size


def _record(kind: str, record_id: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + END + block


def records(page_id: object, url: str | None, payload: bytes, keep: object, date: str, segment: int, chunk: int) -> list[bytes]:
    """The records of a page, without the two line ends after each; ``keep`` is the page it revisits, or None."""
    sha = hashlib.sha1(payload).digest()
    digest = "sha1:" + base64.b32encode(sha).decode()
    name = lambda x: f"{URN}:{'' if x is None else x}:{sha.hex()}"
    own = name(page_id)
    target = "".join((url or "").split())
    about = [("WARC-Date", date), *([("WARC-Target-URI", target)] if target else []), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if keep is not None:
        about += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{name(keep)}>")]
        return [_record("revisit", own, about, head + b"Content-Length: %d\r\n\r\n" % len(payload))]
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    if len(block) <= segment:
        return [_record("response", own, about, block)]
    cuts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [_record("response", own, [*about, ("WARC-Segment-Number", 1)], cuts[0])]
    for i, cut in enumerate(cuts[1:], 2):
        total = [("WARC-Segment-Total-Length", len(block))] if i == len(cuts) else []
        out.append(_record("continuation", f"{own}:{i}", [("WARC-Date", date), ("WARC-Segment-Origin-ID", f"<{own}>"), ("WARC-Segment-Number", i), *total], cut))
    return out


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", at_least: int = 0, segment: int = 32 << 10, chunk: int = 8 << 10, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record per row; of rows whose payloads of at least ``at_least`` bytes are equal, all but that of the largest id revisit it.

    Payloads are the html in UTF-8, null being empty. Rows that repeat an id and its html make equal records. A null id is kept
    as null. White space in URLs is dropped, a null URL left out. Other columns are not read. However long a payload is, a record's block has at most ``segment``
    bytes, as the rest goes on in further records, so a file of 20,000 records stays below 2 GB. An empty table makes archives without pages.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("body")).withColumn("sha", F.sha1("body"))
    big = rows.where(F.length("body") >= at_least)
    many = stable(big.groupBy("sha").agg(F.max("id").alias("keep"), F.count("*").alias("n")).where("n > 1").select("sha", "keep"))
    if many.count() <= 200_000:  # else both sides are shuffled
        many = F.broadcast(many)
    rows = rows.join(many, "sha", "left").withColumn("keep", F.when((F.length("body") >= at_least) & ~F.col("id").eqNullSafe(F.col("keep")), F.col("keep")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([_record("warcinfo", f"{URN}:info", [("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC file version 1.1\r\n")], pa.binary())], ["record"])
        for batch in batches:
            out: list[bytes] = []
            for page, url, body, keep in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "body", "keep"))):
                out += records(page, url, body, keep, date, segment, chunk)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    made = rows.select("id", "url", "body", F.col("keep").cast(kind).alias("keep")).mapInArrow(run, "record binary")
    made.select(F.col("record").cast("string")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", 20_000).text(path)


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record in a stream of bytes; ValueError if it ends within a record."""
    held = b""
    for piece in pieces:
        held += piece
        at = 0
        while True:
            head = held.find(END, at)
            if head < 0:
                break
            lines = held[at:head].decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"not a record: {lines[0][:40]!r}")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = int(fields["content-length"])
            if len(held) < head + 8 + size:
                break
            yield fields, held[head + 4 : head + 4 + size]
            at = head + 8 + size
        held = held[at:]
    if held:
        raise ValueError("archive cut short")


def _gunzip(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    stream = zlib.decompressobj(31)
    for i in range(0, len(content), step):
        data = content[i : i + step]
        while data:
            yield stream.decompress(data)
            data = stream.unused_data
            if data:
                stream = zlib.decompressobj(31)


PARTS = "kind string, record string, origin string, number int, total long, uri string, refers string, digest string, block binary"
PAGES = "record string, kind string, uri string, refers string, digest string, payload_bytes long, payload binary, complete boolean"


def _decoded(kind: str, digest: str | None, block: bytes) -> tuple[int | None, bytes | None, bool]:
    """Payload bytes of the full payload, the payload (none for revisits), and whether it is whole."""
    head, _, body = block.partition(END)
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if kind == "revisit":
        return int(http.get(b"content-length", 0)), None, True
    try:
        payload = unchunked(body) if http.get(b"transfer-encoding", b"").lower() == b"chunked" else body
    except ValueError:
        return None, None, False
    sound = digest is None or digest == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return len(payload), payload, sound


def _pages(rows: list[tuple]) -> pa.RecordBatch:
    names = ["record", "kind", "uri", "refers", "digest", "payload_bytes", "payload", "complete"]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(record, kind, uri, refers, digest, payload_bytes, payload, complete)`` for each response and revisit of the archives.

    Only segmented records are shuffled: by their origin, then put in order of their numbers. ``complete`` is false, and the payload null, if
    a segment is missing, the total length differs or the framing is cut short; false with the payload if its digest differs.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "record", "origin", "number", "total", "uri", "refers", "digest", "block"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            for content in batch.column("content"):
                for f, block in parse(_gunzip(content.as_py())):
                    if f["warc-type"] not in ("response", "revisit", "continuation"):
                        continue
                    bare = lambda k, f=f: f[k].strip("<>") if k in f else None
                    number, total = (int(f[k]) if k in f else None for k in ("warc-segment-number", "warc-segment-total-length"))
                    rows.append((f["warc-type"], bare("warc-record-id"), bare("warc-segment-origin-id") or bare("warc-record-id"), number, total, f.get("warc-target-uri"), bare("warc-refers-to"), f.get("warc-payload-digest"), block))
                    held += len(block)
                    if held >= 8 << 20:
                        yield out()
                        rows, held = [], 0
        yield out()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = zip(*(batch.column(c).to_pylist() for c in ("record", "kind", "uri", "refers", "digest", "block")))
            yield _pages([(r, k, u, ref, d, *_decoded(k, d, b)) for r, k, u, ref, d, b in cells])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for origin, segments in zip(batch.column("origin").to_pylist(), batch.column("segments").to_pylist()):
                first = segments[0]
                copies = sum(s["number"] == 1 for s in segments)
                chain = segments[:: max(1, copies)]  # a page that was written twice has every segment twice
                block = b"".join(s["block"] for s in chain)
                sound = copies > 0 and [s["number"] for s in chain] == list(range(1, len(chain) + 1)) and chain[-1]["total"] == len(block) and len(chain) * copies == len(segments)
                found = _decoded("response", first["digest"], block) if sound else (None, None, False)
                rows += [(origin, "response", first["uri"], None, first["digest"], *found)] * max(1, copies)
            yield _pages(rows)

    parts = files.mapInArrow(split, PARTS)
    cut = parts.where("number is not null").groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("number", "block", "total", "uri", "digest"))).alias("segments"))
    return parts.where("number is null").mapInArrow(whole, PAGES).unionByName(cut.mapInArrow(joined, PAGES))


def index(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of the archives that ``write`` made."""
    page = lambda c: F.when(F.split(c, ":")[2] != "", F.split(c, ":")[2]).cast(id_type)
    return read(spark, path).select(
        page(F.col("record")).alias("page_id"), "payload_bytes", F.regexp_replace("digest", "^sha1:", "").alias("payload_digest"), F.col("kind").alias("record_type"), page(F.col("refers")).alias("refers_to"), "complete"
    )
