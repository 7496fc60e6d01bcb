"""WARC archives: records written by Spark's own text sink, read back with segments put together again.

A record is a line of the text sink whose line separator is the two line ends
that close a WARC record, so archives are written by all executors under Spark's
commit protocol, to any file system that Spark knows. A block longer than
`segment_bytes` continues in records of its own. Reading groups these by origin
id, orders them by segment number, verifies the total length, and decodes the
chunked transfer framing.

An archive is cut by its number of records, each of at most a segment's bytes, so
it is at most `records_per_archive` times `segment_bytes` long, and is parsed once.

Defined results: a null payload counts as empty; a record's id comes from page
id, url and payload, so repeated rows are equal records, and as many when read; of
pages tied for the largest id with one payload each is a response; a null page id
is left out of the record and null when read, a null url likewise; a very long
payload is many segments, held together when it is read; an empty table gives
archives without records; other columns are ignored. Segments that are missing or
don't add up raise an error.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlight.llm.common import HOT_KEYS, counted_join, durable, spread_join

END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PARSED = "record_id string, page_id long, record_type string, refers_id string, segment int, total long, block binary, payload_bytes long, payload_digest string"


@dataclass(frozen=True)
class WarcParams:
    #: Payloads from this size on are written once and revisited.
    revisit_bytes: int = 1000
    segment_bytes: int = 32_768
    chunk_bytes: int = 8192
    records_per_archive: int = 2048
    date: str = "2024-01-01T00:00:00Z"


def chunked(payload: bytes, size: int) -> bytes:
    parts = [payload[k : k + size] for k in range(0, len(payload), size)]
    return b"".join([b"%x\r\n%b\r\n" % (len(x), x) for x in parts] + [b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if len(out[-1]) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + n


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(END)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def _records(record_id: str, page_id: int | None, url: str | None, payload: bytes, refers_id: str | None, p: WarcParams) -> Iterator[bytes]:
    digest = "sha1:" + base64.b32encode(sha1(payload).digest()).decode()
    uri = None if url is None else " ".join(url.split())
    common = [("WARC-Date", p.date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest), ("X-Page-ID", page_id), ("Content-Type", "application/http;msgtype=response")]
    if refers_id:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id), ("WARC-Refers-To", refers_id), ("WARC-Profile", PROFILE), *common], HTTP)
        return
    block = HTTP + chunked(payload, p.chunk_bytes)
    parts = [block[k : k + p.segment_bytes] for k in range(0, len(block), p.segment_bytes)]
    if len(parts) == 1:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", record_id), *common], block)
        return
    for k, part in enumerate(parts, 1):
        if k == 1:
            yield _record([("WARC-Type", "response"), ("WARC-Record-ID", record_id), ("WARC-Segment-Number", 1), *common], part)
        else:
            own = f"{record_id[:-1]}-{k}>"
            total = len(block) if k == len(parts) else None
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total), ("WARC-Date", p.date)], part)


def _record_id(page_id: Column, url: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_archives(pages: DataFrame, where: str, p: WarcParams = WarcParams()) -> None:
    """Archives of `page_id`, `url` and `html` in the folder `where`, gzipped."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha1("payload"))
    rows = rows.withColumn("record_id", _record_id(F.col("page_id"), F.col("url"), F.col("digest")))
    long = rows.where(F.octet_length("payload") >= p.revisit_bytes)
    again = long.groupBy("digest").agg(F.max(F.struct("page_id", "record_id")).alias("last"), F.count("*").alias("n")).where("n > 1")
    again = durable(again.select("digest", F.col("last.record_id").alias("last_id"), F.col("last.page_id").alias("last_page")))
    if again.count() <= HOT_KEYS:  # a checked size; the same rows either way
        rows = rows.join(F.broadcast(again), "digest", "left")
    else:
        rows = spread_join(rows, again, ["digest"], F.col("record_id"))
    refers = F.when((F.octet_length("payload") >= p.revisit_bytes) & F.col("last_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_page")), F.col("last_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for values in zip(*[c for c in b.columns]):
                for r in _records(*(v.as_py() for v in values), p):
                    out.append(r)
                    size += len(r)
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = rows.select("record_id", "page_id", "url", "payload", refers.alias("refers_id")).mapInArrow(run, "record binary")
    lines = records.select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", p.records_per_archive).text(where)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields, in lower case, and block of each record; gzip members one after another, or plain."""
    while archive[:2] == b"\x1f\x8b":
        parts = []
        while archive:
            d = zlib.decompressobj(31)
            parts.append(d.decompress(archive))
            archive = d.unused_data
        archive = b"".join(parts)
    at = 0
    while at < len(archive):
        end = archive.index(END, at)
        first, *lines = archive[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record starts at {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(fields["content-length"])
        block = archive[end + 4 : end + 4 + n]
        if len(block) != n or archive[end + 4 + n : end + 8 + n] != END:
            raise ValueError(f"the record at {at} is cut short")
        yield fields, block
        at = end + 8 + n


def _parsed(archives: DataFrame) -> DataFrame:
    """Records of a single segment with their payload's length and digest, and segments with their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for f, block in parse(content.as_py()):
                    page = int(f["x-page-id"]) if "x-page-id" in f else None
                    if segment := f.get("warc-segment-number"):
                        origin = f.get("warc-segment-origin-id", f["warc-record-id"])
                        rows.append((origin, page, f["warc-type"], None, int(segment), int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, block, None, None))
                        size += len(block)
                    else:
                        revisit = f["warc-type"] == "revisit"
                        payload = b"" if revisit else payload_of(block)
                        digest = None if revisit else _checked(f["warc-payload-digest"], payload)
                        rows.append((f["warc-record-id"], page, f["warc-type"], f.get("warc-refers-to"), None, None, None, None if revisit else len(payload), digest))
                    if size > 1 << 24:
                        yield _as_batch(rows)
                        rows, size = [], 0
                yield _as_batch(rows)

    return archives.mapInArrow(run, PARSED)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in PARSED.split(", ")])


def _checked(said: str, payload: bytes) -> str:
    h = sha1(payload)
    if said != "sha1:" + base64.b32encode(h.digest()).decode():
        raise ValueError("a payload doesn't have its digest")
    return h.hexdigest()


def reassembled(segments: DataFrame) -> DataFrame:
    """Records from their segments: all numbers from 1 to the last, as long together as the last one says.

    Equal records have equal segments; these are counted first, and a record comes out as often as each of its segments.
    """
    once = segments.groupBy("record_id", "segment", "total", "page_id", "block").agg(F.count("*").alias("times"))
    one = F.struct("segment", "block", "total", "page_id", "times")
    whole = once.groupBy("record_id").agg(F.sort_array(F.collect_list(one)).alias("parts"))  # a record's own segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for record_id, parts in zip(b.column(0).to_pylist(), b.column(1)):
                own = parts.as_py()
                if len({x["segment"] for x in own}) < len(own):
                    raise ValueError(f"{record_id}: two segments have one number")
                block = b"".join(x["block"] for x in own)
                if [x["segment"] for x in own] != list(range(1, len(own) + 1)) or own[-1]["total"] != len(block) or len({x["times"] for x in own}) > 1:
                    raise ValueError(f"{record_id}: segments are missing")
                payload = payload_of(block)
                row = (record_id, own[0]["page_id"], "response", None, None, None, None, len(payload), sha1(payload).hexdigest())
                for k in range(0, own[0]["times"], 4096):
                    yield _as_batch([row] * min(4096, own[0]["times"] - k))

    return whole.mapInArrow(run, PARSED)


def read_archives(spark: SparkSession, where: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; a revisit has its response's payload."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(where).select("content")
    columns = ["record_id", "page_id", "record_type", "refers_id", "payload_bytes", "payload_digest"]
    parsed = durable(_parsed(archives))
    whole = durable(reassembled(parsed.where("segment IS NOT NULL")).select(columns))
    records = parsed.where("segment IS NULL").select(columns).unionByName(whole)
    responses, revisits = records.where("record_type = 'response'"), records.where("record_type = 'revisit'")
    asked = revisits.groupBy("refers_id").agg(F.count("*").alias("n"))
    origin = responses.select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("digest"))
    origin = durable(asked.join(origin, "refers_id").dropDuplicates(["refers_id"]))
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    resolved = counted_join(revisits.select("refers_id", "page_id", "record_type"), origin, "refers_id", revisits.count(), "left")
    resolved = resolved.withColumnsRenamed({"bytes": "payload_bytes", "digest": "payload_digest"}).select(out)
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(out).unionByName(resolved)
