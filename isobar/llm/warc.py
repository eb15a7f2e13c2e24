"""WARC archives: writing with revisits, segments and chunked framing, and reading them back whole.

An archive is a row ``(path, content)``, as Spark's ``binaryFile`` source gives one: gzip members,
one record each, about ``ARCHIVE`` bytes together. A record whose block is longer than
``SEGMENT`` bytes is written as a first segment and continuations. Reading groups segments by
origin identifier, orders them by number, checks the total length, and takes the chunked framing
off the payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

SEGMENT, CHUNK, ARCHIVE = 16 << 10, 4 << 10, 1 << 20
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def to_chunks(payload: bytes, size: int = CHUNK) -> bytes:
    """``payload`` in chunked transfer framing."""
    parts = [payload[i: i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def from_chunks(framed: bytes) -> bytes:
    """The payload of chunked transfer framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2
        if framed[at + size: at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its length says")
        out.append(framed[at: at + size])
        at += size + 2


def record(headers: dict, block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in (headers | {"Content-Length": len(block)}).items() if v is not None)
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def records(archive: bytes) -> Iterator[tuple[dict, bytes]]:
    """Headers (lower-case names) and block of each record of an archive."""
    while archive:
        unpack = zlib.decompressobj(31)
        data = unpack.decompress(archive) + unpack.flush()
        archive = unpack.unused_data
        at = 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            lines = data[at:end].decode().split("\r\n")
            headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
            size = int(headers["content-length"])
            block = data[end + 4: end + 4 + size]
            if len(block) < size:
                raise ValueError("a record ends early")
            yield headers, block
            at = end + 4 + size + 4


def record_id(page_id, digest: str) -> str:
    """Of the response with a payload, the same in every attempt of a task."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def information() -> bytes:
    """The record that an archive begins with."""
    headers = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}
    return record(headers, b"format: WARC File Format 1.1\r\n")


def page_records(page_id, url, payload: bytes, refers_to, first_url, single: bool = True) -> Iterator[bytes]:
    """The record of a page, or its segments. ``single``: the response of this page and payload, or
    the one referred to, is the only one, so that its identifier follows from them."""
    digest = base32_sha1(payload)
    own = record_id(page_id, digest) if single and refers_to is None else f"<urn:uuid:{uuid.uuid4()}>"
    uri = None if url is None else quote(url, safe=";/?:@&=+$,-_.!~*'()#%[]|")
    headers = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": own, "WARC-Target-URI": uri, "WARC-Date": DATE,
               "WARC-Payload-Digest": "sha1:" + digest, "Content-Type": "application/http; msgtype=response", "X-Page-Id": page_id}
    if refers_to is not None:
        first = None if first_url is None else quote(first_url, safe=";/?:@&=+$,-_.!~*'()#%[]|")
        yield record(headers | {"WARC-Profile": REVISIT, "WARC-Refers-To": record_id(refers_to, digest) if single else None, "WARC-Refers-To-Target-URI": first, "X-Refers-To-Page": refers_to}, HTTP)
        return
    block = HTTP + to_chunks(payload)
    if len(block) <= SEGMENT:
        yield record(headers, block)
        return
    parts = [block[i: i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    yield record(headers | {"WARC-Segment-Number": 1}, parts[0])
    for n, part in enumerate(parts[1:], 2):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Target-URI": uri, "WARC-Date": DATE,
                "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": n}
        yield record(more | {"WARC-Segment-Total-Length": len(block)} if n == len(parts) else more, part)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """``(path, content)``: archives of one record per row of ``pages``, in the shared folder.

    Payloads are the html in UTF-8, null as empty. Of equal payloads of at least ``least_bytes``
    bytes the row with the largest id is a response and rows of other ids revisit it; all shorter
    ones are responses. Equal rows of that largest id are all responses; a row with a null id
    revisits like others, and is a response where no equal payload has an id. A null URL is left out.
    """
    payload = F.encode(F.coalesce(html_col, F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    # Ids are matched by digest without their payloads; payloads then move by page and digest, so that
    # no common page gathers in one task.
    ids = rows.groupBy("page", "digest").agg(F.max("url").alias("url"), F.max(F.length("payload")).alias("size"), F.count("*").alias("copies"))
    last = (ids.groupBy("digest").agg(F.max("page").alias("last"), F.max_by("url", "page").alias("last_url"), F.max_by("copies", "page").alias("last_copies"), F.max("size").alias("most"))
            .where(F.col("last").isNotNull() & (F.col("most") >= least_bytes)))
    other = ~F.col("page").eqNullSafe(F.col("last")) & F.col("last").isNotNull()
    refers = ids.join(last, "digest", "left").where(other | (F.col("copies") > 1)).select(
        F.xxhash64("page", "digest").alias("key"), F.col("page").alias("_page"), F.col("digest").alias("_digest"), F.when(other, F.col("last")).alias("last"), "last_url",
        F.when(other, F.col("last_copies") == 1).otherwise(F.lit(False)).alias("single"))
    same = (F.col("key") == F.xxhash64("page", "digest")) & F.col("page").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest"))
    rows = rows.join(refers, same, "left").select("page", "url", "payload", F.col("last").alias("refers_to"), "last_url", F.coalesce("single", F.lit(True)).alias("single"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [information()], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4()}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], names=["path", "content"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                for part in page_records(*row):
                    held.append(part)
                    size += len(part)
                if size >= ARCHIVE:
                    yield archive()
                    held, size = [information()], 0
        if size:
            yield archive()

    return stored(rows.mapInArrow(of, "path string, content binary"), "archives")


READ = T.StructType([T.StructField(n, t) for n, t in (
    ("origin", T.StringType()), ("number", T.IntegerType()), ("total", T.LongType()), ("page_id", T.LongType()), ("record_type", T.StringType()),
    ("refers_to", T.LongType()), ("url", T.StringType()), ("digest", T.StringType()), ("block", T.BinaryType()))])


def _parsed(archives: DataFrame, segments: bool) -> DataFrame:
    """Records that are segments, or those that are not."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for h, block in records(content.as_py()):
                    if h["warc-type"] in ("response", "revisit", "continuation") and ("warc-segment-number" in h) == segments:
                        number = lambda k: int(h[k]) if k in h else None  # noqa: E731, B023
                        rows.append((h.get("warc-segment-origin-id", h["warc-record-id"]), number("warc-segment-number"), number("warc-segment-total-length"),
                                     number("x-page-id"), h["warc-type"], number("x-refers-to-page"), h.get("warc-target-uri"), h.get("warc-payload-digest"), block))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW)], names=READ.names)

    return archives.select("content").mapInArrow(of, READ)


ARROW = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]


def reassembled(archives: DataFrame) -> DataFrame:
    """Whole records of ``archives(path, content)``: columns of ``READ`` but number and total.

    Segments are grouped by the identifier of their origin and ordered by number; a gap, a missing
    first or last segment, or a length other than the one declared raises. The unit of work is one
    record, whose block has to fit a row anyway.
    """
    parts = _parsed(archives, True)
    own = F.max(F.when(F.col("number") == 1, F.struct("page_id", "record_type", "refers_to", "url", "digest")))
    joined = parts.groupBy("origin").agg(own.alias("own"), F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"))
    block = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")  # casts keep the bytes
    joined = joined.withColumn("block", block)
    numbers = F.transform("parts", lambda p: p["number"])
    whole = (F.col("own").isNotNull() & (numbers == F.sequence(F.lit(1), F.size("parts"))) & F.col("total").eqNullSafe(F.length("block").cast("long")))
    checked = F.when(whole, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments do not make up record "), "origin")))
    long = joined.select("origin", "own.*", checked.alias("block"))
    return _parsed(archives, False).select(*long.columns).unionByName(long)


def read_pages(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_bytes, payload_digest`` and ``payload``.

    Payloads are decoded and their digests checked; revisits get size and, if asked for, payload
    of the response they refer to. Empty payloads and null ids are rows like others; no archives, no
    rows. A record, also a very long one, has to fit a row.
    """
    whole = reassembled(archives)
    schema = "page_id long, url string, record_type string, refers_to long, digest string, size long" + ", payload binary" * with_payload

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, payloads = [], []
            for kind, digest, block in zip(b.column(2).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist()):
                payload = None
                if kind == "response":
                    head, body = block.split(b"\r\n\r\n", 1)
                    payload = from_chunks(body) if b"transfer-encoding: chunked" in head.lower() else body
                    if digest != "sha1:" + base32_sha1(payload):
                        raise ValueError("a payload does not match its digest")
                sizes.append(None if payload is None else len(payload))
                payloads.append(payload)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sizes, pa.int64())] + [pa.array(payloads, pa.binary())] * with_payload,
                                             names=["page_id", "url", "record_type", "refers_to", "digest", "size"] + ["payload"] * with_payload)

    pages = whole.select("page_id", "url", "record_type", "refers_to", "digest", "block").mapInArrow(of, schema)
    if not with_payload:
        pages = stored(pages, "warc-pages")
    extra = ["payload"] * with_payload
    first = (pages.where("record_type = 'response' and page_id is not null").dropDuplicates(["page_id", "digest"])
             .select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("size").alias("_size"), *[F.col(c).alias("_" + c) for c in extra]))
    out = pages.join(first, (F.col("refers_to") == F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    return out.select("page_id", "url", "record_type", "refers_to", F.coalesce("size", "_size").alias("payload_bytes"),
                      F.substring("digest", 6, 32).alias("payload_digest"), *[F.coalesce(c, "_" + c).alias(c) for c in extra])


def op4_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_pages(write_archives(pages), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as hex from pages),
last as (select hex, max(page_id) as last from p group by hex)
select page_id, strlen(body)::bigint as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + (((('0x' || substr(p.hex, (5 * i // 4 + 1)::int, 2))::int) >> (3 - (5 * i % 4))::int) & 31)::int, 1)), '') as payload_digest,
       case when page_id = last then 'response' else 'revisit' end as record_type,
       case when page_id <> last then last end as refers_to
from p join last using (hex)
"""
