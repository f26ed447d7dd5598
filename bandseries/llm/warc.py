"""WARC: archives of gzip members, and a splittable reader for them."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import each_salt, salt, salts_seen, scratch, small, stored, table

#: A gzip member with nothing in it; it stands between the rows that Spark's text sink writes, so a file stays valid gzip.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20

RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _b32(digest_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(digest_hex)).decode()


def _id(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _page(urn: str | None) -> int | None:
    return None if urn is None or urn.endswith(":null>") else int(urn.rpartition(":")[2][:-1])


def record(page: int | None, url: str | None, digest: str, size: int, refers_to: int | None, revisit: bool, payload: bytes) -> bytes:
    """One WARC/1.1 record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if revisit else http + payload
    target = "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in (url or "about:blank").encode()).encode("latin-1")
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        f"WARC-Record-ID: {_id(page)}".encode(),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Target-URI: " + target,
        f"WARC-Payload-Digest: sha1:{_b32(digest)}".encode(),
        b"Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}".encode(),
    ]
    if revisit:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to)}".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def _gzip(raw: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of gzip members, joined to blobs of about CHUNK bytes."""
    blob: list[bytes] = []
    held = 0
    for b in batches:
        *plain, html = b.columns
        for page, url, digest, size, refers, revisit, page_html in zip(*(c.to_pylist() for c in plain), html, strict=True):
            text = b"" if revisit or not page_html.is_valid else page_html.as_py().encode()
            blob.append(_gzip(record(page, url, digest, size, refers, revisit, text)))
            held += len(blob[-1])
            if held >= CHUNK:
                yield pa.RecordBatch.from_pydict({"blob": pa.array([b"".join(blob)], pa.binary())})
                blob, held = [], 0
    if blob:
        yield pa.RecordBatch.from_pydict({"blob": pa.array([b"".join(blob)], pa.binary())})


def write_warc(pages: DataFrame, path: str, least: int = 1000) -> None:
    """Writes pages (page_id, url, html) as gzipped WARC records, a file for each task.

    Of the rows with equal payloads (the html in UTF-8; null is empty) of at least `least` bytes, those with the
    largest page_id are responses and the others are revisits that refer to it; all else is a response.  A null
    page_id counts as the smallest.  No rows: no records.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("size"), "html")
    keys = rows.filter(F.col("size") >= least).select("digest", "size", "page_id").withColumn("salt", salt("page_id"))
    groups = keys.groupBy("digest", "size").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("refers_to"), salts_seen().alias("salts"))
    groups = groups.filter("n > 1 AND refers_to IS NOT NULL").select("digest", "size", "refers_to", each_salt().alias("salt"))
    again = keys.join(groups, ["digest", "size", "salt"]).filter("page_id IS NULL OR page_id < refers_to")
    again = stored(again.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to").distinct(), "revisits")
    rows = rows.join(small(again), F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    rows = rows.select("page_id", "url", "digest", "size", "refers_to", F.col("_digest").isNotNull().alias("revisit"), "html")
    blobs = rows.mapInArrow(_members, "blob binary")
    # The text sink writes a string's bytes as they are, through Spark's own committer and to any store Spark can write to.
    blobs.select(F.col("blob").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


class Window:
    """A file's bytes from `at` on, read in chunks as they are asked for; bytes that are done with are let go."""

    def __init__(self, file, at: int) -> None:
        self.file, self.at, self.held = file, at, b""
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(CHUNK)
        self.held += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n


def _member(window: Window, i: int) -> tuple[bytes, int] | None:
    """The member that starts at held[i], and where it ends; None if it isn't a whole gzip member."""
    d, out, at = zlib.decompressobj(31), [], i
    while True:
        try:
            out.append(d.decompress(window.held[at:]))
        except zlib.error:
            return None
        if d.eof:
            return b"".join(out), len(window.held) - len(d.unused_data)
        at = len(window.held)
        if not window.more():
            return None


def _heads(window: Window, i: int) -> bool:
    """Whether a member with a WARC header, or one with nothing in it, starts at held[i]."""
    while len(window.held) - i < 4096 and window.more():
        pass
    try:
        d = zlib.decompressobj(31)
        head = d.decompress(window.held[i : i + 4096], 16)
    except zlib.error:
        return False
    return head.startswith(b"WARC/1.") or (not head and d.eof)


def scan(file, start: int, end: int) -> Iterator[bytes]:
    """The WARC records whose members start in the bytes [start, end) of an open file."""
    window = Window(file, start)
    window.more()
    i = 0
    while True:
        i = window.held.find(MAGIC, i)
        if i < 0:
            keep = min(len(window.held), len(MAGIC) - 1)
            window.drop(len(window.held) - keep)
            i = 0
            if window.at >= end or not window.more():
                return
            continue
        if window.at + i >= end:
            return
        if _heads(window, i) and (found := _member(window, i)):
            if found[0]:
                yield found[0]
            window.drop(found[1])
            i = 0
        else:
            i += 1


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's WARC fields (names in lower case), and its payload, which is what follows the HTTP header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.decode().lower()] = value.strip().decode()
    body = rest[: int(fields.get("content-length", 0))]
    return fields, body.partition(b"\r\n\r\n")[2] if "application/http" in fields.get("content-type", "") else body


def _row(raw: bytes) -> dict | None:
    fields, payload = parse(raw)
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    revisit = kind == "revisit"
    if revisit:  # the header block of the response that it stands for has the full payload's length
        head = raw.partition(b"\r\n\r\n")[2].partition(b"\r\n\r\n")[0]
        size = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return {
        "page_id": _page(fields.get("warc-record-id")), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": _page(fields.get("warc-refers-to")) if revisit else None, "url": fields.get("warc-target-uri"), "payload": None if revisit else payload,
    }


def _reader(payloads: bool):
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "payload": pa.binary()}
    kinds = kinds if payloads else {k: v for k, v in kinds.items() if k != "payload"}
    schema = pa.schema(list(kinds.items()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows: list[dict] = []
                held = 0
                with _open(path) as file:
                    for raw in scan(file, start, end):
                        if row := _row(raw):
                            rows.append({k: row[k] for k in kinds})
                            held += len(raw) if payloads else 0
                            if len(rows) >= 2000 or held > 8 * CHUNK:
                                yield pa.RecordBatch.from_pylist(rows, schema)
                                rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read_warc(spark: SparkSession, path: str, split_bytes: int = 4 << 20, payloads: bool = True) -> DataFrame:
    """The response and revisit records of the gzipped WARC files in `path`, as RECORDS (without payloads if so asked).

    Files are cut into byte ranges whatever their content.  A task looks for gzip magic in its range, takes a member
    only if its decoded head is a WARC header, and owns the records that start inside; the last may end beyond.  Each
    record is read once for any split_bytes.  A folder without records gives no rows.  Executors open the files
    through Arrow's file systems (local and shared folders, HDFS, S3, ...).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    ranges = files.filter("length > 0").select("path", cut.alias("start"), F.lit(split_bytes).alias("size"))
    ranges = ranges.select("path", "start", (F.col("start") + F.col("size")).alias("end"))
    n = max(1, ranges.count())
    ranges = ranges.repartition(min(n, 100_000), "path", "start")
    schema = RECORDS if payloads else RECORDS.removesuffix(", payload binary")
    return ranges.mapInArrow(_reader(payloads), schema)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op3_warc": op3_warc}
ORACLE = {
    "op3_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
        FROM m
    """
}
