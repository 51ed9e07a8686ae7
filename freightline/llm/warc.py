"""WARC archives: a writer and a salvage reader.

Writer: one gzip member per record, as the format asks.  Of equal payloads the smallest page is a
response and the others are revisit records that refer to it.  Each task writes files of bounded
size under names of its own into the shared folder and returns a manifest; only files in the
manifest of a successful task count, so a retried task leaves no double records.

Salvage reader: files are read in blocks.  Where a record fails a check (gzip stream, version line,
header, length, block or payload digest), the reader searches the following bytes for the next gzip
member that opens with a valid record, or in plain files for the next version line with a valid
record, goes on from there, and logs the bytes in between as a quarantined gap.

Defined cases: null html is an empty payload; null urls become ``urn:no-url``; rows without a
page_id have no id and are revisits only of a page that has one; repeated rows with the smallest
page_id are all responses; payloads under 100 bytes are all responses; an empty table writes no
file.
"""
from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freightline.session import ensure_checkpoint_dir, scratch_path

from .common import bounded_batches, map_batches, materialise, utf8

# Fixed values of the format.
VERSION = b"WARC/1.1"
CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MAGIC = b"\x1f\x8b\x08"
MIN_REVISIT = 100
BLOCK = 1 << 20
#: A record longer than this is taken for a damaged length.
MAX_RECORD = 1 << 30


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           date: str) -> bytes:
    """One record, with its closing line ends."""
    block = HTTP + payload if kind == "response" else HTTP
    ident = page_id if page_id is not None else f"none-{uuid.uuid4()}"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{ident}>"), ("WARC-Date", date),
               ("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "urn:no-url"),
               ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"),
               ("WARC-Block-Digest", f"sha256:{sha(block)}"), ("X-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    headers.append(("Content-Length", str(len(block))))
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    return VERSION + CRLF + head + CRLF + block + CRLF + CRLF


def member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def planned(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to): which page each equal payload refers to.  Only the
    ids and digests of equal payloads meet; the html moves once, in the join that a hot payload
    may skew and adaptive execution then splits."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    digest = F.sha2(html.cast("binary"), 256)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.alias("html"), digest.alias("digest"), F.octet_length(html).alias("size"))
    groups = rows.filter(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    groups = materialise(groups.select("digest", "first"), "payloads")
    revisit = F.when(~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("size") >= MIN_REVISIT), F.col("first"))
    return rows.join(groups, "digest", "left").select("page_id", "url", "html", "digest", revisit.alias("refers_to"))


MANIFEST = [("path", T.StringType()), ("records", T.LongType()), ("bytes", T.LongType())]


def write_warc(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 32 << 20,
               compress: bool = True) -> DataFrame:
    """Write pages (page_id, url, html) as archives below ``folder`` (any address that Arrow's file
    systems know); returns the manifest of committed files."""
    rows = planned(pages)
    bounded_batches(rows.sparkSession)
    names = [n for n, _ in MANIFEST]
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        from pyarrow import fs
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out, name, n, size, done = None, "", 0, 0, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for page_id, url, html, digest, refers_to in zip(*columns):
                payload = utf8(html)
                kind = "response" if refers_to is None else "revisit"
                data = record(kind, page_id, url, payload, sha(payload), refers_to, date)
                data = member(data) if compress else data
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * compress
                    out, n, size = system.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], schema=schema)

    manifest = rows.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in MANIFEST])).select(*names)
    return materialise(manifest, "warc-manifest")


class Source:
    """Random access to a file in blocks."""

    def __init__(self, file):
        self.file, self.size, self.at, self.block = file, file.size(), 0, b""

    def read(self, start: int, n: int) -> bytes:
        """Up to n bytes from ``start``; served from one block that is kept."""
        if not (self.at <= start and start + n <= self.at + len(self.block)):
            self.file.seek(start)
            self.at, self.block = start, self.file.read(max(n, BLOCK))
        return self.block[start - self.at:start - self.at + n]

    def find(self, needle: bytes, start: int) -> int:
        """First place of ``needle`` at or after ``start``; -1 if none."""
        while start < self.size:
            part = self.read(start, BLOCK)
            if (i := part.find(needle)) >= 0:
                return start + i
            if start + len(part) >= self.size:
                return -1
            start += len(part) - len(needle) + 1
        return -1


class Damaged(Exception):
    """A record failed a check."""


def parsed(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, length) of the record that ``data`` opens with; raises Damaged."""
    if not data.startswith(b"WARC/1."):
        raise Damaged("version line")
    stop = data.find(CRLF + CRLF)
    if stop < 0:
        raise Damaged("header")
    headers = {}
    for line in data[:stop].split(CRLF)[1:]:
        name, colon, value = line.partition(b":")
        if not colon or value.lstrip().startswith(b"WARC/1."):  # a header cut short runs into the next record
            raise Damaged("header")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit():
        raise Damaged("length")
    length = int(headers["content-length"])
    block = data[stop + 4:stop + 4 + length]
    end = stop + 4 + length
    if len(block) < length or data[end:end + 4] != CRLF + CRLF:
        raise Damaged("length")
    if (want := headers.get("warc-block-digest", "")).startswith("sha256:") and sha(block) != want[7:]:
        raise Damaged("block digest")
    if headers.get("warc-type") == "response" and (want := headers.get("warc-payload-digest", "")).startswith("sha256:"):
        if sha(block.partition(CRLF + CRLF)[2]) != want[7:]:
            raise Damaged("payload digest")
    return headers, block, end + 4


def read_member(source: Source, start: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at ``start``; raises Damaged."""
    if source.read(start, 3) != MAGIC:
        raise Damaged("gzip magic")
    z, out, at, size = zlib.decompressobj(31), [], start, 0
    try:
        while not z.eof:
            part = source.read(at, 1 << 16)
            if not part:
                raise Damaged("gzip end")
            out.append(z.decompress(part))
            at += len(part)
            size += len(out[-1])
            if size > MAX_RECORD:
                raise Damaged("record size")
    except zlib.error as e:
        raise Damaged("gzip stream") from e
    return b"".join(out), at - len(z.unused_data)


def read_plain(source: Source, start: int) -> tuple[dict[str, str], bytes, int]:
    """The uncompressed record at ``start``: reads on until header and block are there."""
    n = 1 << 16
    while True:
        data = source.read(start, n)
        stop = data.find(CRLF + CRLF)
        if not data.startswith(b"WARC/1."):
            raise Damaged("version line")
        if stop < 0 and (n > 1 << 20 or len(data) < n):
            raise Damaged("header")
        if stop >= 0:
            break
        n *= 4
    length = next((x.partition(b":")[2].strip() for x in data[:stop].split(CRLF) if x.lower().startswith(b"content-length:")), b"")
    if not length.isdigit() or int(length) > MAX_RECORD:
        raise Damaged("length")
    headers, block, size = parsed(source.read(start, stop + 4 + int(length) + 4))
    return headers, block, start + size


def salvage(source: Source) -> Iterator[tuple[str, int, int, dict[str, str], bytes, str]]:
    """("record", start, end, headers, block, "") and ("gap", start, end, {}, b"", reason), in file order."""
    zipped = source.read(0, 2) == MAGIC[:2] or (source.find(MAGIC, 0) >= 0 and source.find(b"WARC/1.", 0) < 0)
    needle = MAGIC if zipped else b"WARC/1."
    at, gap, reason = 0, None, ""
    while at < source.size:
        try:
            if zipped:
                data, end = read_member(source, at)
                headers, block, size = parsed(data)
                if size != len(data):
                    raise Damaged("length")
            else:
                headers, block, end = read_plain(source, at)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            found = source.find(needle, at + 1)
            at = found if found >= 0 else source.size
            continue
        if gap is not None:
            yield "gap", gap, at, {}, b"", reason
            gap = None
        yield "record", at, end, headers, block, ""
        at = end
    if gap is not None:
        yield "gap", gap, source.size, {}, b"", reason


RECORDS = [("path", T.StringType()), ("kind", T.StringType()), ("start", T.LongType()), ("end", T.LongType()),
           ("reason", T.StringType()), ("warc_type", T.StringType()), ("record_id", T.StringType()),
           ("target_uri", T.StringType()), ("refers_to", T.StringType()), ("payload_digest", T.StringType()),
           ("payload_length", T.LongType()), ("payload", T.BinaryType())]


def read_warc(paths: DataFrame) -> DataFrame:
    """Records and quarantined gaps of the files named by ``path``; one task reads a file in blocks."""

    def run(names):
        from pyarrow import fs
        for name in names:
            system, path = fs.FileSystem.from_uri(name)
            with system.open_input_file(path) as file:
                rows, size = [], 0
                for kind, start, end, h, block, reason in salvage(Source(file)):
                    payload = block.partition(CRLF + CRLF)[2] if kind == "record" else None
                    length = h.get("x-payload-length", "")
                    rows.append((name, kind, start, end, reason or None, h.get("warc-type"), h.get("warc-record-id"),
                                 h.get("warc-target-uri"), h.get("warc-refers-to"),
                                 h.get("warc-payload-digest", "").removeprefix("sha256:") or None,
                                 int(length) if length.isdigit() else len(payload) if payload is not None else None, payload))
                    size += len(block)
                    if size > 8 << 20:
                        yield dict(zip((n for n, _ in RECORDS), zip(*rows)))
                        rows, size = [], 0
                if rows:
                    yield dict(zip((n for n, _ in RECORDS), zip(*rows)))

    return map_batches(paths, run, RECORDS, ["path"])


def one_file_per_task(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The manifest's paths dealt out so that files are read side by side."""
    n = manifest.count()
    return manifest.select("path").repartition(max(1, min(n, 10_000)), "path")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages as archives and read them back: records and gaps."""
    ensure_checkpoint_dir(spark)
    folder = scratch_path(spark, "warc")
    folder = folder if ":/" in folder else f"file://{folder}"
    return read_warc(one_file_per_task(spark, write_warc(pages, folder)))


def op3_warc_salvage(spark, sf_dir: str) -> DataFrame:
    found = round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")).filter("kind = 'record'")
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return found.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"),
                        "payload_digest", F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"))
