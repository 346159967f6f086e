"""WARC archives: monolithic gzip files normalised to one gzip member per record, with a sidecar offset index.

Nulls: a null payload is the empty one, a null url is left out, a null id is written without an id header and reads back as null (it is never the
response while another id has the payload). Repeated rows are records of their own: one is the response, the rest revisit it. Extra columns are ignored; an empty
table gives no files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table, values, written
from .files import attempt_name, opened

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def response(page_id: int | None, url: str | None, payload: bytes) -> bytes:
    digest = payload_digest(payload)
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        headers.append(("WARC-Target-URI", "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url)))
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    return record(headers, HTTP + payload)


def revisit(headers: dict[str, str], payload_bytes: int, refers_to: int | None) -> bytes:
    """The record that stands for a response whose payload another record holds: its headers, without the payload."""
    keep = [(k, "revisit" if k == "WARC-Type" else v) for k, v in headers.items() if k != "Content-Length"]
    keep += [("WARC-Profile", REVISIT), ("X-Payload-Bytes", str(payload_bytes))]
    if refers_to is not None:
        keep.append(("X-Refers-To-Page", str(refers_to)))
    return record(keep, HTTP)


class Records:
    """Records of a gzip stream, whatever its members: (headers, whole record). Inflates once, holds one record at a time."""

    def __init__(self, source, chunk: int = 1 << 20):
        self.source, self.chunk = source, chunk
        self.buf, self.z, self.rest = bytearray(), zlib.decompressobj(31), b""

    def _more(self) -> bool:
        data = self.rest or self.source.read(self.chunk)
        if not data:
            return False
        if self.z.eof:
            self.z = zlib.decompressobj(31)
        self.buf += self.z.decompress(data)
        self.rest = self.z.unused_data
        return True

    def __iter__(self):
        while True:
            while (at := self.buf.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    if self.buf.strip():
                        raise ValueError("a record is cut off")
                    return
            headers = dict(line.split(": ", 1) for line in self.buf[:at].decode().split("\r\n")[1:])
            end = at + 4 + int(headers["Content-Length"]) + 4
            while len(self.buf) < end:
                if not self._more():
                    raise ValueError("a record is cut off")
            whole = bytes(self.buf[:end])
            del self.buf[:end]
            yield headers, whole


def block_of(headers: dict[str, str], whole: bytes) -> bytes:
    return whole[-4 - int(headers["Content-Length"]) : -4]


def write_monolithic(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", roll: int = 64 << 20) -> DataFrame:
    """Writes all rows as response records to files of one gzip stream each, where the rows are, without a shuffle.

    (path, seq, id, payload_bytes, digest) of each record. A file ends after about `roll` bytes of records.
    """

    def run(batches):
        out = z = path = None
        size = seq = 0
        for b in batches:
            rows = []
            for page_id, url, html in zip(values(b, "page_id"), values(b, "url"), values(b, "html"), strict=True):
                if out is None:
                    path = f"{folder}/{attempt_name('whole', '.warc.gz')}"
                    system, at = opened(path)
                    system.create_dir(at.rpartition("/")[0], recursive=True)
                    out, z, size, seq = system.open_output_stream(at, compression=None), zlib.compressobj(4, zlib.DEFLATED, 31), 0, 0
                payload = (html.as_py() or "").encode()
                data = response(page_id.as_py(), url.as_py(), payload)
                out.write(z.compress(data))
                rows.append((path, seq, page_id.as_py(), len(payload), payload_digest(payload)))
                size += len(data)
                seq += 1
                if size >= roll:
                    out.write(z.flush())
                    out.close()
                    out = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["path", "seq", "page_id", "payload_bytes", "digest"])
        if out is not None:
            out.write(z.flush())
            out.close()

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
    return rows.mapInArrow(run, "path string, seq long, page_id long, payload_bytes long, digest string")


def decide(records: DataFrame, least: int = 0) -> DataFrame:
    """records with is_revisit and refers_to: of equal payloads of at least `least` bytes the smallest id is the response (null ids last)."""
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "path", "seq")
    first = records.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min(order).alias("first"))
    own = records.join(first, "digest", "left")
    again = F.col("first").isNotNull() & (F.col("payload_bytes") >= least) & ~((F.col("first.path") == F.col("path")) & (F.col("first.seq") == F.col("seq")))
    return own.select("path", "seq", "payload_bytes", again.alias("is_revisit"), F.when(again, F.col("first.page_id")).alias("refers_to"))


def normalise(decisions: DataFrame, folder: str, files: int) -> DataFrame:
    """Rewrites each monolithic file so that every record is a gzip member of its own, revisits without payload, and writes a sidecar index.

    (path, index, records) of each new file. A task inflates its file's stream once and holds one record at a time. The work is that of the `files`, not of
    the few bytes a decision has, so there are as many tasks.
    """

    def run(key: tuple, tab: pa.Table) -> pa.Table:
        tab = tab.sort_by("seq")
        name = attempt_name("pages", "")
        system, source = opened(key[0].as_py())
        to, at = opened(f"{folder}/{name}.warc.gz")
        to.create_dir(at.rpartition("/")[0], recursive=True)
        where, n = 0, 0
        with system.open_input_stream(source, compression=None) as data, to.open_output_stream(at, compression=None) as out, to.open_output_stream(at.replace(".warc.gz", ".index"), compression=None) as index:
            plan = zip(tab["payload_bytes"].to_pylist(), tab["is_revisit"].to_pylist(), tab["refers_to"].to_pylist(), strict=True)
            for (headers, whole), (size, again, target) in zip(Records(data), plan, strict=True):
                z = zlib.compressobj(4, zlib.DEFLATED, 31)
                member = z.compress(revisit(headers, size, target) if again else whole) + z.flush()
                out.write(member)
                index.write(f"{where} {len(member)} {headers['WARC-Record-ID']}\n".encode())
                where += len(member)
                n += 1
        return pa.table({"path": [f"{folder}/{name}.warc.gz"], "index": [f"{folder}/{name}.index"], "records": pa.array([n], pa.int64())})

    return decisions.repartition(max(1, files), "path").groupBy("path").applyInArrow(run, "path string, index string, records long")


def read_archives(files: DataFrame) -> DataFrame:
    """One row for each record, read through the sidecar index by offset; a response's digest and size are those of the payload read."""

    def run(batches):
        for b in batches:
            for path, index in zip(values(b, "path").to_pylist(), values(b, "index").to_pylist(), strict=True):
                system, at = opened(path)
                rows = []
                with system.open_input_file(at) as data, system.open_input_stream(opened(index)[1], compression=None) as lines:
                    held = b""
                    while True:
                        got = lines.read(1 << 20)
                        *whole, held = (held + got).split(b"\n")
                        for line in whole:
                            where, size, _ = line.split(b" ", 2)
                            headers, rec = next(iter(Records(pa.BufferReader(data.read_at(int(size), int(where))))))
                            kind, page = headers["WARC-Type"], headers.get("X-Page-Id")
                            payload = block_of(headers, rec)[len(HTTP) :]
                            if kind == "response":
                                rows.append((page and int(page), len(payload), payload_digest(payload), kind, None))
                            else:
                                to = headers.get("X-Refers-To-Page")
                                rows.append((page and int(page), int(headers["X-Payload-Bytes"]), headers["WARC-Payload-Digest"].removeprefix("sha1:"), kind, to and int(to)))
                        if len(rows) > 20_000 or not got and rows:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                            rows = []
                        if not got:
                            break

    return files.repartition(max(1, files.count()), "path").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """The normalised files' (path, index, records) for all rows of `pages`."""
    spark = pages.sparkSession
    records = written(write_monolithic(pages, new_path(spark, "warc-whole")), "warc-records")
    files = records.agg(F.countDistinct("path")).first()[0]
    return written(normalise(decide(records, least), new_path(spark, "warc"), files), "warc-files")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(archive(table(spark, sf_dir, "pages")))
