"""WARC archives as a chunked record table.

Writing: every task streams its records into gzip members of archive files of bounded size, in a folder that all
executors share; a file gets its final name only when it is whole, so a task that runs again replaces its own files.
Reading: every archive file streams as rows (record, chunk number, bytes); an oversized payload is never held whole, and
each chunk carries the SHA-1 of the payload so far, so that the last chunk has the payload's digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, materialize

#: Payloads from this size on are written once; further records of the same payload revisit it.
REVISIT_BYTES = 1000
CHUNK = 1 << 16
FILE_BYTES = 128 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n"


# --------------------------------------------------------------------------- writing


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}:{digest}'.encode()).digest())}>"


def record_head(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """A record's header and the HTTP header that opens its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    uri = "".join(c if c.isprintable() and c != " " else "%20" for c in url) if url else f"urn:page:{page_id}"
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": date,
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(http) + (0 if revisit else size)),
        "X-Payload-Length": str(size),
    }
    if page_id is not None:
        fields["X-Page-Id"] = str(page_id)
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest)}
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in fields.items())]
    return END.join(lines) + END + END + http


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a URI; Hadoop's names of S3 (s3a, s3n) mean the same store."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


class ArchiveFile:
    """One archive under a temporary name until it is closed."""

    def __init__(self, folder: str, name: str, attempt: int) -> None:
        self.fs, root = opened(folder)
        self.fs.create_dir(root, recursive=True)
        self.final, self.draft = f"{root}/{name}", f"{root}/.{name}.{attempt}"
        self.uri = f"{folder}/{name}"
        self.out = self.fs.open_output_stream(self.draft, compression=None)
        self.records, self.bytes = 0, 0

    def add(self, head: bytes, payload: memoryview) -> None:
        pack = zlib.compressobj(4, zlib.DEFLATED, 31)
        for part in (head, *(payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK)), END + END):
            self._put(pack.compress(part))
        self._put(pack.flush())
        self.records += 1

    def _put(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.bytes += len(data)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        self.fs.move(self.draft, self.final)
        return self.uri, self.records, self.bytes


def _write(folder: str, date: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        done, now = [], None
        for batch in batches:
            ids, urls, digests, refers = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "digest", "refers_to"))
            payloads = batch.column(batch.schema.get_field_index("payload"))
            for i, (page_id, url, digest, refers_to) in enumerate(zip(ids, urls, digests, refers, strict=True)):
                if now and now.bytes >= file_bytes:
                    done.append(now.close())
                    now = None
                now = now or ArchiveFile(folder, f"part-{task.partitionId():06d}-{len(done):04d}.warc.gz", task.taskAttemptId())
                payload = memoryview(payloads[i].as_buffer() or b"")
                now.add(record_head(page_id, url, digest, len(payload), refers_to, date), payload if refers_to is None else payload[:0])
        if now:
            done.append(now.close())
        names, records, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], ["file", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for every row and returns the manifest (file, records, bytes).

    Of records with equal payloads of ``revisit_bytes`` or more, those with the largest page id are responses and the
    others revisit it. A null payload is an empty one; a text payload is written in UTF-8. Rows that repeat a page id
    each get a record; rows without one are responses. An empty table gives an empty manifest and no files. Other
    columns are not read.
    """
    payload = F.col(payload_col) if dict(pages.dtypes)[payload_col] == "binary" else F.col(payload_col).cast("string").cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(payload, F.lit(b"")).alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= revisit_bytes)
    # written, so that the join is between two exchanges and Spark can split the payloads of a hot digest
    shared = materialize(large.groupBy("digest").agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "latest"), "digests")
    refers_to = F.when((F.octet_length("payload") >= revisit_bytes) & (F.col("page_id") < F.col("latest")), F.col("latest"))
    told = rows.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", refers_to.alias("refers_to"))
    return materialize(told.mapInArrow(_write(folder, date, file_bytes), "file string, records long, bytes long"), "manifest")


# --------------------------------------------------------------------------- reading


class _Bytes:
    """The bytes of a plain file or the decompressed bytes of a file of gzip members, taken from the front."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.source, self.unpack, self.held, self.ended = source, zlib.decompressobj(31), bytearray(), False
        self.rest = source.read(CHUNK)
        self.plain = bool(self.rest) and not self.rest.startswith(b"\x1f\x8b")

    def _more(self) -> bool:
        while not self.ended:
            raw = self.rest or self.source.read(CHUNK)
            if not raw:
                self.ended = True
                if not self.plain and not self.unpack.eof and self.held:
                    raise ValueError("the archive ends within a record")
                break
            if self.plain:
                self.rest = b""
                self.held += raw
                return True
            if self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
            got = self.unpack.decompress(raw, 4 * CHUNK)
            self.rest = self.unpack.unconsumed_tail or self.unpack.unused_data
            self.held += got
            if got:
                return True
        return False

    def line(self) -> bytes | None:
        while (at := self.held.find(END)) < 0:
            if not self._more():
                return None
        out = bytes(self.held[:at])
        del self.held[: at + 2]
        return out

    def some(self, most: int) -> bytes:
        if not self.held and not self._more():
            raise ValueError("the archive ends within a record")
        out = bytes(self.held[:most])
        del self.held[:most]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """n bytes in chunks of CHUNK, the last one shorter."""
        part = bytearray()
        while n:
            got = self.some(min(n, CHUNK - len(part)))
            n -= len(got)
            part += got
            if len(part) == CHUNK or not n:
                yield bytes(part)
                part.clear()


def _header(data: _Bytes) -> tuple[dict[str, str], int]:
    fields, size = {}, 0
    while line := data.line():
        size += len(line) + 2
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, size + 2


def record_chunks(source: pa.NativeFile) -> Iterator[tuple]:
    """(record id, type, page id, record it refers to, header digest, header length, chunk number, bytes, SHA-1 so far, bytes so far, last)."""
    data = _Bytes(source)
    while (line := data.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head, _ = _header(data)
        left = int(head["content-length"])
        if head.get("content-type", "").startswith("application/http"):
            data_line = data.line() or b""
            _, size = _header(data)
            left -= len(data_line) + 2 + size
        page = head.get("x-page-id")
        digest = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex() if "warc-payload-digest" in head else None
        length = int(head["x-payload-length"]) if "x-payload-length" in head else None
        key = (head.get("warc-record-id"), head.get("warc-type"), page and int(page), head.get("warc-refers-to"), digest, length)
        so_far, size, number = hashlib.sha1(), 0, 0
        if not left:
            yield (*key, 0, b"", so_far.hexdigest(), 0, True)
        for part in data.take(left):
            so_far.update(part)
            size += len(part)
            yield (*key, number, part, so_far.hexdigest(), size, size == left)
            number += 1


CHUNK_SCHEMA = "record_id string, record_type string, page_id long, refers_to_id string, told_digest string, told_bytes long, chunk int, data binary, digest string, bytes long, last boolean"


def _read(with_data: bool):
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.bool_()]
    names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = opened(uri)
                with fs.open_input_stream(path, compression=None) as source:
                    for row in record_chunks(source):
                        rows.append(row if with_data else (*row[:7], None, *row[8:]))
                        if len(rows) >= 256:
                            yield out(rows)
                            rows = []
        if rows:
            yield out(rows)

    return run


def read_archives(manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk table of the manifest's files, a row for each chunk of each record; an empty payload is one empty chunk.

    digest and bytes run over the payload so far; ``last`` marks a record's last chunk. Without ``with_data`` the bytes
    are read and digested but not returned.
    """
    files = manifest.select("file")
    n = max(1, files.count())
    return files.repartition(n, "file").mapInArrow(_read(with_data), CHUNK_SCHEMA)


def archived(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record, from its last chunk.

    A revisit's page is found by the record that its WARC-Refers-To names (null if the archives do not have it); pages
    are numbered by the header X-Page-Id, which other tools' archives lack: their page_id is null. Files are gzip
    members or plain. A response whose bytes do not match the length and digest of its header stops the query; a revisit has no bytes of
    its own and gives the full payload's figures from its header.
    """
    revisit = F.col("record_type") == "revisit"
    sound = revisit | (F.coalesce(F.col("digest") == F.col("told_digest"), F.lit(True)) & F.coalesce(F.col("bytes") == F.col("told_bytes"), F.lit(True)))
    last = chunks.where("last").where(F.when(sound, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("damaged record "), "record_id")).cast("boolean")))
    last = materialize(last.drop("data", "chunk", "last"), "records")  # the archives are read once
    target = last.where(~revisit).groupBy(F.col("record_id").alias("refers_to_id")).agg(F.min("page_id").alias("refers_to"))
    found = last.where(revisit).join(target, "refers_to_id", "left").select(*last.columns, "refers_to")
    found = found.unionByName(last.where(~revisit).withColumn("refers_to", F.lit(None).cast("long")))
    return found.select("page_id", F.when(revisit, F.coalesce("told_bytes", F.lit(0))).otherwise(F.col("bytes")).alias("payload_bytes"), F.when(revisit, F.col("told_digest")).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all pages written to archives in the shared folder and read back."""
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_path(spark, "warc"))
    return archived(read_archives(manifest, with_data=False))


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), m AS (SELECT h, max(page_id) AS latest FROM p WHERE n >= 1000 GROUP BY h)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < latest THEN latest END AS refers_to
FROM p LEFT JOIN m ON p.h = m.h
"""
