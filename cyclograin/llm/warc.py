"""WARC archives through a chunked record table.

A record is rows of the table: record id, chunk number, bytes. Writing: pages are cut into chunk rows
inside the JVM, and every task streams these rows into gzip members of its own archive file, one chunk
at a time. Reading: archives are streamed into such rows again, each with the length and digest
of the payload so far; no record is ever held whole in Python, and the row of the last chunk carries
the payload's length and digest. Records with equal payloads are stored once: the one with the
largest id is a response, the others are revisit records that refer to it.

Files are opened through ``pyarrow.fs``, so the archive folder may be any place that it reaches
(local paths, ``file:``, ``hdfs:``, object stores). A file's name holds the task's attempt; the
manifest lists only files of attempts that ended well.

Edge cases: a null payload is empty; a null URI is left out; a null id is kept as null and is never
referred to; repeated rows (same id and payload) are written as often as they occur; an empty
table writes no file and reads as no rows. Only the named columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cyclograin.llm import textkit
from cyclograin.operators.attach import settled

CHUNK = 1 << 18
FILE_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"
# Fixed value: the revisit profile named by the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAME = "urn:record:"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def roles(pages: DataFrame, id_col: str, payload_col: str, least: int = 0) -> DataFrame:
    """``id, digest, refers_to`` of the records that are revisits, one row per id and payload."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    keys = pages.select(F.col(id_col).alias("id"), F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).alias("n"))
    keys = settled(keys.filter(F.col("n") >= least))
    first = keys.groupBy("digest", "n").agg(F.max("id").alias("refers_to"), F.count("*").alias("_rows"))
    first = first.filter((F.col("_rows") > 1) & F.col("refers_to").isNotNull()).drop("_rows")
    again = keys.join(first, ["digest", "n"]).filter(~F.col("id").eqNullSafe(F.col("refers_to")))
    return again.select("id", "digest", "refers_to").distinct()


def _header(lines: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode()


def _one_line(uri: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)


class _Archive:
    """One growing archive file; every record is a gzip member."""

    def __init__(self, folder: str, name: str):
        self.fs, path = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(path, recursive=True)
        self.path, self.uri = f"{path}/{name}", f"{folder.rstrip('/')}/{name}"
        self.out, self.records = self.fs.open_output_stream(self.path, compression=None), 0
        self._member([_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{name}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", "0")])])

    def _member(self, parts) -> None:
        self.begin()
        for part in parts:
            self.put(part)
        self.end()

    def begin(self) -> None:
        self.squeeze = zlib.compressobj(5, zlib.DEFLATED, 31)

    def put(self, part: bytes) -> None:
        self.out.write(self.squeeze.compress(part))

    def end(self) -> None:
        self.put(b"\r\n\r\n")
        self.out.write(self.squeeze.flush())

    def head(self, ident, uri: str | None, size: int, digest: bytes, refers_to) -> None:
        """Open a record: its headers and those of the HTTP response, which a revisit keeps."""
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        lines = [
            ("WARC-Type", "response" if refers_to is None else "revisit"),
            ("WARC-Record-ID", f"<{_NAME}{'' if ident is None else ident}>"),
            ("WARC-Date", DATE),
            ("WARC-Payload-Digest", "sha1:" + base32(digest)),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", str(len(http) + (size if refers_to is None else 0))),
        ]
        if uri is not None:
            lines.append(("WARC-Target-URI", _one_line(uri)))
        if refers_to is not None:
            lines += [("WARC-Refers-To", f"<{_NAME}{refers_to}>"), ("WARC-Profile", PROFILE)]
        self.begin()
        self.put(_header(lines))
        self.put(http)
        self.records += 1

    def close(self) -> tuple[str, int]:
        self.out.close()
        return self.uri, self.records


def to_chunks(pages: DataFrame, id_col: str, uri_col: str, payload_col: str, least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of pages; a record's rows follow one another in order.

    Columns ``id, uri, refers_to, payload_bytes, digest`` are those of the record, ``data`` is empty for
    revisits. Payloads of at least ``least`` bytes that occur more than once are stored once.
    """
    again = settled(roles(pages, id_col, payload_col, least))
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "payload_bytes": F.octet_length("payload").cast("long")})
    same = F.col("p.id").eqNullSafe(F.col("a.id")) & (F.col("p.digest") == F.col("a.digest"))
    rows = rows.alias("p").join(again.alias("a"), same, "left").select("p.*", "a.refers_to")
    body = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("body") / F.lit(chunk)).cast("int") - 1)
    rows = rows.withColumn("body", body).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    part = F.substring(F.col("body"), F.col("chunk_no") * chunk + 1, F.lit(chunk))
    return rows.select("id", "uri", "refers_to", "payload_bytes", "digest", "chunk_no", (F.col("chunk_no") == last).alias("last"), part.alias("data"))


def write_chunks(chunks: DataFrame, folder: str) -> DataFrame:
    """Write archives from chunk rows in the order in which each partition has them.

    Returns the settled manifest ``path, records``. Ids are whole numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number, archive, size = 0, None, 0
        done: list[tuple[str, int]] = []
        for piece, parts in textkit.chunks(batches, "data"):
            for (ident, uri, refers, n, digest, at, last), data in zip(zip(*(c.to_pylist() for c in piece.columns[:7]), strict=True), parts, strict=True):
                if archive is None:
                    archive = _Archive(folder, f"part-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.warc.gz")
                if at == 0:
                    archive.head(ident, uri, n, digest, refers)
                archive.put(data)
                size += len(data)
                if last:
                    archive.end()
                    if size >= FILE_BYTES:
                        done.append(archive.close())
                        number, archive, size = number + 1, None, 0
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_pydict({"path": pa.array([d[0] for d in done], pa.string()), "records": pa.array([d[1] for d in done], pa.int64())})

    return settled(chunks.select("id", "uri", "refers_to", "payload_bytes", "digest", "chunk_no", "last", "data").mapInArrow(run, "path string, records long"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write the archives of pages; the manifest of the files."""
    return write_chunks(to_chunks(pages, id_col, uri_col, payload_col, least, chunk), folder)


_CHUNKS = (
    "id long, type string, uri string, refers_to long, declared_bytes long, declared_digest string, chunk_no long, "
    "data binary, bytes_so_far long, digest_so_far string, last boolean"
)
_CHUNK_ARROW = pa.schema(
    [
        ("id", pa.int64()), ("type", pa.string()), ("uri", pa.string()), ("refers_to", pa.int64()), ("declared_bytes", pa.int64()),
        ("declared_digest", pa.string()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("bytes_so_far", pa.int64()),
        ("digest_so_far", pa.string()), ("last", pa.bool_()),
    ]
)


def _fields(stream: io.BufferedIOBase) -> dict[str, str] | None:
    """Header fields up to the empty line; None at the end of the file."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    out = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _named(value: str | None) -> int | None:
    number = (value or "").strip("<>").removeprefix(_NAME)
    return int(number) if number else None


def _records(stream: io.BufferedIOBase, chunk: int) -> Iterator[tuple]:
    while (head := _fields(stream)) is not None:
        left = int(head.get("content-length", 0))
        if head.get("warc-type") not in ("response", "revisit"):
            while left:
                left -= len(stream.read(min(left, chunk))) or left
            continue
        before = left
        http, used = {}, 0
        line = stream.readline(left)
        used += len(line)
        while (line := stream.readline(left - used)) not in (b"\r\n", b"\n", b""):
            used += len(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            http[name.strip().lower()] = value.strip()
        left = before - used - len(line)
        digest, seen, number = hashlib.sha1(), 0, 0
        declared = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        fixed = (
            _named(head.get("warc-record-id")), head["warc-type"], head.get("warc-target-uri"), _named(head.get("warc-refers-to")),
            int(http["content-length"]) if "content-length" in http else None, declared,
        )
        while True:
            data = stream.read(min(left, chunk))
            if left and not data:
                raise EOFError(f"archive ends inside record {fixed[0]}")
            left -= len(data)
            seen += len(data)
            digest.update(data)
            yield (*fixed, number, data, seen, base32(digest.copy().digest()), left == 0)
            number += 1
            if not left:
                break


def read(spark: SparkSession, manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives listed in ``manifest(path)``; order within a record is ``chunk_no``.

    Every archive is a task of its own; the manifest is one short row per archive.
    """
    files = manifest.select("path")
    n_files = files.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as unpacked:
                    rows, size = [], 0
                    for row in _records(io.BufferedReader(unpacked, chunk), chunk):
                        rows.append(row)
                        size += len(row[7]) + 200
                        if size >= textkit.CHUNK_BYTES:
                            yield _batch(rows)
                            rows, size = [], 0
                    yield _batch(rows)

    numbered = files.withColumn("number", F.row_number().over(Window.orderBy("path")) - 1)
    return numbered.repartitionById(max(1, n_files), "number").select("path").mapInArrow(run, _CHUNKS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_CHUNK_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CHUNK_ARROW, strict=True)], schema=_CHUNK_ARROW)


def summary(chunks: DataFrame) -> DataFrame:
    """One row per record, from its last chunk: ids, type, length and digest of the full payload.

    ``intact`` is false when a response's bytes do not fit its headers.
    """
    own = F.col("type") == "response"
    return chunks.filter("last").select(
        "id",
        "uri",
        "type",
        "refers_to",
        F.when(own, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(own, F.col("digest_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        (~own | ((F.col("bytes_so_far") == F.col("declared_bytes")) & (F.col("digest_so_far") == F.col("declared_digest")))).alias("intact"),
    )
