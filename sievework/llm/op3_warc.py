"""Operator 3, WARC writing and the monolithic-gzip normaliser.

`write_archives` writes a page table as WARC files whose records share one gzip stream (as some crawlers leave them).
`normalise` inflates each whole-file stream once, in blocks, and writes every record again as a gzip member of its
own, with a sidecar index (offset, length, page_id: a line a member) beside each file; the same rows come back as a table, and
`read_sidecars` reads them from the files. `read_records` reads members by their offsets.

Of pages with equal payloads of at least `LEAST` bytes the one with the smallest page_id is a response; the others are
revisits that carry the HTTP headers only and refer to it. Digests are counted with map-side aggregation; only groups of
two and more meet the pages again, in a salted join, since one payload may be in a third of all rows.

Files go to the shared folder, by pyarrow's file systems; a task writes to a name of its own attempt and renames, so a
task that runs again leaves the same bytes. Memory: an inflated block and one record. Tables that later steps read
(archives, index) are written before they are read, so nothing is made twice.

Defined results: a null or empty html is an empty payload (always a response); rows that repeat a page_id
give a record each, of the same type; a null page_id is written as an empty id, comes back null, and is a revisit if
any page with an id has its payload; an empty table gives no rows; other columns are neither read nor written.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salted_join, table, work_dir, written

LEAST = 100
#: Payloads of several pages that are broadcast at once; more are met by a shuffle.
FEW = 50_000
#: Payload bytes after which a new archive begins, and of a block that is inflated at once.
ARCHIVE, BLOCK = 256 << 20, 1 << 18
LEVEL = 1
SIDECAR = ".idx"
# Names and forms of the WARC 1.1 standard.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def file_system(uri: str) -> tuple[object, str]:
    """pyarrow's file system of a URI and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else "file://" + uri)


def record_id(page_id: int | None, ordinal: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{ordinal}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, ordinal: str) -> bytes:
    """One uncompressed record; a revisit has the HTTP headers of its response but no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http if kind == "revisit" else http + payload
    target = "".join(c for c in url or "" if c not in "\r\n")
    head = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, ordinal)}", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """Named fields of a record's or message's head, by lower-case name; the first line is left out."""
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class RecordReader:
    """Cuts a stream of bytes into whole records."""

    def __init__(self) -> None:
        self.held = bytearray()
        self.need = 0

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.held += data
        while True:
            if not self.need:
                end = self.held.find(b"\r\n\r\n")
                if end < 0:
                    return
                if not self.held.startswith(b"WARC/"):
                    raise ValueError("not a WARC record")
                self.need = end + 8 + int(parse_head(bytes(self.held[:end]))["content-length"])
            if len(self.held) < self.need:
                return
            yield bytes(self.held[: self.need])
            del self.held[: self.need]
            self.need = 0

    def finish(self) -> None:
        if self.held:
            raise ValueError("the stream ends inside a record")


def inflate(chunks: Iterator[bytes], block: int = BLOCK) -> Iterator[bytes]:
    """Inflated bytes of a gzip stream (or several, one after another) in blocks of bounded size."""
    z = zlib.decompressobj(31)
    started = False
    for data in chunks:
        while data:
            out = z.decompress(data, block)
            started = True
            if out:
                yield out
            if z.eof:
                data, z, started = z.unused_data, zlib.decompressobj(31), False
            else:
                data = z.unconsumed_tail
    if started and not z.eof:
        rest = z.flush()
        if rest:
            yield rest
        if not z.eof:
            raise ValueError("the gzip stream is cut off")


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def read_chunks(uri: str, size: int = BLOCK) -> Iterator[bytes]:
    system, path = file_system(uri)
    with system.open_input_stream(path, compression=None) as f:
        while data := f.read(size):
            yield bytes(data)


class AtomicFile:
    """A file that appears under its name when it is whole."""

    def __init__(self, uri: str):
        self.system, self.path = file_system(uri)
        context = TaskContext.get()
        self.temporary = f"{self.path}.{context.taskAttemptId() if context else 0}-{uuid.uuid4().hex[:8]}.part"
        self.file = self.system.open_output_stream(self.temporary, compression=None)

    def write(self, data: bytes) -> None:
        self.file.write(data)

    def done(self) -> None:
        self.file.close()
        self.system.move(self.temporary, self.path)


# --- stages ---------------------------------------------------------------------------------------------------------


def with_responses(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, first (the least page_id of two or more pages with this payload, else null)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).select("page_id", F.sha2("payload", 256).alias("digest"), F.length("payload").alias("n"))
    groups = narrow.where(F.col("n") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    groups = written(groups, "payloads")
    if groups.limit(FEW + 1).count() <= FEW:  # payloads needn't be shuffled
        return rows.join(F.broadcast(groups), "digest", "left")
    return salted_join(rows, groups, ["digest"], "left", F.col("page_id"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows of with_responses as monolithic archives; returns archive, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names, counts, made = [], [], 0
        out = z = None

        def close() -> None:
            out.write(z.flush())
            out.done()

        for b in batches:
            for page_id, url, payload, digest, first in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if out is None or made > ARCHIVE:
                    if out is not None:
                        close()
                    name = f"{folder}/part-{part:05d}-{len(names):03d}.warc.gz"
                    out, z, made = AtomicFile(name), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
                    names.append(name)
                    counts.append(0)
                refers = None if first == page_id else first
                record = make_record(page_id, url, payload, digest, refers, f"{part}/{len(names)}/{counts[-1]}")
                out.write(z.compress(record))
                made += len(record)
                counts[-1] += 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["archive", "records"])

    make_folder(rows.sparkSession, folder)
    return written(rows.select("page_id", "url", "payload", "digest", "first").mapInArrow(run, "archive string, records long"), "archives")


def make_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def normalise_file(source: str, target: str) -> Iterator[tuple[int | None, int, int]]:
    """Rewrites a monolithic archive with a member a record, and its sidecar; yields (page_id, offset, length) of each."""
    out, side, at, reader = AtomicFile(target), AtomicFile(target + SIDECAR), 0, RecordReader()
    for block in inflate(read_chunks(source)):
        for record in reader.feed(block):
            member = gzip_member(record)
            page = parse_head(record[: record.index(b"\r\n\r\n")]).get("x-page-id", "")
            out.write(member)
            side.write(f"{at}\t{len(member)}\t{page}\n".encode())
            yield int(page) if page else None, at, len(member)
            at += len(member)
    reader.finish()
    out.done()
    side.done()


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """The index(file, page_id, offset, length) of a folder of normalised archives, from the files beside them."""
    rows = spark.read.schema("offset long, length long, page_id long").option("sep", "\t").option("pathGlobFilter", f"*{SIDECAR}").csv(folder)
    return rows.select(F.regexp_replace("_metadata.file_path", SIDECAR.replace(".", r"\.") + "$", "").alias("file"), "page_id", "offset", "length")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Normalises archives(archive) into a folder; returns the sidecar index: file, page_id, offset, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source in b.column(0).to_pylist():
                target = f"{folder}/{source.rpartition('/')[2]}"
                rows = list(normalise_file(source, target))
                pages, offsets, lengths = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([target] * len(rows), pa.string()), pa.array(pages, pa.int64()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["file", "page_id", "offset", "length"])

    make_folder(archives.sparkSession, folder)
    spread = archives.select("archive").repartition(max(1, min(2000, archives.count())))
    return written(spread.mapInArrow(run, "file string, page_id long, offset long, length long"), "index")


def read_member(data: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of a record's gzip member."""
    record = zlib.decompress(data, 31)
    end = record.index(b"\r\n\r\n")
    fields = parse_head(record[:end])
    block = record[end + 4 : end + 4 + int(fields["content-length"])]
    cut = block.index(b"\r\n\r\n")
    http, body = parse_head(block[:cut]), block[cut + 4 :]
    page = int(fields["x-page-id"]) if fields.get("x-page-id") else None
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    kind = fields["warc-type"]
    if kind == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(http["content-length"])):
        raise ValueError(f"page {page}: the payload doesn't have its digest")
    refers = int(fields["x-refers-to-page-id"]) if kind == "revisit" else None
    return page, int(http["content-length"]), digest, kind, refers, fields.get("warc-target-uri")


def read_records(index: DataFrame) -> DataFrame:
    """The records of an index(file, offset, length), each read from its offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, name = None, None
        for b in batches:
            rows = []
            for file, offset, length in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if file != name:
                    if opened is not None:
                        opened.close()
                    system, path = file_system(file)
                    opened, name = system.open_input_file(path), file
                rows.append(read_member(opened.read_at(length, offset)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in RECORD.split(", ")])
        if opened is not None:
            opened.close()

    return index.select("file", "offset", "length").mapInArrow(run, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives, normalises them and reads them back."""
    from .common import delete

    spark = pages.sparkSession
    folder = work_dir(spark, "warc")
    archives = write_archives(with_responses(pages), f"{folder}/whole")
    index = normalise(archives, f"{folder}/members")
    delete(spark, f"{folder}/whole")
    return read_records(index)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).drop("url")


ORACLE = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
    SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""
