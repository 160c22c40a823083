"""WARC archives with an embedded Zstandard dictionary (op 10).

An archive begins with a skippable frame that holds the dictionary, followed by one
Zstandard frame for each WARC record, compressed with it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._rows import bound_batches
from graphloom.plans.materialize import materialize, shared_dir

#: Fixed value: magic number of the dictionary's skippable frame.
_SKIPPABLE = 0x184D2A5D
_RECORD_SPACE = uuid.UUID("6f1e3a52-5f3c-5d5e-9a63-1b1c2d3e4f50")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """Upper-case base-32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, url: str | None, revisit: bool) -> str:
    """A response is named by its page and payload, so that revisits can name it; a revisit by its URL too."""
    name = f"{page_id}\n{digest}" if not revisit and page_id is not None else f"{page_id}\n{digest}\n{url}"
    return f"<urn:uuid:{uuid.uuid5(_RECORD_SPACE, name)}>"


def refers_id(page_id: int, digest: str) -> str:
    return record_id(page_id, digest, None, False)


def _clean(value: str) -> str:
    """A header value: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One response or revisit record; a revisit has no payload but keeps its digest and length."""
    digest = payload_digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, url, revisit)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {refers_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines += [f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """A dictionary from archived records; one from fixed header lines where there are too few to train on."""
    if sum(map(len, samples)) > 8 * size and len(samples) >= 16:
        try:
            return zstandard.train_dictionary(size, samples)
        except zstandard.ZstdError:
            pass
    # a dictionary of some fixed text, which any reader takes for one
    return zstandard.train_dictionary(4096, [b"%s: %d\r\n%s" % (name, 7 * i, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n") for i in range(400) for name in (b"Content-Length", b"WARC-Payload-Digest: sha1", b"<html><head><title>", b"</title></head><body>")])


class ArchiveWriter:
    """Writes one archive: dictionary first, then a frame for each record."""

    def __init__(self, sink, samples: list[bytes], dictionary_bytes: int, level: int):
        self.sink = sink
        dictionary = train_dictionary(samples, dictionary_bytes)
        content = dictionary.as_bytes()
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True)
        sink.write(struct.pack("<II", _SKIPPABLE, len(content)) + content)
        self.size, self.records = 8 + len(content), 0

    def write(self, record: bytes) -> None:
        frame = self.compressor.compress(record)
        self.sink.write(frame)
        self.size += len(frame)
        self.records += 1


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive opened for reading."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != _SKIPPABLE:
        raise ValueError("no dictionary frame at the start of the archive")
    content = source.read(size)
    kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind))
    stream = io.BufferedReader(plain.stream_reader(source, read_across_frames=True), 1 << 16)
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"record expected, found {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("record not closed")
        yield headers, block


def _open_fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI or local path, and the place in it; Hadoop's names of S3 stand for ``s3``."""
    scheme, there, rest = uri.partition("://")
    if not there:
        return pyarrow.fs.FileSystem.from_uri(f"file://{uri.removeprefix('file:')}")
    return pyarrow.fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", dictionary_bytes: int = 32 << 10, sample_bytes: int = 1 << 20, archive_bytes: int = 256 << 20, level: int = 3, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0, hot_copies: int = 1 << 12
) -> DataFrame:
    """Write every page as a record into archives under ``folder`` (a URI all executors reach); the list of archives.

    Of records with equal payloads of at least ``least_bytes`` bytes, the one with the largest page id is the
    response and the others revisit it.  Payloads are compared by SHA-1 and length, summed up as (digest, largest
    id) before any join.  Payloads with more than ``hot_copies`` copies are few; their digests are broadcast (up to
    131,072 of them, beyond that skewed partitions are left to adaptive execution), so their copies never meet in one task.

    Each task writes its own archives (a new one after ``archive_bytes``), with a dictionary from its first
    ``sample_bytes`` of records.  Names carry the attempt, and the returned list (``path, records, bytes``) is
    written once all tasks ended: an archive that a lost task left behind is not in it.

    Null html is an empty payload and a null URL no URL.  Null ids are smaller than any other; records with no id
    among them are all responses.  Rows that repeat id and html are responses each.  No rows give no archives.
    """
    bound_batches(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    largest = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    largest = materialize(largest.select(F.col("digest").alias("_d"), F.col("size").alias("_s"), "top", "n"), "repeated")
    hot = largest.where(F.col("n") > hot_copies).select(F.col("_d").alias("_hd"), F.col("_s").alias("_hs"), F.col("top").alias("hot_top"))
    if hot.count() <= 1 << 17:
        # rows of a hot payload stay where they are; the others' key is spread for them
        rows = rows.join(F.broadcast(hot), (F.col("digest") == F.col("_hd")) & (F.col("size") == F.col("_hs")), "left").drop("_hd", "_hs")
        rows = rows.withColumn("digest", F.when(F.col("hot_top").isNull(), F.col("digest")).otherwise(F.concat(F.lit("hot "), F.xxhash64("page_id", "url"))))
    else:
        rows = rows.withColumn("hot_top", F.lit(None).cast("long"))
    joined = rows.join(largest.drop("n").hint("merge"), (F.col("digest") == F.col("_d")) & (F.col("size") == F.col("_s")), "left").withColumn("top", F.coalesce("hot_top", "top"))
    records = joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open_fs(folder)
        context = TaskContext.get()
        stem = f"{base}/part-{context.partitionId():05d}-{context.taskAttemptId()}"
        built = (
            build_record(i, u, p, r, r is not None, date)
            for b in batches
            for i, u, p, r in zip(*(b[c].to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True)
        )
        done, held = [], []
        while True:
            size = sum(map(len, held))
            for record in built:
                held.append(record)
                size += len(record)
                if size >= sample_bytes:
                    break
            if not held:
                break
            path = f"{stem}-{len(done)}.warc.zst"
            with fs.open_output_stream(path, compression=None) as sink:
                # heads of records make up the sample, so that one long record does not fill it
                archive = ArchiveWriter(sink, [x[:4096] for x in held], dictionary_bytes, level)
                for record in held:
                    archive.write(record)
                held = []
                for record in built:
                    archive.write(record)
                    if archive.size >= archive_bytes:
                        break
            done.append((path, archive.records, archive.size))
        paths, n, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(n, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"])

    spark = pages.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)
    return materialize(records.mapInArrow(write, "path string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Records of the archives of a list: ``page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload``.

    ``payload`` is null for revisits.  Each archive is read by one task, as a stream.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open_fs(folder)
        types = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]

        def table(out: list[tuple]) -> pa.RecordBatch:
            cols = zip(*out, strict=True) if out else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, types, strict=True)], names=[n for n, _ in types])

        for batch in batches:
            for path in batch["path"].to_pylist():
                out, held = [], 0
                with fs.open_input_stream(path, compression=None) as source:
                    for headers, block in read_archive(source):
                        kind = headers["WARC-Type"]
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if payload is not None and payload_digest(payload) != digest:
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} does not have its digest")
                        number = lambda name, h=headers: int(h[name]) if name in h else None
                        out.append((number("X-Page-Id"), headers.get("WARC-Target-URI"), kind, number("X-Payload-Length"), digest, number("X-Refers-To-Page"), payload))
                        held += len(block)
                        if held > 8 << 20:
                            yield table(out)
                            out, held = [], 0
                yield table(out)

    n = max(1, archives.count())
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return archives.repartition(n, F.xxhash64("path")).mapInArrow(read, schema)


def archive_folder(spark) -> str:
    """A new folder for archives under the shared one."""
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
