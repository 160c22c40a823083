"""Files of drifted schemas, rewritten to an evolved one by field id (op 12).

Rows get an exact global rank without a global sort: a histogram over the high bits of a checksum has a fixed number of
buckets, its exclusive prefix sums say where each bucket begins, and ``row_number`` inside the bucket gives the rest.
Ranks deal rows to files; each file is written, and later rewritten, by one task that streams it.

Attempts write to a folder of their own, a table names the one that counts, and only that is moved to its place, so a
task that runs twice, or is lost after it has written, leaves no second file.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm._rows import bound_batches
from graphloom.llm.warc_zstd import _open_fs
from graphloom.plans.materialize import discard, materialize, shared_dir

#: Names of the evolved schema, whose field ids are 1 to 10.
COLUMNS = ("client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance")

#: What stands for a column that a file does not have.
MISSING = {"nation_id": -1, "city": "none"}

#: Bits of a version.
SWAPPED, REVERSED, DROPPED, NARROWED = 1, 2, 4, 8

_FIELD_ID = b"PARQUET:field_id"
_MANIFEST = "file_no long, version long, attempt string"
_DIGEST = "file_no long, version long, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string, start_columns string, columns string, path string, rewritten boolean"


class Column(NamedTuple):
    name: str
    id: int
    type: pa.DataType


def evolved(zoned: bool = False) -> list[Column]:
    """The schema that all files have in the end; ``zoned``: times are instants and not without a zone."""
    kinds = {"client_id": pa.int64(), "master_id": pa.int64(), "nation_id": pa.int64(), "balance": pa.float64(), "updated_at": pa.timestamp("us", "UTC" if zoned else None)}
    return [Column(name, i, kinds.get(name, pa.string())) for i, name in enumerate(COLUMNS, 1)]


def drifted(columns: list[Column], version: int) -> list[Column]:
    """The schema that a file of this version starts with.  Ids stay with the data, whatever else drifts."""
    out = list(columns)
    if version & SWAPPED:
        names = {"name": "email", "email": "name"}
        out = [c._replace(name=names.get(c.name, c.name)) for c in out]
    if version & NARROWED:
        kinds = {columns[9].id: pa.float32(), columns[7].id: pa.int32()}
        out = [c._replace(type=kinds.get(c.id, c.type)) for c in out]
    if version & REVERSED:
        out = [out[0], *out[:0:-1]]
    if version & DROPPED:
        gone = {c.id for c in columns if c.name in MISSING}
        out = [c for c in out if c.id not in gone]
    return out


def version_of(file_no: int, seed: int = 7) -> int:
    v = zlib.crc32(f"{seed}:{file_no}".encode()) % 24
    return v if v <= 15 else 0


def arrow_schema(columns: list[Column]) -> pa.Schema:
    return pa.schema([pa.field(c.name, c.type, True, {_FIELD_ID: str(c.id)}) for c in columns])


def field_ids(schema: pa.Schema) -> dict[int, int]:
    """Position of each field id in a file's schema."""
    return {int(f.metadata[_FIELD_ID]): i for i, f in enumerate(schema) if f.metadata and _FIELD_ID in f.metadata}


def exact_ranks(df: DataFrame, key: str, bits: int = 14) -> tuple[DataFrame, int]:
    """``row`` (all columns), ``rank`` (from 0) by unsigned crc32 of the decimal key, then the key; and the number of rows.

    Rows with a null key come last.  Rows of one key stand in order of their other columns.  The histogram has
    ``2 ** bits + 1`` rows at most, whatever the input; it alone is summed up in one task and broadcast.
    """
    crc = F.crc32(F.col("key").cast("string").cast("binary"))
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{key}`").cast("long").alias("key")).withColumn("crc", crc)
    keyed = keyed.withColumn("bucket", F.coalesce(F.shiftright("crc", 32 - bits), F.lit(1 << bits)).cast("int"))
    histogram = materialize(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "histogram")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = histogram.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("bucket").orderBy("crc", "key", "row")
    ranked = keyed.join(F.broadcast(base), "bucket").select("row", (F.col("base") + F.row_number().over(inside) - 1).alias("rank"))
    return ranked, histogram.agg(F.sum("n")).head()[0] or 0


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder under ``spark.checkpoint.dir`` that stays when the application ends."""
    return f"{shared_dir(spark).rpartition('/')[0]}/{name}-{uuid.uuid4().hex}"


def place_of(folder: str, file_no: int) -> str:
    return f"{folder}/data/clients-{file_no:05d}.parquet"


def _sink(folder: str) -> str:
    uri = f"{folder}/_attempts/{uuid.uuid4().hex}.parquet"
    fs, path = _open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return uri


def _move(attempt: str, place: str) -> None:
    """Put an attempt in its place, over what is there.  Whoever comes second finds it done."""
    fs, a = _open_fs(attempt)
    _, b = _open_fs(place)
    fs.create_dir(b.rpartition("/")[0], recursive=True)
    if fs.get_file_info(a).type == pa.fs.FileType.NotFound and fs.get_file_info(b).type != pa.fs.FileType.NotFound:
        return
    try:
        fs.move(a, b)
    except FileNotFoundError:
        if fs.get_file_info(b).type == pa.fs.FileType.NotFound:
            raise


def _manifest(file_no: int, version: int, attempt: str | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file_no], pa.int64()), pa.array([version], pa.int64()), pa.array([attempt], pa.string())], names=["file_no", "version", "attempt"])


def _write_start(folder: str, seed: int, zoned: bool):
    columns = evolved(zoned)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_no = key[0].as_py()
        version = version_of(file_no, seed)
        layout = drifted(columns, version)
        at = {c.id: c.name for c in columns}
        schema, last, uri = arrow_schema(layout), -1, _sink(folder)
        fs, path = _open_fs(uri)
        with fs.open_output_stream(path) as out, pq.ParquetWriter(out, schema) as writer:
            for batch in batches:
                ranks = batch["rank"].to_numpy()
                if len(ranks) and (ranks[0] <= last or (np.diff(ranks) != 1).any()):
                    raise ValueError(f"rows of file {file_no} are not in order")
                last = ranks[-1] if len(ranks) else last
                arrays = [_narrow(pc.struct_field(batch["row"], at[c.id]), c.type) for c in layout]
                writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=schema))
        yield _manifest(file_no, version, uri)

    return run


def _narrow(values: pa.Array, kind: pa.DataType) -> pa.Array:
    return values if values.type == kind else values.cast(kind, safe=not pa.types.is_float32(kind))


def _rewrite(folder: str, zoned: bool):
    columns = evolved(zoned)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place = place_of(folder, row["file_no"])
                _move(row["attempt"], place)
                done = _evolve_file(place, folder, columns) if row["version"] else None
                yield _rewritten(row, done, place)

    return run


def _rewritten(row: dict, attempt: str | None, place: str) -> pa.RecordBatch:
    fs, path = _open_fs(place)
    with fs.open_input_file(path) as f:
        names = ",".join(pq.ParquetFile(f).schema_arrow.names)
    out = _manifest(row["file_no"], row["version"], attempt)
    return pa.RecordBatch.from_arrays([*out.columns, pa.array([names], pa.string())], names=[*out.schema.names, "start_columns"])


def _evolve_file(place: str, folder: str, columns: list[Column]) -> str:
    """A new file with the rows of the one at ``place``, in order; columns are found by field id."""
    schema, uri = arrow_schema(columns), _sink(folder)
    fs, source = _open_fs(place)
    _, path = _open_fs(uri)
    with fs.open_input_file(source) as f, fs.open_output_stream(path) as out, pq.ParquetWriter(out, schema) as writer:
        start = pq.ParquetFile(f)
        at = field_ids(start.schema_arrow)
        for batch in start.iter_batches(1 << 16):
            arrays = [batch.column(at[c.id]).cast(c.type) if c.id in at else pa.array([MISSING[c.name]] * batch.num_rows, c.type) for c in columns]
            writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=schema))
    return uri


def _texts_of(batch: pa.RecordBatch) -> list[pa.Array]:
    """Each column as text, ``?`` for null; times as microseconds, fractions as whole 1048576ths."""
    out = []
    for values in batch.columns:
        if pa.types.is_timestamp(values.type):
            values = values.cast(pa.int64())
        elif pa.types.is_floating(values.type):
            values = pa.array([None if x is None else str(math.floor(1048576 * x)) if math.isfinite(x) else str(x) for x in values.to_pylist()], pa.string())
        out.append(pc.fill_null(values.cast(pa.string()), "?"))
    return out


def _digest(folder: str):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place = place_of(folder, row["file_no"])
                if row["attempt"]:
                    _move(row["attempt"], place)
                yield _digest_file(row, place)

    return run


def _digest_file(row: dict, place: str) -> pa.RecordBatch:
    ids, rows, n, nulls = hashlib.sha256(), hashlib.sha256(), 0, 0
    fs, path = _open_fs(place)
    with fs.open_input_file(path) as f:
        file = pq.ParquetFile(f)
        names = file.schema_arrow.names
        for batch in file.iter_batches(1 << 16):
            if not batch.num_rows:
                continue
            texts = _texts_of(batch)
            lead = b"" if n == 0 else b","
            ids.update(lead + ",".join(texts[0].to_pylist()).encode())
            lead = b"" if n == 0 else b"\n"
            rows.update(lead + "\n".join(pc.binary_join_element_wise(*texts, "|").to_pylist()).encode())
            n += batch.num_rows
            nulls += sum(c.null_count for c in batch.columns)
    found = [row["file_no"], row["version"], n, nulls, ids.hexdigest(), rows.hexdigest(), row["start_columns"], ",".join(names), place, row["attempt"] is not None]
    kinds = [pa.int64()] * 4 + [pa.string()] * 5 + [pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(found, kinds, strict=True)], names=[p.split()[0] for p in _DIGEST.split(", ")])


def rewrite_drifted(clients: DataFrame, folder: str | None = None, files: int = 1000, seed: int = 7) -> DataFrame:
    """Deal ``clients`` to files of drifted schemas in ``folder`` and rewrite those there; one row per final file.

    Files are ``<folder>/data/clients-<file_no>.parquet``; a rewritten one takes the place of the one it was made of, so
    that folder holds nothing else in the end.  A file of version 0 has the evolved schema already and is not touched.
    Of N rows a file has ``1 + N // files``, the last one maybe fewer.  A table without rows gives no file.

    Null values stay null; a column that a file lacks becomes -1 or ``none``.  Rows with a null ``client_id`` come last,
    repeated ones beside each other.  Other columns than those of the evolved schema are left out, whatever their names;
    a missing one is an error.  A balance that is no number is written and digested as ``nan``, ``inf`` or ``-inf``.
    """
    spark = clients.sparkSession
    bound_batches(spark)
    folder = folder or new_folder(spark, "schema-rewrite")
    zoned = isinstance(clients.schema["updated_at"].dataType, T.TimestampType)
    kinds = {"client_id": "long", "master_id": "long", "nation_id": "long", "balance": "double", "updated_at": "timestamp" if zoned else "timestamp_ntz"}
    ranked, n = exact_ranks(clients.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS]), "client_id")
    # tasks of a million rows, or as many as the session deals out; a number given keeps small tables from being merged into one
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(files, n // 1_000_000))
    dealt = ranked.withColumn("file_no", F.expr(f"rank div {1 + n // files}")).repartition(tasks, "file_no").sortWithinPartitions("file_no", "rank")
    begun = materialize(dealt.groupBy("file_no").applyInArrow(_write_start(folder, seed, zoned), _MANIFEST), "started")
    alone = lambda t: t.repartition(tasks, "file_no").groupBy("file_no")
    changed = materialize(alone(begun).applyInArrow(_rewrite(folder, zoned), _MANIFEST + ", start_columns string"), "rewritten")
    done = materialize(alone(changed).applyInArrow(_digest(folder), _DIGEST), "digests")
    discard(begun, changed)
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_attempts")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return done
