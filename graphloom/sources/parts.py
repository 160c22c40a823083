"""Single files whose bytes are made by many tasks.

Every task writes the bytes of its rows as a part of its own, a table lists the parts that count, and one task then
streams them into the file, in order; the driver sees names and lengths alone.  A part of a task that was lost is
not listed, and the file appears under its name only when it is whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from graphloom.plans.materialize import discard, materialize, shared_dir
from graphloom.sources.binary import open_fs

PART = "seq long, part string, bytes long"


def part_row(seq: int, part: str, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([part], pa.string()), pa.array([size], pa.int64())], names=["seq", "part", "bytes"])


def parts_folder(spark: SparkSession) -> str:
    folder = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)
    return folder


def pack_sorted(rows: DataFrame, cell: list[tuple[str, str]], folder: str) -> DataFrame:
    """Parts of globally sorted ``rows``, each column as the number type that ``cell`` says."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = f"{folder}/{uuid.uuid4().hex}", 0
        fs, place = open_fs(part)
        with fs.open_output_stream(place, compression=None) as sink:
            for batch in batches:
                out = np.empty(batch.num_rows, cell)
                for name, _ in cell:
                    out[name] = np.asarray(batch[name])
                sink.write(out.tobytes())
                size += out.nbytes
        yield part_row(TaskContext.get().partitionId(), part, size)

    return materialize(rows.select([name for name, _ in cell]).mapInArrow(pack, PART), "parts")


def pack_groups(rows: DataFrame, key: str, pack: Callable[[pa.Table], bytes], folder: str) -> DataFrame:
    """Parts of the groups of ``rows``, in order of a whole-numbered ``key``."""

    def run(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part, data = f"{folder}/{uuid.uuid4().hex}", pack(table)
        fs, place = open_fs(part)
        with fs.open_output_stream(place, compression=None) as sink:
            sink.write(data)
        return pa.Table.from_batches([part_row(group[0].as_py(), part, len(data))])

    return materialize(rows.groupBy(key).applyInArrow(run, PART), "parts")


def assemble(spark: SparkSession, sections: list[bytes | DataFrame], path: str, folder: str) -> None:
    """One file of sections in order: a few bytes, or the parts of a table in order of ``seq``.  ``folder`` goes."""
    kind = "section int, seq long, part string, head binary"
    rows = spark.createDataFrame([(i, 0, None, bytearray(s)) for i, s in enumerate(sections) if isinstance(s, bytes)], kind)
    for i, s in enumerate(sections):
        if not isinstance(s, bytes):
            rows = rows.unionByName(s.selectExpr(f"{i} AS section", "seq", "part", "CAST(NULL AS BINARY) AS head"))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = open_fs(path)
        attempt = f"{place}.{uuid.uuid4().hex}"
        with fs.open_output_stream(attempt, compression=None) as sink:
            for batch in batches:
                for part, head in zip(batch["part"].to_pylist(), batch["head"].to_pylist(), strict=True):
                    if part is None:
                        sink.write(head)
                        continue
                    own, where = open_fs(part)
                    with own.open_input_stream(where) as source:
                        while data := source.read(4 << 20):
                            sink.write(data)
        fs.move(attempt, place)
        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    done = materialize(rows.coalesce(1).sortWithinPartitions("section", "seq").mapInArrow(copy, "path string"), "assembled")
    discard(done)
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
