"""Binary graph files.

A serialized graph is one array after another, so byte ranges can be read apart from
each other: the driver reads the header and plans ranges of arcs, tasks read theirs.
Files are read through ``pyarrow.fs``, which reaches local and remote stores.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from graphloom.graph import Graph, bucket_number
from graphloom.plans.materialize import materialize

#: Magic number and earth radius (cm) of the geo format.
GEO_MAGIC, GEO_RADIUS_CM = 0x150842A7, 637_100_000.0
_EDGES = "src long, dst long, weight long"


def open_fs(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI or local path, and the place in it; Hadoop's names of S3 stand for ``s3``."""
    scheme, there, rest = path.partition("://")
    if not there:
        return pyarrow.fs.FileSystem.from_uri(f"file://{path.removeprefix('file:')}")
    return pyarrow.fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else path)


def file_size(path: str) -> int:
    fs, place = open_fs(path)
    return fs.get_file_info(place).size


def _array(fs, path: str, offset: int, n: int, dtype) -> np.ndarray:
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return np.frombuffer(f.read(n * np.dtype(dtype).itemsize), dtype)


def _arcs_of(fs, offsets: tuple[str, int], n: int, targets: tuple[str, int], cell: np.dtype, arcs: int, low: int, high: int, vertices: int = 1 << 16, rows: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Arcs ``low`` to ``high`` of a file, in batches of ``rows``; ``offsets`` and ``targets`` are files and where the arrays begin.

    The first arc's vertex is searched for in the file, and offsets are read ``vertices`` at a time from there on.
    """
    with fs.open_input_file(offsets[0]) as index, fs.open_input_file(targets[0]) as table:

        def read(f, begin: int, at: int, many: int, dtype) -> np.ndarray:
            f.seek(begin + at * np.dtype(dtype).itemsize)
            return np.frombuffer(f.read(many * np.dtype(dtype).itemsize), dtype)

        v, above = 0, n
        while above - v > vertices:
            middle = (v + above) // 2
            v, above = (middle, above) if read(index, offsets[1], middle, 1, "<i8")[0] <= low else (v, middle)
        while low < high:
            count = min(vertices, n - v)
            bounds = read(index, offsets[1], v, min(count + 1, n - v), "<i8")
            bounds = np.append(bounds, arcs) if len(bounds) == count else bounds
            stop = min(high, int(bounds[-1]))
            while low < stop:
                end = min(low + rows, stop)
                src = np.repeat(np.arange(v, v + count, dtype=np.int64), np.diff(np.clip(bounds, low, end)))
                met = read(table, targets[1], low, end - low, cell)
                weight = met["weight"].astype(np.int64) if "weight" in cell.names else np.ones(len(met), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(met["dst"].astype(np.int64)), pa.array(weight)], names=["src", "dst", "weight"])
                low = end
            v += count


def _arc_table(spark: SparkSession, offsets: tuple[str, int], n: int, targets: tuple[str, int], cell: np.dtype, arcs: int, arcs_each: int) -> DataFrame:
    """``src, dst, weight`` of a file of sorted arcs.  Tasks are dealt arcs and not vertices, which may have any number of them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, index = open_fs(offsets[0])
        table = open_fs(targets[0])[1]
        for batch in batches:
            for part in batch["id"].to_pylist():
                yield from _arcs_of(fs, (index, offsets[1]), n, (table, targets[1]), cell, arcs, part * arcs_each, min((part + 1) * arcs_each, arcs))

    parts = -(-arcs // arcs_each)
    return spark.range(0, parts, 1, max(1, parts)).mapInArrow(read, _EDGES)


def read_serialized(spark: SparkSession, path: str, weighted: bool = False, arcs_each: int = 1 << 21) -> Graph:
    """``.sg`` / ``.wsg``: directed flag, arcs and vertices (int64), offsets, targets (int32, with weights in ``.wsg``).

    Such graphs are canonical already.  A task reads ``arcs_each`` arcs.  The transposed arrays that follow in directed
    graphs are not needed.
    """
    fs, place = open_fs(path)
    directed = bool(_array(fs, place, 0, 1, np.uint8)[0])
    arcs, n = map(int, _array(fs, place, 1, 2, "<i8"))
    begin = 17 + 8 * (n + 1)
    cell = np.dtype([("dst", "<i4"), ("weight", "<i4")]) if weighted else np.dtype([("dst", "<i4")])
    if fs.get_file_info(place).size < begin + arcs * cell.itemsize:
        raise ValueError("the file is shorter than its header says")
    return Graph(_arc_table(spark, (path, 17), n, (path, begin), cell, arcs, arcs_each), n, directed, buckets=bucket_number(spark, arcs))


def index_of(path: str) -> str:
    """Where a geo file's table of record runs lies."""
    return f"{path}.index"


def _indexed(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of record runs beside a geo file, if there is one and it is of this file's length."""
    target = spark._jvm.org.apache.hadoop.fs.Path(index_of(path))
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    index = spark.read.parquet(index_of(path))
    fs, place = open_fs(path)
    return index if index.agg({"stop": "max"}).head()[0] == fs.get_file_info(place).size else None


def _geo_chunks(spark: SparkSession, path: str, vertices_each: int = 1 << 16) -> DataFrame:
    """``first, count, offset`` of runs of records: one task passes over the file once and reads only their lengths."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in batch["id"].to_pylist():
                fs, where = open_fs(path)
                starts = [8]
                with fs.open_input_stream(where, buffer_size=1 << 20) as f:
                    magic, n = struct.unpack("<II", f.read(8))
                    if magic != GEO_MAGIC:
                        raise ValueError("not a geo graph")
                    at = 8
                    for u in range(n):
                        k = struct.unpack("<I", f.read(20)[16:])[0]
                        f.read(12 * k)
                        at += 20 + 12 * k
                        if (u + 1) % vertices_each == 0 and u + 1 < n:
                            starts.append(at)
                first = np.arange(len(starts), dtype=np.int64) * vertices_each
                count = np.minimum(vertices_each, n - first)
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(count), pa.array(starts, pa.int64()), pa.array([*starts[1:], at], pa.int64())], names=["first", "count", "offset", "stop"])

    return materialize(spark.range(1).mapInArrow(find, "first long, count long, offset long, stop long"), "records")


def read_geo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Geo graph: ``(edges, coordinates)``; weights are centimetres, coordinates radians (id, lat, lon).

    Records are of different lengths.  Where runs of them begin is in the table that ``write_geo`` leaves beside a file;
    without it one task passes over the file once to find out.  Tasks then read a run each.
    """
    chunks = _indexed(spark, path)
    chunks = _geo_chunks(spark, path) if chunks is None else chunks
    chunks = chunks.repartition(max(1, chunks.count()), "first")

    def records(batches: Iterator[pa.RecordBatch], coordinates: bool) -> Iterator[pa.RecordBatch]:
        fs, where = open_fs(path)
        for batch in batches:
            for first, count, offset, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = _array(fs, where, offset, stop - offset, np.uint8).tobytes()
                at, places, degree, dst, angle = 0, [], [], [], []
                for _ in range(count):
                    lat, lon, k = struct.unpack_from("<ddI", data, at)
                    places.append((lat, lon))
                    degree.append(k)
                    dst.append(np.frombuffer(data, "<u4", k, at + 20))
                    angle.append(np.frombuffer(data, "<f8", k, at + 20 + 4 * k))
                    at += 20 + 12 * k
                ids = np.arange(first, first + count)
                if coordinates:
                    yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array([p[i] for p in places], pa.float64()) for i in (0, 1))], names=["id", "lat", "lon"])
                elif count:
                    weight = (np.concatenate(angle) * GEO_RADIUS_CM).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, degree)), pa.array(np.concatenate(dst).astype(np.int64)), pa.array(weight)], names=["src", "dst", "weight"])

    return chunks.mapInArrow(lambda b: records(b, False), _EDGES), chunks.mapInArrow(lambda b: records(b, True), "id long, lat double, lon double")


def adjacency_cell(weighted: bool) -> np.dtype:
    return np.dtype([("dst", "<u4"), ("weight", "<i4")]) if weighted else np.dtype([("dst", "<u4")])


def read_binary_adjacency(spark: SparkSession, config: str, adjacency: str, index: str, weighted: bool = False, arcs_each: int = 1 << 21) -> DataFrame:
    """Three files: the number of vertices as text, targets (uint32, with weights) and offsets (int64)."""
    fs, place = open_fs(config)
    with fs.open_input_stream(place) as f:
        n = int(f.read().split()[0])
    cell = adjacency_cell(weighted)
    return _arc_table(spark, (index, 0), n, (adjacency, 0), cell, file_size(adjacency) // cell.itemsize, arcs_each)


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    """``id, lat, lon`` of a geo graph."""
    return read_geo(spark, path)[1]
