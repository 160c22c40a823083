"""Compact exchange of hash keys between documents.

Duplicate search needs the equal keys of all documents in one place.  A row for
each key would carry several times its bytes in row overhead, so a map task packs
its keys into one binary block per bucket (bucket = key modulo the number of
buckets, which grows with the corpus), and each bucket is settled by one task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._hashing import mix64, run_starts

#: Rows between the two sides of the exchange.
BLOCK = "bucket long, done boolean, block binary"


def bucket_count(df: DataFrame, column: str, bytes_each: int = 8 << 20) -> int:
    """Buckets so that each stands for about ``bytes_each`` bytes of text, however large the corpus."""
    total = df.agg(F.sum(F.octet_length(column))).head()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bytes_each))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one block; ``unpack`` needs the same dtypes."""
    return struct.pack(f"<{len(arrays)}Q", *map(len, arrays)) + b"".join(a.tobytes() for a in arrays)


def unpack(block: bytes, *dtypes) -> list[np.ndarray]:
    sizes = struct.unpack_from(f"<{len(dtypes)}Q", block)
    at, out = 8 * len(dtypes), []
    for n, t in zip(sizes, dtypes, strict=True):
        out.append(np.frombuffer(block, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def block_rows(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    b, d, x = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(d, pa.bool_()), pa.array(x, pa.binary())], names=["bucket", "done", "block"])


def split_by(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices) of an array of bucket numbers."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    starts = run_starts(bucket[order])
    for s, e in zip(starts, [*starts[1:], len(order)], strict=True):
        yield int(bucket[order[s]]), order[s:e]


class KeyPacker:
    """Map side of the search for keys that occur twice.

    Of the owners that hold a key in one flush, the first goes on to the key's bucket, as a single entry that tells
    how often the key is there and whether it is known to be repeated; the others are settled ("done" rows) and go
    to buckets of their own.  So a key that a third of all documents hold costs its bucket one entry for each
    flush, and each owner is told of a key once.

    Keys may come with how often their owner has them (summed up, in an entry to 32,767 at most), and with a mask of
    those that are repeated whoever else has them.
    """

    def __init__(self, buckets: int, flush_at: int = 1 << 19):
        self.buckets, self.flush_at = buckets, flush_at
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, owner: int, keys: np.ndarray, times: np.ndarray | None = None, repeated: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        if len(keys):
            ones = np.ones(len(keys), np.int32) if times is None else times.astype(np.int32)
            known = np.zeros(len(keys), bool) if repeated is None else repeated
            self.parts.append((keys, np.full(len(keys), owner, np.int64), ones, known))
            self.size += len(keys)
            if self.size >= self.flush_at:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        keys, owners, times, known = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order = np.argsort(keys, kind="stable")
        keys, owners = keys[order], owners[order]
        first = run_starts(keys)
        counts = np.diff(np.append(first, len(keys)))
        info = np.minimum(np.add.reduceat(times[order], first), _MOST).astype(np.uint16)
        info |= np.where((counts > 1) | np.logical_or.reduceat(known[order], first), np.uint16(_MOST + 1), np.uint16(0))
        rest = np.ones(len(keys), bool)
        rest[first] = False
        rows = []
        for b, idx in split_by((mix64(owners[rest].view(np.uint64)) % np.uint64(self.buckets)).astype(np.int64)):
            rows.append((b, True, pack(keys[rest][idx], owners[rest][idx])))
        keys, owners = keys[first], owners[first]
        for b, idx in split_by((keys % np.uint64(self.buckets)).astype(np.int64)):
            rows.append((b, False, pack(keys[idx], owners[idx], info[idx])))
            if len(rows) >= 4096:
                yield block_rows(rows)
                rows = []
        yield block_rows(rows)


#: The largest count an entry tells; the bit above it tells that the key is known to be repeated.
_MOST = 0x7FFF


def _told(table: pa.Table, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, owners) that one bucket tells of, each pair once: those of repeated keys, and what map tasks settled.

    And the keys that are there more than ``most`` times.
    """
    entries, out, often = [], [(np.empty(0, np.uint64), np.empty(0, np.int64))], np.empty(0, np.uint64)
    for done, block in zip(table["done"].to_pylist(), table["block"].to_pylist(), strict=True):
        if done:
            out.append(tuple(unpack(block, np.uint64, np.int64)))
        else:
            entries.append(unpack(block, np.uint64, np.int64, np.uint16))
    if entries:
        k, o, info = (np.concatenate(x) for x in zip(*entries, strict=True))
        del entries
        order = np.argsort(k, kind="stable")
        k, o, info = k[order], o[order], info[order]
        if most is not None:
            first = run_starts(k)
            often = k[first][np.add.reduceat((info & np.uint16(_MOST)).astype(np.int64), first) > most]
        same = k[1:] == k[:-1]
        hit = np.append(same, False) | np.append(False, same) | (info > _MOST)
        out.append((k[hit], o[hit]))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]), often


def _owner_counts(table: pa.Table) -> pa.Table:
    owner, n = np.unique(_told(table)[1], return_counts=True)
    return pa.table({"owner": pa.array(owner), "n": pa.array(n.astype(np.int64))})


def repeated_keys(blocks: DataFrame, most: int) -> DataFrame:
    """Reduce side: ``(owner, key)`` for keys that some other entry holds too, or that are known to be repeated.

    Rows without an owner name the keys that are there more than ``most`` times.
    """

    def settle(table: pa.Table) -> pa.Table:
        k, o, often = _told(table, most)
        owner = pa.concat_arrays([pa.array(o, pa.int64()), pa.nulls(len(often), pa.int64())])
        return pa.table({"owner": owner, "key": pa.array(np.concatenate([k, often]).view(np.int64))})

    return blocks.groupBy("bucket").applyInArrow(settle, "owner long, key long")


def repeated_key_counts(blocks: DataFrame) -> DataFrame:
    """Reduce side: ``(owner, shared)``, how many of an owner's distinct keys some other entry holds too."""
    return blocks.groupBy("bucket").applyInArrow(_owner_counts, "owner long, n long").groupBy("owner").agg(F.sum("n").alias("shared"))
