"""SentencePiece ids of whole texts through a table of distinct chunks (op 11).

Where no piece goes on past a run of white-space markers, merging never crosses from the end of a word to the next
marker, so a text's ids are those of its chunks (a run of markers and what follows up to the next one) in order.
Texts are gathered in blocks, a block's distinct chunks go to the bucket of their hash, each bucket segments each chunk
once, and the ids return to the block, where they are joined by position.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._rows import bound_batches, carried, carried_type, row_of
from graphloom.plans.materialize import materialize_bucketed

#: Fixed value: the marker that stands for a space.
MARK = "▁"


class PieceChunks:
    """A model, how its texts fall into chunks, and the ids of single chunks."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        crosses = any(MARK in p.piece.lstrip(MARK) for p in spec.pieces if p.type == p.NORMAL)
        odd = any(p.type in (p.USER_DEFINED, p.UNUSED) for p in spec.pieces)
        n, t = spec.normalizer_spec, spec.trainer_spec
        #: whether chunks are words; otherwise a whole text is one chunk
        self.parted = t.model_type == t.BPE and not (crosses or odd or n.precompiled_charsmap or n.remove_extra_whitespaces or t.treat_whitespace_as_suffix) and n.add_dummy_prefix and n.escape_whitespaces
        self.pattern = re.compile(f"{MARK}+[^{MARK}]*")

    def split(self, text: str) -> list[str]:
        """Chunks of a text; an empty one has none."""
        if not self.parted or not text:
            return [text] if text else []
        return self.pattern.findall(MARK + text.replace(" ", MARK))

    def ids(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk, by the library.  It puts a marker of its own before what it gets."""
        if not self.parted:
            return self.library.encode(chunks, num_threads=1)
        found = self.library.encode([c[1:] for c in chunks], num_threads=1)
        alone = [self.library.piece_to_id(MARK)]
        return [x if len(c) > 1 else alone for c, x in zip(chunks, found, strict=True)]


@cache
def piece_chunks(path: str) -> PieceChunks:
    return PieceChunks(path)


def pack_numbers(*arrays: np.ndarray) -> bytes:
    """Arrays of small numbers as one compressed value: equal bytes of neighbours lie together."""
    lengths = np.array([len(a) for a in arrays], "<u4")
    planes = b"".join(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(len(arrays).to_bytes(4, "little") + lengths.tobytes() + planes)


def unpack_numbers(packed: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + 4 * n, []
    for size in np.frombuffer(raw, "<u4", n, 4):
        planes = np.frombuffer(raw, np.uint8, 4 * int(size), at).reshape(4, -1)
        out.append(np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64))
        at += 4 * int(size)
    return out


def first_seen(codes: np.ndarray, base: int) -> np.ndarray:
    """Numbers given in order of first appearance, ``base`` of them before: 0 for a new one, else the number and one."""
    before = np.maximum.accumulate(np.concatenate([[base - 1], codes]))[:-1]
    return np.where(codes > before, 0, codes + 1)


def numbers_of(seen: np.ndarray, base: int) -> np.ndarray:
    """What ``first_seen`` was made of."""
    new = seen == 0
    return np.where(new, base + np.cumsum(new) - 1, seen - 1)


def _blocks(path: str, block_bytes: int, parts: int, slots: int):
    """Map side: rows of documents (with the numbers of their chunks) and of a block's distinct chunks by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_chunks(path)
        known: dict[str, int] = {}
        kind, size, block = None, 0, uuid.uuid4().hex

        def rows(slot: pa.Array, bodies: list[bytes | None], numbers: list[bytes], extra: pa.Array | None) -> pa.RecordBatch:
            n = len(numbers)
            part = zlib.crc32(block.encode()) % parts
            columns = [pa.array([block] * n, pa.string()), pa.array([part] * n, pa.int32()), slot, pa.array(bodies, pa.binary()), pa.array(numbers, pa.binary())]
            names = ["block", "part", "slot", "body", "numbers"]
            return pa.RecordBatch.from_arrays(columns if kind is None else [*columns, extra], names=names if kind is None else [*names, "row"])

        def chunk_rows() -> pa.RecordBatch:
            chunks = np.array(list(known), object)
            slot = np.array([zlib.crc32(c.encode()) % slots for c in known], np.int64)
            order = np.argsort(slot, kind="stable")
            at, first = np.unique(slot[order], return_index=True)
            bodies, numbers = [], []
            for own in np.split(order, first[1:]):
                bodies.append(zstandard.ZstdCompressor(level=1).compress("".join(chunks[own]).encode()))
                numbers.append(pack_numbers(np.array([len(c) for c in chunks[own]], np.int64), np.diff(own, prepend=0)))
            return rows(pa.array(at, pa.int32()), bodies, numbers, None if kind is None else pa.nulls(len(at), kind))

        for batch in batches:
            extra = row_of(batch)[0]
            kind = extra[0].type if extra else None
            begun, numbers = 0, []
            for i, text in enumerate(batch["text"].to_pylist()):
                found, base, put = pieces.split(text or ""), len(known), known.setdefault
                numbers.append(pack_numbers(np.array([base]), first_seen(np.array([put(c, len(known)) for c in found], np.int64), base)))
                size += 16 + sum(map(len, found))
                if size >= block_bytes:
                    yield rows(pa.nulls(len(numbers), pa.int32()), [None] * len(numbers), numbers, extra[0].slice(begun, len(numbers)) if extra else None)
                    if known:
                        yield chunk_rows()
                    begun, numbers = i + 1, []
                    known, size, block = {}, 0, uuid.uuid4().hex
            if numbers:
                yield rows(pa.nulls(len(numbers), pa.int32()), [None] * len(numbers), numbers, extra[0].slice(begun) if extra else None)
        if known:
            yield chunk_rows()

    return run


def _segment(path: str):
    """A bucket: each distinct chunk is segmented once, and every block gets the ids of its own."""

    def run(table: pa.Table) -> pa.Table:
        pieces = piece_chunks(path)
        known: dict[str, int] = {}
        blocks = []
        for body, packed in zip(table["body"].to_pylist(), table["numbers"].to_pylist(), strict=True):
            text = zstandard.ZstdDecompressor().decompress(body).decode()
            lengths, steps = unpack_numbers(packed)
            ends = np.cumsum(lengths).tolist()
            own = [known.setdefault(text[a:b], len(known)) for a, b in zip([0, *ends], ends, strict=False)]
            blocks.append((steps, np.array(own, np.int64)))
        found = pieces.ids(list(known))
        sizes = np.array([len(x) for x in found], np.int64)
        starts = np.cumsum(sizes) - sizes
        ids = np.fromiter((i for x in found for i in x), np.int64, int(sizes.sum()))
        packed = [pack_numbers(steps, sizes[own], ids[ranges(starts[own], sizes[own])]) for steps, own in blocks]
        return pa.table({"block": table["block"], "pieces": pa.array(packed, pa.binary())})

    return run


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...`` (``sizes[0]`` of them), then those of the next one."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def _join_back(path: str, end: bool, decode: bool):
    """A block: ids of its chunks by number, joined by position for each document, and decoded."""

    def run(docs: pa.Table, pieces: pa.Table) -> pa.Table:
        library = piece_chunks(path).library
        parts = [unpack_numbers(packed) for packed in pieces["pieces"].to_pylist()]
        number, size, flat = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in ([np.cumsum(p[0]) for p in parts], [p[1] for p in parts], [p[2] for p in parts]))
        start, length = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        start[number], length[number] = np.cumsum(size) - size, size
        last = np.array([library.eos_id()] if end else [], np.int64)
        out, texts = [], []
        for packed in docs["numbers"].to_pylist():
            base, seen = unpack_numbers(packed)
            at = numbers_of(seen, int(base[0]))
            own = np.concatenate([flat[ranges(start[at], length[at])], last]).astype(np.int32)
            out.append(own)
            if decode:
                texts.append(library.decode(own.tolist()))
        bounds = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out])]), pa.int32())
        done = {"ids": pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(out) if out else np.zeros(0, np.int32), pa.int32()))}
        if decode:
            done["decoded"] = pa.array(texts, pa.string())
        if "row" in docs.column_names:
            done["row"] = docs["row"]
        return pa.table(done)

    return run


def encode_pieces(docs: DataFrame, model: str, column: str = "text", carry: tuple[str, ...] = ("doc_id",), end: bool = True, decode: bool = True, block_bytes: int = 32 << 20, part_bytes: int = 32 << 30) -> DataFrame:
    """``row`` (the carried columns), ``ids`` (array of int, with the end id last unless ``end`` is off) and ``decoded``.

    Ids are those of the library for the whole text, ``decoded`` is what it makes of them.  A null text is empty: it has
    the end id alone and decodes to an empty text.  Rows are encoded each for itself, so repeated rows and ids come
    back as often as they are there; other columns, whatever they are named, stay out unless carried.  A table
    without rows gives none.  A text longer than a block is a block of its own.

    A bucket gets each distinct chunk of each block of ``block_bytes`` of text once.  So that a chunk that all blocks
    hold does not fill its bucket, there is a set of buckets for every ``part_bytes`` of text: a chunk is segmented
    once in each.  Models whose pieces cross markers, or which change white space, get whole texts as chunks.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    total = docs.agg(F.sum(F.octet_length(column))).head()[0] or 0
    parts = -(-total // part_bytes) or 1
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-min(total, part_bytes) // (16 << 20)))
    base = docs.select(F.col(column).cast("string").alias("text"), *carried(carry))
    more = carried_type(base)
    dealt = base.mapInArrow(_blocks(model, block_bytes, parts, slots), "block string, part int, slot int, body binary, numbers binary" + more)
    # positions are most of it; they lie in buckets by block, so that only chunks and their ids are exchanged
    buckets = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (256 << 20))))
    table = materialize_bucketed(dealt, "block", "chunks", buckets, exchange=False)
    pieces = table.where("slot is not null").select("block", "part", "slot", "body", "numbers").groupBy("part", "slot").applyInArrow(_segment(model), "block string, pieces binary")
    whole = table.where("slot is null").select("block", "numbers", *([F.col("row")] if carry else []))
    return whole.groupBy("block").cogroup(pieces.groupBy("block")).applyInArrow(_join_back(model, end, decode), "ids array<int>" + ", decoded string" * decode + more)
