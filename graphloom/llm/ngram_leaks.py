"""Benchmark decontamination (op 1) with an Aho-Corasick automaton over normalised benchmark windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._rows import bound_batches, carried, carried_type, row_of, text_of
from graphloom.plans.materialize import materialize

#: Lower-cases A-Z and turns every ASCII byte that is no word character into a space.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_FIRST = 0x100


def words_of(text: bytes) -> list[bytes]:
    """Maximal runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_NORMAL).split()


class WindowAutomaton:
    """All windows of some items as one automaton over word symbols.

    Normalised words are the alphabet: each word of the items is one code point, any other word is a space, so
    one step of the automaton consumes a word and a match position is a word position.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.width = width
        self.symbol: dict[bytes, str] = {}
        windows: dict[str, set[str]] = {}
        for item, words in items:
            line = "".join(map(self._add, words))
            for at in range(max(1, len(line) - width + 1) if line else 0):
                windows.setdefault(line[at : at + width], set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for window, owners in windows.items():
            self.automaton.add_word(window, (len(window), tuple(sorted(owners))))
        self.automaton.make_automaton()
        self.empty = not windows

    def _add(self, word: bytes) -> str:
        if word not in self.symbol:
            code = _FIRST + len(self.symbol)
            self.symbol[word] = chr(code if code < 0xD800 else code + 0x800)
        return self.symbol[word]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit ranges [first, last + 1) of word positions, and the items that occur."""
        if self.empty:
            return [], set()
        get = self.symbol.get
        line = "".join([get(w, " ") for w in words])
        spans: list[list[int]] = []
        items: set[str] = set()
        for end, (n, owners) in self.automaton.iter(line):
            items.update(owners)
            begin = end + 1 - n
            while spans and spans[-1][1] >= begin:
                begin = min(begin, spans.pop()[0])
            spans.append([begin, end + 1])
        return [tuple(x) for x in spans], items


def original_offsets(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of the original text for ranges of word positions."""
    marks = np.frombuffer(text.translate(_NORMAL), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    return [(int(begin[a]), int(end[b - 1])) for a, b in spans]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, width: int, most_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Benchmark items as words, in blocks of bounded size, one at a time on the driver.

    An item that is larger than a block goes on in the next one, from the last words that a window still needs.
    """
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).where("text is not null and item is not null")
    block, held = [], 0
    for item, text in rows.orderBy("item", "text").toLocalIterator():
        words = words_of(bytes(text))
        while words:
            if block and held + len(words) > most_words:
                yield block
                block, held = [], 0
            n = max(most_words, width)
            block.append((item, words[:n]))
            held += len(words[:n])
            words = words[n - width + 1 :] if len(words) > n else []
    if block:
        yield block


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_SPAN_TYPE = "array<struct<first:long,last:long>>"
_SCHEMA = f"doc_id long, n_words long, spans {_SPAN_TYPE}, bytes {_SPAN_TYPE}, items array<string>"


def _span_array(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"first": a, "last": b} for a, b in x] for x in spans], _SPANS)


def _scan(items: list[tuple[str, list[bytes]]], width: int, text_col: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = WindowAutomaton(items, width)
        for batch in batches:
            n, spans, places, found = [], [], [], []
            for scalar in text_of(batch, text_col):
                text = scalar.as_buffer().to_pybytes() if scalar.is_valid else b""
                words = words_of(text)
                hit, names = automaton.scan(words)
                n.append(len(words))
                spans.append(hit)
                places.append(original_offsets(text, hit) if hit else [])
                found.append(sorted(names))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), _span_array(spans), _span_array(places), pa.array(found, pa.list_(pa.string())), *row_of(batch)[0]], names=["doc_id", "n_words", "spans", "bytes", "items", *row_of(batch)[1]]
            )

    return run


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = 10, most_words: int = 200_000, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Occurrences of benchmark windows in documents.

    Returns one row per document: ``doc_id, n_words, spans, bytes, items``.  ``spans`` are merged ranges of hit word
    positions, ``bytes`` the same ranges as bytes of the original UTF-8 text (for ``remove_leaks``), ``items`` the ids,
    as strings, of items with an occurring window.  Columns named in ``carry`` come along in a struct ``row``.  A
    window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one window.

    A task holds one automaton, whose size is bounded: a benchmark of more than ``most_words`` words is cut into
    blocks of about that size, and each has a pass of its own, whose hits are written to the shared folder before the
    driver reads the next block; the passes meet by two 64-bit hashes of id and text.  The driver reads the
    benchmark, never a document.

    Null texts have no words and no hits, long texts are scanned whole.  Null items and items without an id or words
    occur nowhere.  Repeated items count once.  Rows that repeat a ``doc_id`` are scanned each for itself.  Empty
    tables give empty results, or no hits.  Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    own = [] if text_col in carry else [F.col(text_col)]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), *own, *carried(carry))
    schema = _SCHEMA + carried_type(base)
    blocks = _blocks(benchmark, item_id_col, item_text_col, width, most_words)
    block, following = next(blocks, []), next(blocks, None)
    if following is None:
        return base.mapInArrow(_scan(block, width, text_col), schema)
    text = F.col(text_col if own else f"row.{text_col}")
    name = [F.xxhash64("doc_id", text).alias("_name"), F.xxhash64(F.lit(1), "doc_id", text).alias("_check")]
    rows = base.select(F.struct(*name).alias("row"), text.alias("text"), "doc_id")
    found = None
    while block is not None:
        part = rows.mapInArrow(_scan(block, width, "text"), f"{_SCHEMA}, row struct<_name:long,_check:long>").where("size(spans) > 0")
        part = materialize(part.select("row.*", "spans", "items").dropDuplicates(["_name", "_check"]), "hits")
        found = part if found is None else found.unionByName(part)
        block, following = following, next(blocks, None)
    merged = found.groupBy("_name", "_check").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return base.select("*", *name).join(merged, ["_name", "_check"], "left").drop("_name", "_check").mapInArrow(_finish(text_col), schema)


def _finish(text_col: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in text_of(batch, text_col)]
            spans = [merge_ranges([(x["first"], x["last"]) for x in s or ()]) for s in batch["spans"].to_pylist()]
            places = [original_offsets(t, s) if s else [] for t, s in zip(texts, spans, strict=True)]
            n = pa.array([len(words_of(t)) for t in texts], pa.int64())
            items = pa.array([x or [] for x in batch["items"].to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], n, _span_array(spans), _span_array(places), items, *row_of(batch)[0]], names=["doc_id", "n_words", "spans", "bytes", "items", *row_of(batch)[1]])

    return run


def remove_leaks(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the byte ranges ``spans``."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])
