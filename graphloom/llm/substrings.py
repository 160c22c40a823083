"""Exact removal of repeated passages: word windows (op 4) and byte strings (op 5).

Both operators compare *windows*: 13 consecutive words, or 200 consecutive bytes.
A window is a suffix of its document cut at the depth that matters.  Suffixes are
dealt into groups that a task can hold, and each group's suffixes are sorted:

* op 4 builds the suffix tree of a group's word sequences (``SuffixTree``); its
  internal nodes of depth 13 and more are the maximal repeats.
* op 5 sorts a group's byte strings by bucket-pointer refinement
  (``string_classes``); neighbours that share 200 bytes are repeats.

Sending every suffix would move many times the input, so groups are made in two
steps that lose nothing:

1. Each window names its *anchor*: the gram inside it with the smallest hash.  Equal
   windows name equal anchors.  Only anchors (a few per cent of all positions) are
   exchanged and counted; an anchor that occurs once proves that all its windows do.
2. Neighbouring windows that name one repeated anchor are a *run*.  Its text goes to
   the group of that anchor: the gram is the prefix by which suffixes are dealt.

How long a prefix is depends on counts.  Where a gram occurs more often than a group
may hold, its windows name their smallest gram of the next length instead
(``Windows.lengths``: 5, 7, 9, 11 and 13 words, 50 to 200 bytes), until one is found
that a group can hold.  The grams of the lengths between are counted like those of
step 1, in one more pass over the texts that hold a hot gram; a window that names one
of them that is there once has no equal and goes no further.  At the last length a
group holds one text, which a map task sends once for each flush.

Verdicts come back as ranges of window starts, are joined with the texts by row, and
each document is cut once.  What the counts find are tables in the shared folder; a
lost executor costs its running tasks.

Windows are compared word by word or byte by byte.  Rows are told apart by two 64-bit
hashes of id and text.  Long texts are taken in pieces, so a task holds a piece's
arrays and not a text's.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._exchange import BLOCK, KeyPacker, bucket_count, pack, repeated_keys, split_by, unpack
from graphloom.llm._hashing import byte_values, hash_words, prefix_hashes, run_starts, sliding_min, window_hashes
from graphloom.llm._rows import bound_batches, carried, carried_type, row_of
from graphloom.llm._suffixes import SuffixTree, string_classes
from graphloom.plans.materialize import materialize

_NO_ID = (1 << 63) - 1
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_pieces(text: bytes, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, those of about ``most`` bytes at a time."""
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + most) if at + most < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end].split()
        at = end


class Windows:
    """Windows of ``width`` tokens; anchors are grams of ``lengths`` tokens, from ``gram`` to the whole window."""

    def __init__(self, width: int, gram: int, steps: int = 4):
        self.width = width
        self.lengths = sorted({gram + (width - gram) * k // steps for k in range(steps + 1)})

    def prefix(self, tokens) -> np.ndarray:
        return prefix_hashes(self.values(tokens))

    def span(self, level: int) -> int:
        """How many grams of a level a window holds."""
        return self.width - self.lengths[level] + 1

    def minima(self, prefix: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """From prefix hashes: hashes of the grams of a level, and for each window the smallest one inside it."""
        grams = window_hashes(prefix, self.lengths[level])
        return grams, sliding_min(grams, self.span(level))

    def runs(self, prefix: np.ndarray, keys: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first window, last + 1, anchor, again) of the runs of neighbours that name one repeated anchor.

        ``keys`` are the repeated anchors of the text at all levels, ``hot`` those of them that no group can hold; at
        the last level every anchor is taken.  ``again``: windows of the run may equal each other, as its text has
        repeated grams in more than one place.
        """
        places: list[np.ndarray] = []
        for at in range(len(self.lengths)):
            grams, least = self.minima(prefix, at)
            whole = 0 < at == len(self.lengths) - 1
            here = np.isin(least, keys) | whole
            places.append(np.append(0, np.cumsum(np.isin(grams, keys) | whole)))
            if at == 0:
                low, keep = least, here
                level, longer = np.zeros(len(low), np.int64), np.isin(low, hot)
            else:
                low, keep, level = np.where(longer, least, low), np.where(longer, here, keep), np.where(longer, at, level)
                longer = longer & np.isin(least, hot)
            if not longer.any():
                break
        first = run_starts(low)
        end = np.append(first[1:], len(low))
        kept = keep[first]
        first, end = first[kept], end[kept]
        again = np.zeros(len(first), bool)
        for at, place in enumerate(places):
            mine = np.flatnonzero(level[first] == at)
            again[mine] = place[end[mine] + self.span(at) - 1] - place[first[mine]] > 1
        return first, end, low[first], again


class WordWindows(Windows):
    """Words; a run's body is its words with a space between."""

    def pieces(self, text: bytes) -> Iterator[tuple[int, list[bytes]]]:
        """(first word, words) of pieces that have every window in one of them."""
        base, held = 0, []
        for words in word_pieces(text):
            words = held + words
            if len(words) >= self.width:
                yield base, words
            held = words[1 - self.width :] if len(words) >= self.width else words
            base += len(words) - len(held)

    def values(self, words: list[bytes]) -> np.ndarray:
        return hash_words(words)

    def body(self, words: list[bytes], lo: int, hi: int) -> bytes:
        return b" ".join(words[lo : hi + self.width - 1])

    def classes(self, bodies: list[bytes], n: np.ndarray) -> np.ndarray:
        """Class numbers of the ``n`` windows of each body, equal for equal windows."""
        number: dict[bytes, int] = {}
        words = [number.setdefault(w, len(number)) for body in bodies for w in body.split(b" ")]
        first = np.cumsum(n + self.width - 1) - (n + self.width - 1)
        tree = SuffixTree(np.array(words, np.int64), np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum())), self.width)
        out = np.arange(len(tree.order)) + len(tree.order)
        for number_, (a, b) in enumerate(zip(*map(np.ndarray.tolist, tree.nodes(self.width)), strict=True)):
            out[tree.order[a:b]] = number_
        return np.unique(out, return_inverse=True)[1]


class ByteWindows(Windows):
    """Bytes; a run's body is its bytes."""

    def __init__(self, width: int, gram: int, piece: int = 1 << 18):
        super().__init__(width, gram)
        self.piece = piece

    def pieces(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(first byte, bytes) of pieces that have every window in one of them."""
        for at in range(0, len(text) - self.width + 1, self.piece):
            yield at, text[at : at + self.piece + self.width - 1]

    def values(self, data: bytes) -> np.ndarray:
        return byte_values(np.frombuffer(data, np.uint8))

    def body(self, data: bytes, lo: int, hi: int) -> bytes:
        return data[lo : hi + self.width - 1]

    def classes(self, bodies: list[bytes], n: np.ndarray) -> np.ndarray:
        size = n + self.width - 1
        starts = np.repeat(np.cumsum(size) - size - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return string_classes(np.frombuffer(b"".join(bodies), np.uint8), size, starts, self.width)


def _rows(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """(name, check, doc_id, text[, row]): rows go by ``name`` and are told apart by both hashes of their content."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.col(id_col).cast("long")
    return docs.select(F.xxhash64(key, text).alias("name"), F.xxhash64(F.lit(1), key, text).alias("check"), key.alias("doc_id"), text.alias("text"), *carried(carry))


def _named(kind: Windows, prefix: np.ndarray, level: int, inside: bool, of: np.ndarray | None = None) -> np.ndarray:
    """The anchors of a text at one level, as often as they have runs of at most ``span`` windows (of the windows ``of``).

    ``inside``: as often as they have places.
    """
    grams, low = kind.minima(prefix, level)
    span = kind.span(level)
    if inside:
        # a position counts if its gram is the least of some window that holds it, that is, if it is the largest of
        # those windows' minima (found as a minimum of complements)
        most = np.iinfo(np.uint64).max
        edge = np.full(span - 1, most, np.uint64)
        flipped = ~low if of is None else np.where(of, ~low, most)
        return grams[grams == ~sliding_min(np.concatenate([edge, flipped, edge]), span)]
    if of is None:
        at, n = run_starts(low), len(low)
    else:
        place = np.flatnonzero(of)
        low, n = low[place], len(place)
        at = np.flatnonzero(np.append(True, (np.diff(place) != 1) | (low[1:] != low[:-1])))
    return np.repeat(low[at], -(-np.diff(np.append(at, n)) // span))


def _anchors(kind: Windows, buckets: int, inside: bool, hot: np.ndarray | None = None) -> Callable:
    """Map step 1: texts to blocks of anchors, each with how often the text has it.

    Texts are read once more with ``hot`` anchors, given for all or in a column ``split``: windows that name one of
    them name those of the levels between the first and the last.  ``inside``: an anchor that one text has in two places is repeated.
    """

    def found(prefix: np.ndarray, split: np.ndarray | None) -> list[np.ndarray]:
        if split is None:
            return [_named(kind, prefix, 0, inside)]
        of = np.isin(kind.minima(prefix)[1], split)
        return [_named(kind, prefix, level, inside, of) for level in range(1, len(kind.lengths) - 1)] if of.any() else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = KeyPacker(buckets)
        for batch in batches:
            again = "split" in batch.schema.names
            for row, text, split in zip(batch["name"].to_pylist(), batch["text"], batch["split"] if again else [None] * batch.num_rows, strict=True):
                split = np.asarray(split.values).view(np.uint64) if again else hot
                named = [x for _, tokens in kind.pieces(text.as_buffer().to_pybytes()) for x in found(kind.prefix(tokens), split)]
                if named:
                    keys, times = np.unique(np.concatenate(named), return_counts=True)
                    yield from packer.add(row, keys, times, times > 1 if inside else None)
        yield from packer.flush()

    return run


_RUN, _DONE = 0, 1
_PACKED = "bucket long, kind int, block binary"
_HEAD = (np.uint64, np.int64, np.int32, np.int32, np.int32, np.uint8)
_OWNER = (np.int64, np.int64, np.int32)
_RANGES = "name long, check long, lo long, hi long"


def _packed_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, x = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], names=["bucket", "kind", "block"])


def _joined_ranges(ranges: np.ndarray) -> np.ndarray:
    """Rows (name, check, lo, hi) with those that follow on each other made one."""
    if not len(ranges):
        return ranges
    ranges = ranges[np.lexsort((ranges[:, 2], ranges[:, 1], ranges[:, 0]))]
    fresh = np.append(True, (ranges[1:, :2] != ranges[:-1, :2]).any(1) | (ranges[1:, 2] != ranges[:-1, 3]))
    first = np.flatnonzero(fresh)
    return np.column_stack([ranges[first, :3], ranges[np.append(first[1:], len(ranges)) - 1, 3]])


def _suspects(kind: Windows, buckets: int, settle_local: Callable) -> Callable:
    """Map step 2: runs of windows with a repeated anchor, to the group of that anchor.

    A run that is there twice in one flush travels once, with the owners that wait for a verdict; ``settle_local``
    says which those are, under which id they go, and which owners are settled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            runs, done = [], []
            for (anchor, body), (n, again, owners) in held.items():
                ident, waiting, settled = settle_local(owners)
                done += [(name, check, lo, lo + n) for _, name, check, lo in settled]
                runs.append(((anchor, ident, n, len(body), len(waiting), again), waiting, body))
            held, size = {}, 0
            rows = []
            done = _joined_ranges(np.array(done, np.int64).reshape(-1, 4))
            for b, idx in split_by((done[:, 0].view(np.uint64) % np.uint64(buckets)).astype(np.int64)):
                rows.append((b, _DONE, pack(*(done[idx, j].copy() for j in range(4)))))
            for b, idx in split_by((np.array([x[0][0] for x in runs], np.uint64) % np.uint64(buckets)).astype(np.int64)):
                part = [runs[i] for i in idx]
                head = [np.array([x[0][j] for x in part], t) for j, t in enumerate(_HEAD)]
                owner = [np.array([o[j + 1] for x in part for o in x[1]], t) for j, t in enumerate(_OWNER)]
                rows.append((b, _RUN, pack(*head, *owner, np.frombuffer(b"".join(x[2] for x in part), np.uint8))))
                if len(rows) >= 256:
                    yield _packed_rows(rows)
                    rows = []
            yield _packed_rows(rows)

        for batch in batches:
            for name, check, ident, text, keys, hot in zip(*(batch[c].to_pylist() for c in ("name", "check", "doc_id")), *(batch[c] for c in ("text", "keys", "split")), strict=True):
                ident = _NO_ID if ident is None else ident
                keys, hot = (np.asarray(x.values).view(np.uint64) for x in (keys, hot))
                for base, tokens in kind.pieces(text.as_buffer().to_pybytes()):
                    for lo, hi, anchor, again in zip(*map(np.ndarray.tolist, kind.runs(kind.prefix(tokens), keys, hot)), strict=True):
                        body = kind.body(tokens, lo, hi)
                        known = held.setdefault((anchor, body), [hi - lo, again, []])
                        if not known[2]:
                            size += len(body) + 450
                        known[2].append((ident, name, check, base + lo))
                        size += 170
                    if size >= 24 << 20:
                        yield from flush()
        yield from flush()

    return run


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of ``n[i]`` places each, one after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class _Runs:
    """The runs of one group, with the owners that wait for verdicts on them."""

    def __init__(self, blocks: list[bytes]):
        cols = [np.concatenate(x) for x in zip(*(unpack(b, *_HEAD, *_OWNER, np.uint8) for b in blocks), strict=True)]
        self.anchor, self.ident = cols[:2]
        self.n, self.size, self.owners = (x.astype(np.int64) for x in cols[2:5])
        self.several = cols[5] > 0
        self.name, self.check, self.lo = cols[6:9]
        self.body = cols[9].tobytes()
        self.end = np.cumsum(self.size)

    def text(self, i: int) -> bytes:
        return self.body[self.end[i] - self.size[i] : self.end[i]]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, fresh, group): runs in order of anchor and body, where a new body begins, where a new anchor does."""
        marks = np.fromiter((xxhash.xxh3_64_intdigest(self.text(i)) for i in range(len(self.n))), np.uint64, len(self.n))
        order = np.lexsort((marks, self.anchor))
        group = np.append(True, np.diff(self.anchor[order]) != 0)
        fresh = group | np.append(True, np.diff(marks[order]) != 0)
        for i in np.flatnonzero(~fresh).tolist():
            fresh[i] = self.text(order[i]) != self.text(order[i - 1])
        return order, fresh, group

    def ranges(self, run: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """(name, check, lo, hi) for every owner of each run, of the windows from ``first`` to before ``last``."""
        times = self.owners[run]
        own = _spread((np.cumsum(self.owners) - self.owners)[run], times)
        lo = self.lo[own].astype(np.int64)
        return self.name[own], self.check[own], lo + np.repeat(first, times), lo + np.repeat(last, times)


def _settle(kind: Windows, by_id: bool, most: int = 1 << 20) -> Callable:
    """Reduce step 2: the windows of one group that are to go, as ranges.

    Runs with one text are sorted once, whatever their number; an anchor whose runs all have one text needs no
    sorting.  Anchors are sorted some at a time, up to about ``most`` bytes of differing texts.

    ``by_id``: a window goes if an equal one has a smaller id; otherwise if an equal one is there at all.
    """

    def verdicts(runs: _Runs) -> Iterator[tuple[np.ndarray, ...]]:
        order, fresh, group = runs.distinct()
        first = np.flatnonzero(fresh)
        copies = np.diff(np.append(first, len(order)))
        least = np.minimum.reduceat(runs.ident[order], first)
        mates = np.diff(np.append(np.flatnonzero(group[first]), len(first)))
        alone = np.repeat(mates == 1, mates)
        if not by_id:
            alone &= ~runs.several[order[first]]
        # anchors with one text
        body = np.repeat(np.arange(len(first)), copies)
        gone = order[np.repeat(alone, copies) & ((runs.ident[order] > least[body]) if by_id else (copies > 1)[body])]
        yield runs.ranges(gone, np.zeros(len(gone), np.int64), runs.n[gone])
        # the others, whole anchors at a time
        left = np.flatnonzero(~alone)
        if not len(left):
            return
        heads = np.append(np.flatnonzero(np.append(True, np.diff(runs.anchor[order[first[left]]]) != 0)), len(left))
        edge = np.append(0, np.cumsum(runs.size[order[first[left]]]))
        at = 0
        while at < len(heads) - 1:
            to = max(at + 1, int(np.searchsorted(edge[heads], edge[heads[at]] + most, side="right")) - 1)
            part = left[heads[at] : heads[to]]
            at = to
            n = runs.n[order[first[part]]]
            found = kind.classes([runs.text(i) for i in order[first[part]].tolist()], n)
            many = int(found.max()) + 1
            if by_id:
                value = np.full(many, _NO_ID)
                np.minimum.at(value, found, np.repeat(least[part], n))
            else:
                value = np.bincount(found, np.repeat(copies[part], n), many)
            value = value[found]
            # every run of these texts
            slot = _spread(first[part], copies[part])
            run, own = order[slot], np.repeat(np.arange(len(part)), copies[part])
            window = _spread((np.cumsum(n) - n)[own], runs.n[run])
            owner = np.repeat(np.arange(len(run)), runs.n[run])
            gone = np.flatnonzero(value[window] < runs.ident[run][owner] if by_id else value[window] > 1)
            if len(gone):
                r, s = owner[gone], (gone - np.repeat(np.cumsum(runs.n[run]) - runs.n[run], runs.n[run])[gone])
                cut = np.flatnonzero((np.diff(r) != 0) | (np.diff(s) != 1)) + 1
                begin, last = np.append(0, cut), np.append(cut, len(gone)) - 1
                yield runs.ranges(run[r[begin]], s[begin], s[last] + 1)

    def run(table: pa.Table) -> pa.Table:
        blocks: dict[int, list[bytes]] = {_RUN: [], _DONE: []}
        for what, block in zip(table["kind"].to_pylist(), table["block"].to_pylist(), strict=True):
            blocks[what].append(block)
        out = [tuple(unpack(b, *[np.int64] * 4)) for b in blocks.pop(_DONE)]
        if blocks[_RUN]:
            out += verdicts(_Runs(blocks.pop(_RUN)))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
        return pa.table(dict(zip(("name", "check", "lo", "hi"), map(pa.array, cols), strict=True)))

    return run


def _told(keys: DataFrame, most_shipped: int = 1 << 20) -> tuple[DataFrame, int]:
    """(owner, keys, split) from the table of repeated keys, and how many hot ones there are; ``split`` are those of its keys that are hot.

    Hot keys are few, as each has thousands of places; up to ``most_shipped`` they are broadcast, beyond that joined.
    """
    hot = keys.where("owner is null").select(F.col("key").alias("_hot"))
    told = keys.where("owner is not null")
    n = hot.count()
    if not n:
        return told.groupBy("owner").agg(F.collect_set("key").alias("keys"), F.array().cast("array<long>").alias("split")), 0
    told = told.join(F.broadcast(hot) if n <= most_shipped else hot.hint("merge"), F.col("key") == F.col("_hot"), "left")
    return told.groupBy("owner").agg(F.collect_set("key").alias("keys"), F.collect_set("_hot").alias("split")), n


def _cut_plan(docs: DataFrame, kind: Windows, by_id: bool, settle_local: Callable, most: int, most_sent: int = 1 << 18) -> DataFrame:
    """Every row of ``docs`` with ``cuts``, the ranges of its windows that are to go.

    Both joins read ``docs`` with the same columns and key, so its texts are shuffled once and the exchange is reused.
    """
    bound_batches(docs.sparkSession)
    buckets = bucket_count(docs, "text")
    find = _anchors(kind, buckets, not by_id)
    keys = materialize(repeated_keys(docs.select("name", "text").mapInArrow(find, BLOCK), most), "anchors")
    anchors, n_hot = _told(keys)
    if n_hot and len(kind.lengths) > 2:
        again = docs.select("name", "text")
        if n_hot <= most_sent:
            # most texts hold a hot gram, so the few grams go to the texts
            hot = np.array([x[0] for x in keys.where("owner is null").select("key").collect()], np.int64).view(np.uint64)
            find = _anchors(kind, buckets, not by_id, hot)
        else:
            hold = anchors.where(F.size("split") > 0).select("owner", "split")
            again = again.join(hold, again["name"] == hold["owner"]).select("name", "text", "split")
        longer = materialize(repeated_keys(again.mapInArrow(find, BLOCK), most), "longer_anchors")
        anchors, _ = _told(keys.unionByName(longer))
    suspects = docs.join(anchors, docs["name"] == anchors["owner"]).select(*docs.columns, "keys", "split")
    ranges = suspects.mapInArrow(_suspects(kind, buckets, settle_local), _PACKED).groupBy("bucket").applyInArrow(_settle(kind, by_id), _RANGES)
    # rows that repeat each other share a name: each of them finds the same ranges, which are kept once
    cuts = ranges.groupBy("name").agg(F.collect_set(F.struct("check", "lo", "hi")).alias("cuts")).withColumnRenamed("name", "_name")
    return docs.join(cuts, docs["name"] == cuts["_name"], "left").select(*docs.columns, "cuts")


def _covered(cuts: pa.Scalar, check: int, width: int) -> list[tuple[int, int]]:
    """Maximal ranges of tokens that lie in windows whose starts are in ``cuts``."""
    if not cuts.is_valid:
        return []
    own, lo, hi = (np.asarray(cuts.values.field(c)) for c in ("check", "lo", "hi"))
    lo, hi = lo[own == check], hi[own == check] + width - 1
    if not len(lo):
        return []
    order = np.argsort(lo)
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    fresh = np.append(True, lo[1:] > hi[:-1])
    first = np.flatnonzero(fresh)
    return list(zip(lo[first].tolist(), hi[np.append(first[1:], len(lo)) - 1].tolist(), strict=True))


# --- op 4 -------------------------------------------------------------------


def _least_id_waits(owners: list[tuple]) -> tuple[int, list[tuple], list[tuple]]:
    """Every owner with the least id waits, as a smaller one elsewhere removes all of them; larger ids are settled."""
    least = min(x[0] for x in owners)
    return least, [x for x in owners if x[0] == least], [x for x in owners if x[0] > least]


def _words_left(width: int) -> Callable:
    def cut(text: bytes, gone: list[tuple[int, int]]) -> tuple[int, bytes]:
        kept, n = [], 0
        for words in word_pieces(text):
            at = n
            n += len(words)
            while gone and gone[0][0] < n:
                a, b = gone[0]
                kept += words[at - (n - len(words)) : max(a, at) - (n - len(words))]
                at = max(at, min(b, n))
                if b > n:
                    break
                gone.pop(0)
            kept.append(b" ".join(words[at - (n - len(words)) :]))
            kept = [b" ".join(x for x in kept if x)]
        return n, b"".join(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for given, check, text, cuts in zip(*(batch[c].to_pylist() for c in ("doc_id", "check")), batch["text"], batch["cuts"], strict=True):
                gone = _covered(cuts, check, width)
                removed = sum(b - a for a, b in gone)
                out.append((given, removed, *cut(text.as_buffer().to_pybytes(), gone)))
            ids, removed, n, kept = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), *row_of(batch)[0]], names=["doc_id", "n_words", "n_removed", "kept", *row_of(batch)[1]])

    return run


def dedup_word_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, gram: int = 5, carry: tuple[str, ...] = (), most: int = 1 << 14) -> DataFrame:
    """Remove every word covered by a ``width``-word window that also starts in a document with a smaller id.

    Returns one row per input row: ``doc_id, n_words, n_removed, kept`` (kept words joined by one space), and the
    columns named in ``carry`` as a struct ``row``.

    Words are runs of bytes other than ASCII white space, compared unchanged.  Null and empty texts have no
    words; a text of fewer words than ``width`` loses nothing.  Rows that repeat an id are one document as to
    order: neither removes words of the other.  A null id counts as larger than any other, and null ids do not
    order each other.  Other columns of ``docs`` are not read.  An empty table gives an empty result.  Texts of any
    length are read whole, in pieces; a text and what is left of it have to fit into a worker.

    Suffixes are dealt by prefixes of ``gram`` words, longer ones where more than ``most`` runs share one, and in the
    end by all ``width`` words.
    """
    kind = WordWindows(width, gram)
    plan = _cut_plan(_rows(docs, id_col, text_col, carry), kind, True, _least_id_waits, most)
    return plan.mapInArrow(_words_left(width), "doc_id long, n_words long, n_removed long, kept binary" + carried_type(plan))


# --- op 5 -------------------------------------------------------------------


def _all_settled(owners: list[tuple]) -> tuple[int, list[tuple], list[tuple]]:
    """One owner waits; several are settled already."""
    return 0, owners[:1], owners if len(owners) > 1 else []


def _bytes_left(width: int, whole_characters: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for given, check, text, cuts in zip(*(batch[c].to_pylist() for c in ("doc_id", "check")), batch["text"], batch["cuts"], strict=True):
                text, gone = text.as_buffer().to_pybytes(), _covered(cuts, check, width)
                kept, at = [], 0
                for a, b in gone:
                    kept.append(text[at:a])
                    at = b
                left = b"".join([*kept, text[at:]]) if gone else text
                if gone and whole_characters:
                    left = left.decode("utf-8", "ignore").encode()
                out.append((given, len(text), sum(b - a for a, b in gone), len(gone), left))
            cols = zip(*out, strict=True) if out else ((),) * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)] + row_of(batch)[0], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *row_of(batch)[1]])

    return run


def dedup_byte_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, gram: int = 50, carry: tuple[str, ...] = (), whole_characters: bool = False, most: int = 1 << 13) -> DataFrame:
    """Remove every byte covered by a ``width``-byte string that also starts anywhere else, same document included.

    Returns one row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes left), and the columns
    named in ``carry`` as a struct ``row``.  A cut may fall inside a character; with ``whole_characters`` what is left
    of that character goes from ``kept`` too.

    Texts are UTF-8 bytes; null and empty texts, and texts shorter than ``width``, lose nothing.  Rows that
    repeat each other are occurrences of each other, so all of them lose their repeated bytes, the first
    included.  A null id is carried through.  Other columns of ``docs`` are not read.  An empty table gives an
    empty result.  Texts of any length are read whole, in pieces; a text and what is left of it have to fit into a
    worker.

    Suffixes are dealt by prefixes of ``gram`` bytes, longer ones where there are more than ``most`` of one, and in the
    end by all ``width`` bytes.
    """
    kind = ByteWindows(width, gram)
    plan = _cut_plan(_rows(docs, id_col, text_col, carry), kind, False, _all_settled, most)
    return plan.mapInArrow(_bytes_left(width, whole_characters), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary" + carried_type(plan))
