"""Exact token counts of every prefix (op 2) by dynamic programming over BPE prefixes.

A byte-pair encoding has a unique last token for every prefix of a word, and that
token follows one whose own prefix is already encoded.  So one left-to-right pass
finds, for each prefix, the single token that ends there and is compatible with
the encoding of what precedes it; its count is one more than that prefix's.  Once
these counts are stored, "how many tokens has this prefix" and "where do I cut for
this budget" are lookups.  Offsets are of the text as given, not of its normalised form.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._rows import bound_batches

#: The byte alphabet of byte-level BPE.  Printable bytes stand for themselves, the others for code points from 256 up.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_PRINTABLE))}


#: A character with the marks and jamo that normalising may join to it.
_CLUSTER = regex.compile(r".[\p{M}\u1160-\u11FF]*", regex.DOTALL)

#: White space after a word and before what is no mark of it.
_GAP = regex.compile(r"(?<=\S)[ \n](?![\p{M}\u1160-\u11FF])")


class Item(NamedTuple):
    """A word or an added token of a text."""

    begin: int
    stop: int | None  #: none where a character's normalised form goes on into the next word
    word: str | None  #: normalised; none for an added token
    ends: list[int | None] | None  #: where each character of the word ends in the text; none if one follows the other


class PrefixBpe:
    """Prefix dynamic programming for a BPE with word-end suffix, read from a tokenizer file.

    The normaliser, splitting pattern and added tokens are those the file states.  The library itself normalises, but
    for ASCII text that the normaliser would only lower-case (white space, which parts words, is left as it is).
    """

    def __init__(self, path: str, bound: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.vocab: set[str] = set(model["vocab"])
        self.longest = max(map(len, self.vocab))
        self.starts = {t[:i] for t in self.vocab for i in range(1, len(t) + 1)}
        bodies = [t.removesuffix(self.end) for t in self.vocab if self.end and t.endswith(self.end)]
        self.tails = {t[i:] for t in bodies for i in range(len(t))}
        self.normalizer = tokenizers.Tokenizer.from_file(path).normalizer
        self.plain = self._plain(spec.get("normalizer"))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        parts = regex.findall(r"\[(?:\\.|[^\]])+\]\+?|[^|\[\]]+", split["pattern"]["Regex"])
        self.literals = {x for x in parts if x[0] != "["}
        #: every prefix of a word is one word, unless the word is one of the literals
        self.closed = "|".join(parts) == split["pattern"]["Regex"] and not any(set(x) & set(r"\.^$*+?{}()") for x in self.literals)
        self.clusters: dict[str, str] = {}
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.added_heads = {x[0] for x in self.added}
        self.added_pattern = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.parted = not any(set(x) & set(" \n") for x in (*self.added, *self.literals))
        self.bound = bound
        self.words: dict[str, int] = _Counts(self)
        self.pairs: dict[tuple[str, str], bool] = {}

    # -- one word -------------------------------------------------------------

    def _merge(self, symbols: list[str]) -> list[str]:
        """Plain merging by rank, used only to judge pairs of tokens."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 60))
            pair = (symbols[best], symbols[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _fits(self, left: str, right: str) -> bool:
        """Whether merging the two tokens' symbols gives back just these tokens (``left`` may be empty)."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is not None:
            return known
        if len(self.pairs) > self.bound:
            self.pairs.clear()
        known = self.pairs[key] = self._merge((self._symbols(left) if left else []) + self._symbols(right)) == ([left, right] if left else [right])
        return known

    def _open(self, line: str, budget: int | None = None) -> tuple[list[str], list[int]]:
        """Last token and token count of every prefix of ``line``, as the inside of a word.

        With a ``budget``, of the prefixes up to one after which none has that few tokens: a token is no longer than
        the longest of the vocabulary, so once that many neighbouring places have used the budget up, all later
        prefixes are over it.
        """
        n, vocab, starts, fits = len(line), self.vocab, self.starts, self._fits
        last, count, spent = [""] * (n + 1), [0] * (n + 1), 0
        for begin in range(n):
            before = last[begin]
            if budget is not None:
                spent = spent + 1 if count[begin] >= budget or begin and not before else 0
                if spent >= self.longest:
                    return last[: begin + 1], count[: begin + 1]
            if begin and not before:
                continue
            for stop in range(begin + 1, n + 1):
                piece = line[begin:stop]
                if piece not in starts:
                    break
                if not last[stop] and piece in vocab and fits(before, piece):
                    last[stop], count[stop] = piece, count[begin] + 1
        return last, count

    def _shut(self, line: str, last: list[str], count: list[int], stop: int) -> int:
        """Token count of the prefix of ``line`` up to ``stop`` as a whole word."""
        if not self.end:
            return count[stop]
        for begin in range(stop - 1, -1, -1):
            body = line[begin:stop]
            if body not in self.tails:
                break
            if (last[begin] or not begin) and (token := body + self.end) in self.vocab and self._fits(last[begin], token):
                return count[begin] + 1
        raise ValueError(f"no encoding of {line[:stop]!r}")

    @staticmethod
    def _line(word: str) -> str:
        return word if word.isascii() and word.isalnum() else "".join(map(_ALPHABET.__getitem__, word.encode("utf-8", "surrogatepass")))

    def word_count(self, word: str) -> int:
        """Tokens of one word."""
        line = self._line(word)
        if line + self.end in self.vocab and self._fits("", line + self.end):
            return 1
        return self._shut(line, *self._open(line), len(line))

    def word_prefixes(self, word: str, budget: int | None = None) -> list[int]:
        """Token counts of the prefixes of one word: entry i is for its first i + 1 bytes taken as a whole word.

        With a ``budget`` the list may end where all longer prefixes have more tokens.
        """
        line = self._line(word)
        last, count = self._open(line, budget)
        return [self._shut(line, last, count, stop) for stop in range(1, len(last))]

    # -- texts ------------------------------------------------------------------

    def pieces(self, text: str) -> Iterator[tuple[str | None, str]]:
        """(added token or None, stretch between them)."""
        at = 0
        for m in self.added_pattern.finditer(text) if any(x in text for x in self.added_heads) else ():
            yield None, text[at : m.start()]
            yield m.group(), ""
            at = m.end()
        yield None, text[at:]

    def _normal(self, stretch: str) -> str:
        if self.normalizer is None:
            return stretch
        return stretch.lower() if self.plain and stretch.isascii() else self.normalizer.normalize_str(stretch)

    @staticmethod
    def _plain(spec: dict | None) -> bool:
        """Whether all that the normaliser does to ASCII text, as far as words are concerned, is to lower-case it."""
        steps = spec["normalizers"] if spec and spec["type"] == "Sequence" else [spec] if spec else []
        spaces = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
        return any(x["type"] == "Lowercase" for x in steps) and all(x["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or x == spaces for x in steps)

    def count(self, text: str, lead: str = "") -> int:
        """Tokens of the whole text, after a normalised word that it may go on."""
        total, known = 0, self.words.__getitem__
        for special, stretch in self.pieces(text):
            total += 1 if special else sum(map(known, self.pattern.findall(lead + self._normal(stretch))))
            lead = ""
        return total

    def item_counts(self, text: str) -> list[int]:
        """The prefix counts at the ends of a text's words and added tokens, in the order of ``items``."""
        each: list[int] = []
        for special, stretch in self.pieces(text):
            each += [1] if special else map(self.words.__getitem__, self.pattern.findall(self._normal(stretch)))
        return list(accumulate(each))

    def _spread(self, stretch: str) -> tuple[str, list[int], list[int | None]]:
        """A normalised stretch, and for each of its characters where it begins and ends in the stretch as given."""
        line, begins, ends, known = [], [], [], self.clusters
        for m in _CLUSTER.finditer(stretch):
            raw = m.group()
            done = known.get(raw)
            if done is None:
                if len(known) > self.bound:
                    known.clear()
                done = known[raw] = self._normal(raw)
            line.append(done)
            begins += [m.start()] * len(done)
            ends += [None] * (len(done) - 1) + [m.end()] * bool(done)
        whole = "".join(line)
        if self.pattern.findall(whole) != self.pattern.findall(self._normal(stretch)):
            raise ValueError("the normaliser looks beyond single characters and their marks")
        return whole, begins, ends

    def items(self, text: str) -> Iterator[Item]:
        """Words and added tokens in their order, with offsets in ``text``."""
        at = 0
        for special, stretch in self.pieces(text):
            if special:
                yield Item(at, at + len(special), None, None)
                at += len(special)
                continue
            if self.normalizer is None or self.plain and stretch.isascii():
                for m in self.pattern.finditer(self._normal(stretch)):
                    yield Item(at + m.start(), at + m.end(), m.group(), None)
            else:
                line, begins, ends = self._spread(stretch)
                for m in self.pattern.finditer(line):
                    places = [None if e is None else at + e for e in ends[m.start() : m.end()]]
                    yield Item(at + begins[m.start()], places[-1], m.group(), places)
            at += len(stretch)

    def _inside(self, text: str, item: Item, before: Item | None, budget: int | None = None) -> Iterator[tuple[int, int]]:
        """(offset, tokens) for the cuts inside an item; tokens since ``before`` began if that touches an added token,
        else since the item began.  With a ``budget``, cuts of a word that are all over it may be left out."""
        begin, _, word, ends = item
        if word is None:
            lead = before.word if before and before.word is not None and before.stop == begin else ""
            yield from ((cut, self.count(text[begin:cut], lead)) for cut in range(begin + 1, item.stop))
            return
        if word in self.literals:
            steps = [sum(map(self.words.__getitem__, self.pattern.findall(word[:i]))) for i in range(1, len(word))]
        else:
            by_byte, n, steps = self.word_prefixes(word, budget), 0, []
            for c in word[:-1]:
                n += len(c.encode("utf-8", "surrogatepass"))
                if n > len(by_byte):
                    break
                steps.append(by_byte[n - 1])
        for i, count in enumerate(steps):
            cut = begin + i + 1 if ends is None else ends[i]
            if cut is not None:
                yield cut, count

    def _check(self) -> None:
        if not self.closed:
            raise ValueError("prefixes of this splitting pattern's words are not words")

    def _whole(self, item: Item) -> int:
        return 1 if item.word is None else self.words[item.word]

    def prefix_table(self, text: str) -> tuple[list[int], list[int]]:
        """(offsets, counts): counts[i] tokens has each prefix of ``text`` that ends at offsets[i] or in the white space
        after it.  Every character's end is there but for those between a character and its marks, which is no place
        to cut; the last offset is the end of the text."""
        self._check()
        offsets, counts, base, last, before = [0], [0], 0, 0, None
        for item in self.items(text):
            joined = item.word is None and before is not None and before.word is not None and before.stop == item.begin
            for cut, n in self._inside(text, item, before):
                offsets.append(cut)
                counts.append((last if joined else base) + n)
            last, base, before = base, base + self._whole(item), item
            if item.stop is not None:
                offsets.append(item.stop)
                counts.append(base)
        if offsets[-1] < len(text):
            offsets.append(len(text))
            counts.append(base)
        return offsets, counts

    def _blocks(self, text: str, size: int = 1024) -> Iterator[tuple[int, int]]:
        """A text in stretches that end with a word and go on with white space, so that each is counted for itself."""
        at = 0
        while len(text) - at > size and self.parted and (m := _GAP.search(text, at + size)):
            yield at, m.start()
            at = m.start()
        yield at, len(text)

    def fit(self, text: str, budget: int) -> tuple[int, int]:
        """(tokens of the whole text, largest offset of its prefix table with at most ``budget`` tokens).

        Counts at the ends of words never fall, so the cut is read from the stored counts of the block that passes the
        budget; only the word that passes it is looked into.
        """
        total, cut = 0, None
        for begin, stop in self._blocks(text):
            if cut is not None:
                total += self.count(text[begin:stop])
                continue
            stored = self.item_counts(text[begin:stop])
            n = stored[-1] if stored else 0
            if total + n > budget:
                cut = begin + self._cut(text[begin:stop], stored, budget - total)
            total += n
        return total, len(text) if cut is None else cut

    def _cut(self, text: str, stored: list[int], budget: int) -> int:
        """Largest offset with at most ``budget`` tokens in a text that has more, by its ``item_counts``: in the item
        that passes the budget, or in an added token that touches it."""
        self._check()
        best = base = last = 0
        before, passed = None, False
        for item, after in zip(self.items(text), stored, strict=False):
            joined = item.word is None and before is not None and before.word is not None and before.stop == item.begin
            if passed and not joined:
                break
            if after <= budget and item.stop is not None:
                best = item.stop
            else:
                cuts = self._inside(text, item, before, budget - base)
                best = max([best, *(cut for cut, n in cuts if (last if joined else base) + n <= budget)])
                if passed:
                    break
                passed = after > budget
            last, base, before = base, after, item
        return best


class _Counts(dict):
    """Word to token count for a bounded number of words: two generations, so that frequent words stay.

    Words over ``longest`` characters are counted each time that they come and are not kept.
    """

    longest = 1000

    def __init__(self, bpe: PrefixBpe):
        super().__init__()
        self.bpe = bpe
        self.older: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        if len(word) > self.longest:
            return self.bpe.word_count(word)
        if len(self) >= self.bpe.bound // 2:
            self.older = dict(self)
            self.clear()
        value = self.older.get(word)
        value = self[word] = self.bpe.word_count(word) if value is None else value
        return value


class PrefixCounts:
    """Answers about one text from its stored prefix counts, without encoding again."""

    def __init__(self, offsets: list[int], counts: list[int]):
        self.offsets, self.counts = offsets, counts

    def tokens_before(self, offset: int) -> int:
        return self.counts[bisect_right(self.offsets, offset) - 1]

    def longest_within(self, budget: int) -> int:
        """The largest stored offset whose prefix has at most ``budget`` tokens (counts may dip, so all are looked at)."""
        return max((o for o, c in zip(self.offsets, self.counts, strict=True) if c <= budget), default=0)


_loaded: dict[str, PrefixBpe] = {}


def _bpe(path: str) -> PrefixBpe:
    if path not in _loaded:
        _loaded[path] = PrefixBpe(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Token counts of whole texts: ``doc_id, n_bytes, n_tokens, over_limit, fit_chars``, one row per input row.

    ``fit_chars`` is the length in characters of the longest prefix with at most ``limit`` tokens (the whole text, if
    that fits; never between a character and its marks).

    ``tokenizer_path`` names a tokenizer file that every executor has.  Counts are the library's without added
    begin or end tokens; the strings of added tokens inside a text count one each, as is its default.  Null and
    empty texts have no tokens.  Long texts are read whole; a worker keeps a bounded number of words.  Repeated
    rows and ids are counted each for itself, other columns are not read, and an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(tokenizer_path)
        for batch in batches:
            found = [bpe.fit(t, limit) if t else (0, 0) for t in batch["text"].to_pylist()]
            n = [x for x, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_bytes"], pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array([cut for _, cut in found], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    bound_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored table itself: ``doc_id, offsets array<int>, counts array<int>`` for use with ``PrefixCounts``.

    Offsets count characters of the text as given.  Null and empty texts have the one entry (0, 0); repeated rows have
    a table each; other columns are not read; an empty table gives no rows.  A table has an entry for nearly every
    character, so a text needs some tens of times its size in a worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(tokenizer_path)
        for batch in batches:
            tables = [bpe.prefix_table(t or "") for t in batch["text"].to_pylist()]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([t[0] for t in tables], ints), pa.array([t[1] for t in tables], ints)], names=["doc_id", "offsets", "counts"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, offsets array<int>, counts array<int>")


def truncate_to_budget(docs: DataFrame, tokenizer_path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, cut``: the characters of each text that may stay so that at most ``budget`` tokens are left.

    Null and empty texts have 0 tokens and cut 0; a text within the budget is not cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = [PrefixCounts(o, c) for o, c in zip(batch["offsets"].to_pylist(), batch["counts"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([s.counts[-1] for s in stored], pa.int64()), pa.array([s.longest_within(budget) for s in stored], pa.int64())], names=["doc_id", "n_tokens", "cut"])

    return prefix_counts(docs, tokenizer_path, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, cut long")
