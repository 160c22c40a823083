"""Ops 4 and 5 against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from graphloom.llm import substrings
from graphloom.llm._exchange import unpack
from graphloom.llm._suffixes import SuffixTree, string_classes
from graphloom.llm.substrings import _HEAD, _OWNER, _RUN, ByteWindows, WordWindows, _all_settled, _least_id_waits, _named, _suspects, dedup_byte_strings, dedup_word_windows, word_pieces

SCHEMA = "doc_id long, text string, n_words string, row string, kept string"


def brute_bytes(texts, width):
    seen = Counter()
    data = [(t or "").encode() for t in texts]
    for b in data:
        seen.update(b[i : i + width] for i in range(len(b) - width + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def brute_words(docs, width):
    first = defaultdict(lambda: 1 << 63)
    order = lambda d: (1 << 63) - 1 if d is None else d
    words = [(d, (t or "").encode().split()) for d, t in docs]
    for d, w in words:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first[k], order(d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < order(d):
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def made_docs(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6)))
    passage = [" ".join(word() for _ in range(n)) for n in (40, 60, 90, 13, 12)]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(r.randint(0, 50)))]
        for _ in range(r.randint(0, 2)):
            parts.insert(r.randrange(len(parts) + 1), r.choice(passage))
            parts.append(" ".join(word() for _ in range(r.randint(0, 20))))
        docs.append((i, r.choice([" ", "\n", "  "]).join(parts)))
    docs += [(60, None), (61, ""), (62, "x"), (63, "ab" * 500), (64, "a" * 450), (65, "aab" * 300), (66, docs[3][1]), (3, docs[3][1]), (67, docs[5][1] + "!"), (None, docs[5][1]), (None, docs[5][1])]
    docs += [(68, "one two " * 200), (69, "one two " * 10)]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", "y", "z") for d, t in docs], SCHEMA).repartition(5)


def sortable(rows):
    return sorted(rows, key=repr)


def test_bytes_made(spark):
    docs = made_docs()
    for width, gram in ((200, 50), (64, 20)):
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup_byte_strings(frame(spark, docs), width=width, gram=gram).collect()]
        want = [(d, *x) for (d, _), x in zip(docs, brute_bytes([t for _, t in docs], width))]
        assert sortable(got) == sortable(want)


def test_words_made(spark):
    docs = made_docs()
    for width, gram in ((13, 5), (6, 3)):
        got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in dedup_word_windows(frame(spark, docs), width=width, gram=gram).collect()]
        assert sortable(got) == sortable(brute_words(docs, width))


def test_words_repeated_in_the_larger_id(spark):
    """Passages twice or more in a larger id, or in several null ids, whose smaller id is in another task."""
    r = random.Random(4)
    words = lambda n: " ".join(f"w{r.randrange(10**9)}" for _ in range(n))
    docs = []
    for i in range(12):
        passage = words(60)
        docs += [(i, f"{words(20)} {passage} {words(9)}"), (100 + i, " ".join(f"{words(15)} {passage}" for _ in range(3))), (200 + i, f"{words(5)} {passage} {words(5)}")]
        docs += [(200 + i, f"{passage} {words(30)}"), (None, f"{passage} {words(8)} {passage}"), (None, f"{words(8)} {passage}")]
        only = words(50)
        docs += [(300 + i, f"{only} {words(3)} {only}"), (None, f"{only} {words(4)} {only}"), (None, f"{words(2)} {only}")]
    off = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        got = [(x.doc_id, x.n_words, x.n_removed, bytes(x.kept)) for x in dedup_word_windows(frame(spark, docs)).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sortable(got) == sortable(brute_words(docs, 13))


def groups_of(kind, docs, by_id, most):
    """(level, runs, different texts) of every group that the texts are dealt to, counted in the test."""
    texts = [t.encode() for _, t in docs]
    levels = []
    split = None
    for level in range(len(kind.lengths) - 1):
        named = []
        for t in texts:
            prefix = kind.prefix(next(kind.pieces(t))[1])
            of = None if split is None else np.isin(kind.minima(prefix)[1], split)
            named.append(np.zeros(0, np.uint64) if of is not None and not of.any() else _named(kind, prefix, level, not by_id, of))
        count = Counter(np.concatenate(named).tolist())
        levels.append(count)
        split = np.array([k for k, n in levels[0].items() if n > most], np.uint64)
    keys = np.array([k for c in levels for k, n in c.items() if n > 1], np.uint64).view(np.int64)
    hot = np.array([k for c in levels for k, n in c.items() if n > most], np.uint64).view(np.int64)
    ids = pa.array([d for d, _ in docs])
    columns = [pa.array([x.tolist()] * len(docs), pa.list_(pa.int64())) for x in (keys, hot)]
    batch = pa.RecordBatch.from_arrays([ids, ids, ids, pa.array(texts), *columns], names=["name", "check", "doc_id", "text", "keys", "split"])
    held = defaultdict(list)
    for out in _suspects(kind, 16, _least_id_waits if by_id else _all_settled)(iter([batch])):
        for what, block in zip(out["kind"].to_pylist(), out["block"].to_pylist(), strict=True):
            if what == _RUN:
                head, body = unpack(block, *_HEAD, *_OWNER, np.uint8)[:6], unpack(block, *_HEAD, *_OWNER, np.uint8)[-1].tobytes()
                end = np.cumsum(head[3])
                for anchor, size, to in zip(head[0].tolist(), head[3].tolist(), end.tolist()):
                    held[anchor].append(body[to - size : to])
    return [(next((x for x, c in enumerate(levels) if a in c), len(levels)), len(x), len(set(x))) for a, x in held.items()]


def test_runs_of_a_frequent_gram_are_dealt(spark):
    """Prefixes grow until a group holds few texts, of all lengths, and the result is the same."""
    kind, r = WordWindows(13, 5), random.Random(6)
    words = lambda n: " ".join(f"w{r.randrange(10**9)}" for _ in range(n))
    hash_of = lambda g: int(kind.minima(kind.prefix(f"{g} {g} {g}".encode().split()))[0][0])
    gram = min((words(5) for _ in range(3000)), key=hash_of)
    near = [(words(n), words(n)) for n in (1, 2, 3, 4)]
    around = [(words(12), words(12)) for _ in range(100)]
    passages = [words(20) for _ in range(4)]
    docs = []
    for i in range(300):
        (before, after), (first, last) = near[i % 4], around[i % 100]
        docs.append((i, f"{first} {before} {gram} {after} {last}" + (f" {passages[i % 4]} {gram} {passages[i % 4]}" if i % 3 == 0 else "")))
    for of, by_id, some in ((kind, True, docs), (ByteWindows(60, 20), False, docs)):
        found = groups_of(of, some, by_id, 4)
        assert {level for level, _, _ in found} == set(range(len(of.lengths)))
        assert all(runs <= 4 for level, runs, _ in found if level < len(of.lengths) - 1)
        assert all(texts == 1 for level, _, texts in found if level == len(of.lengths) - 1)
    made = made_docs(9)
    for some in (docs, made):
        for most in (3, 20, 1 << 14):
            got = [(x.doc_id, x.n_words, x.n_removed, bytes(x.kept)) for x in dedup_word_windows(frame(spark, some), most=most).collect()]
            assert sortable(got) == sortable(brute_words(some, 13))
            got = [(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in dedup_byte_strings(frame(spark, some), width=60, gram=20, most=most).collect()]
            assert sortable(got) == sortable([(d, *x) for (d, _), x in zip(some, brute_bytes([t for _, t in some], 60))])


def test_tandem_repeats_and_common_passages(spark):
    """Long runs of one byte or word, tandem repeats, and one passage in all documents, at different places."""
    r = random.Random(12)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passage = words(45)
    docs = [(i, f"{words(r.randint(0, 30))} {passage} {words(r.randint(0, 30))}") for i in range(40)]
    docs += [(100, "z" * 900), (101, "z" * 203 + "y" + "z" * 150), (102, "abc" * 150), (103, "bca" * 90 + "q"), (104, "ab" * 90 + "abb" * 80), (105, words(1) * 3)]
    docs += [(200, "go " * 70), (201, "go " * 20), (202, "to be or not " * 30), (203, "not to be or " * 9), (204, passage + " " + passage)]
    for most in (3, 1 << 13):
        got = [(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in dedup_byte_strings(frame(spark, docs), most=most).collect()]
        assert sortable(got) == sortable([(d, *x) for (d, _), x in zip(docs, brute_bytes([t for _, t in docs], 200))])
        got = [(x.doc_id, x.n_words, x.n_removed, bytes(x.kept)) for x in dedup_word_windows(frame(spark, docs), most=most).collect()]
        assert sortable(got) == sortable(brute_words(docs, 13))


def test_many_identical_rows(spark):
    """Copies of one row share their cuts: 5,000 of them, each with the ranges of one."""
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(None, text)] * 5000 + [(7, text), (8, "x " + text)]
    docs = spark.createDataFrame([(d, t, "a", "b", "c") for d, t in rows], SCHEMA).repartition(8)
    got = Counter((r.doc_id, r.n_removed) for r in dedup_word_windows(docs).collect())
    assert got == {(None, 200): 5000, (7, 0): 1, (8, 200): 1}
    got = Counter((r.doc_id, r.n_removed) for r in dedup_byte_strings(docs).collect())
    n = len(text.encode())
    assert got == {(None, n): 5000, (7, n): 1, (8, n): 1}


def test_very_long_texts(spark):
    """Texts of many pieces: each window is in one of them, and a repeat may lie on their border."""
    r = random.Random(13)
    long = " ".join(f"w{r.randrange(10**7)}" for _ in range(250_000))
    edge = long[(1 << 20) - 300 : (1 << 20) + 300]
    docs = [(1, long), (2, edge), (3, long[5000:6000] + " x " + long[-900:]), (4, "a" * 600_000)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in dedup_byte_strings(frame(spark, docs)).collect()}
    assert got == {1: (len(long), 2500, 3), 2: (600, 600, 1), 3: (1903, 1900, 2), 4: (600_000, 600_000, 1)}
    got = {x.doc_id: (x.n_words, x.n_removed, bytes(x.kept)) for x in dedup_word_windows(frame(spark, docs)).collect()}
    assert got[1] == (250_000, 0, long.encode()) and got[4][:2] == (1, 0)
    for d in (2, 3):
        n = len(dict(docs)[d].split())
        assert got[d][0] == n and n - 6 <= got[d][1] < n  # words cut at the edges are not those of the long text
    assert b"".join(b"".join(x) for x in word_pieces(long.encode(), 1 << 16)) == long.encode().replace(b" ", b"")


def test_classes_against_brute_force():
    r = random.Random(1)
    for _ in range(120):
        width = r.choice([1, 3, 8, 9, 20, 64, 200])
        alphabet = r.choice([b"a", b"ab", b"\x00\x01", b"abcdefgh", bytes(range(256))])
        base = bytes(r.choice(alphabet) for _ in range(600))
        bodies = []
        for _ in range(r.randint(1, 12)):
            a = r.randrange(300)
            body = bytearray(base[a : a + width + r.randint(0, 150)])
            for _ in range(r.randint(0, 3)):
                body[r.randrange(len(body))] = r.choice(alphabet)
            bodies.append(bytes(body))
        n = np.array([len(b) - width + 1 for b in bodies])
        starts = np.concatenate([np.arange(m) + o for m, o in zip(n, np.cumsum(n + width - 1) - (n + width - 1))])
        got = string_classes(np.frombuffer(b"".join(bodies), np.uint8), n + width - 1, starts, width, wave=r.choice([1, 5, 50, 1 << 16]))
        same_classes(got.tolist(), [b[i : i + width] for b in bodies for i in range(len(b) - width + 1)])


def same_classes(got, windows):
    there, back = {}, {}
    assert all(there.setdefault(x, w) == w and back.setdefault(w, x) == x for x, w in zip(got, windows, strict=True))


def test_suffix_tree_against_brute_force():
    r = random.Random(2)
    for width in (1, 2, 5, 13):
        words = np.array([r.randrange(4) for _ in range(400)])
        starts = np.array(sorted(r.sample(range(400 - width), 300)))
        tree = SuffixTree(words, starts, width)
        seen = Counter(tuple(words[s : s + width]) for s in starts)
        for depth in range(1, width + 1):
            first, last = tree.nodes(depth)
            found = [{tuple(words[starts[i] : starts[i] + depth]) for i in tree.order[a:b]} for a, b in zip(first, last)]
            assert all(len(x) == 1 for x in found)
            want = Counter(w[:depth] for w in seen.elements())
            assert Counter({x.pop(): int(b - a) for x, a, b in zip(found, first, last)}) == Counter({w: n for w, n in want.items() if n > 1})


def test_bytes_table(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup_byte_strings(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == dict(zip(t["doc_id"].to_pylist(), brute_bytes(t["text"].to_pylist(), 200)))


def test_empty_table(spark):
    assert dedup_byte_strings(frame(spark, [])).collect() == []
    assert dedup_word_windows(frame(spark, [])).collect() == []


def test_hot_grams_joined_with_texts(spark, monkeypatch):
    """More hot grams than may be sent: texts are joined with theirs."""
    monkeypatch.setattr(substrings._cut_plan, "__defaults__", (0,))
    docs = made_docs(5)
    got = [(x.doc_id, x.n_words, x.n_removed, bytes(x.kept)) for x in dedup_word_windows(frame(spark, docs), most=3).collect()]
    assert sortable(got) == sortable(brute_words(docs, 13))
