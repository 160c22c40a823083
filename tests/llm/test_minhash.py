"""Op 3 against brute force."""

import random

import numpy as np
import pyarrow.parquet as pq

from graphloom.llm.minhash_dedup import near_duplicates, shingle_set, sketch

SCHEMA = "doc_id long, text string, n string, rep string, key string"


def brute(docs, width, similarity):
    """Rows (doc_id, n_shingles, component_id) by comparing all pairs; rows that share an id are one vertex."""
    sets = []
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets.append((d, {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()))
    root = {d: d for d, _ in docs if d is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= similarity * len(x | y):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return [(d, len(x), top(d)) for d, x in sets]


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "a", "b", "c") for d, t in docs], SCHEMA).repartition(4)


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"edit{r.randrange(10**6)}"
    return out


def made(seed=5):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randint(1, 120)))) for i in range(150)]
    base = r.choices(vocabulary, k=150)
    # a group whose members are, pair by pair, above and below the threshold
    docs += [(1000 + i, " ".join(edited(r, base, r.randint(0, 7)))) for i in range(120)]
    # short texts that share a passage and nothing else
    docs += [(2000 + i, " ".join(base[:60] + r.choices(vocabulary, k=40))) for i in range(60)]
    docs += [(3000, None), (3001, ""), (3002, " \n\t"), (3003, "a"), (3004, "A"), (3005, "a b c"), (3006, "a  B\nc"), (3007, docs[0][1]), (3008, docs[0][1].upper())]
    docs += [(5, docs[7][1]), (3007, docs[3][1])]
    return docs


def test_made(spark):
    docs = made()
    for width in (4, 5):
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, docs), width=width).collect()]
        assert sorted(got) == sorted(brute(docs, width, 80))


def test_tiles(spark):
    docs = [x for x in made(6) if x[0] >= 1000]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, docs), width=4, rounds=1, tile=16).collect()]
    assert sorted(got) == sorted(brute(docs, 4, 80))


def test_near_copies_of_every_text_of_an_id(spark):
    """Ids with several texts, each of which has near copies under larger ids, and smaller ones for some."""
    r = random.Random(8)
    docs = []
    for i in range(20):
        for k in range(3):
            text = [f"v{r.randrange(10**9)}" for _ in range(120)]
            docs += [(100 * i + 50, " ".join(text)), (100 * i + 60 + k, " ".join(edited(r, text, 1))), (100 * i + 70 + k, " ".join(edited(r, text, 2)))]
            if k and i % 4 == 0:
                docs += [(100 * i + k, " ".join(edited(r, text, 1))), (100 * i + 50, " ".join(text))]
    for rounds, tile in ((2, 1024), (1, 4)):
        got = [(x.doc_id, x.n_shingles, x.component_id) for x in near_duplicates(frame(spark, docs), width=4, rounds=rounds, tile=tile).collect()]
        assert sorted(got) == sorted(brute(docs, 4, 80))


def test_null_ids_and_empty(spark):
    rows = near_duplicates(frame(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (None, "lonely text here"), (None, None)])).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in rows), key=repr) == sorted([(None, 4, False), (4, 4, True), (None, None, True), (None, None, True)], key=repr)
    assert near_duplicates(frame(spark, [])).collect() == []


def test_sketch_fills_and_estimates():
    one = sketch([np.array([7], np.uint64)], 128)
    assert (one != np.iinfo(np.uint64).max).all()
    r = np.random.default_rng(1)
    both = r.integers(0, 1 << 63, 1000, dtype=np.uint64)
    a, b = np.unique(np.append(both, r.integers(0, 1 << 63, 125, dtype=np.uint64))), np.unique(np.append(both, r.integers(0, 1 << 63, 125, dtype=np.uint64)))
    x, y = sketch([a, b], 512)
    assert abs((x == y).mean() - 1000 / 1250) < 0.08


def test_shingles_of_short_texts():
    assert len(shingle_set(b"a b c", 4)) == 1 and len(shingle_set(b"a b c d e", 4)) == 2 and len(shingle_set(None, 4)) == 0


def test_table(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet")
    docs = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), width=4).collect()]
    assert sorted(got) == sorted(brute(docs, 4, 80))
