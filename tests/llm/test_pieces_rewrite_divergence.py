"""Ops 11, 12 and 13 against the library, brute force and odd rows."""

import datetime
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from functools import cmp_to_key

import numpy as np
import pyarrow.dataset as ds
import pyarrow.parquet as pq
import pytest
import sentencepiece

from graphloom.llm import queries as Q
from graphloom.llm.piece_chunks import PieceChunks, encode_pieces, first_seen, numbers_of, pack_numbers, unpack_numbers
from graphloom.llm.schema_rewrite import COLUMNS, drifted, evolved, exact_ranks, field_ids, rewrite_drifted, version_of
from graphloom.llm.source_divergence import audit_sources, terms_of

CLASH = ", row string, block string, slot string, chunks string, term string, shard string, rank string, bucket string, key string, crc string"
MODEL = Q.tokenizer_file("piece_bpe_32k.model")


def clashing(spark, rows, schema):
    return spark.createDataFrame([(*r, *"abcdefghij") for r in rows], schema + CLASH).repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- op 11

ODD_TEXTS = [None, "", " ", "  ", "▁", "▁ ▁a", " a", "a ", "a  b   c", "\n\n x\ty", "<s> </s> <unk> <0x41>", "naïve ﬁ é 日本語 😀😀", "\u0000a\u0000 b", "▁▁x " * 5, "a" * 5000, "ab " * 20_000, "​ 　 �", "1234567 12 \r\n"]


def want_pieces(library, text):
    ids = [*library.encode(text or ""), library.eos_id()]
    return ids, library.decode(ids)


def test_pieces_against_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(5)
    texts = ODD_TEXTS + ["".join(rng.choice("ab ▁e\n<x>日é 😀t") for _ in range(rng.randrange(40))) for _ in range(400)]
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(None, "a b"), (3, "a b"), (3, "a b")]
    for block, part in ((64, 1 << 30), (1 << 20, 200)):
        found = encode_pieces(clashing(spark, rows, "doc_id long, text string"), MODEL, carry=("doc_id", "text", "row"), block_bytes=block, part_bytes=part).collect()
        assert len(found) == len(rows)
        assert Counter((r.row.doc_id, r.row.text) for r in found) == Counter(rows)
        for r in found:
            assert (list(r.ids), r.decoded) == want_pieces(library, r.row.text)
            assert r.row.row == "a"


def test_pieces_of_empty_table_and_whole_texts(spark, monkeypatch):
    assert encode_pieces(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []
    assert encode_pieces(spark.createDataFrame([(1, "")], "doc_id long, text string"), MODEL, end=False, decode=False).head().asDict()["ids"] == []
    whole = PieceChunks(MODEL)
    assert whole.parted
    whole.parted = False
    assert whole.split("a b") == ["a b"] and whole.ids(["a b"]) == [whole.library.encode("a b")]


def test_numbers_come_back():
    rng = np.random.default_rng(1)
    arrays = [rng.integers(0, 1 << 31, n) for n in (0, 1, 1000)]
    for base, codes in ((0, []), (0, [0, 1, 0, 2]), (5, [1, 5, 5, 0, 6, 4]), (3, [0, 2, 1])):
        assert numbers_of(first_seen(np.array(codes, np.int64), base), base).tolist() == codes
    assert all((a == b).all() for a, b in zip(arrays, unpack_numbers(pack_numbers(*arrays)), strict=True))


def test_op11_query(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = ds.dataset(f"{sf}/documents.parquet").to_table().to_pylist()
    found = {r.doc_id: r for r in Q.op11(spark, sf).collect()}
    assert len(found) == len(docs)
    for d in docs:
        ids, text = want_pieces(library, d["text"])
        r = found[d["doc_id"]]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(text))


# --- op 12


def brute_files(rows, files=1000):
    """What op 12 returns but for the path, from rows as dicts in the columns of the evolved schema."""
    crc = lambda r: zlib.crc32(str(r["client_id"]).encode())
    rows = sorted(rows, key=lambda r: (crc(r), r["client_id"]))
    per, out = 1 + len(rows) // files, []
    for file_no, at in enumerate(range(0, len(rows), per)):
        v = zlib.crc32(f"7:{file_no}".encode()) % 24
        v = 0 if v > 15 else v
        names = list(COLUMNS)
        if v & 1:
            names[4], names[5] = "email", "name"
        if v & 2:
            names = names[:1] + names[:0:-1]
        if v & 4:
            names = [n for n in names if n not in ("nation_id", "city")]
        lines, ids, nulls = [], [], 0
        for r in rows[at : at + per]:
            r = dict(r)
            if v & 4:
                r["nation_id"], r["city"] = -1, "none"
            if v & 8 and r["balance"] is not None:
                r["balance"] = float(np.float32(r["balance"]))
            nulls += sum(r[c] is None for c in COLUMNS)
            if r["updated_at"] is not None:
                r["updated_at"] = (r["updated_at"] - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
            if r["balance"] is not None:
                r["balance"] = math.floor(1048576 * r["balance"])
            ids.append(str(r["client_id"]))
            lines.append("|".join("?" if r[c] is None else str(r[c]) for c in COLUMNS))
        out.append((file_no, v, len(lines), nulls, sha(",".join(ids)), sha("\n".join(lines)), ",".join(names), ",".join(COLUMNS), v != 0))
    return out


def plain(rows):
    return sorted((r.file_no, r.version, r.n_rows, r.n_nulls, r.ids_sha256, r.rows_sha256, r.start_columns, r.columns, r.rewritten) for r in rows)


def test_op12_query(spark, sf):
    found = Q.op12(spark, sf).collect()
    assert plain(found) == brute_files(ds.dataset(f"{sf}/clients.parquet").to_table().to_pylist())
    assert {r.version for r in found} >= {0, 1, 2, 4, 8}


def test_rewritten_files(spark, tmp_path):
    rng = random.Random(2)
    maybe = lambda x: None if rng.random() < 0.2 else x
    rows = [
        (rng.randrange(1 << 40), maybe(i), maybe("s|\n"), maybe(datetime.datetime(1969, 12, 31, 23, 59, 59, i)), maybe("né"), maybe(""), maybe("c"), maybe(i % 7), maybe("g"), maybe(rng.uniform(-1e6, 1e6)))
        for i in range(500)
    ]
    schema = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
    df = clashing(spark, rows, schema)
    folder = f"file://{tmp_path}/deal"
    found = rewrite_drifted(df, folder, files=100).collect()
    assert plain(found) == brute_files([dict(zip(COLUMNS, r, strict=True)) for r in rows], 100)
    data = sorted((tmp_path / "deal" / "data").iterdir())
    assert [f"file://{p}" for p in data] == sorted(r.path for r in found) and len(list((tmp_path / "deal").rglob("*.parquet"))) == len(data)
    for p in data:
        have = pq.ParquetFile(p).schema_arrow
        assert field_ids(have) == {i + 1: i for i in range(10)} and all(f.nullable for f in have)
        assert have.field("nation_id").type == "int64" and have.field("balance").type == "double"


def test_rewrite_of_odd_rows(spark, tmp_path):
    schema = "client_id long, master_id long, source string, updated_at timestamp, name string, email string, city string, nation_id int, segment string, balance double"
    none = (None,) * 9
    assert rewrite_drifted(spark.createDataFrame([], schema), f"file://{tmp_path}/a").collect() == []
    rows = [(None, *none), (None, *none), (5, *none), (5, *none), (5, 1, *none[1:]), (7, *none[:8], float("nan"))]
    found = rewrite_drifted(spark.createDataFrame(rows, schema), f"file://{tmp_path}/b", files=1).collect()
    files = {r.file_no: r for r in found}
    assert list(files) == [0] and files[0].n_rows == 6
    order = sorted([5, 5, 5, 7], key=lambda i: (zlib.crc32(str(i).encode()), i))
    assert found[0].ids_sha256 == sha(",".join(map(str, order)) + ",?,?")


def test_versions_and_layouts():
    columns = evolved()
    assert [c.name for c in drifted(columns, 0)] == list(COLUMNS)
    assert [(c.name, c.id) for c in drifted(columns, 3)][-2:] == [("source", 3), ("master_id", 2)]
    assert {c.id: c.name for c in drifted(columns, 1)}[5] == "email"
    assert {str(c.type) for c in drifted(columns, 12)} == {"int64", "string", "timestamp[us]", "float"}
    assert all(0 <= version_of(i) <= 15 for i in range(1000))


def test_ranks_are_exact(spark):
    ids = list(range(5000))
    for bits in (1, 14):
        ranked, n = exact_ranks(spark.createDataFrame([(i,) for i in ids], "id long").repartition(5), "id", bits)
        want = sorted(ids, key=lambda i: (zlib.crc32(str(i).encode()), i))
        assert n == 5000 and {r.rank: r.row.id for r in ranked.collect()} == dict(enumerate(want))


# --- op 13


def brute_audit(rows, least=3, ranks=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    n, df, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        terms = Counter(terms_of(text))
        n[lang, source].update(terms)
        df[lang].update(terms.keys())
        sources[lang].add(source)
    order = cmp_to_key(lambda a, b: (b[1] > a[1]) - (b[1] < a[1]) or (a[0].encode() > b[0].encode()) - (a[0].encode() < b[0].encode()))
    out = []
    for lang, names in sources.items():
        kept = [t for t, k in df[lang].items() if k >= least]
        share = lambda count, total, v=len(kept): 1 + 1_000_000_000 * (count + 1) // (total + v)
        total = {s: sum(n[lang, s][t] for t in kept) for s in names}
        p = {s: {t: share(n[lang, s][t], total[s]) for t in kept} for s in names}
        q = {t: share(sum(n[lang, s][t] for s in names), sum(total.values())) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in names:
            pairs = sorted(((o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in names if o != s), key=order)
            terms = sorted(((t.decode(), f(p[s][t], q[t])) for t in kept if n[lang, s][t] and p[s][t] > q[t]), key=order)[:ranks]
            out += [(lang, s, part, item, value, i) for part, found in (("pair", pairs), ("term", terms)) for i, (item, value) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["Éa", "éa", "THE", "the", "İx", "a1b", "don't", "日本", "\x7fz", "q_r"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["x", "y", "Z", "é", None, ""]), " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for _ in range(120)]
    rows += [("lone", "only", "a b c a"), ("dry", "p", None), ("dry", "q", "12 34"), ("dry", "r", "once here"), ("en", "mute", ""), ("en", "long", "the w " * 50_000)] + [("en", "x", "same same")] * 4
    rows = [(*r, i) for i, r in enumerate(rows)]
    df = clashing(spark, rows, "lang string, source string, text string, doc_id long")
    found = audit_sources(df, ranks=7, shard_bytes=200).collect()
    assert sorted(map(tuple, found)) == brute_audit([r[:3] for r in rows], ranks=7)


def test_divergence_of_empty_table(spark):
    assert audit_sources(spark.createDataFrame([], "lang string, source string, text string")).collect() == []
