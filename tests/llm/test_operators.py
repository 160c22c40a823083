"""Ops 1, 2, 6, 7, 8, 9 and 10, and the pipeline, against brute force, libraries and round trips."""

import base64
import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from graphloom.llm import queries as Q
from graphloom.llm.ngram_leaks import find_leaks, original_offsets, remove_leaks, words_of
from graphloom.llm.source_mix import golden_sources, mix_sources, texts_taken, water_fill, words_taken
from graphloom.llm.token_counts import PrefixBpe, PrefixCounts, count_tokens, prefix_counts, truncate_to_budget
from graphloom.llm.toxicity import Likelihood, distinct_rows, features_of, fit, grade_toxicity, labelled_sample
from graphloom.llm.url_rules import Rule, filter_urls, index_rules, parse_rule
from graphloom.llm.vector_links import later_cells, link_vectors, paying_axes
from graphloom.llm.warc_zstd import archive_folder, read_archives, write_archives

CLASH = ", row string, n_words string, spans string, size string"


def frame(spark, rows, schema):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], schema + CLASH).repartition(3)


# --- op 1


def brute_leaks(docs, items, width):
    windows = defaultdict(set)
    for item, text in items:
        w = words_of((text or "").encode())
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add(str(item))
    out = []
    for d, text in docs:
        w = words_of((text or "").encode())
        hit, names = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    names |= windows[tuple(w[i : i + n])]
        out.append((d, len(w), len(hit), sorted(names)))
    return out


@pytest.mark.parametrize("most_words", [200_000, 30])
def test_leaks(spark, most_words):
    r = random.Random(1)
    word = lambda: r.choice(["Aa", "b", "ça", "d9", "é", "zz"])
    items = [(i, ", ".join(word() for _ in range(r.randint(0, 18)))) for i in range(12)] + [(12, None), (13, "zz zz"), (13, "zz zz")]
    docs = [(i, r.choice([" ", "; "]).join([word() for _ in range(r.randint(0, 60))])) for i in range(40)] + [(50, None), (51, ""), (3, "zz ZZ!"), (3, "zz ZZ!")]
    docs += [(60, "pre " + items[5][1].upper() + " post")]
    docs += [(70, "filler, " * 60_000 + items[5][1])]
    items += [(20, " ".join(f"long{i}" for i in range(90))), (21, "one two")]
    docs += [(71, " ".join(f"long{i}" for i in range(20, 70))), (72, "x Long29 long30 long31 LONG32 y"), (73, "— one — two — one")]
    got = find_leaks(frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string"), width=4, most_words=most_words).collect()
    texts = defaultdict(list)
    for d, t in docs:
        texts[d].append((t or "").encode())
    for x in got:
        for text in texts[x.doc_id]:
            if len(words_of(text)) == x.n_words and len(texts[x.doc_id]) == 1:
                assert [words_of(text[b["first"] : b["last"]]) for b in x.bytes] == [words_of(text)[s["first"] : s["last"]] for s in x.spans]
                assert len(words_of(remove_leaks(text, [(b["first"], b["last"]) for b in x.bytes]))) == x.n_words - sum(s["last"] - s["first"] for s in x.spans)
    assert sorted((x.doc_id, x.n_words, sum(s["last"] - s["first"] for s in x.spans), list(x["items"])) for x in got) == sorted(brute_leaks(docs, items, 4))


def test_leak_offsets():
    text = "Ein — Wort, und ÑOCH eins".encode()
    spans = original_offsets(text, [(1, 3)])
    a, b = spans[0]
    assert words_of(text[a:b]) == words_of(text)[1:3]
    assert words_of(remove_leaks(text, spans)) == words_of(text)[:1] + words_of(text)[3:]


def test_leaks_of_nothing(spark):
    docs = frame(spark, [(1, "a b")], "doc_id long, text string")
    none = frame(spark, [], "item_id long, text string")
    assert [(r.doc_id, r.n_words, r.spans) for r in find_leaks(docs, none).collect()] == [(1, 2, [])]
    assert find_leaks(docs.limit(0), frame(spark, [(1, "a")], "item_id long, text string")).collect() == []


# --- op 2


def test_token_counts(spark, sf):
    from tokenizers import Tokenizer

    path = Q.tokenizer_file()
    library = Tokenizer.from_file(path)
    texts = pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()[:150]
    texts += ["", None, "don't I'LL 12½", "x<|endoftext|>y <|startoftext|>", "İß ΑΣ", "日本語 🙂👍🏽", "a" * 3000, "\x00\x85\u200b"]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(frame(spark, rows, "doc_id long, text string"), path, limit=100).collect()}
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 100)


def test_prefix_counts(spark):
    from tokenizers import Tokenizer

    path = Q.tokenizer_file()
    library, bpe = Tokenizer.from_file(path), PrefixBpe(path)
    text = "unbelievably tokenized straße isn't it? 3.14 naïve"
    stored = PrefixCounts(*bpe.prefix_table(text))
    count = lambda k: len(library.encode(text[:k], add_special_tokens=False).ids)
    assert [stored.tokens_before(k) for k in range(len(text) + 1)] == [count(k) for k in range(len(text) + 1)]
    for budget in (0, 3, 7, 100):
        cut = stored.longest_within(budget)
        assert count(cut) <= budget and (cut >= len(text.rstrip()) or all(count(k) > budget for k in range(cut + 1, len(text) + 1) if text[k - 1] != " "))
    docs = frame(spark, [(1, text), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in truncate_to_budget(docs, path, 7).collect()} == {1: count(len(text)), 2: 0}
    assert prefix_counts(docs.limit(0), path).collect() == []


def test_prefixes_of_odd_texts(spark):
    import regex
    from tokenizers import Tokenizer

    path = Q.tokenizer_file()
    library, bpe = Tokenizer.from_file(path), PrefixBpe(path)
    rnd = random.Random(5)
    parts = ["a", "E", "the ", "unbeliev", "'", "'re", "'ll", " ", "\n", "?!", "12", "e\u0301", "\u00e9", "\u0130", "\u03a3", "\u1112\u1161\u11ab", "\u0301", "<|endoftext|>", "<|", "\u65e5\u672c", "\U0001f44d\U0001f3fd", "\x85", "\u092e\u0938\u094d\u0924\u0947", "=\u0338"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 12))) for _ in range(300)]
    wanted = {}
    for i, text in enumerate(texts):
        # a cut never falls between a character and its marks
        places = [0, *(m.end() for m in regex.finditer(r".[\p{M}\u1160-\u11FF]*", text, regex.DOTALL))]
        want = {k: len(library.encode(text[:k], add_special_tokens=False).ids) for k in places}
        stored = PrefixCounts(*bpe.prefix_table(text))
        assert {k: stored.tokens_before(k) for k in places} == want, text
        cut = stored.longest_within(4)
        assert want[cut] <= 4 and all(want[k] > 4 or not text[cut:k].strip(" \n\x85") for k in places if k > cut), text
        wanted[i] = (want[len(text)], cut)
        assert bpe.fit(text, 4) == wanted[i]
    long = "".join(rnd.choices(parts, k=4000))
    stored = PrefixCounts(*bpe.prefix_table(long))
    for budget in (0, 100, 1000, 5000, 10**6):
        assert bpe.fit(long, budget) == (stored.counts[-1], stored.longest_within(budget))
    # words that go on and on: only as much of their prefixes is looked into as can be within the budget
    r = random.Random(4)
    for word in ("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=4000)), "a" * 3000, "".join(r.choices("etaoin\u00e9\u4e2d", k=1500))):
        stored = PrefixCounts(*bpe.prefix_table(word))
        for budget in (1, 7, 100, 400):
            assert bpe.fit(word, budget) == (stored.counts[-1], stored.longest_within(budget))
        assert len(bpe.word_prefixes(word, 20)) < len(word) / 2 and bpe.word_prefixes(word, 20) == bpe.word_prefixes(word)[: len(bpe.word_prefixes(word, 20))]
    docs = frame(spark, [*enumerate(texts), (-1, None), (-2, "again and again and again"), (-2, "again and again and again")], "doc_id long, text string")
    counted = count_tokens(docs, path, limit=4).collect()
    assert {r.doc_id: (r.n_tokens, r.fit_chars) for r in counted if r.doc_id >= 0} == wanted
    assert sorted((r.doc_id, r.n_tokens, r.fit_chars) for r in counted if r.doc_id < 0) == [(-2, 5, 19), (-2, 5, 15 + 4), (-1, 0, 0)]
    assert {r.doc_id: (r.n_tokens, r.cut) for r in truncate_to_budget(docs, path, 4).collect() if r.doc_id >= 0} == wanted
    assert count_tokens(docs.limit(0), path).collect() == []


# --- op 6


def plain_verdict(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:end], rest[end:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = rest[: min([rest.index(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.name), len(r.host), r.verdict), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


@pytest.mark.parametrize("most_inline", [512, 0])
def test_urls(spark, most_inline):
    rules = [parse_rule(v, r) for v, r in Q.URL_RULES] + [parse_rule("block", "a+b.net/x.y/"), parse_rule("allow", "net/x.y/z")]
    urls = [None, "", "no scheme", "http://", "http://ORG", "http://Org/", "https://m.example.org/es/1?x", "https://example.org/en/12#t", "https://example.org/en/2", "http://xexample.org/es/", "http://a.com/de/x", "http://a.com/fr/x", "http://a.com/De/"]
    urls += ["ftp://a+b.net/x.y/q", "ftp://aab.net/x.y/z1", "http://a.net/xqy/z", "x://a.org?/en/", "x://u#/://b.com/de/", "http://É.org/ü/" + "a" * 5000, "http://a.com/de/", "http://a.com/de/"]
    got = filter_urls(frame(spark, list(enumerate(urls)), "page_id long, url string"), rules, most_inline=most_inline).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: plain_verdict(u, rules) for i, u in enumerate(urls)}


def test_rule_index():
    index = index_rules([parse_rule("allow", "org/"), parse_rule("block", "example.org/es/")])
    assert {t: [r.name for r in x] for t, x in index.items()} == {"h:org": ["org/"], "h:example": ["example.org/es/"]}
    assert Rule("a.b", "/c/d", "block").tokens() == ["h:a", "h:b", "p:c"]


# --- op 7


def test_toxicity_held_out(spark):
    r = random.Random(3)
    common, bad = ["".join(r.choices("abcdefgh", k=7)) for _ in range(5000)], ["nasty", "vile", "awful"]

    def text(toxic):
        w = r.choices(common, k=r.randint(20, 200))
        for _ in range(r.randint(1, 6) if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(bad))
        return " ".join(w)

    model = fit([(features_of(text(y)), y) for y in [0, 1] * 200])
    assert len(model.thresholds) == 1
    held = [(i, text(i % 2)) for i in range(200)] + [(1000, None), (1001, ""), (1002, "clean " * 300_000 + "nasty vile awful"), (3, "nasty vile awful"), (3, "nasty vile awful")]
    rows = grade_toxicity(frame(spark, held, "doc_id long, text string"), model).collect()
    assert len(rows) == len(held) and sum(x.toxic for x in rows if x.doc_id == 3) >= 2
    got = {x.doc_id: (x.toxic, x.severity) for x in rows}
    assert sum(got[i][0] == bool(i % 2) for i in range(200)) >= 196
    assert not got[1000][0] and not got[1001][0] and got[1002][0]
    assert np.mean([got[i][1] for i in range(1, 200, 2)]) > 0.8 > 0.2 > np.mean([got[i][1] for i in range(0, 200, 2)])
    assert model.score(features_of("nasty vile awful nasty")) > model.score(features_of("nasty"))
    only = fit([(features_of("a b"), 0)])
    assert not grade_toxicity(frame(spark, [(1, "x")], "doc_id long, text string"), only).head().toxic
    assert grade_toxicity(frame(spark, [], "doc_id long, text string"), model).collect() == []
    carried = grade_toxicity(frame(spark, [(1, "a")], "doc_id long, text string"), model, carry=("text", "row")).head()
    assert (carried.row.text, carried.row.row) == ("a", "a")


def test_ordinal_grades():
    """Four grades: ordered thresholds, one weight vector, grades that follow, and the loss of a plain optimiser."""
    r = random.Random(7)
    plain = ["".join(r.choices("abcdefgh", k=8)) for _ in range(3000)]
    words = {1: ["rude", "silly"], 2: ["nasty", "vile"], 3: ["savage", "brutal"]}

    def row(y):
        x = r.choices(plain, k=30)
        return features_of(" ".join(x + [w for k in range(1, y + 1) for w in words[k]])), y

    rows = [row(i % 4) for i in range(400)]
    model = fit(rows)
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    held = [row(i % 4) for i in range(200)]
    assert sum(model.grade(model.score(x)) == y for x, y in held) >= 190
    assert [round(model.expected(model.score(row(y)[0]))) for y in range(4)] == [0, 1, 2, 3]
    loss = Likelihood(rows, sorted(model.weights), 4, 1e-4)
    theta = np.concatenate([[model.weights[f] for f in sorted(model.weights)], [model.thresholds[0]], np.log(np.diff(model.thresholds))])
    at, grad = loss.at(theta)
    for i in range(0, len(theta), 3):
        step = np.zeros(len(theta))
        step[i] = 1e-6
        assert abs((loss.at(theta + step)[0] - loss.at(theta - step)[0]) / 2e-6 - grad[i]) < 1e-6
    # the likelihood as it is defined, and its plain projected descent over weights and thresholds themselves
    model, kept = fit(rows, decay=1e-2), distinct_rows(rows)
    vocabulary, y = sorted(model.weights), np.array([y for _, y in kept])
    x = np.array([[np.log2(1 + row[f]) for f in vocabulary] for row, _ in kept])
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y == 0).sum())

    def sides(w, t):
        above = 1 / (1 + np.exp(-((x @ w)[:, None] - t)))
        above = np.column_stack([np.ones(len(y)), above, np.zeros(len(y))])
        return above[np.arange(len(y)), y], above[np.arange(len(y)), y + 1]

    def value(w, t):
        p, q = sides(w, t)
        return -(weight * np.log(p - q)).sum() + 0.5e-2 * (w @ w)

    w, t = np.array([model.weights[f] for f in vocabulary]), model.thresholds
    best = value(w, t)
    assert abs(Likelihood(kept, vocabulary, 4, 1e-2).at(np.concatenate([w, t[:1], np.log(np.diff(t))]))[0] - best) < 1e-9
    w, t = np.zeros(len(w)), np.array([-1.0, 0.0, 1.0])
    for _ in range(30_000):
        p, q = sides(w, t)
        dp, dq = p * (1 - p), q * (1 - q)
        up = weight / (p - q)
        gw = -x.T @ (up * (dp - dq)) + 1e-2 * w
        gt = np.array([(up * (np.where(y == j + 1, dp, 0) - np.where(y == j, dq, 0))).sum() for j in range(3)])
        w, t = np.maximum(w - 0.05 * gw, 0), t - 0.05 * gt
    assert best <= value(w, t) + 1e-7 and value(w, t) < 1.01 * best


def test_two_grades_are_logistic_regression():
    """With labels of 0 and 1 the fit is the optimum of a logistic regression with weights that are not negative."""
    r = random.Random(8)
    plain, marks = ["".join(r.choices("abcdefgh", k=8)) for _ in range(500)], ["nasty", "vile", "awful"]
    rows = [(features_of(" ".join(r.choices(plain, k=20) + r.choices(marks, k=r.randint(1, 3)) * (r.random() < (0.9 if i % 2 else 0.05)))), i % 2) for i in range(300)]
    model, kept = fit(rows), distinct_rows(rows)
    vocabulary, y = sorted(model.weights), np.array([y for _, y in kept])
    x = np.array([[np.log2(1 + row[f]) for f in vocabulary] for row, _ in kept])
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y == 0).sum())
    w, t = np.zeros(len(vocabulary)), 0.0
    for _ in range(60_000):
        miss = weight * (1 / (1 + np.exp(-(x @ w - t))) - y)
        w, t = np.maximum(w - 0.2 * (x.T @ miss + 1e-4 * w), 0), t + 0.2 * miss.sum()
    assert np.abs(x @ w - t - (x @ np.array([model.weights[f] for f in vocabulary]) - model.thresholds[0])).max() < 0.05


def test_sample_is_small(spark):
    """The driver holds a labelled sample as numbers: names once, not once for each row."""
    import tracemalloc

    r, letters = random.Random(5), str.maketrans("0123456789", "abcdefghij")
    words = [f"word{k:05d}x".translate(letters) for k in range(3000)]
    docs = [(i, " ".join(r.choices(words, k=2000))) for i in range(120)]
    docs_, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    tracemalloc.start()
    got = labelled_sample(docs_, labels)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert {frozenset(x.items()) for x, _ in got} == {frozenset(features_of(t).items()) for _, t in docs}
    assert len(got) == 120 and [y for _, y in got] == [0] * 60 + [1] * 60
    assert held < 24 * sum(len(x) for x, _ in got), held
    whole, apart = fit(got, odds=0.1, z=-50), fit(list(got), odds=0.1, z=-50)
    assert whole.weights == apart.weights and (whole.thresholds == apart.thresholds).all()


def test_labelled_sample(spark):
    docs = [(i, f"text number{i} " * (1 if i else 30_000)) for i in range(30)] + [(None, "x y"), (40, None), (41, "twice"), (41, "twice"), (42, "one text"), (42, "other text")]
    labels = [(i, i % 3 == 0) for i in range(0, 30)] + [(0, False), (41, True), (42, False), (None, True), (40, True), (7, None), (99, True)]
    frame_ = spark.createDataFrame([(d, None if y is None else int(y)) for d, y in labels], "doc_id long, toxic int")
    got = labelled_sample(frame(spark, docs, "doc_id long, text string"), frame_)
    want = [(features_of(t), int(i % 3 == 0)) for i, t in docs[:30]] + [(features_of("twice"), 1), (features_of("one text"), 0), (features_of("other text"), 0)]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) or sorted((sorted(x.items()), y) for x, y in got) == sorted((sorted(x.items()), y) for x, y in want)
    assert [y for _, y in labelled_sample(frame(spark, docs, "doc_id long, text string"), frame_, most_each=4)] == [0] * 4 + [1] * 4
    assert labelled_sample(frame(spark, docs, "doc_id long, text string"), frame_.limit(0)) == []
    assert labelled_sample(frame(spark, [], "doc_id long, text string"), frame_) == []


# --- op 8


def brute_vectors(rows, cosine):
    ok = [lab is not None and v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) for _, v, lab in rows]
    root = {i: i for i, _, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    n = [0] * len(rows)
    for p in range(len(rows)):
        for q in range(p):
            if ok[p] and ok[q] and rows[p][2] == rows[q][2] and len(rows[p][1]) == len(rows[q][1]):
                a, b = np.array(rows[p][1], float), np.array(rows[q][1], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    n[p] += 1
                    n[q] += 1
                    x, y = top(rows[p][0]), top(rows[q][0])
                    root[max(x, y)] = min(x, y)
    return {i: (n[k], top(i), top(i) == i) for k, (i, _, _) in enumerate(rows)}


@pytest.mark.parametrize("tile", [2048, 7])
def test_vectors(spark, tile):
    g = np.random.default_rng(2)
    base = g.normal(size=(6, 12))
    rows = [(i, (base[i % 6] + 0.18 * g.normal(size=12)).tolist(), i % 2) for i in range(120)]
    rows += [(200, None, 1), (201, [0.0] * 12, 1), (202, [float("nan")] * 12, 1), (203, [1.0] * 11 + [float("inf")], 1), (204, [], 0), (205, rows[3][1], None), (206, rows[3][1], 1), (207, [2 * x for x in rows[3][1]], 1), (208, [1.0, 0.0], 1), (209, [1.0, 0.01], 1)]
    got = link_vectors(frame(spark, rows, "vec_id long, embedding array<double>, label int"), cosine=0.93, tile=tile).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_vectors(rows, 0.93)
    assert link_vectors(frame(spark, [], "vec_id long, embedding array<double>, label int")).collect() == []


def test_vectors_of_repeated_and_null_ids(spark):
    """Classes that share a least id count for themselves, and null ids do not join what nothing else joins."""
    e = np.eye(8)
    near = lambda k, d=0.02: (e[k] + d * e[7]).tolist()
    rows = [(5, e[0].tolist(), 1), (5, e[1].tolist(), 1), (6, near(0), 1), (7, near(0, 0.03), 1), (8, near(1), 1)]
    # id 9 is in the class of id 3 and in one of its own; and has a row of no use
    rows += [(3, e[2].tolist(), 1), (9, e[2].tolist(), 1), (9, e[3].tolist(), 1), (12, near(3), 1), (9, None, 1), (14, None, 1)]
    # null ids beside ids that have nothing to do with each other
    rows += [(None, e[4].tolist(), 1), (20, near(4), 1), (None, e[5].tolist(), 1), (21, near(5), 1), (None, e[4].tolist(), 2), (22, near(4), 2), (None, e[6].tolist(), 1), (None, near(6), 1)]
    got = link_vectors(frame(spark, rows, "vec_id long, embedding array<double>, label int")).collect()
    want = [(5, 2, 5), (5, 1, 5), (6, 2, 5), (7, 2, 5), (8, 1, 5), (3, 1, 3), (9, 1, 3), (9, 1, 3), (12, 1, 3), (9, 0, 3), (14, 0, 14)]
    want += [(None, 1, 20), (20, 1, 20), (None, 1, 21), (21, 1, 21), (None, 1, 22), (22, 1, 22), (None, 1, None), (None, 1, None)]
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == sorted(((*x, x[0] == x[2]) for x in want), key=repr)


def test_vectors_of_any_size(spark):
    """Squares that under- or overflow do not hide a link; labels may be text."""
    rows = [(i, v, "a b") for i, v in enumerate([[1e-200, 2e-200], [1e-200, 2.0001e-200], [1.0, 2.0], [1e200, 2e200], [5e-324, 1e-323], [1.7e308, -1.7e308]])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in link_vectors(frame(spark, rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {0: (4, 0), 1: (4, 0), 2: (4, 0), 3: (4, 0), 4: (4, 0), 5: (0, 5)}


@pytest.mark.parametrize("axes", [1, 2, 3, None])
def test_vectors_in_grids(spark, axes):
    """Floats, and coordinates of very different spread, in grids of one to three axes."""
    g = np.random.default_rng(4)
    spread = np.array([9.0, 7.0, 6.0, 5.0, 5.0, 4.0, 3.0, 3.0, 2.0, 2.0, 1.0, 1.0])
    base = g.normal(size=(40, 12)) * spread
    rows = [(i, (base[i % 40] + 0.5 * g.normal(size=12)).astype(np.float32).tolist(), i % 2) for i in range(240)]
    got = link_vectors(frame(spark, rows, "vec_id long, embedding array<float>, label int"), axes=axes).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_vectors(rows, 0.93)
    assert paying_axes(np.array([0.125] * 4), 0.187) == 1 and paying_axes(np.array([2.0, 1.0, 0.9, 0.8]), 0.2) == 3
    assert len(later_cells(2)) == 5 and later_cells(1) == [(0,), (1,)]


# --- op 9


def test_water_fill():
    assert water_fill([10, 100, 100], [3, 1, 2], 315, 2) == [20, pytest.approx(295 / 3), pytest.approx(590 / 3)]
    assert water_fill([5, 0], [1, 1], 7.5, 2) == [7.5, 0]
    share = np.bincount(golden_sources(0, 100_000, np.cumsum([0.5, 0.3, 0.2]))) / 100_000
    assert np.abs(share - [0.5, 0.3, 0.2]).max() < 2e-4


def test_mix(spark):
    r = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 300))), r.choice(["a", "b", "B", "ä", None])) for i in range(400)] + [(500, None, "a"), (501, "", "empty"), (1, "twice " * 50, "a"), (1, "twice " * 50, "a")]
    docs = frame(spark, rows, "doc_id long, text string, source string")
    got = words_taken(mix_sources(docs, per_bucket=20)).collect()
    assert sorted(x.doc_id for x in got) == sorted(i for i, _, _ in rows)
    assert all(0 <= x.taken <= 2 * x["size"] for x in got)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, water_fill([sizes[s] for s in names], [(3.0, 1.0, 2.0)[k % 3] for k in range(len(names))], 1.5 * sum(sizes.values()), 2)))
    taken = defaultdict(int)
    for x in got:
        taken[x.source_size, x.target] += x.taken
    assert sorted(taken.values()) == sorted(int(t) for t in want.values())
    again = words_taken(mix_sources(docs.repartition(7), per_bucket=20)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert words_taken(mix_sources(docs.limit(0))).collect() == []


def brute_mix(spark, rows, per_block, seed):
    """Words taken of each row of unique ids, by going through the schedule slot by slot.

    Only the order in which a source's documents are laid out is taken from Spark: its hash of id, size, text and seed.
    """
    sized = [(d, t, len((t or "").split())) for d, t, _ in rows]
    marks = spark.createDataFrame(sized, "doc_id long, text string, size long").selectExpr("doc_id", f"xxhash64(doc_id, size, xxhash64(text), {seed}) AS mark")
    mark = {r.doc_id: r.mark for r in marks.collect()}
    size = {d: len((t or "").split()) for d, t, _ in rows}
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    weight = [(3, 1, 2)[i % 3] for i in range(len(names))]
    own = [sum(size[d] for d, _, s in rows if s == name) for name in names]
    # the excess of sources at their cap goes to the others by weight, one source at a time
    target, capped = [0.0] * len(names), set()
    while True:
        left = 1.5 * sum(own) - sum(2 * own[i] for i in capped)
        free = [i for i in range(len(names)) if i not in capped]
        target = [2.0 * own[i] if i in capped else left * weight[i] / sum(weight[j] for j in free) for i in range(len(names))]
        over = [i for i in free if target[i] > 2 * own[i] + 1e-9]
        if not over:
            break
        capped.add(over[0])
    quota = [int(t) for t in target]
    line = []
    for name in names:
        order = sorted((d for d, _, s in rows if s == name and size[d]), key=lambda d: (mark[d], d))
        line.append([d for _ in range(2) for d in order for _ in range(size[d])])
    bounds = np.cumsum(np.array(target) / sum(target))
    need = [-(-q // per_block) for q in quota]
    got, taken = [0] * len(names), defaultdict(int)

    def take(i):
        if got[i] < need[i]:
            for d in line[i][got[i] * per_block : min((got[i] + 1) * per_block, quota[i])]:
                taken[d] += 1
        got[i] += 1

    for n in range(sum(need)):
        point = ((n * 0x9E3779B97F4A7C15) % 2**64 >> 11) / 2**53
        take(min(int(np.searchsorted(bounds, point, side="right")), len(names) - 1))
    for i in range(len(names)):
        while got[i] < need[i]:
            take(i)
    return [(d, size[d], own[names.index(s)], target[names.index(s)], taken[d]) for d, _, s in rows]


def test_mix_against_brute_force(spark):
    r = random.Random(15)
    rows = [(i, " ".join(f"w{r.randrange(99)}" for _ in range(r.randint(0, 90))), r.choices(["a", "b", "B", "ä", None, "tiny"], [9, 3, 3, 2, 2, 0.2])[0]) for i in range(300)]
    rows += [(400, None, "a"), (401, "", "tiny"), (402, "word " * 6000, "b")]
    docs = frame(spark, rows, "doc_id long, text string, source string")
    mix = mix_sources(docs, block_tokens=32, per_bucket=20)
    got = sorted(map(tuple, words_taken(mix).collect()))
    want = sorted(brute_mix(spark, rows, 32, 7))
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want]
    assert all(abs(x[3] - y[3]) < 1e-6 for x, y in zip(got, want))
    whole = {x.doc_id: x for x in texts_taken(mix, docs).collect()}
    text = {d: t for d, t, _ in rows}
    assert sorted(whole) == sorted(text)
    for d, x in whole.items():
        assert x.text == text[d] and sum(p["last"] - p["first"] for p in x.pieces) == x.taken and x.pieces == sorted(x.pieces)
        assert all(0 <= p["first"] < p["last"] <= x["size"] for p in x.pieces)


def test_mix_of_null_and_repeated_ids(spark):
    rows = [(None, "a b c", "x"), (None, "a b c", "x"), (None, "d e", "x"), (1, "f g", None), (1, "f g", None), (1, None, None)]
    docs = frame(spark, rows, "doc_id long, text string, source string")
    got = words_taken(mix_sources(docs)).collect()
    assert sorted((repr(x.doc_id), x["size"]) for x in got) == sorted((repr(d), len((t or "").split())) for d, t, _ in rows)
    assert all(x.taken <= 2 * x["size"] for x in got) and sum(x.taken for x in got) == sum(int(t) for t in {(x.source_size, x.target) for x in got} for t in t[1:])
    assert len(texts_taken(mix_sources(docs), docs).collect()) == len(rows)


# --- op 10


def test_archives(spark):
    rows = [(i, f"http://x/{i}\r\nX: y", f"<p>{i % 7}</p>" * (i % 5)) for i in range(60)] + [(100, None, None), (101, "u", ""), (None, "n", "<p>1</p>"), (None, "n", "alone"), (7, "http://x/7", "big" * 200_000)]
    folder = archive_folder(spark)
    archives = write_archives(frame(spark, rows, "page_id long, url string, html string"), folder, archive_bytes=4096, sample_bytes=2048)
    back = read_archives(archives, folder).collect()
    assert len(back) == len(rows) and archives.count() > 3
    top = defaultdict(lambda: None)
    for i, _, h in rows:
        top[h or ""] = i if top[h or ""] is None else max(top[h or ""], i if i is not None else -1)
    want = []
    for i, _, h in rows:
        body, best = (h or "").encode(), top[h or ""]
        revisit = best is not None and i != best
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", best if revisit else None, None if revisit else body))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in back]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    none = archive_folder(spark)
    assert read_archives(write_archives(spark.createDataFrame([], "page_id long, url string, html string"), none), none).collect() == []


# --- pipeline


def test_pipeline(spark, sf):
    from test_minhash import brute
    from test_substrings import brute_bytes

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    left = stage["toxicity"](spark, docs, sf)
    assert left.columns == docs.columns and 0 < left.count() < docs.count()
    rows = [(r.doc_id, r.text) for r in left.collect()]
    near = {r.doc_id for r in stage["minhash_dedup"](spark, left, sf).collect()}
    assert near == {d for d, _, c in brute(rows, 5, 80) if c == d}
    kept = left.where(left.doc_id.isin(sorted(near)))
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    cut = {r.doc_id: r.text for r in stage["suffix_array_dedup"](spark, kept, sf).collect()}
    want = {d: x[3].decode("utf-8", "ignore") for (d, t), x in zip(rows, brute_bytes([t for _, t in rows], 200))}
    assert cut == {d: t for d, t in want.items() if t or not dict(rows)[d]}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in stage["benchmark_decontamination"](spark, kept, sf).collect()}
    assert clean == {d for d, _, hit, _ in brute_leaks(rows, items, 10) if not hit}
    # the whole run, against the stages one after the other and the mixture by brute force
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(f(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = corpus_pipeline.run(spark, sf).collect()
    want = {d: (size, taken) for d, size, _, _, taken in brute_mix(spark, rows, 256, 7)}
    assert {r.doc_id: (r["size"], r.taken) for r in got} == want and {r.doc_id: r.text for r in got} == {d: t for d, t, _ in rows}


def test_near_copies_without_ids(spark, sf):
    a, b = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    rows = [(1, a), (None, a), (None, b), (None, b + " end"), (None, ""), (None, None), (2, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.minhash_dedup(spark, docs, sf).collect()), key=repr)
    assert len(got) == 5 and {(1, a), (None, ""), (None, None), (2, "")} < set(got) and (set(got) & {(None, b), (None, b + " end")})


@pytest.mark.parametrize("number", range(5))
def test_pipeline_stages_of_odd_rows(spark, sf, number):
    """Nulls in every column, empty and long texts, repeated rows, extra columns with the operators' names, no rows."""
    name, stage = corpus_pipeline.STAGES[number]
    long = " ".join(f"long{i}" for i in range(60_000))
    rows = [(1, "some plain words", "en", "a", 16), (1, "some plain words", "en", "a", 16), (None, "no id here", None, None, None), (2, None, "en", None, 0), (3, "", None, "b", None), (4, long, "en", "b", len(long)), (None, None, None, None, None), (5, " \n", "de", "", 2)]
    docs = spark.createDataFrame([(*r, "x", "y", "z", 7, "k") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, n_words string, kept string, component_id long, _kept string")
    got = stage(spark, docs, sf).collect()
    key = lambda r: (repr(r.doc_id), repr(r.text))
    want = {(repr(d), repr(t)): 0 for d, t, *_ in rows}
    if name == "suffix_array_dedup":
        assert {key(r) for r in got} == set(want)
    elif name == "minhash_dedup":
        assert {key(r) for r in got} == set(want)
    else:
        assert sorted(map(key, got)) == sorted((repr(d), repr(t)) for d, t, *_ in rows)
    assert stage(spark, docs.limit(0), sf).collect() == []
    assert stage(spark, docs.where("doc_id is null"), sf).count() == 2
