"""MinHash near-dedup (op 3): fast similarity sketches, banding, exact verification.

A sketch has t coordinates.  In round i < t every shingle is hashed to one bin, and an
empty bin keeps the least (round, hash) it meets; from round t on, round i throws all
shingles into bin i - t.  So every coordinate is filled after 2t rounds, usually after
about ln t / (n / t), and the number of equal coordinates is concentrated around
t times the Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._exchange import BLOCK, KeyPacker, repeated_key_counts
from graphloom.llm._hashing import U, hash_words, mix64
from graphloom.llm._rows import bound_batches
from graphloom.operators.components import connected_components
from graphloom.plans.materialize import discard, materialize, materialize_bucketed

_FULL = np.iinfo(np.uint64).max


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of ``width``-word shingles; a text of fewer words is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, U)
    h = hash_words(words)
    n = max(1, len(h) - width + 1)
    w = min(width, len(h))
    out = np.full(n, U(w), U)
    for k in range(w):
        out = mix64(out * U(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches of several non-empty sets, one row each."""
    rows = np.full((len(sets), t), _FULL, U)
    flat = rows.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.empty(0, U)
    for i in range(2 * t):
        h = mix64(items + U(((i + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF))
        bins = owner * t + ((h % U(t)).astype(np.int64) if i < t else i - t)
        # only bins that are still empty take part: what an earlier round found is smaller
        empty = flat[bins] == _FULL
        np.minimum.at(flat, bins[empty], (U(i) << U(52)) | (h[empty] >> U(12)))
        open_ = (rows == _FULL).any(1)
        if not open_.any():
            break
        keep = open_[owner]
        owner, items = owner[keep], items[keep]
    return rows


def band_keys(rows: np.ndarray, per_band: int) -> np.ndarray:
    """A 64-bit key for each band of ``per_band`` coordinates; the band's number is part of the key."""
    bands = rows.shape[1] // per_band
    out = np.tile(np.arange(1, bands + 1, dtype=U) * U(0xA0761D6478BD642F), (len(rows), 1))
    for k in range(per_band):
        out = mix64(out * U(0x9E3779B97F4A7C15) + rows[:, k : bands * per_band : per_band])
    return out


def _name(items: np.ndarray) -> tuple[int, int, int]:
    """(n, a, b) of a shingle set; equal for equal sets only, up to collisions of 128 bits."""
    if not len(items):
        return 0, 0, 0
    return len(items), int(np.bitwise_xor.reduce(items).view(np.int64)), int(mix64(items + U(1)).sum(dtype=U).view(np.int64))


def _features(width: int, t: int, bands_: int, per_band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch["text"].to_pylist(), batch["doc_id"]
            at = 0
            while at < len(texts):
                # groups of bounded total length, for sketches are made for many texts at once
                end, size = at, 0
                while end < len(texts) and (end == at or size < 1 << 20):
                    size += len(texts[end] or b"") + 512
                    end += 1
                sets = [shingle_set(x, width) for x in texts[at:end]]
                full = [i for i, s in enumerate(sets) if len(s)]
                rows = sketch([sets[i] for i in full], t)
                keys, low = band_keys(rows[:, : bands_ * per_band], per_band).view(np.int64), (mix64(rows) >> U(56)).astype(np.uint8)
                bands: list = [None] * len(sets)
                marks: list = [None] * len(sets)
                for i, k, m in zip(full, keys, low, strict=True):
                    bands[i], marks[i] = k, m.tobytes()
                n, a, b = zip(*map(_name, sets), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids[at:end], pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                    names=["doc_id", "n", "a", "b", "bands", "marks"],
                )
                at = end

    return run


def _near(n1, c1, n2, c2, similarity: int):
    """Whether a pair can have the similarity (in per cent), by set sizes ``n`` and how much of each set is shared at all, ``c``."""
    common = F.least(c1, c2)
    return common * 100 >= (n1 + n2 - common) * similarity


def least_equal(t: int, similarity: int) -> int:
    """Equal coordinates that a linked pair has at least, but for a chance of 3e-7 (5 standard deviations)."""
    p = similarity / 100
    return int(t * p - 5 * (t * p * (1 - p)) ** 0.5)


def _likely(pairs: DataFrame, marks: DataFrame, least: int) -> DataFrame:
    """Pairs whose sketches (a byte for each coordinate) are equal in at least ``least`` places."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("x", "y"))
                yield batch.select(["src", "dst"]).filter(pa.array((x == y).sum(1) >= least))

    x = marks.select(F.col("rep").alias("src"), F.col("marks").alias("x"))
    y = marks.select(F.col("rep").alias("dst"), F.col("marks").alias("y"))
    return pairs.join(x, "src").join(y, "dst").select("src", "dst", "x", "y").mapInArrow(check, "src long, dst long")


def _sets(wanted: DataFrame, docs: DataFrame, width: int, equal: DataFrame | None) -> DataFrame:
    """(id, items): full shingle sets of the classes in ``wanted``; ``equal`` has their names where ids repeat."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([shingle_set(x, width).tobytes() for x in batch["text"].to_pylist()], pa.binary())], names=["id", "items"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [shingle_set(x, width) for x in batch["text"].to_pylist()]
            n, a, b = zip(*map(_name, items), strict=True) if items else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([x.tobytes() for x in items], pa.binary())], names=["least", "n", "a", "b", "items"]
            )

    if equal is None:
        return docs.join(wanted.hint("merge"), docs["doc_id"] == wanted["id"], "left_semi").mapInArrow(sets, "id long, items binary")
    # an id may hold the texts of several classes, and a class the same text several times
    wanted = equal.join(wanted, F.col("rep") == F.col("id"), "left_semi")
    texts = docs.join(wanted.select("least").distinct().hint("merge"), F.col("doc_id") == F.col("least"), "left_semi").dropDuplicates(["doc_id", "text"])
    found = texts.mapInArrow(named, "least long, n long, a long, b long, items binary").join(wanted.hint("merge"), ["least", "n", "a", "b"])
    return found.select(F.col("rep").alias("id"), "items").dropDuplicates(["id"])


def _verify(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (src, dst) whose full shingle sets have the similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
                p, q = np.frombuffer(x, U), np.frombuffer(y, U)
                both = np.sort(np.concatenate([p, q]))
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= similarity * (len(p) + len(q) - common))
            yield batch.select(["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    x = sets.select(F.col("id").alias("src"), F.col("items").alias("x"))
    y = sets.select(F.col("id").alias("dst"), F.col("items").alias("y"))
    return pairs.join(x, "src").join(y, "dst").select("src", "dst", "x", "y").mapInArrow(check, "src long, dst long").distinct()


def _unsettled(members: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, size, mass, rep, n, c, part) of the buckets that hold more than one component; ``mass`` is the sum of their set sizes."""
    named = members.join(parts, F.col("rep") == F.col("id"), "left").select("key", "rep", "n", "c", F.coalesce("component", "rep").alias("part"))
    mixed = named.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("mass"), F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select(F.col("key").alias("_k"), "size", "mass")
    # merged, so that adaptive execution can split the partition of a large bucket
    return named.join(mixed.hint("merge"), F.col("key") == F.col("_k")).select("key", "size", "mass", "rep", "n", "c", "part")


def _star(members: DataFrame, order, similarity: int) -> DataFrame:
    """Pairs of each member with its bucket's first one (by ``order``) where that is in another component."""
    heads = members.groupBy("key").agg(F.min(F.struct(order.alias("o"), "rep", "n", "c", "part")).alias("head")).withColumnRenamed("key", "_k")
    met = members.join(heads.hint("merge"), F.col("key") == F.col("_k")).where((F.col("part") != F.col("head.part")) & _near(F.col("n"), F.col("c"), F.col("head.n"), F.col("head.c"), similarity))
    return met.select(F.greatest("rep", "head.rep").alias("src"), F.least("rep", "head.rep").alias("dst")).distinct()


def _shared_counts(ids: DataFrame, sets: DataFrame, keys_each: int = 2_000_000) -> DataFrame:
    """(owner, shared): how many of a document's shingles another one of ``ids`` (rep, n) has too; a task takes about ``keys_each`` of them."""
    buckets = max(1, -(-(ids.agg(F.sum("n")).head()[0] or 0) // keys_each))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = KeyPacker(buckets)
        for batch in batches:
            for i, items in zip(batch["id"].to_pylist(), batch["items"].to_pylist(), strict=True):
                yield from packer.add(i, np.unique(np.frombuffer(items, U)))
        yield from packer.flush()

    return repeated_key_counts(sets.join(ids, sets["id"] == F.col("rep"), "left_semi").mapInArrow(entries, BLOCK))


def _several(feats: DataFrame) -> DataFrame | None:
    """(doc_id) of the ids that several texts share; None where there are none."""
    own = feats.where("n > 0 and doc_id is not null")
    several = own.groupBy("doc_id").agg(F.min(F.struct("n", "a", "b")).alias("p"), F.max(F.struct("n", "a", "b")).alias("q")).where("p <> q").select("doc_id")
    several = materialize(several, "several")
    return several if several.head(1) else None


def _classes(feats: DataFrame, several: DataFrame | None) -> DataFrame:
    """(n, a, b, least, rep) of the classes of equal sets: their least id, and the vertex that stands for them.

    The vertex is the least id, but of classes with one least id only the first gets that; the others get a hash.
    """
    equal = feats.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("least")).where("least is not null")
    if several is None:
        # written, so that the last join's sides are exchanges of their own, which adaptive execution can split
        return materialize(equal.withColumn("rep", F.col("least")), "classes")
    first = equal.groupBy("least").agg(F.min(F.struct("n", "a", "b")).alias("first"))
    rep = F.when(F.struct("n", "a", "b") == F.col("first"), F.col("least")).otherwise(F.xxhash64("least", "n", "a", "b"))
    return materialize(equal.join(first, "least").select("n", "a", "b", "least", rep.alias("rep")), "classes")


def _versions(feats: DataFrame, several: DataFrame, equal: DataFrame) -> DataFrame:
    """Links of ids that several texts share to the classes of these texts."""
    own = feats.where("n > 0 and doc_id is not null")
    return materialize(own.join(several, "doc_id").join(equal, ["n", "a", "b"]).select(F.col("doc_id").alias("src"), F.col("rep").alias("dst")).distinct(), "versions")


def _settle(left: DataFrame, marks: DataFrame, sets: DataFrame, similarity: int, least: int, tile: int, tile_shingles: int = 1_000_000) -> DataFrame:
    """Links (src, dst) that join the components which meet in a bucket, verified on full sets.

    The sets travel with the members of a bucket, once for each tile they meet, and not once for each pair.  A pair
    is compared if its sketches allow the similarity and the links found so far in the bucket do not connect it; so
    what comes out of a bucket is a forest over its components.

    Buckets up to ``tile`` members and ``tile_shingles`` shingles are dealt whole, many to a task; larger ones are cut
    into tiles that meet pairwise.
    """
    deals = max(1 << 12, -(-(left.agg(F.sum("n")).head()[0] or 0) // tile_shingles))
    rows = left.join(marks, "rep").join(sets, F.col("rep") == F.col("id"))
    rows = rows.withColumn("tiles", F.ceil(F.greatest(F.col("size") / tile, F.col("mass") / tile_shingles)).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    t1, t2 = F.least("own", "with"), F.greatest("own", "with")
    # whole buckets share a deal; each pair of tiles of a larger one has a deal of its own
    deal = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("key"), F.lit(deals))).otherwise(F.xxhash64("key", t1, t2))
    rows = rows.select(deal.alias("deal"), "key", t1.alias("t1"), t2.alias("t2"), "own", "rep", "n", "c", "part", "marks", "bands", "items")

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("t1", "ascending"), ("t2", "ascending")])
        key, t1, t2, own, rep, n, c, part = (np.asarray(table[x]) for x in ("key", "t1", "t2", "own", "rep", "n", "c", "part"))
        mark = np.frombuffer(b"".join(table["marks"].to_pylist()), np.uint8).reshape(len(rep), -1)
        bands = np.array(table["bands"].to_pylist(), np.int64).reshape(len(rep), -1)
        items = [np.frombuffer(x.as_buffer(), U) for x in table["items"]]
        cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(t1) != 0) | (np.diff(t2) != 0)) + 1
        links = []
        for lo, hi in zip([0, *cut], [*cut, len(rep)], strict=True):
            joined = part[lo:hi].copy()
            for i in range(lo + 1, hi):
                most = np.minimum(c[lo:i], c[i])
                ok = (joined[: i - lo] != joined[i - lo]) & (100 * most >= similarity * (n[lo:i] + n[i] - most))
                if t1[i] != t2[i]:
                    ok &= own[lo:i] != own[i]
                j = lo + np.flatnonzero(ok)
                alike = (mark[j] == mark[i]).sum(1)
                j, alike = j[alike >= least], alike[alike >= least]
                if len(j):
                    # a pair that shares several buckets is compared in the first of them, the likeliest pairs first
                    first = bands[i][(bands[j] == bands[i]).argmax(1)] == key[i]
                    j = j[first][np.argsort(-alike[first], kind="stable")]
                for k in j:
                    here, there = joined[i - lo], joined[k - lo]
                    if here != there:
                        both = np.sort(np.concatenate([items[i], items[k]]))
                        common = int((both[1:] == both[:-1]).sum())
                        if 100 * common >= similarity * (n[i] + n[k] - common):
                            joined[joined == there] = here
                            links.append((max(rep[i], rep[k]), min(rep[i], rep[k])))
        src, dst = zip(*links) if links else ((), ())
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return rows.groupBy("deal").applyInArrow(meet, "src long, dst long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: int = 80, bands: int = 24, per_band: int = 4, coordinates: int = 192, rounds: int = 2, tile: int = 1024
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Documents are linked when 100 * |A & B| >= similarity * |A | B| for their sets of ``width``-word shingles
    (words are runs of bytes that are not ASCII white space, A-Z lower-cased; a text of fewer words is one
    shingle).  With 24 bands of 4 rows a pair of similarity 0.8 is a candidate with probability 1 - 3e-6.

    1. Rows with equal sets are one class; only its least id goes on.  Classes with one least id, which is then
       that of several texts, go on each for itself and are linked with that id.
    2. In each band's bucket, members are paired with one centre: first the least id, then, up to ``rounds``
       times in all, another one in buckets that still hold several components.  Large groups of copies are
       joined by as many pairs as members a round.
       After the first round a document in such a bucket counts how many of its shingles others there have at
       all; what it has alone is in no intersection, which rules out most pairs that only share a passage.
    3. What is left, buckets that hold several components, is compared tile against tile in memory; only links
       that join components are put out.
    Candidates are verified on full sets, after their sketches have been compared.  No step is capped.

    Null, empty and white-space texts have no shingles and are linked with nothing, and are kept.  Rows that
    repeat an id count as one document with several texts: what is linked with one of them is linked with the id.
    A null id counts as the largest; such rows are linked through others only.  Other columns are not read.  Long
    texts are read whole; a text and its set have to fit into a worker.  An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    least = least_equal(coordinates, similarity)
    feats = materialize(base.mapInArrow(_features(width, coordinates, bands, per_band), "doc_id long, n long, a long, b long, bands array<long>, marks binary"), "features")
    several = _several(feats)
    equal = _classes(feats, several)
    # the class's own row of its least id; rows repeated with that id are alike
    chosen = feats.join(equal.select("rep", F.col("least").alias("_least"), *[F.col(c).alias(f"_{c}") for c in "nab"]), (F.col("doc_id") == F.col("_least")) & (F.col("n") == F.col("_n")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
    marks = chosen.select("rep", "marks", "bands").dropDuplicates(["rep"])
    every = chosen.select("rep", "n", F.explode("bands").alias("key"))
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select(F.col("key").alias("_k"))
    members = materialize(every.join(shared.hint("merge"), F.col("key") == F.col("_k"), "left_semi"), "members")
    near = materialize(marks.join(members.select("rep").distinct(), "rep", "left_semi"), "marks")

    nothing = members.select(F.col("rep").alias("id"), F.col("rep").alias("component")).limit(0)
    parts, links, sets = nothing, None if several is None else _versions(feats, several, equal), None
    # tables that no plan reads once the components are known
    done = [members, near, several, links]

    def kept(df: DataFrame, name: str) -> DataFrame:
        done.append(materialize(df, name))
        return done[-1]

    members = members.withColumn("c", F.col("n"))
    left = members.select("key", "rep", "n", "c", F.col("rep").alias("part"))
    for k in range(rounds):
        pairs = kept(_likely(_star(left, F.col("rep") if k == 0 else F.xxhash64("rep", "key", F.lit(k)), similarity), near, least), "pairs")
        if sets is None:
            # bucketed by id, so that the verification of every round leaves the sets where they are
            sets = materialize_bucketed(_sets(near.select(F.col("rep").alias("id")), base, width, None if several is None else equal), "id", "sets")
        more = _verify(pairs, sets, similarity)
        links = kept(more if links is None else links.unionByName(more), "links")
        parts = connected_components(links)
        left = kept(_unsettled(members, parts), "unsettled")
        if not left.head(1):
            break
        for _ in range(2 if k == 0 else 0):
            # twice, for what only dropped documents shared is shared no more
            shared = kept(_shared_counts(left.select("rep", "n").distinct(), sets), "shared")
            members = left.join(shared, F.col("rep") == F.col("owner"), "left").select("key", "rep", "n", F.coalesce("shared", F.lit(0)).alias("c"))
            members = kept(members.where(_near(F.col("n"), F.col("c"), F.col("c"), F.col("c"), similarity)), "members")
            left = kept(_unsettled(members, parts), "unsettled")
    if left.head(1):
        discard(parts)
        links = kept(links.unionByName(_settle(left, near, sets, similarity, least, tile)), "links")
        parts = connected_components(links)

    discard(*done, sets)
    whole = equal.join(parts, F.col("rep") == F.col("id"), "left").select(F.col("n").alias("_n"), F.col("a").alias("_a"), F.col("b").alias("_b"), "least", F.coalesce("component", "rep").alias("component_id"))
    if several is not None:
        # a hash may be the least vertex of its component
        named = whole.groupBy("component_id").agg(F.min("least").alias("_least"))
        whole = whole.join(named, "component_id").select("_n", "_a", "_b", F.col("_least").alias("component_id"))
    out = feats.select("doc_id", "n", "a", "b").join(whole.hint("merge"), (F.col("n") == F.col("_n")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
