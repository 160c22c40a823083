"""Toxicity grades (op 7) by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
import zlib
from collections import Counter, deque
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._rows import bound_batches, carried, carried_type, row_of, text_of
from graphloom.plans.materialize import discard, materialize

_WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str) -> Counter:
    """Sparse features of a text: its words, and the four- and five-letter beginnings of longer words."""
    words = Counter(_WORD.findall(text.lower()))
    out = Counter()
    for w, n in words.items():
        out[w] += n
        for k in (4, 5):
            if len(w) > k:
                out[w[:k] + "*"] += n
    return out


def _squash(n: int | np.ndarray):
    return np.log2(1 + n)


class Sample(Sequence):
    """Rows of (features, grade) that are held as numbers; a row's counter is made when it is looked at.

    A name is kept once for all rows, and a feature of a row takes eight bytes (counters: some 150 with their strings).
    """

    def __init__(self, rows: Iterable[tuple[Iterable[str], Iterable[int], int]] = ()):
        self.names: dict[str, int] = {}
        self.rows: list[tuple[np.ndarray, np.ndarray, int]] = []
        for names, counts, y in rows:
            at = [self.names.setdefault(x, len(self.names)) for x in names]
            self.rows.append((np.array(at, np.int32), np.array(counts, np.uint32), y))
        self._named = list(self.names)

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i):
        if isinstance(i, slice):
            return self.take(range(len(self))[i])
        at, counts, y = self.rows[i]
        return Counter(dict(zip([self._named[k] for k in at.tolist()], counts.tolist(), strict=True))), y

    def take(self, order: Iterable[int]) -> Sample:
        """The rows of these numbers, in this order."""
        out = Sample()
        out.names, out._named, out.rows = self.names, self._named, [self.rows[i] for i in order]
        return out


@dataclass
class OrdinalModel:
    """P(grade > k) = logistic(w . x - threshold_k), with one weight vector for all ordered thresholds."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def score(self, features: Counter) -> float:
        get = self.weights.get
        return float(sum(get(f, 0.0) * _squash(n) for f, n in features.items() if f in self.weights))

    def above(self, score: float) -> np.ndarray:
        return 1 / (1 + np.exp(-(score - self.thresholds)))

    def expected(self, score: float) -> float:
        """Expected severity: the sum over thresholds of the chance to be above."""
        return float(self.above(score).sum())

    def grade(self, score: float) -> int:
        """The number of thresholds that the text is more likely than not to be above."""
        return int((score > self.thresholds).sum())


def _select(rows: Sequence[tuple[Counter, int]], most: int, least_seen: int, odds: float, z: float) -> list[str]:
    """Features that toxic rows hold ``odds`` times as often as others, with a significance of ``z`` standard errors."""
    bad, good = Counter(), Counter()
    n_bad = n_good = 0
    for x, y in rows:
        n_bad, n_good = n_bad + (y > 0), n_good + (y == 0)
        (bad if y else good).update(x.keys())
    scored = []
    for f, n in bad.items():
        p, q, both = n / n_bad, good[f] / n_good, (n + good[f]) / (n_bad + n_good)
        error = np.sqrt(both * (1 - both) * (1 / n_bad + 1 / n_good)) + 1e-12
        if n + good[f] >= least_seen and (n + 0.5) / (n_bad + 1) > odds * (good[f] + 0.5) / (n_good + 1) and p - q > z * error:
            scored.append(((q - p) / error, f))
    return [f for _, f in sorted(scored)[:most]]


def distinct_rows(rows: Sequence[tuple[Counter, int]]) -> Sequence[tuple[Counter, int]]:
    """Rows without near copies of an earlier one, which would pass off their own words as signs of their class.

    A near copy shares half of six minima over the longer words with one earlier row.
    """
    holders: dict[tuple[int, int], list[int]] = {}
    out = []
    for at, (x, _) in enumerate(rows):
        words = [w.encode() for w in x if len(w) > 5] or [w.encode() for w in x]
        marks = [(i, min(zlib.crc32(w, i * 0x9E3779B1) for w in words)) for i in range(1, 7)] if words else []
        shared = Counter(h for m in marks for h in holders.get(m, ()))
        if max(shared.values(), default=0) < 3:
            out.append(at)
            for m in marks:
                holders.setdefault(m, []).append(at)
    return rows.take(out) if isinstance(rows, Sample) else [rows[at] for at in out]


class Likelihood:
    """The penalized cumulative-link loss of weights and thresholds over rows of (features, grade).

    Parameters are the weights, the first threshold, and the logarithms of the gaps to the next ones, so the order
    of thresholds holds by construction.  Clean and other rows weigh the same in sum.
    """

    def __init__(self, rows: Sequence[tuple[Counter, int]], vocabulary: list[str], grades: int, decay: float):
        at = {f: i for i, f in enumerate(vocabulary)}
        cells = [(r, at[f], _squash(n)) for r, (x, _) in enumerate(rows) for f, n in x.items() if f in at]
        self.row, self.column = (np.array([c[i] for c in cells], np.int64) for i in (0, 1))
        self.value = np.array([c[2] for c in cells], float)
        self.size, self.k, self.rows, self.decay = len(vocabulary), grades - 1, len(rows), decay
        y = np.array([y for _, y in rows])
        over, own = np.arange(self.k)[None, :] == y[:, None] - 1, np.arange(self.k)[None, :] == y[:, None]
        weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
        #: of each row, the threshold that it is over and the one that it is not
        self.over, self.under = over * weight[:, None], own * weight[:, None]
        #: weights in sum of the grades between two thresholds
        self.between = np.bincount(y, weight, grades)[1 : self.k]

    def thresholds(self, theta: np.ndarray) -> np.ndarray:
        cut = theta[self.size :]
        return cut[0] + np.concatenate([[0.0], np.cumsum(np.exp(cut[1:]))])

    def at(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """(loss, gradient): minus the weighted logarithms of P(y = k) = logistic(w . x - t_k-1) - logistic(w . x - t_k).

        The difference is the product of being over the one, not over the other, and 1 - exp(t_k-1 - t_k), so its
        logarithm is a sum that does not cancel.
        """
        w, cut = theta[: self.size], self.thresholds(theta)
        margin = np.bincount(self.row, self.value * w[self.column], self.rows)[:, None] - cut
        held = self.between > 0
        gap = np.diff(cut)[held]
        loss = (self.over * np.logaddexp(0, -margin) + self.under * np.logaddexp(0, margin)).sum() + 0.5 * self.decay * (w @ w)
        loss -= (self.between[held] * np.log(-np.expm1(-gap))).sum()
        g = self.under * np.exp(-np.logaddexp(0, -margin)) - self.over * np.exp(-np.logaddexp(0, margin))
        grad = np.empty_like(theta)
        grad[: self.size] = np.bincount(self.column, self.value * g.sum(1)[self.row], self.size) + self.decay * w
        push = np.zeros(self.k - 1)
        push[held] = self.between[held] / np.expm1(gap)
        back = -g.sum(0) + np.append(push, 0) - np.append(0, push)
        grad[self.size] = back.sum()
        grad[self.size + 1 :] = [np.exp(theta[self.size + 1 + i]) * back[i + 1 :].sum() for i in range(self.k - 1)]
        return float(loss), grad


def minimize(loss: Likelihood, theta: np.ndarray, steps: int, tolerance: float, memory: int = 10) -> np.ndarray:
    """Least loss with weights that are not negative, by projected quasi-Newton steps from ``theta``.

    Ends when no component of the gradient that may be followed exceeds ``tolerance``, when no step lowers the loss
    any more, or after ``steps``.
    """
    value, grad = loss.at(theta)
    pairs: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=memory)
    for _ in range(steps):
        fixed = np.zeros(len(theta), bool)
        fixed[: loss.size] = (theta[: loss.size] <= 0) & (grad[: loss.size] > 0)
        free = np.where(fixed, 0.0, grad)
        if np.abs(free).max() <= tolerance:
            break
        way, taken = -free, []
        for s, y in reversed(pairs):
            taken.append((s @ way) / (s @ y))
            way = way - taken[-1] * y
        if pairs:
            s, y = pairs[-1]
            way = way * ((s @ y) / (y @ y))
        for (s, y), a in zip(pairs, reversed(taken), strict=True):
            way = way + (a - (y @ way) / (s @ y)) * s
        way[fixed] = 0
        if way @ free >= 0:
            way = -free
            pairs.clear()
        size = 1.0
        while True:
            new = theta + size * way
            new[: loss.size] = np.maximum(new[: loss.size], 0)
            with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
                new_value, new_grad = loss.at(new)
            if new_value <= value + 1e-4 * (grad @ (new - theta)):
                break
            size /= 2
            if size < 1e-10:
                return theta
        s, y = new - theta, new_grad - grad
        if s @ y > 1e-10 * (y @ y):
            pairs.append((s, y))
        theta, value, grad = new, new_value, new_grad
    return theta


def fit(rows: Sequence[tuple[Counter, int]], most_features: int = 2000, least_seen: int = 3, odds: float = 8.0, z: float = 5.0, steps: int = 1000, tolerance: float = 1e-6, decay: float = 1e-4) -> OrdinalModel:
    """Fit weights and ordered thresholds to the greatest penalized cumulative-link likelihood (see ``minimize``).

    ``rows`` are (features, grade), grades 0 .. K as the labels give them; there is a threshold between each two
    neighbouring grades, so labels of 0 and 1 have one.  Features are those that rows of a grade over 0 hold more
    often, so weights are kept from going negative.  Rows that are all clean, or none of them, give a model that
    grades everything alike.
    """
    rows = distinct_rows(rows)
    found = [y for _, y in rows]
    grades, toxic = max(found, default=1) + 1, [y > 0 for y in found]
    if not any(toxic) or all(toxic):
        return OrdinalModel({}, np.full(max(1, grades - 1), -30.0 if any(toxic) else 30.0))
    vocabulary = _select(rows, most_features, least_seen, odds, z)
    loss = Likelihood(rows, vocabulary, grades, decay)
    theta = np.zeros(len(vocabulary) + grades - 1)
    theta[len(vocabulary)] = 2.0
    theta = minimize(loss, theta, steps, tolerance)
    return OrdinalModel({f: float(x) for f, x in zip(vocabulary, theta, strict=False) if x}, loss.thresholds(theta))


def labelled_sample(docs: DataFrame, labels: DataFrame, most_each: int = 1500, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Sequence[tuple[Counter, int]]:
    """At most ``most_each`` labelled rows of each grade, those with the least hashes of their ids, as features.

    The sample is the only thing that is bounded, and it is bounded in rows: texts of any length take part in full.
    Their features are counted where they lie, in one pass for all grades, and only the counts come to the driver,
    which holds them as numbers (see ``Sample``).

    Rows with a null id, text or label, or a negative one, are left out.  Of several labels of an id the largest
    counts.  Repeated rows count once; rows that share an id with different texts are rows of their own.
    """
    bound_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).cast("int").alias("y")).where("_id is not null and y >= 0").groupBy("_id").agg(F.max("y").alias("y"))
    named = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("twin")).where("text is not null")
    rows = materialize(named.select("_doc", "twin").join(known, F.col("_doc") == F.col("_id")).select("_id", "twin", "y").distinct(), "labelled")
    grades = sorted(r["y"] for r in rows.select("y").distinct().collect())
    chosen = None
    for y in grades:
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id", "twin").limit(most_each)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return []
    chosen = materialize(chosen, "chosen")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features_of(t) for t in batch["text"].to_pylist()]
            names, counts = pa.array([list(x) for x in found], pa.list_(pa.string())), pa.array([list(x.values()) for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["twin"], batch["y"], names, counts], names=["_id", "twin", "y", "names", "counts"])

    kind = chosen.schema["_id"].dataType.simpleString()
    texts = named.join(F.broadcast(chosen.withColumnRenamed("twin", "_twin")), (F.col("_doc") == F.col("_id")) & (F.col("twin") == F.col("_twin"))).select("_id", "twin", "y", "text")
    counted = texts.mapInArrow(count, f"_id {kind}, twin long, y int, names array<string>, counts array<long>").dropDuplicates(["_id", "twin"])
    order: list[tuple] = []

    def taken() -> Iterator[tuple[list[str], list[int], int]]:
        for r in counted.toLocalIterator():
            order.append((r["y"], zlib.crc32(str(r["_id"]).encode()), str(r["_id"]), r["twin"], len(order)))
            yield r["names"], r["counts"], r["y"]

    got = Sample(taken())
    discard(rows)
    discard(chosen)
    return got.take(at for *_, at in sorted(order)) if order else []


def grade_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, grade, severity, toxic`` for every row: the grade, its expectation, and whether the grade is over 0.

    Columns named in ``carry`` come along in a struct ``row``, so that a filter on the verdict needs no join.

    Whole texts are scored, of any length.  Null and empty texts have no features and get the model's score of an
    empty text, which is grade 0 unless all training rows were toxic.  Repeated rows and ids are scored each for
    itself; other columns are not read; an empty table gives no rows.
    """
    weights, thresholds = model.weights, model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = OrdinalModel(weights, thresholds)
        whole = {f: w for f, w in weights.items() if not f.endswith("*")}
        heads = {f[:-1]: w for f, w in weights.items() if f.endswith("*")}
        seen: dict[str, tuple[str, ...]] = {}

        def hits(word: str) -> tuple[str, ...]:
            out = (word,) if word in whole else ()
            return out + tuple(word[:k] + "*" for k in (4, 5) if len(word) > k and word[:k] in heads)

        for batch in batches:
            grades, severities = [], []
            for text in text_of(batch, text_col):
                found: Counter = Counter()
                for word in _WORD.findall((text.as_py() or "").lower()):
                    f = seen.get(word)
                    if f is None:
                        if len(seen) > 50_000:
                            seen.clear()
                        f = seen[word] = hits(word)
                    for x in f:
                        found[x] += 1
                score = scorer.score(found)
                grades.append(scorer.grade(score))
                severities.append(scorer.expected(score))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(grades, pa.int32()), pa.array(severities, pa.float64()), pa.array([g > 0 for g in grades], pa.bool_()), *row_of(batch)[0]], names=["doc_id", "grade", "severity", "toxic", *row_of(batch)[1]])

    bound_batches(docs.sparkSession)
    own = [] if text_col in carry else [F.col(text_col)]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), *own, *carried(carry))
    return base.mapInArrow(run, "doc_id long, grade int, severity double, toxic boolean" + carried_type(base))
