"""Toxicity by a classifier chain of linear models.

The categories are predicted one after the other. Each model is a logistic regression over the words of a text and over
the probabilities that the chain gives for the categories before; in training those are out-of-fold predictions, so that
a later model meets them as they will be, not as an earlier model remembers its own training rows.

What is counted is a word in lower case, its first four and its first five bytes (stems), and the last three bytes of what
white space separates; a feature is that one of these occurs once or more, twice or more, or three times or more. Features
are chosen by chi-square against each category, counted by Spark over the sample, and for each fold's model anew without
the rows of that fold. Positive and negative rows weigh alike, as positive ones are few. Training takes at most SAMPLE_DOCS
labelled documents (about, drawn by a hash of the id); their chosen features are gathered on the driver, where the
regressions take a minute or two. Every text is scored whole.

Defined results: null and empty texts have no features and get each model's base rate; labels that are null are left out
of their category's training; an id that is labelled twice is positive if any of its labels is; with no labelled rows of
either kind all probabilities are the share of positives (0 if there is none). Repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .hashing import _BYTE_BASE, _byte_values, _powers, Words, bytes_of, mix, slices

SAMPLE_DOCS = 8000
#: Features chosen for each category at most, and the chi-square that each needs.
MOST_FEATURES, LEAST_CHI2 = 2000, 30.0
FOLDS, STEPS = 3, 25
#: Penalties of squared weights; each category takes the one whose out-of-fold predictions are best.
RIDGES = (1.0, 0.1, 0.01)
THRESHOLD = 0.5
#: Numbers of occurrences that are told apart; a feature's last two bits say which it is.
LEVELS = 3
_FILTER_BITS, _LEVEL = 18, np.uint64(3)


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature hash) of every word's features, with repeats."""
    w = Words(texts, lower=True, marks=True)
    raw = Words(texts)
    p, q = _powers(_BYTE_BASE, len(w.data) + 1)

    def part(words: Words, first: np.ndarray, size: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        s = np.zeros(len(words.data) + 1, np.uint64)
        np.cumsum(_byte_values(salt)[_lower(words.data)] * p[: len(words.data)], out=s[1:])
        long = words.ends - words.starts >= size
        at = first[long]
        return np.searchsorted(words.first, np.flatnonzero(long), "right") - 1, mix((s[at + size] - s[at]) * q[at])

    parts = [(np.repeat(np.arange(len(texts)), w.counts()), w.hashes)]
    parts += [part(w, w.starts, n, n) for n in (4, 5)]
    parts += [part(raw, raw.ends - 3, 3, 99)]
    return np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]) & ~_LEVEL


def _leveled(of: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature), by text: for each hash of a text, the levels that its number of occurrences reaches."""
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    n, of, h = np.diff(np.append(at, len(h))), of[at], h[at]
    reached = [n >= level for level in range(1, LEVELS + 1)]
    of = np.concatenate([of[x] for x in reached])
    h = np.concatenate([h[x] | np.uint64(level) for level, x in enumerate(reached, 1)])
    order = np.argsort(of, kind="stable")
    return of[order], h[order]


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data)


class Chain:
    """A trained chain: `names`, sorted feature hashes, and weights (features, earlier categories, base) for each."""

    def __init__(self, names: list[str], hashes: np.ndarray, weights: list[np.ndarray]):
        self.names, self.hashes, self.weights = names, hashes, weights
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def present(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature number) of the chosen features that a text has, once each."""
        of, h = _features(texts)
        near = self.filter[h >> np.uint64(64 - _FILTER_BITS)]
        of, h = _leveled(of[near], h[near])
        if not len(self.hashes):
            return of[:0], of[:0]
        k = np.searchsorted(self.hashes, h)
        k[k == len(self.hashes)] = 0
        hit = self.hashes[k] == h
        return of[hit], k[hit]

    def scores(self, rows: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, 0))
        for w in self.weights:
            out = np.concatenate([out, _probability(rows, features, out, w, n)[:, None]], axis=1)
        return out


def _probability(rows: np.ndarray, features: np.ndarray, before: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    m = len(w) - 1 - before.shape[1]
    z = np.bincount(rows, w[:m][features], n) + before @ w[m:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit(rows: np.ndarray, features: np.ndarray, before: np.ndarray, y: np.ndarray, m: int, penalty: float) -> np.ndarray:
    """Ridge logistic regression by Newton steps, each solved by conjugate gradients. Both classes weigh alike."""
    n, w = len(y), np.zeros(m + before.shape[1] + 1)
    rate = np.clip(y.mean() if n else 0.0, 1e-6, 1 - 1e-6)
    w[-1] = np.log(rate / (1 - rate))
    if not 0 < y.sum() < n:
        return w
    weight = np.where(y == 1, 0.5 / rate, 0.5 / (1 - rate))
    w[-1] = 0

    def back(r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(features, r[rows], m), before.T @ r, [r.sum()]])

    def forth(v: np.ndarray) -> np.ndarray:
        return np.bincount(rows, v[:m][features], n) + before @ v[m:-1] + v[-1]

    ridge = np.full(len(w), penalty)
    ridge[-1] = 0

    def loss(v: np.ndarray) -> float:
        z = forth(v)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (ridge * v * v).sum() / 2)

    now = loss(w)
    for _ in range(STEPS):
        p = _probability(rows, features, before, w, n)
        g = back(weight * (p - y)) + ridge * w
        d = weight * np.maximum(p * (1 - p), 1e-5)
        step, r = np.zeros_like(w), -g
        s, rr = r.copy(), r @ r
        if rr < 1e-12:
            break
        for _ in range(30):
            hs = back(d * forth(s)) + ridge * s
            if s @ hs <= 0:
                break
            a = rr / (s @ hs)
            step += a * s
            r = r - a * hs
            rr, old = r @ r, rr
            if rr < 1e-2 * (g @ g):
                break
            s = r + rr / old * s
        # a whole step may lead too far where the classes are all but separated
        t = 1.0
        while (ahead := loss(w + t * step)) > now and t > 1e-6:
            t /= 2
        if ahead > now:
            break
        w, now = w + t * step, ahead
        if np.abs(t * step).max() < 1e-3:
            break
    return w


def _log_loss(p: np.ndarray, y: np.ndarray) -> float:
    """The mean of both classes' mean losses."""
    p = np.clip(p, 1e-9, 1 - 1e-9)
    parts = [-np.log(p[y == 1]), -np.log(1 - p[y == 0])]
    return float(sum(x.mean() for x in parts if len(x)))


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample_docs: int = SAMPLE_DOCS) -> Chain:
    """A chain over `categories`, in their order: name -> 0/1 expression over `labels`, which has doc_id."""
    names = list(categories)
    marked = labels.where("doc_id is not null").select("doc_id", *[c.cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())])
    total = marked.count()
    share = min(1.0, sample_docs / max(1, total))
    marked = marked.where(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    ys = [f"y{i}" for i in range(len(names))]
    marked = marked.groupBy("doc_id").agg(*[F.max(y).alias(y) for y in ys])
    # at most about sample_docs rows of a few numbers: safe to broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            of, h = _leveled(*_features(batch.column("text")))
            lists = _lists(of, h.view(np.int64), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[batch.column(y) for y in ys], lists], ["doc_id", *ys, "f"])

    kind = docs.select("doc_id").schema[0].simpleString().replace(":", " ", 1)
    rows = written(sample.mapInArrow(features, f"{kind}, {', '.join(f'{y} int' for y in ys)}, f array<bigint>"))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int"))
    chosen = [_chosen(rows, y) for y in ys]
    hashes = np.unique(np.concatenate([x for own in chosen for x in own]))
    # bounded: the sample's rows, with the chosen features only
    shared = docs.sparkSession.sparkContext.broadcast(hashes)

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column("f")
            of = np.repeat(np.arange(batch.num_rows), np.diff(f.offsets.to_numpy()))
            h = f.flatten().to_numpy().view(np.uint64)
            hit = np.isin(h, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("fold"), *[batch.column(y) for y in ys], _lists(of[hit], h[hit].view(np.int64), batch.num_rows)], ["fold", *ys, "f"])

    table = rows.mapInArrow(picked, f"fold int, {', '.join(f'{y} int' for y in ys)}, f array<bigint>").toArrow().combine_chunks()
    lists = table.column("f").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int64()))
    of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()) if len(lists) else 0)
    k = np.searchsorted(hashes, lists.flatten().to_numpy().view(np.uint64)) if len(lists) else np.zeros(0, np.int64)
    fold = table.column("fold").to_numpy()
    before, weights = np.zeros((len(lists), 0)), []
    for y, choice in zip(ys, chosen):
        target = table.column(y).to_numpy().astype(float)

        known = ~np.isnan(target)

        def fit(mask: np.ndarray, features: np.ndarray, penalty: float) -> np.ndarray:
            mask = mask & known
            place = np.cumsum(mask) - 1
            own = mask[of] & np.isin(hashes, features)[k]
            return _fit(place[of[own]], k[own], before[mask], target[mask], len(hashes), penalty)

        def out_of_fold(penalty: float) -> np.ndarray:
            out = np.zeros(len(lists))
            for f in range(FOLDS):
                p = _probability(of, k, before, fit(fold != f, choice[f], penalty), len(lists))
                out[fold == f] = p[fold == f]
            return out

        tried = {penalty: out_of_fold(penalty) for penalty in RIDGES}
        penalty = min(tried, key=lambda x: _log_loss(tried[x][known], target[known]))
        weights.append(fit(np.ones(len(lists), bool), choice[FOLDS], penalty))
        before = np.concatenate([before, tried[penalty][:, None]], axis=1)
    return Chain(names, hashes, weights)


def _lists(of: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """n lists of values, which are in the order of the lists that they are of."""
    cuts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(values))


def _chosen(rows: DataFrame, y: str) -> list[np.ndarray]:
    """The features chosen for a category without each of the folds, and with all."""
    within = [F.col("fold") == f for f in range(FOLDS)]
    sums = rows.agg(*[x for w in within for x in (F.count(F.when(w, F.col(y))), F.coalesce(F.sum(F.when(w, F.col(y))), F.lit(0)))]).first()
    counted = rows.select(F.explode("f").alias("f"), "fold", F.col(y).alias("y")).groupBy("f").agg(
        *[x for f, w in enumerate(within) for x in (F.count(F.when(w, F.col("y"))).alias(f"n{f}"), F.coalesce(F.sum(F.when(w, F.col("y"))), F.lit(0)).alias(f"p{f}"))]
    )
    chi2 = []
    for out in range(FOLDS + 1):
        own = [f for f in range(FOLDS) if f != out]
        n, pos = float(sum(sums[2 * f] for f in own)), float(sum(sums[2 * f + 1] for f in own))
        a, all_f = (sum((F.col(f"{k}{f}") for f in own), F.lit(0.0)) for k in "pn")
        cross = a * (n - pos - (all_f - a)) - (all_f - a) * (pos - a)
        chi2.append((n * cross * cross / F.greatest(F.lit(1.0), all_f * (n - all_f) * pos * (n - pos)) if 0 < pos < n else F.lit(0.0)).alias(f"c{out}"))
    scored = written(counted.select("f", *chi2).where(F.greatest(*[F.col(f"c{i}") for i in range(FOLDS + 1)]) >= LEAST_CHI2))
    tops = [scored.where(F.col(f"c{i}") >= LEAST_CHI2).orderBy(F.desc(f"c{i}"), "f").limit(MOST_FEATURES).select("f").collect() for i in range(FOLDS + 1)]
    return [np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64)) for top in tops]


def score(docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and a probability p_<category> for each category, for every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in slices(batches):
            p = chain.scores(*chain.present(batch.column("text")), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(p[:, i]) for i in range(p.shape[1])]], ["doc_id", *[f"p_{x}" for x in chain.names]])

    return rows.mapInArrow(run, rows.schema[0].simpleString().replace(":", " ", 1) + "".join(f", p_{x} double" for x in chain.names))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, p_low_quality, p_toxic, toxic (p_toxic of THRESHOLD or more)."""
    chain = train(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    return score(docs, chain).withColumn("toxic", F.col("p_toxic") >= THRESHOLD)
