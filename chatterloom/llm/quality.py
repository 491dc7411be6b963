"""Quality classifier by positive-unlabelled learning.

Trusted positives P and unlabelled web text U are known; no negative is. A
linear score g over shape features of the whole text minimises

    prior * mean_P l(g, +)  +  max(0, mean_U l(g, -) - prior * mean_P l(g, -))

with the logistic loss l. For it l(g, +) - l(g, -) = -g, so the unbiased risk is
convex and Newton steps fit it; whenever the second part, which estimates the
risk on negatives, falls below 0, the step goes the way that raises it instead.
The class prior comes from the data: a first score tells P from U, and the prior
is the least ratio of the shares of U and of P above a threshold, plus what
sampling noise explains. Each half of the rows is scored by a fit on the other
half, since a fit sees its own positives too high.

All rows take part: each step is one pass over a table of features that adds up
a gradient and a curvature (features squared) per task, then over ``FAN_IN``
tasks, so what reaches the driver does not grow. Nothing is sampled.

A score is an estimate of P(positive), in [0, 1].

Defined cases: a null text is an empty text and gets a score; an id with several
labels is a positive only if all say so; rows without an id are unlabelled;
repeated rows count as often as they occur; with no positive or no unlabelled row
nothing can be learned, every score is 0.5, and ``keep_good`` keeps all documents
and warns; other columns are carried along.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatterloom.llm import kernels as K
from chatterloom.session import ship_package, written

FAN_IN = 16
BINS = 1000
UNLABELLED, POSITIVE, NEITHER = 0, 1, 2


@dataclass(frozen=True)
class QualityConfig:
    threshold: float = 0.7
    steps: int = 9
    first_steps: int = 4
    ridge: float = 0.03
    ridge_per_feature: float = 0.5  # times features / positives: holds the weights where there are few positives
    backward: float = 0.2
    confidence: float = 0.1


# Byte classes: other, upper case, lower case, digit, space, line break, sentence mark, symbol, non-ASCII.
_CLASS = np.zeros(256, np.int64)
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A], _CLASS[0x20], _CLASS[0x0A] = 1, 2, 3, 4, 5
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 6
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 7
_CLASS[0x80:] = 8


def _distinct(owner: np.ndarray, value: np.ndarray, texts: int) -> np.ndarray:
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=texts)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shape of every text: shares of byte classes, word statistics, repetition; float32 rows."""
    texts, size = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(texts), size)
    kinds = np.bincount(owner * 9 + _CLASS[data], minlength=texts * 9).reshape(texts, 9)
    share = kinds / np.maximum(size, 1)[:, None]
    starts, ends, ranges, hashes = K.words(data, offsets)
    n = np.diff(ranges)
    of, some = np.repeat(np.arange(texts), n), np.maximum(n, 1)
    length = ends - starts
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    capital = np.zeros(len(hashes), bool)
    if len(hashes):
        upper = np.concatenate([[0], np.cumsum((data >= 0x41) & (data <= 0x5A))])
        capital = upper[ends] - upper[starts] == length
    total = lambda x: np.bincount(of, weights=x, minlength=texts)
    pairs = K.mix(hashes[:-1] * np.uint64(31) + hashes[1:])[of[:-1] == of[1:]] if len(hashes) > 1 else hashes[:0]
    pair_of = of[:-1][of[:-1] == of[1:]] if len(hashes) > 1 else of[:0]
    words = n / some
    distinct = _distinct(of, hashes, texts) / some
    couples = _distinct(pair_of, pairs, texts) / np.maximum(n - 1, 1)
    mean = total(length) / some
    spread = np.sqrt(np.maximum(total(length.astype(float) ** 2) / some - mean**2, 0))
    short = total(length <= 3) / some
    repeated, shouted = total(same) / some, total(capital & (length > 1)) / some
    long_ = np.log1p(n)
    base = [
        *(share[:, k] for k in (1, 3, 4, 5, 6, 7, 8)), distinct, couples, mean / 10, spread / 10, short, repeated, shouted,
        long_ / 10, (long_ / 10) ** 2, (n == 0).astype(float), distinct * long_ / 10, couples * long_ / 10,
    ]
    bends = [np.sqrt(x) for x in (share[:, 1], share[:, 7], share[:, 3], repeated, shouted, short, np.maximum(1 - couples, 0))]
    hinges = [np.minimum(x / cut, 1) for x, cut in ((share[:, 7], 0.02), (share[:, 1], 0.15), (repeated, 0.05), (shouted, 0.1))]
    few = [np.maximum(0.25 - short, 0), np.maximum(0.02 - share[:, 6], 0) * 10, np.maximum(0.6 - couples, 0)]
    return np.stack([*base, *bends, *hinges, *few, words, np.ones(texts)], 1).astype(np.float32)


def feature_table(docs: DataFrame, *, key: str, text: str, kind: Column) -> DataFrame:
    """``key, kind, x``: features as bytes."""

    def compute(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        return [pa.array([row.tobytes() for row in features(data, offsets)], pa.binary())]

    slim = docs.select(F.col(key).alias("id"), kind.cast("int").alias("kind"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return K.add_columns(slim, compute, [T.StructField("x", T.BinaryType())], keep=["id", "kind"])


def _matrix(column: pa.Array) -> np.ndarray:
    data, _ = K.utf8(column)
    return np.frombuffer(data.tobytes(), np.float32).reshape(len(column), -1).astype(np.float64)


def _added(table: DataFrame, sums) -> np.ndarray:
    """The sum of ``sums(kind, x)`` over all batches: per task, then over FAN_IN tasks."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = sums(np.asarray(batch.column(0)), _matrix(batch.column(1)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(v, np.float64) for b in batches for v in b.column(0).to_pylist()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(parts, 0).tobytes()], pa.binary())], names=["s"])

    rows = table.select("kind", "x").mapInArrow(one, "s binary").repartition(FAN_IN).mapInArrow(more, "s binary").collect()
    return np.sum([np.frombuffer(r[0], np.float64) for r in rows], 0) if rows else np.zeros(0)


def _softplus(g: np.ndarray) -> np.ndarray:
    return np.maximum(g, 0) + np.log1p(np.exp(-np.abs(g)))


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(g / 2))


def _step_sums(w: np.ndarray, center: np.ndarray, scale: np.ndarray):
    d = len(w)

    def sums(kind: np.ndarray, x: np.ndarray) -> np.ndarray:
        x = (x - center) / scale
        g = x @ w
        p, u = kind == POSITIVE, kind == UNLABELLED
        s = _sigmoid(g)
        curve = s * (1 - s)
        return np.concatenate([
            [p.sum(), u.sum(), g[p].sum(), _softplus(g[p]).sum(), _softplus(g[u]).sum(), _softplus(-g[p]).sum()],
            x[p].sum(0), s[p] @ x[p], s[u] @ x[u], ((x[u].T * curve[u]) @ x[u]).ravel(), ((x[p].T * curve[p]) @ x[p]).ravel(),
        ])

    def taken(total: np.ndarray) -> dict:
        n_p, n_u = total[0], total[1]
        at = 6
        xp, sp, su = (total[at + i * d : at + (i + 1) * d] for i in range(3))
        at += 3 * d
        hu, hp = total[at : at + d * d].reshape(d, d), total[at + d * d :].reshape(d, d)
        return dict(
            g_p=total[2] / n_p, minus_p=total[3] / n_p, minus_u=total[4] / n_u, plus_p=total[5] / n_p,
            x_p=xp / n_p, s_p=sp / n_p, s_u=su / n_u, h_u=hu / n_u, h_p=hp / n_p,
        )

    return sums, taken


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    prior: float
    flipped: int = 0  # steps that raised the risk on negatives

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(((x - self.center) / self.scale) @ self.weights)


def fit(table: DataFrame, config: QualityConfig = QualityConfig()) -> QualityModel | None:
    """Fit on the rows of a feature table that are POSITIVE or UNLABELLED."""
    known = table.filter(F.col("kind") != NEITHER)

    def moments(kind: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.concatenate([[(kind == POSITIVE).sum(), (kind == UNLABELLED).sum()], x.sum(0), (x**2).sum(0)])

    m = _added(known, moments)
    if not len(m) or not m[0] or not m[1]:
        return None
    n, d = m[0] + m[1], (len(m) - 2) // 2
    center, square = m[2 : 2 + d] / n, m[2 + d :] / n
    scale = np.sqrt(np.maximum(square - center**2, 0))
    scale[scale < 1e-9] = 1.0
    center[-1], scale[-1] = 0.0, 1.0  # the constant
    ridge = np.full(d, max(config.ridge, config.ridge_per_feature * d / m[0]))
    ridge[-1] = 0.0

    counts = np.zeros((2, BINS))
    for half in (0, 1):  # equal texts fall into the same half
        in_half = F.pmod(F.xxhash64("x"), F.lit(2)) == half
        counts += _histogram(known.filter(~in_half), _first_fit(known.filter(in_half), center, scale, ridge, config))
    prior = _prior(counts, config)

    w, before, risk_before, flipped = np.zeros(d), np.zeros(d), np.inf, 0
    w[-1] = np.log(prior / (1 - prior))
    best, least = w, np.inf
    for _ in range(config.steps):
        sums, taken = _step_sums(w, center, scale)
        t = taken(_added(known, sums))
        negative = t["minus_u"] - prior * t["minus_p"]
        risk = prior * t["plus_p"] + max(0.0, negative) + (ridge * w**2).sum() / 2
        if risk < least:
            best, least = w, risk
        if risk > risk_before + 1e-9 and negative >= 0:  # too far: go back half the way
            w = (w + before) / 2
            continue
        curve = t["h_u"] + np.diag(ridge + 1e-9)
        if negative >= 0:
            before, risk_before = w, risk
            w = w - np.linalg.solve(curve, t["s_u"] - prior * t["x_p"] + ridge * w)
        else:
            risk_before, flipped = np.inf, flipped + 1
            w = w + config.backward * np.linalg.solve(curve, t["s_u"] - prior * t["s_p"])
    return QualityModel(best, center, scale, prior, flipped)


def _first_fit(known: DataFrame, center: np.ndarray, scale: np.ndarray, ridge: np.ndarray, config: QualityConfig) -> QualityModel:
    """A score that tells P from U, both with weight one half."""
    w = np.zeros(len(center))
    for _ in range(config.first_steps):
        sums, taken = _step_sums(w, center, scale)
        total = _added(known, sums)
        if not len(total) or not total[0] or not total[1]:
            break
        t = taken(total)
        slope = (t["s_p"] - t["x_p"] + t["s_u"]) / 2 + ridge * w
        w = w - np.linalg.solve((t["h_p"] + t["h_u"]) / 2 + np.diag(ridge + 1e-9), slope)
    return QualityModel(w, center, scale, 1.0)


def _histogram(known: DataFrame, first: QualityModel) -> np.ndarray:
    def sums(kind: np.ndarray, x: np.ndarray) -> np.ndarray:
        bins = np.minimum((first.scores(x) * BINS).astype(np.int64), BINS - 1)
        return np.bincount(kind * BINS + bins, minlength=2 * BINS).astype(np.float64)

    counts = _added(known, sums)
    return counts.reshape(2, BINS) if len(counts) else np.zeros((2, BINS))


def _prior(counts: np.ndarray, config: QualityConfig) -> float:
    """Least ratio of tail shares of unlabelled and positive scores, noise allowed for."""
    n_u, n_p = counts.sum(1)
    if not n_u or not n_p:
        return 0.5
    tail_u, tail_p = (np.cumsum(c[::-1]) / c.sum() for c in counts)
    slack = np.sqrt(np.log(4 / config.confidence) / 2) * (1 / np.sqrt(n_u) + 1 / np.sqrt(n_p))
    usable = tail_p > slack
    if not usable.any():
        return 0.5
    best = int(np.argmin((tail_u[usable] + slack) / tail_p[usable]))
    return float(np.clip(tail_u[usable][best] / tail_p[usable][best], 0.01, 0.99))


def scored(table: DataFrame, model: QualityModel | None, config: QualityConfig = QualityConfig()) -> DataFrame:
    """``id, score, predicted`` for every row of a feature table."""
    if model is None:
        return table.select("id", F.lit(0.5).alias("score"), F.lit(int(0.5 >= config.threshold)).alias("predicted"))
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.scores(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= config.threshold).astype(np.int32))], names=["id", "score", "predicted"]
            )

    kind = table.schema["id"].dataType.simpleString()
    return table.select("id", "x").mapInArrow(run, f"id {kind}, score double, predicted int")


def held_out(key: str, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest`` modulo ``mod``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")), F.lit(mod)) == rest, F.lit(False))


def learned_table(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", skip: Column | None = None
) -> DataFrame:
    """Features of all documents, marked POSITIVE, UNLABELLED, or NEITHER where ``skip`` holds. Written once."""
    ship_package(docs.sparkSession)
    aside = F.lit(False) if skip is None else skip
    good = labels.filter(~aside).filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(F.coalesce("quality", F.lit(0))).alias("_q")
    ).filter("_q = 1")
    table = feature_table(docs, key=key, text=text, kind=F.when(aside, NEITHER).otherwise(UNLABELLED))
    marked = table.join(good.select(F.col(key).alias("id"), "_q"), "id", "left")
    kind = F.when((F.col("kind") != NEITHER) & (F.col("_q") == 1), POSITIVE).otherwise(F.col("kind"))
    return written(marked.select("id", kind.cast("int").alias("kind"), "x"), "features")


def keep_good(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", skip: Column | None = None,
    config: QualityConfig = QualityConfig(),
) -> DataFrame:
    """The documents of ``docs`` whose score reaches the threshold.

    The model is fitted once on the feature table; texts are then scored where
    they are read, so they are not shuffled. Where nothing could be learned, no
    document is judged: all of them are kept, with a warning.
    """
    model = fit(learned_table(docs, labels, key=key, text=text, skip=skip), config)
    if model is None:
        warnings.warn("no positive or no unlabelled document to learn from: all documents are kept", stacklevel=2)
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        return [pa.array(shared.value.scores(features(data, offsets).astype(np.float64)) >= config.threshold)]

    judged = K.add_columns(docs, compute, [T.StructField("_good", T.BooleanType())], text=text)
    return judged.filter("_good").select(*docs.columns)
