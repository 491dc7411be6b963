"""Language identification in two levels: the family, then the language within it.

A text is a vector of hashed byte n-grams (one to three bytes, ASCII letters
lower-cased, runs of anything but letters as one space), square roots of counts,
scaled to length 1. One-versus-one linear support vector machines choose among
the families; others, each trained on the texts of two languages only, separate
the languages of the chosen family. Whole texts are read in training and use.

The machines are trained on the driver from at most about ``sample`` different labelled
rows, the same number per language, picked by a hash of id, text and language; that bound
holds whatever the size of the table and however often a row is repeated. All rows are
predicted in one pass, ``ROWS_AT_ONCE`` at a time.

A language that ``families`` does not know is a family of its own; if there are more than
``OWN_FAMILIES`` of those, neighbours along the main axis of their mean vectors share one. Of more than
``MOST_CLASSES`` languages the most frequent are learned. So there are about 20,000 machines of
16 KiB at most.

A score is the product of the logistic margins along the way, in [0, 1].

Defined cases: null texts and texts without a letter are ``und`` with score 0;
rows without a language are not learned from; with no labelled row everything is
``und``, with one language every text with a letter is that; repeated rows each get their
result; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatterloom.llm import kernels as K
from chatterloom.session import ship_package

WIDTH = 4096
UNKNOWN = "und"
ROWS_AT_ONCE = 256  # texts whose dense vectors are in memory at once: 8 MiB
MOST_CLASSES = 1000
OWN_FAMILIES = 32

FAMILIES: Mapping[str, str] = {
    **dict.fromkeys("en de nl sv da no is af fy lb".split(), "germanic"),
    **dict.fromkeys("fr es it pt ro ca gl oc".split(), "romance"),
    **dict.fromkeys("ru uk be pl cs sk bg sr hr sl mk".split(), "slavic"),
    **dict.fromkeys("fi et hu".split(), "uralic"),
    **dict.fromkeys("tr az kk uz".split(), "turkic"),
    **dict.fromkeys("ar he".split(), "semitic"),
    **dict.fromkeys("hi bn mr ne ur".split(), "indic"),
}

_NORMAL = np.full(256, 0x20, np.uint8)
_NORMAL[0x61:0x7B] = np.arange(0x61, 0x7B)
_NORMAL[0x41:0x5B] = np.arange(0x61, 0x7B)
_NORMAL[0x80:] = np.arange(0x80, 0x100)


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of n-gram weights per text."""
    texts, owner = len(offsets) - 1, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    plain = _NORMAL[data]
    keep = np.ones(len(plain), bool)
    keep[1:] = (plain[1:] != 0x20) | (plain[:-1] != 0x20) | (owner[1:] != owner[:-1])
    plain, owner = plain[keep].astype(np.uint64), owner[keep]
    out = np.zeros(texts * WIDTH)
    gram = np.zeros(len(plain), np.uint64)
    for n in range(1, 4):
        size = max(len(plain) - n + 1, 0)
        gram = gram[:size] * np.uint64(256) + plain[n - 1 : n - 1 + size]
        inside = owner[:size] == owner[n - 1 : n - 1 + size]
        slot = ((gram + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
        out += np.bincount(owner[:size][inside] * WIDTH + slot[inside].astype(np.int64), minlength=len(out))
    out = np.sqrt(out.reshape(texts, WIDTH))
    return (out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-12)).astype(np.float32)


def train_machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 150) -> np.ndarray:
    """Linear support vector machine with squared hinge loss; the last weight is the threshold.

    Accelerated gradient descent; classes weigh the same, whatever their sizes. ``y`` is 1 or -1.
    """
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w, ahead, rate = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), 1.0 / (1e-3 + 4.0)
    for t in range(steps):
        gap = np.maximum(1 - y * (x @ ahead[:-1].astype(x.dtype) + ahead[-1]), 0) * weight * y
        slope = np.append(1.0 / (cost * 1000) * ahead[:-1] - 2 * (gap.astype(x.dtype) @ x), -2 * gap.sum())
        new = ahead - rate * slope
        ahead = new + t / (t + 3.0) * (new - w)
        w = new
    return w


@dataclass
class Machines:
    """One-versus-one machines over named classes."""

    names: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None

    @staticmethod
    def trained(x: np.ndarray, y: np.ndarray) -> Machines:
        names = sorted(set(y.tolist()))
        out = Machines(names, [(a, b) for a in range(len(names)) for b in range(a + 1, len(names))])
        rows = []
        for a, b in out.pairs:
            some = (y == names[a]) | (y == names[b])
            rows.append(train_machine(x[some], np.where(y[some] == names[a], 1.0, -1.0)))
        out.weights = np.array(rows, np.float32) if rows else None
        return out

    def chosen(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class number with most votes (ties: larger margins), and its mean logistic margin."""
        if self.weights is None:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margin = x @ self.weights[:, :-1].T.astype(np.float32) + self.weights[:, -1]
        sure = 1 / (1 + np.exp(-np.clip(3 * margin, -30, 30)))
        votes, force = np.zeros((len(x), len(self.names))), np.zeros((len(x), len(self.names)))
        for i, (a, b) in enumerate(self.pairs):
            votes[:, a] += margin[:, i] > 0
            votes[:, b] += margin[:, i] <= 0
            force[:, a] += sure[:, i]
            force[:, b] += 1 - sure[:, i]
        best = np.argmax(votes + force / (len(self.names) + 1), 1)
        return best, force[np.arange(len(x)), best] / (len(self.names) - 1)


@dataclass
class LanguageModel:
    families: Machines
    within: dict[str, Machines]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        family, sure = self.families.chosen(x)
        names, score = np.empty(len(x), object), sure.copy()
        for k, name in enumerate(self.families.names):
            mine = np.flatnonzero(family == k)
            if len(mine):
                best, own = self.within[name].chosen(x[mine])
                names[mine] = np.array(self.within[name].names, object)[best]
                score[mine] *= own
        return names, np.clip(score, 0, 1)


def _tribes(x: np.ndarray, y: np.ndarray, families: Mapping[str, str]) -> dict[str, str]:
    """The family of every language."""
    out = {v: families[v] for v in set(y.tolist()) if v in families}
    rest = sorted(set(y.tolist()) - set(out))
    if len(rest) > OWN_FAMILIES:
        means = np.stack([x[y == v].mean(0) for v in rest])
        axis = np.linalg.svd(means - means.mean(0), full_matrices=False)[2][0]
        rest = [rest[i] for i in np.argsort(means @ axis, kind="stable")]
    each = -(-len(rest) // OWN_FAMILIES)
    return out | {v: f"only {rest[i - i % each]}" for i, v in enumerate(rest)}


def fit(
    labelled: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 4000,
    families: Mapping[str, str] = FAMILIES,
) -> LanguageModel | None:
    """Train on about ``sample`` rows of ``labelled`` whose language is known."""
    ship_package(labelled.sparkSession)
    known = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(text).rlike(r"\p{L}"))
    # Repeated rows count once, so that a text that is copied very often neither fills the sample nor exceeds it.
    known = known.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    known = known.withColumn("h", F.xxhash64("key", "text", "lang"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    # Languages beyond the sample's size would have less than one text each: the most frequent ones are learned.
    top = counts.orderBy(F.desc("n"), "lang").limit(min(sample, MOST_CLASSES)).collect()
    if not top:
        return None
    each = sample / len(top)
    share = F.element_at(F.create_map(*[F.lit(v) for r in top for v in (r[0], min(1.0, each / max(r[1], 1)))]), F.col("lang"))
    pick = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < F.coalesce(share, F.lit(0.0)) * (1 << 30)

    def compute(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        return [pa.array([row.astype(np.float16).tobytes() for row in vectors(data, offsets)], pa.binary())]

    picked = known.filter(pick).dropDuplicates(["h"]).select("lang", "text")
    rows = K.add_columns(picked, compute, [T.StructField("x", T.BinaryType())], keep=["lang"], most_rows=ROWS_AT_ONCE).collect()
    if not rows:
        return None
    y = np.array([r[0] for r in rows], object)
    x = np.stack([np.frombuffer(r[1], np.float16) for r in rows]).astype(np.float32)
    order = np.lexsort((x @ np.arange(x.shape[1], dtype=np.float32), y.astype(str)))
    x, y = x[order], y[order]
    tribes = _tribes(x, y, families)
    tribe = np.array([tribes[v] for v in y], object)
    return LanguageModel(Machines.trained(x, tribe), {f: Machines.trained(x[tribe == f], y[tribe == f]) for f in sorted(set(tribe))})


def identify(docs: DataFrame, model: LanguageModel | None, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        n = len(offsets) - 1
        if shared.value is None:
            return [pa.array([UNKNOWN] * n, pa.string()), pa.array(np.zeros(n))]
        names, score = shared.value.predict(vectors(data, offsets))
        raw = data.tobytes()
        ascii_letter = np.concatenate([[0], np.cumsum((_NORMAL[data] != 0x20) & (data < 0x80))])
        for i in np.flatnonzero(ascii_letter[offsets[1:]] == ascii_letter[offsets[:-1]]).tolist():
            if not any(c.isalpha() for c in raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")):
                names[i], score[i] = UNKNOWN, 0.0
        return [pa.array(names.tolist(), pa.string()), pa.array(score)]

    return K.add_columns(docs, compute, fields, text=text, keep=keep, most_rows=ROWS_AT_ONCE)
