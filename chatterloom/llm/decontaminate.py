"""Benchmark decontamination: a broadcast hash set of test n-grams.

Texts and benchmark items are taken apart into words (ASCII letters lower-cased,
runs of letters, digits and non-ASCII characters). A window is ``width``
consecutive words of an item; an item of fewer words, but not none, is one
window. Every document word inside an occurrence of a window is hit.

The windows' hashes go to the tasks, which hash all windows of their documents
in bulk, look them up, and compare the words of every match, so a hash collision
hits nothing. The set is arrays: the benchmark's lower-cased bytes, the bounds of its words, and
for every window its hash and first word. They are broadcast only while those arrays take at most
``broadcast_bytes``, which is reckoned from the words before anything is collected; a larger
benchmark is matched by a join on the hash after a Bloom filter of fixed size has removed nearly
all other windows.

Defined cases: null and word-less texts have no words and no hits; null or
word-less items have no window; items that repeat an id count once; repeated
document rows each get their result; other columns are carried along, and a
column with the name of a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatterloom.llm import kernels as K

WIDTH = 10
BROADCAST_BYTES = 128 << 20
WORD_BYTES = 40  # a word's bounds and item, and the hash, first word and item of the window it opens
BLOOM_BITS = 27  # 16 MiB whatever the size of the benchmark
RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
]
_STEP = 0xD6E8FEB86659FD93


@dataclass
class Windows:
    """A benchmark's words, and its windows by length: sorted hashes and the first word of each."""

    ids: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]

    def nbytes(self) -> int:
        arrays = [self.data, self.starts, self.ends, self.owner, *[x for pair in self.by_length.values() for x in pair]]
        return sum(x.nbytes for x in arrays)

    def items(self, length: int, value: np.uint64, words: bytes) -> list[str]:
        """Items with a window of these words."""
        hashes, first = self.by_length[length]
        lo, hi = np.searchsorted(hashes, value), np.searchsorted(hashes, value, side="right")
        same = [i for i in first[lo:hi].tolist() if _words_at(self.data, self.starts, self.ends, i, length) == words]
        return self.ids[self.owner[same]].tolist()


def window_hashes(hashes: np.ndarray, left: np.ndarray, lengths: set[int]):
    """For each length in turn, hashes of the windows that start at each word and fit their text."""
    n, value, factor = len(hashes), np.zeros(len(hashes), np.uint64), 1
    for i in range(max(lengths, default=0)):
        factor = factor * _STEP % (1 << 64)
        value[: max(n - i, 0)] += hashes[i:] * np.uint64(factor)
        if i + 1 in lengths:
            at = np.flatnonzero(left > i)
            yield i + 1, at, K.mix(value[at])


def _words_left(ranges: np.ndarray) -> np.ndarray:
    return np.repeat(ranges[1:], np.diff(ranges)) - np.arange(ranges[-1])


def _words_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, length: int) -> bytes:
    return b" ".join(data[starts[i] : ends[i]].tobytes() for i in range(at, at + length))


def windows_of(ids: list[str], texts: list[str | None], width: int = WIDTH) -> Windows:
    data, offsets = K.utf8(pa.array(texts, pa.string()))
    starts, ends, ranges, hashes = K.words(data, offsets)
    counts = np.diff(ranges)
    owner = np.repeat(np.arange(len(counts)), counts)
    by_length = {}
    for length, at, value in window_hashes(hashes, _words_left(ranges), {min(width, int(c)) for c in counts if c}):
        mine = np.minimum(counts[owner[at]], width) == length
        at, value = at[mine], value[mine]
        order = np.lexsort((owner[at], value))
        at, value = at[order], value[order]
        # A window that an item repeats is needed once, unless two windows share a hash.
        again = np.zeros(len(at), bool)
        again[1:] = (value[1:] == value[:-1]) & (owner[at[1:]] == owner[at[:-1]])
        for i in np.flatnonzero(again).tolist():
            again[i] = _words_at(K.LOWER[data], starts, ends, int(at[i]), length) == _words_at(K.LOWER[data], starts, ends, int(at[i - 1]), length)
        by_length[length] = value[~again], at[~again].astype(np.int32)
    bounds = [x.astype(np.int32) for x in (starts, ends, owner)]
    return Windows(np.array(ids, object), K.LOWER[data], *bounds, by_length)


def _spans(hit: np.ndarray, starts: np.ndarray, ends: np.ndarray, ranges: np.ndarray, offsets: np.ndarray):
    """Byte spans of runs of hit words, per text."""
    n = len(hit)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = hit[:-1], hit[1:]
    first = ranges[:-1][np.diff(ranges) > 0]
    before[first] = False
    after[first[1:] - 1] = False
    opened, closed = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)
    base = np.repeat(offsets[:-1], np.diff(np.searchsorted(opened, ranges)))
    flat = np.stack([starts[opened] - base, ends[closed] - base], 1).ravel()
    pairs = pa.ListArray.from_arrays(pa.array(np.arange(len(opened) + 1) * 2, pa.int32()), pa.array(flat, pa.int64()))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(opened, ranges), pa.int32()), pairs)


def _result(hit, starts, ends, ranges, offsets, items: dict[int, set[str]]) -> list[pa.Array]:
    sums = np.concatenate([[0], np.cumsum(hit)])
    return [
        pa.array(np.diff(ranges), pa.int64()),
        _spans(hit, starts, ends, ranges, offsets),
        pa.array(sums[ranges[1:]] - sums[ranges[:-1]], pa.int64()),
        pa.array([sorted(items.get(i, ())) for i in range(len(ranges) - 1)], pa.list_(pa.string())),
    ]


def _scan(windows: Windows):
    """The task side: hits of the broadcast windows in a run of texts."""
    bits = {}
    for length, (hashes, _) in windows.by_length.items():
        bits[length] = np.zeros(1 << 22, bool)
        bits[length][hashes >> np.uint64(42)] = True

    def compute(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        starts, ends, ranges, hashes = K.words(data, offsets)
        low, items = K.LOWER[data], {}
        marks = np.zeros(len(starts) + 1, np.int64)
        for length, at, value in window_hashes(hashes, _words_left(ranges), set(windows.by_length)):
            maybe = np.flatnonzero(bits[length][value >> np.uint64(42)])
            known = windows.by_length[length][0]
            near = np.minimum(np.searchsorted(known, value[maybe]), len(known) - 1)
            maybe = maybe[known[near] == value[maybe]]
            for j in maybe.tolist():
                i = int(at[j])
                found = windows.items(length, value[j], _words_at(low, starts, ends, i, length))
                if found:
                    marks[i] += 1
                    marks[i + length] -= 1
                    items.setdefault(int(np.searchsorted(ranges, i, side="right")) - 1, set()).update(found)
        hit = np.cumsum(marks[:-1]) > 0
        return _result(hit, starts, ends, ranges, offsets, items)

    return compute


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    broadcast_bytes: int = BROADCAST_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``hit_spans`` (byte ranges) and ``items``."""
    spark = docs.sparkSession
    tests = benchmark.select(
        F.coalesce(F.col(item_key).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("words")
    )
    words = F.regexp_count("words", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    bytes_ = F.octet_length("words") + words * WORD_BYTES + F.octet_length("item") + 64
    size = tests.agg(F.sum(bytes_)).first()[0] or 0
    if size <= broadcast_bytes:
        rows = tests.collect()  # their arrays take at most broadcast_bytes
        shared = spark.sparkContext.broadcast(windows_of([r[0] for r in rows], [r[1] for r in rows], width))
        made: list = []

        def compute(data, offsets):
            if not made:
                made.append(_scan(shared.value))
            return made[0](data, offsets)

        return K.add_columns(docs, compute, RESULT, text=text, keep=keep)
    return _find_by_join(docs, tests, text, width, keep)


def _find_by_join(docs: DataFrame, tests: DataFrame, text: str, width: int, keep: list[str] | None) -> DataFrame:
    """For a benchmark of any size. Rows meet by text, so equal texts are matched once."""
    one = T.ArrayType(T.StructType([
        T.StructField("length", T.IntegerType()), T.StructField("hash", T.LongType()),
        T.StructField("at", T.LongType()), T.StructField("body", T.StringType()),
    ]))
    kind = pa.struct([("length", pa.int32()), ("hash", pa.int64()), ("at", pa.int64()), ("body", pa.string())])

    def listed(keep_row, lengths):
        def compute(data, offsets):
            starts, ends, ranges, hashes = K.words(data, offsets)
            low, counts = K.LOWER[data], np.diff(ranges)
            out: list[list] = [[] for _ in counts]
            owner = np.repeat(np.arange(len(counts)), counts)
            some = lengths or {min(width, int(c)) for c in counts if c}
            for length, at, value in window_hashes(hashes, _words_left(ranges), some):
                for j in np.flatnonzero(keep_row(length, value, counts[owner[at]])).tolist():
                    i = int(at[j])
                    body = _words_at(low, starts, ends, i, length).decode("utf-8")
                    signed = int(value[j]) - (1 << 64 if value[j] >= 1 << 63 else 0)
                    out[owner[i]].append((length, signed, i - int(ranges[owner[i]]), body))
            return [pa.array(out, pa.list_(kind))]

        return compute

    field = [T.StructField("_w", one)]
    whole = lambda length, value, count: np.minimum(count, width) == length
    grams = K.add_columns(tests, listed(whole, None), field, text="words", keep=["item"])
    grams = grams.select("item", F.inline("_w")).drop("at").distinct()

    def filled(batches):
        bits = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
        for batch in batches:
            h = np.asarray(batch.column(0)).view(np.uint64) >> np.uint64(64 - BLOOM_BITS)
            np.bitwise_or.at(bits, h >> np.uint64(3), (1 << (h & np.uint64(7))).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()])], names=["bits"])

    # A constant number of filters of constant size reaches the driver.
    parts = grams.select("hash").repartition(8).mapInArrow(filled, "bits binary").toLocalIterator()
    bits = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
    for row in parts:
        bits |= np.frombuffer(row[0], np.uint8)
    lengths = {r[0] for r in grams.select("length").distinct().collect()}  # at most `width`
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def maybe(length, value, count):
        h = value >> np.uint64(64 - BLOOM_BITS)
        return (shared.value[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1

    seen = docs.select(F.col(text).alias("_t")).distinct()
    seen = K.add_columns(seen, listed(maybe, lengths), field, text="_t") if lengths else seen.limit(0).withColumn("_w", F.lit(None))
    if not lengths:
        return K.add_columns(docs, _scan(windows_of([], [], width)), RESULT, text=text, keep=keep)
    matched = seen.select(F.sha2("_t", 256).alias("_k"), F.inline("_w")).join(grams, ["length", "hash", "body"])
    per_text = matched.groupBy("_k").agg(
        F.collect_set(F.struct("at", "length")).alias("_at"), F.array_sort(F.collect_set("item")).alias("items")
    )
    new = [f.name for f in RESULT]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    k, at_, items_ = (K.free_name(c, docs.columns) for c in ("_k", "_at", "items"))
    per_text = per_text.toDF(k, at_, items_)
    joined = docs.select(*dict.fromkeys([*kept, text])).withColumn(k, F.sha2(text, 256)).join(per_text, k, "left").drop(k)
    schema = T.StructType([*[joined.schema[c] for c in kept], *RESULT])

    def marked(batches):
        for batch in batches:
            for part in K.pieces(batch, text):
                data, offsets = K.utf8(part.column(text))
                starts, ends, ranges = K.word_spans(data, offsets)
                marks = np.zeros(len(starts) + 1, np.int64)
                for r, spans in enumerate(part.column(at_).to_pylist()):
                    for span in spans or ():
                        marks[ranges[r] + span["at"]] += 1
                        marks[ranges[r] + span["at"] + span["length"]] -= 1
                items = {r: set(x) for r, x in enumerate(part.column(items_).to_pylist()) if x}
                made = _result(np.cumsum(marks[:-1]) > 0, starts, ends, ranges, offsets, items)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *made], names=schema.names)

    return joined.mapInArrow(marked, schema)


def remove_documents(found: DataFrame, most: float = 0.0) -> DataFrame:
    """Documents of which at most the share ``most`` of words is hit, without the result columns."""
    clean = F.col("n_hit") <= F.lit(most) * F.col("n_words")
    return found.filter(clean).drop(*[f.name for f in RESULT])


def remove_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """Documents with the hit words, and what lies between them, cut out of their text.

    A null text stays null. The result columns are dropped.
    """
    raw = F.encode(text, "UTF-8")
    cut = F.aggregate(
        "hit_spans",
        F.struct(F.lit(1).cast("bigint").alias("at"), F.to_binary(F.lit(""), F.lit("utf-8")).alias("out")),
        lambda s, x: F.struct(
            (F.get(x, 1) + 1).alias("at"),
            F.concat(s["out"], F.substring(raw, s["at"].cast("int"), (F.get(x, 0) + 1 - s["at"]).cast("int"))).alias("out"),
        ),
        lambda s: F.concat(s["out"], F.substring(raw, s["at"].cast("int"), F.lit(2**31 - 1))),
    )
    kept = F.when(F.col("n_hit") == 0, F.col(text)).otherwise(F.decode(cut, "UTF-8"))
    return found.withColumn(text, kept).drop(*[f.name for f in RESULT])
