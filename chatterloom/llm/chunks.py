"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text (after each byte it depends on
the last 32 only), and a chunk ends where the hash has enough zero bits: more of
them before the normal chunk size, fewer after it, which narrows the spread of
sizes. Boundaries depend on content, so an insertion moves them only near by. A
fingerprint is the set of chunk digests with the length of each; what two share,
weighted by length, measures containment.

All boundaries of a run of texts are found together: the gear hash by doubling
(windows of 1, 2, 4, ... 32 bytes), the cuts for all texts in step.

Defined cases: a null or empty text has an empty fingerprint, contained wholly in
any other; a text shorter than the least chunk is one chunk; repeated chunks
count once per text, with their length; equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatterloom.llm import kernels as K
from chatterloom.session import ship_package, written

_GEAR = (K.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_WINDOW = 32
DIGEST_BITS = 40
MOST_RUNS = 20_000
SAMPLED = 32


@dataclass(frozen=True)
class ChunkConfig:
    least: int = 8
    normal: int = 24
    most: int = 128
    hard_bits: int = 6
    easy_bits: int = 4


def gear(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rolling hash after every byte, restarting with each text."""
    sizes = np.diff(offsets)
    at = np.arange(len(data)) + _WINDOW * (np.repeat(np.arange(len(sizes)), sizes) + 1)  # a gap keeps texts apart
    wide = np.zeros(len(data) + _WINDOW * (len(sizes) + 1), np.uint32)
    wide[at] = _GEAR[data]
    width = 1
    while width < _WINDOW:
        wide[width:] += wide[:-width] << np.uint32(width)  # the right side is made before it is added
        width *= 2
    return wide[at]


def cuts(data: np.ndarray, offsets: np.ndarray, config: ChunkConfig = ChunkConfig()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of every chunk, in order."""
    rolled = gear(data, offsets)
    # A boundary after byte i is position i + 1. The high bits depend on the whole window.
    easy = np.flatnonzero(rolled >> np.uint32(32 - config.easy_bits) == 0) + 1
    hard = np.flatnonzero(rolled >> np.uint32(32 - config.hard_bits) == 0) + 1
    never = len(data) + config.most + 1
    easy, hard = np.append(easy, never), np.append(hard, never)
    live = np.flatnonzero(np.diff(offsets))
    start, out = offsets[:-1][live].copy(), []
    while len(live):
        stop = offsets[1:][live]
        strict = hard[np.searchsorted(hard, start + config.least)]
        loose = easy[np.searchsorted(easy, start + config.normal)]
        end = np.where(strict < start + config.normal, strict, loose)
        end = np.minimum(np.minimum(end, start + config.most), stop)
        out.append((live, start, end))
        more = end < stop
        live, start = live[more], end[more]
    if not out:
        return (np.zeros(0, np.int64),) * 3
    owner, start, end = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(start, kind="stable")
    return owner[order], start[order], end[order]


def digests(data: np.ndarray, offsets: np.ndarray, config: ChunkConfig = ChunkConfig()):
    """Sorted distinct digests, their lengths, and the range of each text."""
    owner, start, end = cuts(data, offsets, config)
    value, length = K.span_hashes(data, start, end) >> np.uint64(64 - DIGEST_BITS), end - start
    order = np.lexsort((value, owner))
    owner, value, length = owner[order], value[order], length[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        owner, value, length = owner[new], value[new], length[new]
    return value, length, np.searchsorted(owner, np.arange(len(offsets)))


def containment(value: np.ndarray, length: np.ndarray, other: np.ndarray) -> float:
    """The share of a fingerprint's weight that lies in another's digests."""
    if not len(value):
        return 1.0
    if not len(other):
        return 0.0
    shared = other[np.minimum(np.searchsorted(other, value), len(other) - 1)] == value
    return float(length[shared].sum() / length.sum())


def shown(value: np.ndarray, length: np.ndarray) -> str:
    """A fingerprint as text: 10 hex digits of digest and 2 of length for each chunk."""
    out = np.empty((len(value), 6), np.uint8)
    out[:, :5] = value.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    out[:, 5] = length
    return out.tobytes().hex()


def fingerprints(docs: DataFrame, *, text: str = "text", config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """``docs`` with ``fingerprint``."""
    if config.most > 255:
        raise ValueError("a chunk is at most 255 bytes")

    def compute(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        value, length, ranges = digests(data, offsets, config)
        return [pa.array([shown(value[a:b], length[a:b]) for a, b in zip(ranges, ranges[1:])], pa.string())]

    return K.add_columns(docs, compute, [T.StructField("fingerprint", T.StringType())], text=text)


def edited(text: str, following: str) -> str:
    """``text`` with its later half replaced by the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_PAIR = (
    "{key} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _edges(keys: DataFrame, runs: int) -> list:
    """Order statistics of a bounded sample of keys, picked by hash: at most ``runs`` - 1 of them."""
    total = keys.count()
    some = keys.filter(F.col("_key").isNotNull())
    if total > runs * SAMPLED:  # distinct keys first, or a key that is repeated very often would be picked always or never
        some = some.filter(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) < F.lit(int(runs * SAMPLED / total * (1 << 30)))).distinct()
    picked = sorted(r[0] for r in some.collect())
    return sorted({picked[len(picked) * i // runs] for i in range(1, runs)}) if picked else []


def edited_fingerprints(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", run_bytes: int = 8 << 20, config: ChunkConfig = ChunkConfig()
) -> DataFrame:
    """Each text's fingerprint, that of its edited form, and its containment in that and in the next text.

    The next document follows in key order (nulls first, ties by text); after the last comes
    the first. Keys, of any type that sorts, are cut into runs of about ``run_bytes`` at order statistics of a sample of ``SAMPLED``
    keys a run, at most ``MOST_RUNS``; beyond 160 GB of text runs grow with the table. The first row of a run also goes to the run before, so each run is
    walked in order by one task, which holds about a megabyte of text.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = _PAIR.format(key=f"`{key}`", kind=kind)
    slim = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    total = slim.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    runs = min(int(total // run_bytes) + 1, MOST_RUNS)
    edges: list = []
    if runs > 1:
        edges = _edges(slim.select("_key"), runs)
    dealt = slim.withColumn("_run", _place(F.from_json(F.lit(json.dumps(edges, default=str)), f"array<{kind}>"), len(edges)) if edges else F.lit(0))
    least = F.min(F.struct(F.col("_key").isNotNull().alias("some"), "_key"))
    firsts = sorted((r[0], r[1]) for r in dealt.groupBy("_run").agg(least.alias("f")).select("_run", "f._key").collect())
    if not firsts:  # at most MOST_RUNS rows
        return docs.sparkSession.createDataFrame([], schema)
    before = [firsts[-1], *firsts]
    lead = docs.sparkSession.createDataFrame(
        [(r, k, before[i][0]) for i, (r, k) in enumerate(firsts)], f"_run int, _first {kind}, _to int"
    )
    heads = dealt.join(F.broadcast(lead), "_run").filter(F.col("_key").eqNullSafe(F.col("_first")))
    heads = heads.groupBy("_to", "_run").agg(F.min("_text").alias("_text")).select(
        F.col("_to").alias("_run"), F.lit(1).alias("_tail"), F.lit(None).cast(kind).alias("_key"), "_text"
    )
    rows = dealt.select("_run", F.lit(0).alias("_tail"), "_key", "_text").unionByName(heads)
    placed = rows.repartition(max(len(firsts), 1), "_run").sortWithinPartitions("_run", "_tail", F.asc_nulls_first("_key"), "_text")
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # rows that wait for the text after them
        size = 0
        for batch in batches:
            for run_, tail, k, body in zip(*(batch.column(c).to_pylist() for c in ("_run", "_tail", "_key", "_text"))):
                held.append((tail, k, body))
                size += len(body)
                if len(held) > 1 and (size > (1 << 20) or tail):
                    yield made(held, batch.schema.field("_key").type)
                    held = [] if tail else held[-1:]
                    size = len(body)

    def made(held: list, kind: pa.DataType) -> pa.RecordBatch:
        """Results for all rows held but the last, which is what follows them."""
        texts = [x[2] for x in held]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        own = digests(*K.utf8(pa.array(texts, pa.large_string())), config)
        new = digests(*K.utf8(pa.array(changed, pa.large_string())), config)
        cut = lambda d, i: (d[0][d[2][i] : d[2][i + 1]], d[1][d[2][i] : d[2][i + 1]])
        rows = [
            (
                held[i][1], len(texts[i]), hashlib.sha256(changed[i].encode()).hexdigest(), shown(*cut(own, i)), shown(*cut(new, i)),
                containment(*cut(own, i), cut(new, i)[0]), containment(*cut(own, i), cut(own, i + 1)[0]),
            )
            for i in range(len(changed))
        ]
        kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return placed.mapInArrow(walk, schema)


def _place(bounds, n: int):
    """How many of the sorted bounds are at or below the key, by halving steps."""
    steps, step = [], 1
    while step <= n:
        step *= 2
    while step:
        steps.append(F.lit(step))
        step //= 2
    return F.aggregate(
        F.array(*steps), F.lit(0), lambda low, jump: F.when(F.get(bounds, low + jump - 1) <= F.col("_key"), low + jump).otherwise(low)
    )
