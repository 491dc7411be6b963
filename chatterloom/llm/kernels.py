"""Vectorised text primitives that run inside tasks on Arrow string buffers.

All of them work on the UTF-8 bytes of many texts at once: ``data`` is the
concatenation of the texts and ``offsets`` (one more than texts) delimits them.
A null text is an empty text. Results depend on a text alone, never on its
neighbours or on how rows are batched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chatterloom.session import ship_package

# Texts handled at once; a longer text is handled alone, whole. The arrays made of a piece take some 35
# times its size, and a worker keeps much of that memory.
PIECE_BYTES = 1 << 19

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)

_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x41:0x5B] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, offsets starting at 0."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, ends, values = column.buffers()
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about ``limit`` bytes of text each, and at most ``most`` rows."""
    _, offsets = utf8(batch.column(text))
    at, rows = 0, batch.num_rows
    while at < rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), rows, at + (most or rows))
        yield batch.slice(at, to - at)
        at = to


def keyed_texts(batch: pa.RecordBatch) -> Iterator[tuple[object, str]]:
    """Key and text of every row of a batch of two columns; the texts of one piece are strings at a time."""
    for part in pieces(batch, batch.schema.names[1]):
        yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


def add_columns(
    df: DataFrame,
    compute: Callable[[np.ndarray, np.ndarray], list[pa.Array]],
    fields: list[T.StructField],
    *,
    text: str = "text",
    keep: list[str] | None = None,
    most_rows: int | None = None,
) -> DataFrame:
    """``df`` with columns computed from its whole texts, at most ``most_rows`` at a time.

    A column of ``df`` that has the name of a new one is replaced by it.
    """
    ship_package(df.sparkSession)
    new = [f.name for f in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    source = df.select(*dict.fromkeys([*kept, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text, most=most_rows):
                made = compute(*utf8(part.column(text)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *made], names=[*kept, *new])

    schema = T.StructType([*[source.schema[c] for c in kept], *fields])
    return source.mapInArrow(run, schema)


def free_name(base: str, taken: list[str]) -> str:
    """A column name that no column has yet."""
    while base.lower() in {c.lower() for c in taken}:
        base += "_"
    return base


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        _powers[:] = []
        for base in (_BASE, _INV):
            out = np.empty(size, np.uint64)
            out[0] = 1
            done, step = 1, base
            while done < size:  # doubling: x**(i + done) = x**i * x**done
                more = min(done, size - done)
                np.multiply(out[:more], np.uint64(step), out=out[done : done + more])
                done, step = done + more, step * step % (1 << 64)
            _powers.append(out)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit content hash of every span; equal bytes give equal hashes wherever they lie."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and per text the range of its words.

    A word is a maximal run of ASCII letters, digits and non-ASCII characters
    (at byte level: every byte from 0x80 up belongs to one).
    """
    size = len(data)
    inside = _IS_WORD[data]
    before = np.empty(size, bool)
    after = np.empty(size, bool)
    if size:
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[offsets[:-1][offsets[:-1] < size]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, ranges per text and case-insensitive hashes of all words."""
    starts, ends, ranges = word_spans(data, offsets)
    return starts, ends, ranges, span_hashes(LOWER[data], starts, ends)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of ``width``-word shingles per text, and their ranges.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    _, _, ranges, hashes = words(data, offsets)
    counts = np.diff(ranges)
    n = len(hashes)
    value = np.zeros(n, np.uint64)
    left = np.repeat(ranges[1:], counts) - np.arange(n)  # words from here to the end of the text
    factor = 1
    for i in range(width):
        factor = factor * int(_MUL) % (1 << 64)
        stop = max(n - i, 0)
        value[:stop] += np.where(left[:stop] > i, hashes[i:], np.uint64(0)) * np.uint64(factor)
    first = np.zeros(n, bool)
    first[ranges[:-1][counts > 0]] = True
    keep = (left >= width) | (first & (left < width))
    owner = np.repeat(np.arange(len(counts)), counts)[keep]
    value = mix(value[keep])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(len(counts) + 1))


def multipliers(count: int, seed: int = 0x5EED) -> np.ndarray:
    """Odd factors of the min-wise hash family."""
    base = np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed << 20)
    return mix(base * _MUL) | np.uint64(1)


def minhashes(values: np.ndarray, ranges: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One row of 32-bit minima per text; every text must have a value."""
    out = np.empty((len(ranges) - 1, len(factors)), np.uint32)
    if len(out):
        scratch = np.empty_like(values)
        for k, factor in enumerate(factors):
            np.multiply(values, factor, out=scratch)
            out[:, k] = np.minimum.reduceat(scratch, ranges[:-1]) >> np.uint64(32)
    return out
