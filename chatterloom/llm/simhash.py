r"""SimHash near-duplicates over shards of BK-trees.

A text's fingerprint has bit b set if more than half of its word shingles,
repeats included, have it set in their XXH64 (UTF-8, seed 42). Documents whose
fingerprints differ in at most ``radius`` bits are linked; a document's component
is the least key that links lead to.

1. Equal fingerprints become one node; copies are counted, never paired.
2. Nodes are dealt to shards: 64 bits are cut into blocks, and two fingerprints
   within the radius agree on all but ``radius`` of them. So there is a shard for
   every choice of the other blocks and every value of their bits, and each
   linked pair meets in one of a node's 20 shards (6 blocks, radius 3).
3. A shard of more than ``shard_nodes`` is dealt again, on blocks of the bits that
   its choice left free. Each time half of the free bits go, so after three times
   no shard has over 512 different fingerprints, whatever the table holds.
4. A task builds the trees of its shards and searches them for every node. A
   child hangs under its parent at an edge keyed by their Hamming distance; from
   a node at distance d only edges d - radius ... d + radius are followed. All
   trees of a task are built and searched together, level by level, as arrays.
5. Links become one root per node and shard, and those become components.

A tree goes to the rows that can match it by the shuffle that deals the shards.
A broadcast of all trees would take fingerprints of all documents through the
driver, and every row would have to search every tree.

Defined cases: lower case and white space are ASCII's; a text of fewer than three
words is one shingle; null and word-less texts have fingerprint 0, which links
like any other. A null key sorts after all others, and a component of null keys
only has a null id. Repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from chatterloom.llm import kernels as K
from chatterloom.llm.components import components
from chatterloom.session import ship_package, written

SEED = 42
HASHED_AT_ONCE = 1 << 16
PAIRS_AT_ONCE = 1 << 21
LEAST_SHARD = 512  # different fingerprints that a shard can have after three dealings
_EDGES = 65  # a node has an edge for each Hamming distance 0 ... 64
_LAST = 2**63 - 1

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[0x20] = _IS_SPACE[0x09:0x0E] = True


@dataclass(frozen=True)
class SimHashConfig:
    width: int = 3
    radius: int = 3
    blocks: int = 6
    shard_nodes: int = 4096


# --- fingerprints --------------------------------------------------------------------


def shingle_spans(data: np.ndarray, offsets: np.ndarray, width: int):
    """Lower-cased words with one space between them, and for each shingle its start, end and text."""
    texts = len(offsets) - 1
    apart = np.insert(data, offsets[1:-1], 0x20)  # no word runs on into the next text
    inside = ~_IS_SPACE[apart]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ranges = np.append(np.searchsorted(starts, offsets[:-1] + np.arange(texts)), len(starts))
    kept = inside.copy()
    kept[ends[ends < len(kept)]] = True
    joined = np.where(inside, K.LOWER[apart], 0x20)[kept].astype(np.uint8)
    lengths = ends - starts
    begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(starts) else starts
    counts = np.diff(ranges)
    left = np.repeat(ranges[1:], counts) - np.arange(len(starts))  # words from here to the end of the text
    first = np.zeros(len(starts), bool)
    first[ranges[:-1][counts > 0]] = True
    at = np.flatnonzero((left >= width) | first)
    last = at + np.minimum(left[at], width) - 1
    return joined, begin[at], begin[last] + lengths[last], np.repeat(np.arange(texts), counts)[at]


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int = 3) -> np.ndarray:
    texts = len(offsets) - 1
    joined, starts, ends, owner = shingle_spans(data, offsets, width)
    votes, total = np.zeros((texts, 64), np.int64), np.bincount(owner, minlength=texts)
    view = memoryview(joined.tobytes())
    for lo in range(0, len(starts), HASHED_AT_ONCE):
        part = slice(lo, lo + HASHED_AT_ONCE)
        spans = map(view.__getitem__, map(slice, starts[part].tolist(), ends[part].tolist()))
        hashes = np.fromiter(map(xxh64_intdigest, spans, repeat(SEED)), np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        mine = owner[part]
        heads = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
        votes[mine[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    on = votes * 2 > total[:, None]
    return np.packbits(on, axis=1, bitorder="little").view("<u8").astype(np.uint64).ravel()


# --- trees ---------------------------------------------------------------------------


class Forest:
    """A BK-tree for every group of different fingerprints; ``group`` is sorted.

    ``edges`` holds parent * 65 + distance of every child, sorted, and ``children`` the
    child there. The root of a group is its first fingerprint.
    """

    def __init__(self, group: np.ndarray, values: np.ndarray):
        self.values, todo, slot = values, np.arange(len(values)), group
        edges, children, roots = [], [], None
        while len(todo):
            head = np.append(True, slot[1:] != slot[:-1])
            nodes = todo[head]
            if roots is None:
                roots = nodes[np.cumsum(head) - 1]
            else:
                edges.append(slot[head])
                children.append(nodes)
            parent = nodes[np.cumsum(head) - 1][~head]
            todo = todo[~head]
            slot = parent * _EDGES + np.bitwise_count(values[todo] ^ values[parent])
            order = np.argsort(slot, kind="stable")
            todo, slot = todo[order], slot[order]
        self.roots = todo if roots is None else roots
        none = np.zeros(0, np.int64)
        edges, children = np.concatenate([none, *edges]), np.concatenate([none, *children])
        order = np.argsort(edges)
        self.edges, self.children = edges[order], children[order]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, earlier member of its group) within the radius, a level of the trees at a time."""
        node = self.roots[queries]
        while len(queries):
            d = np.bitwise_count(self.values[queries] ^ self.values[node]).astype(np.int64)
            near = (d <= radius) & (node < queries)
            yield queries[near], node[near]
            low = np.searchsorted(self.edges, node * _EDGES + np.maximum(d - radius, 0))
            many = np.searchsorted(self.edges, node * _EDGES + np.minimum(d + radius, 64), side="right") - low
            queries = np.repeat(queries, many)
            node = self.children[np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(queries))]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked members the least label among them, in place; labels name their own root."""
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low < high
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        above = label[label]
        while not np.array_equal(above, label):
            label[:] = above
            above = label[label]


def linked(group: np.ndarray, values: np.ndarray, radius: int) -> np.ndarray:
    """The least member that links inside the group lead to, for every member."""
    forest, label = Forest(group, values), np.arange(len(values))
    sizes = np.bincount(group)
    cost = np.cumsum(sizes[group])
    cuts = np.searchsorted(cost, np.arange(0, (cost[-1] if len(cost) else 0) + PAIRS_AT_ONCE, PAIRS_AT_ONCE))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        for a, b in forest.within(np.arange(lo, hi), radius):
            merge(label, a, b)
    return label


# --- shards --------------------------------------------------------------------------


def shard_masks(config: SimHashConfig) -> Iterator[np.ndarray]:
    """The bits that the shards of each dealing agree on: all 64 free at first, about half as many each time."""
    masks = np.zeros(1, np.uint64)
    while True:
        finer = []
        for mask in masks.tolist():
            free = [b for b in range(64) if not mask >> b & 1]
            blocks = [sum(1 << b for b in part.tolist()) for part in np.array_split(free, config.blocks)]
            finer += [mask + sum(c) for c in combinations(blocks, config.blocks - config.radius)]
        masks = np.array(finer, np.uint64)
        yield masks


def _deal(masks: np.ndarray, choices: int):
    """A row per finer shard of every (``path``, ``fp``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path = batch.column(0).to_numpy()[:, None] * choices + np.arange(choices)
            fp = np.broadcast_to(batch.column(1).to_numpy().view(np.uint64)[:, None], path.shape)
            agreed = (fp & masks[path]).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(path.ravel()), pa.array(agreed), pa.array(fp.ravel().view(np.int64))], names=["path", "agreed", "fp"]
            )

    return run


def _search(config: SimHashConfig, most: int):
    """Over rows sorted by shard: ``fp, root`` of linked nodes; ``path, fp`` of shards above ``most``."""

    def out(path: np.ndarray, fp: np.ndarray, root: np.ndarray | None) -> pa.RecordBatch:
        roots = pa.nulls(len(fp), pa.int64()) if root is None else pa.array(root)
        return pa.RecordBatch.from_arrays([pa.array(path), pa.array(fp), roots], names=["path", "fp", "root"])

    def searched(path: np.ndarray, agreed: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        head = np.append(True, (path[1:] != path[:-1]) | (agreed[1:] != agreed[:-1]))
        sizes = np.diff(np.append(np.flatnonzero(head), len(fp)))
        sizes = np.repeat(sizes, sizes)
        if (sizes > most).any():
            yield out(path[sizes > most], fp[sizes > most], None)
        some = (sizes > 1) & (sizes <= most)
        values, group = fp[some].view(np.uint64), np.cumsum(head[some]) - 1
        label = linked(group, values, config.radius)
        moved = np.flatnonzero(label != np.arange(len(label)))
        if len(moved):
            yield out(path[some][moved], fp[some][moved], fp[some][label[moved]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, passing = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            path, agreed, fp = (batch.column(c).to_numpy() for c in range(3))
            if passing is not None:  # the rest of a shard that is too large already
                same = int(np.argmin(np.append((path == passing[0]) & (agreed == passing[1]), False)))
                if same:
                    yield out(path[:same], fp[:same], None)
                    path, agreed, fp = path[same:], agreed[same:], fp[same:]
                if not len(fp):
                    continue
                passing = None
            held.append((path, agreed, fp))
            rows += len(fp)
            if rows < 1 << 17:
                continue
            path, agreed, fp = (np.concatenate(c) for c in zip(*held))
            last = (path == path[-1]) & (agreed == agreed[-1])
            whole = int(np.argmax(last))  # where the last shard, which may go on, begins
            if len(fp) - whole > most:
                passing = path[-1], agreed[-1]
                yield out(path[whole:], fp[whole:], None)
                held, rows = [], 0
            else:
                held, rows = [(path[whole:], agreed[whole:], fp[whole:])], len(fp) - whole
            if whole:
                yield from searched(path[:whole], agreed[:whole], fp[:whole])
        if held:
            yield from searched(*(np.concatenate(c) for c in zip(*held)))

    return run


def linked_fingerprints(nodes: DataFrame, config: SimHashConfig = SimHashConfig()) -> DataFrame:
    """``u, v``: pairs of linked fingerprints (column ``fp`` of ``nodes``, distinct) that connect all that links connect."""
    ship_package(nodes.sparkSession)
    rows, found = nodes.select(F.lit(0).cast("bigint").alias("path"), "fp"), []
    choices, most = comb(config.blocks, config.radius), max(config.shard_nodes, LEAST_SHARD)
    for masks in shard_masks(config):
        dealt = rows.mapInArrow(_deal(masks, choices), "path long, agreed long, fp long")
        met = dealt.repartition("path", "agreed").sortWithinPartitions("path", "agreed")
        seen = written(met.mapInArrow(_search(config, most), "path long, fp long, root long"), "shard-links")
        found.append(seen.filter("root IS NOT NULL").select(F.col("fp").alias("u"), F.col("root").alias("v")))
        rows = seen.filter("root IS NULL").select("path", "fp")
        if 1 << 64 - min(m.bit_count() for m in masks.tolist()) <= most or rows.isEmpty():
            break
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


# --- operator ------------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", config: SimHashConfig = SimHashConfig()
) -> DataFrame:
    """``key, fingerprint`` (16 lower-case hex digits), ``component_id`` of every document."""

    def compute(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        return [pa.array(fingerprints(data, offsets, config.width).view(np.int64))]

    slim = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(_LAST)).alias("id"), F.col(text).alias("text"))
    rows = written(K.add_columns(slim, compute, [T.StructField("fp", T.LongType())], keep=["id"]), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    roots = written(components(linked_fingerprints(nodes.select("fp"), config)), "roots").withColumnRenamed("node", "fp")
    best = roots.join(nodes, "fp").groupBy("root").agg(F.min("id").alias("component"))
    named = nodes.join(roots.join(best, "root"), "fp", "left").select("fp", F.coalesce("component", "id").alias("component"))
    shown = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return rows.join(named, "fp").select(
        shown("id").alias(key),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        shown("component").alias("component_id"),
    )
