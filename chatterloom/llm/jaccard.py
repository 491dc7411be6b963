"""N-gram Jaccard join with Bayesian candidate pruning.

Two texts are linked when the Jaccard similarity of their sets of word shingles
is at least a threshold. The join keeps rows per document, never per pair:

1. every text gets the digest of its shingle set and the hashes of its MinHash
   bands; texts with equal sets become one node (copies are counted, not paired);
2. nodes that share a band meet through the least node of that band, its leader.
   Any two nodes that share a band share a leader, and a node has few leaders;
3. a leader's group is compared inside a task. A large group is cut into blocks
   and every pair of blocks is one task, so no group need fit into one;
4. a task compares MinHash values 16 at a time and drops a pair as soon as the
   posterior probability (uniform prior) that its similarity reaches the
   threshold falls below ``tolerance``; what is left is verified on the full sets;
5. tasks return link counts and a local root per node; roots become components.

36 bands of 5 values miss a pair of similarity exactly 0.8 with probability
6.2e-7. ``tolerance`` is a posterior at one round, not a loss: at 1e-8 all rounds
together drop such a pair with probability 6.2e-8. Both together lose it with
probability 6.8e-7, and pairs above 0.8 less often.

Defined cases: a text of fewer words than a shingle, but not none, has one
shingle of all its words; null and word-less texts link with nothing and are
classes of their own. A null key sorts after all others, and a class of null
keys only has a null id. Repeated rows are copies. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatterloom.llm import kernels as K
from chatterloom.llm.components import components
from chatterloom.session import ship_package, written

_LAST = 2**63 - 1


@dataclass(frozen=True)
class JaccardConfig:
    threshold: str = "0.8"
    width: int = 5
    bands: int = 36
    rows: int = 5
    compared: int = 64
    step: int = 16
    tolerance: float = 1e-8
    block_nodes: int = 1024
    block_bytes: int = 8 << 20


def least_matches(config: JaccardConfig) -> list[int]:
    """Matches needed after 16, 32, ... compared values to stay in.

    With a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    t, out = float(Fraction(config.threshold)), []
    for n in range(config.step, config.compared + 1, config.step):
        total, m = 0.0, -1
        while m < n:
            total += comb(n + 1, m + 1) * t ** (m + 1) * (1 - t) ** (n - m)
            if total >= config.tolerance:
                break
            m += 1
        out.append(m + 1)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _fingerprints(config: JaccardConfig):
    factors = K.multipliers(config.bands * config.rows)

    def compute(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        values, ranges = K.shingles(data, offsets, config.width)
        n = np.diff(ranges)
        some = np.flatnonzero(n)
        sums = np.zeros((2, len(n)), np.uint64)
        bands = np.zeros((len(some), config.bands), np.uint64)
        if len(some):
            starts = ranges[:-1][some]
            sums[0, some] = np.add.reduceat(K.mix(values ^ np.uint64(0xA5A5A5A5)), starts)
            sums[1, some] = np.add.reduceat(K.mix(values + np.uint64(0x1234567)), starts)
            mins = K.minhashes(values, np.append(starts, len(values)), factors).astype(np.uint64)
            for b in range(config.bands):
                bands[:, b] = np.uint64(b + 1)
                for r in range(config.rows):
                    bands[:, b] = K.mix(bands[:, b] * np.uint64(31) + mins[:, b * config.rows + r])
        ends = np.concatenate([[0], np.cumsum(np.where(n > 0, config.bands, 0))])
        listed = K.lists(_signed(bands.ravel()), ends, pa.int64())
        return [pa.array(n, pa.int64()), pa.array(_signed(sums[0])), pa.array(_signed(sums[1])), listed]

    return compute


_NODE = [
    T.StructField("n", T.LongType()),
    T.StructField("d1", T.LongType()),
    T.StructField("d2", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())),
]


def _compare(config: JaccardConfig):
    """The task side: links and a local root for every node of a block pair."""
    least = least_matches(config)
    limit = Fraction(config.threshold)
    up, down = limit.numerator, limit.denominator
    factors = K.multipliers(config.compared)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        leader, left, right = (x.as_py() for x in key)
        table = table.combine_chunks()
        nodes, first = np.unique(table["node"].to_numpy(), return_index=True)  # repeated rows are dropped here
        table = table.take(pa.array(first))
        copies, block = table["copies"].to_numpy(), table["block"].to_numpy()
        smaller = [frozenset(x for x in row if x < leader) for row in table["leaders"].to_pylist()]
        batch = table.select(["text"]).combine_chunks().to_batches()[0]
        parts = [K.shingles(*K.utf8(p.column(0)), config.width) for p in K.pieces(batch, "text")]
        vocabulary, ids = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        sizes = np.concatenate([np.diff(p[1]) for p in parts])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        signs = K.minhashes(vocabulary[ids], ends, factors)

        mine, theirs = np.flatnonzero(block == left), np.flatnonzero(block == right)
        links, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        mark = np.zeros(len(vocabulary), bool)
        for lo in range(0, len(mine), 128):
            a, b = _survivors(signs, mine[lo : lo + 128], theirs, left == right, least, config.step)
            for x in np.unique(a).tolist():
                y = b[a == x]
                mark[ids[ends[x] : ends[x + 1]]] = True
                inter = np.array([np.count_nonzero(mark[ids[ends[j] : ends[j + 1]]]) for j in y.tolist()])
                mark[ids[ends[x] : ends[x + 1]]] = False
                y = y[inter * down >= up * (sizes[x] + sizes[y] - inter)]
                joined = np.unique(np.append(label[y], label[x]))
                if len(joined) > 1:
                    label[np.isin(label, joined)] = joined[0]
                if smaller[x]:  # the pair is counted in the group of its least common leader
                    y = y[[smaller[x].isdisjoint(smaller[j]) for j in y.tolist()]] if len(y) else y
                links[x] += copies[y].sum()
                links[y] += copies[x]
        return pa.table({"node": nodes, "links": links, "root": nodes[label]})

    return run


def _survivors(signs, mine, theirs, same, least, step):
    """Index pairs that no round of comparisons dropped."""
    matches = np.zeros((len(mine), len(theirs)), np.int16)
    for k in range(step):
        matches += signs[mine, k][:, None] == signs[theirs, k][None, :]
    kept = matches >= least[0]
    if same:
        kept &= mine[:, None] < theirs[None, :]
    i, j = np.nonzero(kept)
    found, a, b = matches[i, j].astype(np.int32), mine[i], theirs[j]
    for round_, needed in enumerate(least[1:], start=1):
        for lo in range(0, len(a), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            at = slice(round_ * step, (round_ + 1) * step)
            found[part] += (signs[a[part], at] == signs[b[part], at]).sum(1, dtype=np.int32)
        kept = found >= needed
        found, a, b = found[kept], a[kept], b[kept]
    return a, b


def _id(key: str) -> Column:
    return F.coalesce(F.col(key).cast("bigint"), F.lit(_LAST))


@dataclass(frozen=True)
class _Joined:
    rows: DataFrame  # id, th, n, d1, d2 of every row
    nodes: DataFrame  # d1, d2, id, th, copies, class_id, class_th, links


def _join(docs: DataFrame, key: str, text: str, config: JaccardConfig) -> _Joined:
    ship_package(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(_id(key).alias("id"), body.alias("text"))
    rows = K.add_columns(
        slim.select("id", F.xxhash64("text").alias("th"), F.octet_length("text").alias("bytes"), "text"),
        _fingerprints(config), _NODE, keep=["id", "th", "bytes"],
    )
    rows = written(rows, "shingle-sets")
    who = F.min(F.struct("id", "th"))
    one = rows.filter("n > 0").groupBy("d1", "d2").agg(
        who.alias("w"), F.count(F.lit(1)).alias("copies"), F.min("bytes").alias("bytes"), F.any_value("bands").alias("bands")
    )
    nodes = written(
        one.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "w.id", "w.th", "copies", "bytes", "bands"),
        "nodes",
    )
    in_band = nodes.select("node", F.explode("bands").alias("band"))
    led = in_band.groupBy("band").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    members = written(in_band.join(led.drop("many"), "band").select("node", "leader").distinct(), "members")

    facts = nodes.select("node", "id", "th", "copies", "bytes")
    size = members.join(facts.select("node", "bytes"), "node").groupBy("leader").agg(
        F.count(F.lit(1)).alias("many"), F.sum("bytes").alias("bytes")
    )
    blocks = F.ceil(F.greatest(F.col("many") / config.block_nodes, F.col("bytes") / config.block_bytes)).cast("int")
    leaders = members.groupBy("node").agg(F.collect_set("leader").alias("leaders"))
    placed = (
        members.join(size.select("leader", blocks.alias("blocks")), "leader")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "leader", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .join(leaders, "node")
        .join(facts.drop("bytes"), "node")
    )
    texts = slim.select("id", F.xxhash64("text").alias("th"), "text")
    compared = (
        texts.join(placed, ["id", "th"])
        .select("leader", "i", "j", "node", "block", "copies", "leaders", "text")
        .groupBy("leader", "i", "j")
        .applyInArrow(_compare(config), "node long, links long, root long")
    )
    compared = written(compared.groupBy("node", "root").agg(F.sum("links").alias("links")), "links")
    roots = written(components(compared.select(F.col("node").alias("u"), F.col("root").alias("v"))), "roots")
    counts = compared.groupBy("node").agg(F.sum("links").alias("links"))
    best = roots.join(facts, "node").groupBy("root").agg(F.min(F.struct("id", "th")).alias("best"))
    linked = roots.join(best, "root").join(counts, "node").select(
        "node", F.col("best.id").alias("class_id"), F.col("best.th").alias("class_th"), "links"
    )
    out = nodes.drop("bands", "bytes").join(linked, "node", "left").select(
        "d1", "d2", "id", "th", "copies",
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("class_th", "th").alias("class_th"),
        F.coalesce("links", F.lit(0)).alias("links"),
    )
    return _Joined(rows.drop("bands", "bytes"), out)


def near_duplicate_classes(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", config: JaccardConfig = JaccardConfig()
) -> DataFrame:
    """One row per document: its key, ``class_id`` (least key of its component of
    linked documents), ``copy_id`` (least key with the same shingle set) and
    ``n_links`` (other documents it is linked with, copies included)."""
    joined = _join(docs, key, text, config)
    per_set = joined.nodes.select(
        "d1", "d2", "class_id", F.col("id").alias("copy_id"), (F.col("links") + F.col("copies") - 1).alias("n_links")
    )
    own = F.col("n") == 0
    shown = lambda c: F.when(c != _LAST, c)
    return joined.rows.join(per_set, ["d1", "d2"], "left").select(
        shown(F.col("id")).alias(key),
        shown(F.when(own, F.col("id")).otherwise(F.col("class_id"))).alias("class_id"),
        shown(F.when(own, F.col("id")).otherwise(F.col("copy_id"))).alias("copy_id"),
        F.when(own, F.lit(0)).otherwise(F.col("n_links")).cast("bigint").alias("n_links"),
    )


def deduplicate(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", config: JaccardConfig = JaccardConfig()
) -> DataFrame:
    """``docs`` with one row of each class, the one with the least key. Word-less texts stay.

    Of rows with one key and text, the one with the least hash of all its columns stays.
    """
    joined = _join(docs, key, text, config)
    kept = joined.nodes.filter("id = class_id AND th = class_th").select("id", "th")
    kept = kept.unionByName(joined.rows.filter("n = 0").select("id", "th").distinct())
    # The input's columns travel in one struct, so that none of them meets a name used here.
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    named = docs.select(
        _id(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(*hashed).alias("h"),
    )
    one = named.join(kept, ["id", "th"], "left_semi").groupBy("id", "th").agg(F.min_by("row", "h").alias("row"))
    return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
