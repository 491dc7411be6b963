r"""The prefix trie of conversations, as double arrays per prefix shard.

A node is a distinct sequence of first turns (role and text); the conversations
that begin with it are its members. Per node: its least member, depth, parent,
members, children, childless nodes below, the words that sharing it and what is
below it saves (members but one, times the words of its last text), and a digest of the
members that end there.

1. Every conversation becomes a path of turn digests, without texts. Equal paths
   become one, with their number, their least member and the digest of all of them.
2. A path's shard is the shortest prefix of 0, 1, 2, 4, ... turns whose paths have at
   most ``shard_turns`` turns in all, or no second path. So a first turn that a third of the table shares
   is split as deep as it takes, and a shard's turns are bounded.
3. A task numbers the turns of its shards densely and packs a trie into two arrays:
   the child of node s by turn c lies in slot t = BASE[s] + c, and CHECK[t] = s. Only
   children take branches to place; ids go by first appearance, so siblings are near each other.
   All paths walk down the arrays together; sums come up level by level.
4. Nodes from a shard's prefix on belong to that shard alone. Those above it are
   shared: each shard passes the totals of its top up to them, they are added up by the digest of
   their prefix, and what they save themselves is added to those above them.

A conversation's turn digests meet in one row (32 bytes a turn, so 60 million turns
at most); its texts never do. The members of one path are hashed as they pass, in order.

Defined cases: null roles and texts are empty; turns go by number, nulls first, then
role, then the digest of their text; rows without a key are one conversation, which sorts after all others,
is shown as null and is the empty string in a digest; repeated rows are turns of their
own; ``members`` without turns end at the root; an empty table has no nodes; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterloom.session import ship_package, written

SHARD_TURNS = 1 << 17
TRIES = 64  # slots looked at for a node of several children before it goes behind all others
_LAST = 2**63 - 1


# --- double array ----------------------------------------------------------------------


class DoubleArray:
    """BASE and CHECK of the trie of sequences ``ids[offsets[i] : offsets[i + 1]]``; slot 0 is the root."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray):
        self.base, self.check = np.zeros(1, np.int64), np.full(1, -1, np.int64)
        self._used, self._low, self._top = np.ones(1, bool), 1, 1
        many = int(ids.max()) + 1 if len(ids) else 1
        at, lengths = np.zeros(len(offsets) - 1, np.int64), np.diff(offsets)
        for depth in range(int(lengths.max(initial=0))):
            on = np.flatnonzero(lengths > depth)
            pairs, which = np.unique(at[on] * many + ids[offsets[on] + depth], return_inverse=True)
            at[on] = self._place(pairs // many, pairs % many)[which]
        self.base, self.check = self.base[: self._top], self.check[: self._top]

    def _room(self, size: int) -> None:
        if size > len(self._used):
            more = max(size, 2 * len(self._used)) - len(self._used)
            self._used = np.append(self._used, np.zeros(more, bool))
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))

    def _take(self, slots: np.ndarray, parents, ids: np.ndarray) -> None:
        self._used[slots], self.check[slots], self.base[parents] = True, parents, slots - ids
        self._top = max(self._top, int(slots.max()) + 1)

    def _free(self, most: int) -> np.ndarray:
        """The lowest free slots, at least ``most`` of them."""
        self._room(self._top + most)
        full = self._used[self._low : self._top]
        self._low = self._low + int(np.argmin(full)) if not full.all() else self._top
        return self._low + np.flatnonzero(~self._used[self._low : self._top + most])[:most]

    def _place(self, parents: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Slots for children given by parent, then id."""
        starts = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        sizes = np.diff(np.append(starts, len(parents)))
        slots = np.empty(len(parents), np.int64)
        for lo, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            apart = ids[lo : lo + size] - ids[lo]
            self._room(self._top + int(apart[-1]) + 1)
            found = self._top
            if size < TRIES:
                for slot in self._free(TRIES).tolist():
                    self._room(slot + int(apart[-1]) + 1)
                    if not self._used[slot + apart].any():
                        found = slot
                        break
            slots[lo : lo + size] = found + apart
            self._take(slots[lo : lo + size], parents[lo : lo + size], ids[lo : lo + size])
        one = starts[sizes == 1]
        if len(one):
            slots[one] = self._free(len(one))
            self._take(slots[one], parents[one], ids[one])
        return slots

    def step(self, nodes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The children of nodes by turn id, -1 where there is none."""
        to = self.base[nodes] + ids
        there = (to > 0) & (to < len(self.check))
        return np.where(there & (self.check[np.where(there, to, 0)] == nodes), to, -1)


# --- tasks -----------------------------------------------------------------------------

_NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, top boolean, prefix array<string>, prefix_words array<long>"
)


def _flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


def trie_nodes(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Nodes of whole shards. Columns: g, level, path, words, n, first, sha; rows in the order of g and path.

    A top node (``top``) has its prefix; a path that ends above its shard's prefix is one
    row without a node (``top`` null), with all of its path as prefix.
    """
    shard, path, words = rows["g"].dictionary_encode(), rows["path"], rows["words"]
    level, n, first = (rows[c].to_numpy() for c in ("level", "n", "first"))
    turns, offsets = _flat(path)
    ids = turns.dictionary_encode().indices.to_numpy().astype(np.int64) if len(turns) else np.zeros(0, np.int64)
    weight = _flat(words)[0].to_numpy()
    lengths = np.diff(offsets)
    short = np.flatnonzero(lengths < level)
    inside = np.flatnonzero(lengths >= level)

    # One trie for all shards of the batch: the first id of a sequence is its shard.
    left = lengths[inside] - level[inside] + 1
    ends = np.append(0, np.cumsum(left))
    owner = np.repeat(np.arange(len(inside)), left)
    at = np.arange(len(owner)) - ends[owner]  # 0 is the shard, 1 the first turn below its prefix
    below, turn = at > 0, (offsets[inside] + level[inside] - 1)[owner] + at
    sequence = shard.indices.to_numpy().astype(np.int64)[inside][owner]
    sequence[below] = ids[turn[below]]
    trie = DoubleArray(sequence, ends)

    size = len(trie.check)
    members, least, depth, end = np.zeros(size, np.int64), np.full(size, _LAST), np.zeros(size, np.int64), np.full(size, -1)
    heft, via = np.zeros(size, np.int64), np.zeros(size, np.int64)
    node, on, levels = np.zeros(len(inside), np.int64), np.arange(len(inside)), []
    for d in range(int(left.max(initial=0))):
        on = on[left[on] > d]
        to = trie.step(node[on], sequence[ends[on] + d])
        if (to < 0).any():
            raise AssertionError("a path leaves the trie")
        source = inside[on]
        node[on] = to
        np.add.at(members, to, n[source])
        np.minimum.at(least, to, first[source])
        depth[to], via[to] = level[source] + d, source
        known = depth[to] > 0
        heft[to[known]] = weight[offsets[source[known]] + depth[to[known]] - 1]
        done = left[on] == d + 1
        end[to[done]] = source[done]
        levels.append(np.unique(to))

    children = np.bincount(trie.check[trie.check >= 0], minlength=size)
    leaves, saved = (children == 0).astype(np.int64), (members - 1) * heft
    for nodes in reversed(levels[1:]):
        np.add.at(leaves, trie.check[nodes], leaves[nodes])
        np.add.at(saved, trie.check[nodes], saved[nodes])

    tops = levels[0] if levels else np.zeros(0, np.int64)
    rest = np.concatenate(levels[1:]) if len(levels) > 1 else np.zeros(0, np.int64)
    nodes = np.concatenate([tops, rest])
    none, many = len(short), len(nodes)
    sha = rows["sha"].take(pa.array(np.append(end[nodes], short), mask=np.append(end[nodes] < 0, np.zeros(none, bool))))
    prefix = [path[i].values[:k].to_pylist() for i, k in zip(via[tops].tolist(), depth[tops].tolist())]
    heavy = [words[i].values[:k].to_pylist() for i, k in zip(via[tops].tolist(), depth[tops].tolist())]
    over = [None] * len(rest)
    zero = np.zeros(none, np.int64)
    columns = [
        np.append(least[nodes], first[short]), np.append(depth[nodes], lengths[short]),
        pa.array(np.concatenate([np.zeros(len(tops), np.int64), least[trie.check[rest]], zero]),
                 mask=np.concatenate([np.ones(len(tops), bool), np.zeros(len(rest), bool), np.ones(none, bool)])),
        np.append(members[nodes], n[short]), np.append(children[nodes], zero), np.append(leaves[nodes], zero), np.append(saved[nodes], zero),
        sha, pa.array([True] * len(tops) + [False] * len(rest) + [None] * none, pa.bool_()),
        pa.array(prefix + over + [path[i].as_py() for i in short.tolist()], pa.list_(pa.string())),
        pa.array(heavy + over + [words[i].as_py() for i in short.tolist()], pa.list_(pa.int64())),
    ]
    assert many + none == len(columns[0])
    names = [c.strip().split()[0] for c in _NODE.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole shards of a partition sorted by shard, about ``SHARD_TURNS`` turns at once."""
    held, turns = [], 0

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        turns += batch.num_rows + len(_flat(batch["path"])[0])
        if turns < SHARD_TURNS:
            continue
        rows = whole()
        same = np.asarray(rows["g"].to_numpy(zero_copy_only=False) == rows["g"][-1].as_py())
        cut = int(np.argmax(same))  # the last shard may go on
        if cut:
            yield trie_nodes(rows.slice(0, cut))
            held = [rows.slice(cut)]
        else:
            held = [rows]
        turns = held[0].num_rows + len(_flat(held[0]["path"])[0])
    if held:
        yield trie_nodes(whole())


def _member_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (path digest, key) in order: number, least key and SHA-256 of the comma-joined keys of each path."""
    now, sha, n, first, out = None, None, 0, 0, []
    names = ["pd", "n", "first", "sha"]

    def made() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    for batch in batches:
        for path, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            said = b"" if key == _LAST else b"%d" % key
            if path == now:
                sha.update(b"," + said)
                n += 1
                continue
            if now is not None:
                out.append((now, n, first, sha.hexdigest()))
            now, sha, n, first = path, hashlib.sha256(said), 1, key
        if len(out) >= 4096:
            yield made()
            out.clear()
    if now is not None:
        out.append((now, n, first, sha.hexdigest()))
        yield made()


# --- operator --------------------------------------------------------------------------


def _paths(turns: DataFrame, members: DataFrame | None, key: str, turn: str, role: str, text: str) -> DataFrame:
    """``key, path, words, pd``: every conversation as digests and word counts of its turns."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    who = F.coalesce(F.col(key).cast("bigint"), F.lit(_LAST)).alias("key")
    said = turns.select(who, F.col(turn).cast("bigint").alias("turn"), plain(role).alias("role"), plain(text).alias("text"))
    slim = said.select(
        "key",
        F.struct(
            F.coalesce("turn", F.lit(-(2**63))).alias("turn"), "role", F.md5("text").alias("m"),
            F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("d"),
            F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("w"),
        ).alias("t"),
    )
    if members is not None:
        slim = slim.unionByName(members.select(who).distinct().withColumn("t", F.lit(None)), allowMissingColumns=True)
    rows = slim.groupBy("key").agg(F.array_sort(F.collect_list("t")).alias("t"))
    rows = rows.select("key", F.col("t.d").alias("path"), F.col("t.w").alias("words"))
    return rows.withColumn("pd", F.md5(F.array_join("path", "")))


def _sharded(paths: DataFrame, shard_turns: int) -> DataFrame:
    """``paths`` with ``level`` and ``g``, the shard of each."""
    size = F.size("path")
    steps = F.explode(F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int") + 1))
    rows = paths.select("pd", "path", steps.alias("i")).withColumn(
        "level", F.expr("if(i = 0, 0, shiftleft(1, greatest(i - 1, 0)))")
    )
    prefix = F.array_join(F.slice("path", F.lit(1), F.col("level")), "")
    mark = F.when(size < F.col("level"), ".").otherwise("")  # a path that ends before is alone in its group
    rows = rows.select(
        "pd", F.col("level").cast("bigint").alias("level"), (size + 1).alias("turns"),
        F.md5(F.concat(F.col("level").cast("string"), F.lit(":"), prefix, mark)).alias("g"),
    )
    crowded = rows.groupBy("g").agg(F.sum("turns").alias("all"), F.count(F.lit(1)).alias("many"))
    crowded = crowded.filter((F.col("all") > shard_turns) & (F.col("many") > 1)).select("g")
    chosen = rows.join(crowded, "g", "left_anti").groupBy("pd").agg(F.min(F.struct("level", "g")).alias("at"))
    return paths.join(chosen, "pd").select("at.g", "at.level", "path", "words", "n", "first", "sha")


def _shared(tops: DataFrame) -> tuple[DataFrame, Column]:
    """Nodes above the shards, and the digest of the node above a top."""
    digest = lambda i: F.md5(F.array_join(F.slice("prefix", F.lit(1), i), ""))
    size = F.size("prefix")
    last = F.when(F.col("top"), size - 1).otherwise(size)  # depth of the deepest shared node
    chain = tops.filter(last >= 0).select(
        "conv_id", "n_convs", "n_leaves", "saved_tokens", "ends_sha256", "top", "prefix_words", last.alias("last"),
        F.transform(F.sequence(F.lit(0), last), digest).alias("above"),
    ).select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("i"))
    at_end = F.col("i") == F.col("last")
    nodes = chain.select(
        F.get("above", F.col("i")).alias("node"), F.get("above", F.col("i") - 1).alias("parent"),
        F.slice("above", F.lit(1), F.col("i") + 1).alias("above"), F.col("i").cast("bigint").alias("depth"),
        F.coalesce(F.get("prefix_words", F.col("i") - 1), F.lit(0)).alias("w"), "conv_id", "n_convs", "n_leaves", "saved_tokens",
        F.when(at_end & F.col("top").isNull(), F.col("ends_sha256")).alias("ends_sha256"),
        F.when(at_end & F.col("top"), 1).otherwise(0).alias("child"),
    ).groupBy("node", "parent", "depth", "w").agg(
        F.any_value("above").alias("above"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"),
        F.sum("child").alias("tops"),
    )
    nodes = written(nodes, "shared-nodes")
    under = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("inner"), F.min("depth").alias("_")
    ).drop("_")
    nodes = nodes.join(under, "node", "left").withColumn("n_children", F.coalesce("inner", F.lit(0)) + F.col("tops"))
    own = nodes.select(
        F.explode("above").alias("node"), F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("w")).alias("own"),
    ).groupBy("node").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    heads = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    done = nodes.join(own, "node").join(heads, "parent", "left").select(
        "node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved_tokens") + F.col("own")).alias("saved_tokens"), "ends_sha256",
    )
    return done, digest(size - 1)


def prefix_trie(
    turns: DataFrame, members: DataFrame | None = None, *, key: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", shard_turns: int = SHARD_TURNS,
) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node.

    ``members`` (column ``key``) names conversations that may have no turns.
    """
    ship_package(turns.sparkSession)
    talks = written(_paths(turns, members, key, turn, role, text), "paths")
    in_order = talks.select("pd", "key").repartition("pd").sortWithinPartitions("pd", "key")
    ends = in_order.mapInArrow(_member_digests, "pd string, n long, first long, sha string")
    paths = written(talks.join(ends.withColumn("key", F.col("first")), ["pd", "key"]).drop("key"), "distinct-paths")
    dealt = _sharded(paths, shard_turns).repartition("g").sortWithinPartitions("g", "path")
    nodes = written(dealt.mapInArrow(_shards, _NODE), "nodes")
    shared, above = _shared(nodes.filter("prefix IS NOT NULL"))
    shared = written(shared, "shared")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    heads = shared.select(F.col("node").alias("_above"), F.col("conv_id").alias("_head"))
    tops = nodes.filter("top").withColumn("_above", F.when(F.size("prefix") > 0, above)).join(heads, "_above", "left")
    tops = tops.withColumn("parent_conv_id", F.col("_head")).select(columns)
    every = nodes.filter("NOT top").select(columns).unionByName(tops).unionByName(shared.select(columns))
    shown = lambda c: F.when(F.col(c) != _LAST, F.col(c)).alias(c)
    return every.select(
        shown("conv_id"), "depth", shown("parent_conv_id"), *columns[3:7], F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )
