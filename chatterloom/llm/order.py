r"""Training-order materialisation: token sequences in a keyed random order, as fixed-stride shards.

1. Texts become token ids; each task packs its documents, one after another and
   each closed by the end-of-text id, into sequences of ``length`` ids, and the
   sequences are written to a table. A sequence's number is its place in that
   table, which is written once, so numbers stay fixed however tasks are rerun.
2. A keyed Feistel network over the least even number of bits that holds all
   numbers, with cycle walking, maps number to slot: a bijection of the numbers
   of the sequences, computed row by row, without a sort or a shuffle of keys.
3. A shard is a range of ``shard_sequences`` slots. Tasks send their sequences
   to the shards in compressed bundles; one task fills a shard's buffer by slot
   and writes it whole: slot s is at byte ``(s % shard_sequences) * 2 * length``
   of shard ``s div shard_sequences`` (after the last sequence comes one newline).

Reading any run of slots opens only the shards that hold it, so training can
resume at a slot. Ids are 16-bit, little-endian. Unused places of a task's last
sequence hold the end-of-text id; ``n_tokens`` says how many are used.

Defined cases: a null or empty text is one end-of-text id; repeated rows are
tokenised again; strings of special tokens in a text are ordinary text; a long
text spans many sequences; an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatterloom.llm import kernels as K
from chatterloom.session import ship_package

# Fixed value: the pattern that the vocabulary's merges were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROUNDS = 6
ZSTD_LEVEL = 9  # ids are kept twice beside the shards, so their size counts
_ENCODERS: dict = {}


@dataclass(frozen=True)
class OrderConfig:
    ranks: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = PATTERN
    end_of_text: int = 50_256
    length: int = 2048
    shard_sequences: int = 4096
    key: int = 0x5EED


def encoder(config: OrderConfig):
    """The tokenizer, built once per Python worker."""
    import tiktoken

    name = (config.ranks, config.pattern)
    if name not in _ENCODERS:
        with open(config.ranks, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[name] = tiktoken.Encoding("ranks", pat_str=config.pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[name]


def permuted(numbers: np.ndarray, count: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """The slot of each number below ``count``: Feistel rounds, repeated while they leave the range."""
    half = max(1, ((max(count - 1, 1)).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = K.mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key))
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (K.mix(right ^ k) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(count)]
    return out.astype(np.int64)


_SEQUENCES = "part int, seq long, n_tokens int, doc_ids array<{kind}>, starts array<long>, counts array<int>, tokens binary"


def token_sequences(docs: DataFrame, config: OrderConfig = OrderConfig(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed sequences: place (``part``, ``seq``), used ids, document spans and ids. Write it before use."""
    ship_package(docs.sparkSession)
    slim = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    schema = _SEQUENCES.format(kind=slim.schema["_k"].dataType.simpleString())
    size = config.length

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = encoder(config).encode_ordinary, TaskContext.get().partitionId(), 0
        ids, names, begun, held, kind = [], [], [], 0, pa.int64()

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal ids, names, begun, held, seq
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
            ends = np.cumsum([len(x) for x in ids])
            full = -(-len(flat) // size) if last else len(flat) // size
            rows = []
            for s in range(full):
                low, high = s * size, min((s + 1) * size, len(flat))
                a, b = np.searchsorted(ends, low, side="right"), np.searchsorted(ends, high, side="left")
                span = range(a, b + 1)
                opened = [max(low, int(ends[d] - len(ids[d]))) for d in span]
                counts = [min(high, int(ends[d])) - o for d, o in zip(span, opened)]
                starts = [begun[d] + o - int(ends[d] - len(ids[d])) for d, o in zip(span, opened)]
                whole = np.full(size, config.end_of_text, np.uint16)
                whole[: high - low] = flat[low:high]
                rows.append((part, seq, high - low, [names[d] for d in span], starts, counts, whole.astype("<u2").tobytes()))
                seq += 1
            used = min(full * size, len(flat))
            if used < len(flat):
                d = int(np.searchsorted(ends, used, side="right"))
                off = used - int(ends[d] - len(ids[d]))
                ids, names, begun = [ids[d][off:], *ids[d + 1 :]], names[d:], [begun[d] + off, *begun[d + 1 :]]
            else:
                ids, names, begun = [], [], []
            held = len(flat) - used
            if rows:
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(kind), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
                labels = ["part", "seq", "n_tokens", "doc_ids", "starts", "counts", "tokens"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=labels)

        for batch in batches:
            kind = batch.schema.field("_k").type
            for k, t in K.keyed_texts(batch):
                ids.append(np.array([*encode(t), config.end_of_text], np.uint16))
                names.append(k)
                begun.append(0)
                held += len(ids[-1])
                if held >= 256 * size:
                    yield from cut(False)
        yield from cut(True)

    return slim.mapInArrow(pack, schema)


@dataclass(frozen=True)
class Order:
    """A materialised order: its folders and the numbers needed to read it."""

    folder: str
    sequences: int
    length: int
    shard_sequences: int
    key: int
    before: dict[int, int]  # sequences in earlier parts of the table; one entry per task that wrote it

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/sequences")


def materialise(docs: DataFrame, folder: str, config: OrderConfig = OrderConfig(), *, key: str = "doc_id", text: str = "text") -> Order:
    """Write the sequences of ``docs`` and the shards of their training order under ``folder``."""
    spark = docs.sparkSession
    token_sequences(docs, config, key=key, text=text).write.option("compression", "zstd").option(
        "parquet.compression.codec.zstd.level", ZSTD_LEVEL
    ).parquet(f"{folder}/sequences")
    table = spark.read.parquet(f"{folder}/sequences")
    sizes = sorted((r[0], r[1]) for r in table.groupBy("part").agg(F.count(F.lit(1))).collect())
    ends = np.cumsum([n for _, n in sizes]) if sizes else np.zeros(0, np.int64)
    total = int(ends[-1]) if sizes else 0
    before = {p: int(e) - n for (p, n), e in zip(sizes, ends)}
    order = Order(folder, total, config.length, config.shard_sequences, config.key, before)
    meta = [(total, config.length, config.shard_sequences, config.key)]
    spark.createDataFrame(meta, "sequences long, length int, shard_sequences int, key long").coalesce(1).write.json(f"{folder}/order")
    if total:
        _write_shards(table, order)
    return order


def slots_of(table: DataFrame, order: Order) -> DataFrame:
    """``table`` with the ``slot`` of each sequence in place of its tokens."""
    shared = table.sparkSession.sparkContext.broadcast(order.before)
    kept = table.drop("tokens")
    total, key = order.sequences, order.key

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(permuted(_numbers(batch, shared.value), total, key))], names=[*batch.schema.names, "slot"]
            )

    schema = T.StructType([*kept.schema.fields, T.StructField("slot", T.LongType())])
    return kept.mapInArrow(number, schema)


def _numbers(batch: pa.RecordBatch, before: dict[int, int]) -> np.ndarray:
    parts = np.asarray(batch.column("part"))
    names, at = np.unique(parts, return_inverse=True)
    return np.array([before[int(p)] for p in names], np.int64)[at] + np.asarray(batch.column("seq"))


def _write_shards(table: DataFrame, order: Order) -> None:
    shared = table.sparkSession.sparkContext.broadcast(order.before)
    total, size, per, key = order.sequences, order.length, order.shard_sequences, order.key
    shards = -(-total // per)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sequences by shard: slots and compressed ids."""
        for batch in batches:
            slots = permuted(_numbers(batch, shared.value), total, key)
            data, _ = K.utf8(batch.column("tokens"))
            ids = data.reshape(-1, 2 * size)
            rows = []
            for shard in np.unique(slots // per).tolist():
                mine = np.flatnonzero(slots // per == shard)
                packed = pa.Codec("zstd", compression_level=ZSTD_LEVEL).compress(ids[mine].tobytes(), asbytes=True)
                rows.append((shard, slots[mine].astype("<i8").tobytes(), packed))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["shard", "slots", "ids"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per shard, its sequences by slot."""
        open_, buffer = None, None
        for batch in batches:
            for shard, slots, ids in zip(*(batch.column(i) for i in range(3))):
                shard = shard.as_py()
                if shard != open_:
                    if buffer is not None:
                        yield done(open_, buffer)
                    open_, buffer = shard, np.zeros((min(per, total - shard * per), size), "<u2")
                at = np.frombuffer(slots.as_py(), "<i8") - shard * per
                raw = pa.decompress(ids.as_buffer(), decompressed_size=len(at) * 2 * size, codec="zstd", asbytes=True)
                buffer[at] = np.frombuffer(raw, "<u2").reshape(-1, size)
        if buffer is not None:
            yield done(open_, buffer)

    def done(shard: int, buffer: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([buffer.tobytes()], pa.binary())], names=["shard", "ids"])

    kinds = [pa.int32(), pa.binary(), pa.binary()]
    sent = table.select("part", "seq", "tokens").mapInArrow(bundle, "shard int, slots binary, ids binary")
    # Range r of the slots is partition r: one shard a task, and no sample is needed to cut the ranges.
    whole = sent.repartitionById(shards, F.col("shard")).mapInArrow(fill, "shard int, ids binary")
    # Spark's text writer puts bytes as they are and commits files, so a rerun task leaves one copy.
    whole.select(F.col("ids").cast("string").alias("value"), "shard").write.partitionBy("shard").text(f"{order.folder}/shards")


def read_slots(spark: SparkSession, folder: str, first: int = 0, count: int | None = None) -> DataFrame:
    """``slot, shard, byte_offset, tokens`` (binary) of a run of slots, from the shards that hold it."""
    meta = spark.read.schema("sequences long, length int, shard_sequences int, key long").json(f"{folder}/order").first()
    last = meta.sequences if count is None else min(first + count, meta.sequences)
    empty = "slot long, shard int, byte_offset long, tokens binary"
    if first >= last:
        return spark.createDataFrame([], empty)
    stride, per = 2 * meta.length, meta.shard_sequences
    files = spark.read.format("binaryFile").load(f"{folder}/shards").filter(F.col("shard").between(first // per, (last - 1) // per))
    begin = F.col("shard").cast("long") * per
    rows = files.select("shard", "content", F.explode(F.expr(f"sequence(0, int(length div {stride}) - 1)")).alias("i"))
    return rows.select(
        (begin + F.col("i")).alias("slot"), "shard", (F.col("i").cast("long") * stride).alias("byte_offset"),
        F.substring("content", F.col("i") * stride + 1, F.lit(stride)).alias("tokens"),
    ).filter(F.col("slot").between(first, last - 1))


def ordered_rows(docs: DataFrame, folder: str, config: OrderConfig = OrderConfig(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Materialise, read all shards back, and give one row per sequence with its documents and the digest of its ids."""
    spark = docs.sparkSession
    order = materialise(docs, folder, config, key=key, text=text)
    facts = slots_of(order.table(spark), order).select("slot", "n_tokens", "doc_ids", "starts", "counts")
    back = read_slots(spark, folder).select("slot", "shard", "byte_offset", F.sha2("tokens", 256).alias("tokens_sha256"))
    return facts.join(back, "slot")
