import hashlib

import numpy as np
import pytest

from chatterloom.llm import order as O
from chatterloom.session import shared_folder

CONFIG = O.OrderConfig(length=16, shard_sequences=5, key=7)
TEXTS = [f"document {i} says <|endoftext|> naïve words " * (i % 7) for i in range(60)] + [None, "", "x" * 9000, "long text " * 3000]


@pytest.mark.parametrize("count", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation_is_a_keyed_bijection(count):
    slots = O.permuted(np.arange(count), count, 11)
    assert sorted(slots.tolist()) == list(range(count))
    if count > 60:
        assert (slots != O.permuted(np.arange(count), count, 12)).mean() > 0.9
        assert abs(np.corrcoef(np.arange(count), slots)[0, 1]) < 0.4


def plain_slot(number, count, key, rounds=O.ROUNDS):
    """One number's slot, with Python integers."""
    word = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & word
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & word
        return x ^ x >> 31

    half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    while True:
        left, right = number >> half, number & (1 << half) - 1
        for r in range(1, rounds + 1):
            left, right = right, left ^ mix(right ^ mix((r * 0x9E3779B97F4A7C15 & word) ^ key)) & (1 << half) - 1
        number = left << half | right
        if number < count:
            return number


@pytest.mark.parametrize("count", [1, 2, 3, 7, 64, 1000, 10**6 + 3])
def test_slots_equal_a_plain_feistel_loop(count):
    some = np.unique(np.linspace(0, count - 1, 300).astype(np.int64))
    assert O.permuted(some, count, 99).tolist() == [plain_slot(int(i), count, 99) for i in some]


def test_every_shard_is_a_task_of_its_own(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    folder = shared_folder(spark, "order")
    out = O.ordered_rows(docs, folder, CONFIG).collect()
    files = O.read_slots(spark, folder).inputFiles()
    shards = len({r.shard for r in out})
    tasks = {f.rsplit("/", 1)[1].split("-")[1] for f in files}
    assert shards == -(-len(out) // CONFIG.shard_sequences) == len(files) == len(tasks)


def test_round_trip_and_resume(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string").repartition(3)
    folder = shared_folder(spark, "order")
    out = O.ordered_rows(docs, folder, CONFIG).collect()
    slots = {r.slot: bytes(r.tokens) for r in O.read_slots(spark, folder).collect()}
    assert sorted(slots) == list(range(len(out))) == sorted(r.slot for r in out)
    encode, found = O.encoder(CONFIG), {}
    for r in out:
        assert r.shard == r.slot // 5 and r.byte_offset == r.slot % 5 * 32
        assert hashlib.sha256(slots[r.slot]).hexdigest() == r.tokens_sha256
        ids = np.frombuffer(slots[r.slot], "<u2").tolist()
        assert sum(r.counts) == r.n_tokens and all(x == CONFIG.end_of_text for x in ids[r.n_tokens :])
        at = 0
        for doc, start, count in zip(r.doc_ids, r.starts, r.counts):
            found.setdefault(doc, []).append((start, ids[at : at + count]))
            at += count
    for doc, text in {(d, t) for d, t, _ in rows}:
        ids = encode.encode_ordinary(text or "") + [CONFIG.end_of_text]
        copies = 2 if doc == 3 else 1
        got = [x for start, part in sorted(found[doc]) for x in part]
        assert sorted(got) == sorted(ids * copies) and (copies == 2 or got == ids)
    some = {r.slot: bytes(r.tokens) for r in O.read_slots(spark, folder, 7, 11).collect()}
    assert some == {s: slots[s] for s in range(7, 18)}
    files = O.read_slots(spark, folder, 7, 2).inputFiles()
    assert files and O.read_slots(spark, folder, 10_000).count() == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert O.ordered_rows(docs, shared_folder(spark, "order"), CONFIG).count() == 0
