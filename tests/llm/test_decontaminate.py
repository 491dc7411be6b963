import random
import re

import pytest
from pyspark.sql import functions as F

from chatterloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM = "One two three, four five six seven eight nine ten ELEVEN twelve"
LONG = " ".join(f"w{i}" for i in range(6_000))
DOCS = [
    (1, f"start {ITEM.upper()} end", "a"),
    (2, "one two three four five six seven eight nine ten", "b"),
    (3, "one two three four five six seven eight nine TEN\neleven one short ítem here", "c"),
    (4, None, None),
    (5, "", "e"),
    (6, "?! --", "f"),
    (7, LONG + " short ÍTEM x short ítem", "g"),
    (2, "one two three four five six seven eight nine ten", "b"),
    (None, "short ítem", "h"),
]
ITEMS = [(1, ITEM), (2, "short ítem"), (3, None), (4, "..."), (5, "short ítem"), (None, "nine ten eleven"), (1, "absent item")]


def split(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(text):
    ws, hit, items = split(text), set(), set()
    for item, body in ITEMS:
        iw = split(body)
        n = min(10, len(iw))
        for k in range(len(iw) - n + 1 if iw else 0):
            for i in range(len(ws) - n + 1):
                if ws[i : i + n] == iw[k : k + n]:
                    hit |= set(range(i, i + n))
                    items.add("" if item is None else str(item))
    return len(ws), len(hit), sorted(items)


@pytest.mark.parametrize("limit", [1 << 20, 0], ids=["broadcast", "join"])
def test_hits(spark, limit):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, n_hit string").repartition(3)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = D.find_hits(docs, bench, broadcast_bytes=limit)
    assert found.schema["n_hit"].dataType.simpleString() == "bigint"
    got = sorted(((r.text, r.n_words, r.n_hit, list(r["items"])) for r in found.collect()), key=repr)
    assert got == sorted(((t, *brute(t)) for _, t, _ in DOCS), key=repr)


@pytest.mark.parametrize("limit", [1 << 20, 0], ids=["broadcast", "join"])
def test_empty_tables(spark, limit):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, x string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.find_hits(docs.limit(0), bench, broadcast_bytes=limit).count() == 0
    none = D.find_hits(docs, bench.filter("item_id > 9"), broadcast_bytes=limit)
    assert none.agg(F.sum("n_hit")).first()[0] == 0


def test_removal(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, x string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = D.find_hits(docs, bench)
    cut = {r.x: r.text for r in D.remove_spans(found).collect()}
    assert cut["a"] == "start  end" and cut["b"] == "" and cut[None] is None and cut["h"] == ""
    assert cut["g"] == LONG + " short ÍTEM x "
    left = sorted((r.x for r in D.remove_documents(found).collect()), key=str)
    assert left == [None, "e", "f"]
    assert sorted(D.remove_documents(found, 0.5).columns) == ["doc_id", "text", "x"]


def test_broadcast_takes_no_more_than_reckoned():
    import pickle

    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(0, 60))) for _ in range(4000)] + [None, "one", "same words " * 200]
    made = D.windows_of([str(i) for i in range(len(texts))], texts)
    words = sum(len((t or "").split()) for t in texts)
    reckoned = sum(len(t or "") for t in texts) + words * D.WORD_BYTES
    assert made.nbytes() <= reckoned and len(pickle.dumps(made)) <= reckoned + 64 * len(texts)
    repeated = made.by_length[10][1][made.owner[made.by_length[10][1]] == len(texts) - 1]
    assert len(repeated) == 2  # "same words ..." and "words same ..."


@pytest.mark.parametrize("limit", [1 << 30, 0], ids=["broadcast", "join"])
def test_input_columns_of_any_name_are_kept(spark, limit):
    names = ["_k", "_at", "_w", "_t", "items_", "length", "hash", "at", "body", "item", "words", "n_words_"]
    rows = [(i, f"text one two three {i}", *[f"{n}{i}" for n in names]) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    bench = spark.createDataFrame([("b", "two three 4")], "item_id string, text string")
    out = D.find_hits(docs, bench, broadcast_bytes=limit)
    assert sorted(tuple(r) for r in out.select(docs.columns).collect()) == rows
    assert [r.doc_id for r in out.filter("n_hit > 0").collect()] == [4]
    assert D.remove_documents(out).select(docs.columns).count() == 4
