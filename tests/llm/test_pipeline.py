import numpy as np
from test_decontaminate import split
from test_jaccard import shingles

import corpus_pipeline as P
from chatterloom.llm import order
from chatterloom.session import written

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for _, stage in P.STAGES:
        tables.append(written(stage(spark, tables[-1], SF), "stage"))
    rows = [t.collect() for t in tables]
    assert all(t.columns == columns for t in tables[:-1])
    raw, good, single, clean, mixed, sequences = rows

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good}
    assert np.mean([r.doc_id in kept for r in raw if labels.get(r.doc_id) == 1]) > 0.9
    assert set(good) <= set(raw)

    sets, ids = {r.doc_id: shingles(r.text) for r in good}, sorted(r.doc_id for r in good)
    linked = {a: [b for b in ids if a != b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])] for a in ids}
    left, want = set(ids), set()
    for a in ids:
        if a in left:
            want.add(a)
            todo = [a]
            while todo:
                todo += [b for b in linked[todo.pop()] if b in left and not left.discard(b)]
            left.discard(a)
    assert {r.doc_id for r in single} == want and len(single) == len(want)

    windows = set()
    for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        ws = split(item.text)
        n = min(10, len(ws))
        windows |= {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if ws else set()
    hit = lambda t: any(tuple(ws[i : i + n]) in windows for ws in [split(t)] for n in {len(w) for w in windows} for i in range(len(ws)))
    assert {r.doc_id for r in clean} == {r.doc_id for r in single if not hit(r.text)}

    assert {r.doc_id for r in mixed} == {r.doc_id for r in clean}
    encode = order.encoder(order.OrderConfig()).encode_ordinary
    assert sum(r.n_tokens for r in sequences) == sum(len(encode(r.text)) + 1 for r in mixed)
    assert {d for r in sequences for d in r.doc_ids} == {r.doc_id for r in mixed}
    assert sorted(r.slot for r in sequences) == list(range(len(sequences)))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
