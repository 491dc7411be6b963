import numpy as np
import pyarrow as pa

from chatterloom.llm import kernels as K
from chatterloom.llm import language as L
from chatterloom.llm.queries import op4_language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = op4_language(spark, SF).join(docs, "doc_id").collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert np.mean([r.lang == r.lang_pred for r in out if r.held_out]) > 0.97


def test_edge_rows(spark):
    rows = [(i, t * (1 + i % 5), g, "x") for i in range(60) for t, g in [("the cat and the hat ", "en"), ("der hund und das haus ", "de"), ("le chat et la maison ", "fr"), ("zz qq xx ww ", "xx")]]
    rows += [(900, None, "en", "x"), (901, "", "de", "x"), (902, "123 !!", "fr", "x"), (903, "the cat", None, "x"), (904, "١٢٣", "en", "x"), (905, "the hat " * 20_000, None, "x"), (None, "le chat", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    model = L.fit(docs, sample=200)
    assert model.families.names == ["germanic", "only xx", "romance"] and model.within["germanic"].names == ["de", "en"]
    got = L.identify(docs, model).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in got}
    assert by[(900, None)] == by[(901, "")] == by[(902, "123 !!")] == by[(904, "١٢٣")] == ("und", 0.0)
    assert by[(903, "the cat")][0] == "en" and by[(905, "the hat " * 20_000)][0] == "en" and by[(None, "le chat")][0] == "fr"
    assert np.mean([r.lang == r.lang_pred for r in got if r.doc_id is not None and r.doc_id < 900]) == 1.0


def test_few_languages_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "only one language", "en"), (2, "here", "en"), (3, "?", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in L.identify(docs, L.fit(docs)).collect()} == {1: "en", 2: "en", 3: "und"}
    assert L.fit(docs.filter("lang = 'zz'")) is None
    assert {r.lang_pred for r in L.identify(docs, None).collect()} == {"und"}
    assert L.identify(docs.limit(0), L.fit(docs)).count() == 0


def test_vectors_do_not_depend_on_neighbours():
    texts = ["Ein Satz.", "", "a", "été  --  ok", "X" * 300]
    alone = np.concatenate([L.vectors(*K.utf8(pa.array([t]))) for t in texts])
    assert np.allclose(alone, L.vectors(*K.utf8(pa.array(texts))))


def test_sample_is_bounded_under_repeats_and_many_languages_share_families(spark):
    many = [(i, f"{chr(0x100 + i % 90) * 3} {chr(0x100 + i % 90)}a word", f"l{i % 90:02d}") for i in range(270)]
    docs = spark.createDataFrame(many, "doc_id long, text string, lang string")
    often = spark.range(3000).selectExpr("5L AS doc_id", "'one text very often' AS text", "'en' AS lang")
    model = L.fit(docs.unionByName(often), sample=400)
    assert "germanic" in model.families.names and len(model.families.names) <= L.OWN_FAMILIES + 1
    assert sum(len(m.names) for m in model.within.values()) == 91
    got = L.identify(docs, model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95


def test_memory_of_a_batch_of_short_texts_is_bounded(spark, tmp_path):
    """Dense vectors are made for at most ROWS_AT_ONCE texts at once."""
    import resource

    import pandas as pd

    docs = spark.createDataFrame([(i, f"short text {i}", "en" if i % 2 else "fr") for i in range(200)], "doc_id long, text string, lang string")
    model = L.fit(docs)
    batch = pa.RecordBatch.from_pandas(pd.DataFrame({"text": ["a text of words"] * 10_000}))
    sizes = [p.num_rows for p in K.pieces(batch, "text", most=L.ROWS_AT_ONCE)]
    assert sum(sizes) == 10_000 and max(sizes) == L.ROWS_AT_ONCE
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for piece in K.pieces(batch, "text", most=L.ROWS_AT_ONCE):
        model.predict(L.vectors(*K.utf8(piece.column(0))))
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 100
