import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatterloom.llm import kernels as K
from chatterloom.llm import quality as Q
from chatterloom.llm.queries import op3_quality_scores

SF = "/root/testdata/sf0.01"


def text(rng, good):
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(30, 120))]
    return " ".join(words).capitalize() + "." if good else " ".join(w for w in words[:12] for _ in range(8))


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, i % 10 < 7), i % 10 < 7, "x") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, truth boolean, score string").repartition(4)
    labels = docs.filter("truth AND doc_id % 3 = 0").selectExpr("doc_id", "1 quality", "0 toxic")
    return docs, labels


def test_prior_and_scores_of_a_planted_mixture(spark, planted):
    docs, labels = planted
    table = Q.learned_table(docs, labels)
    model = Q.fit(table)
    unlabelled_good = (1050 - labels.count()) / (1500 - labels.count())
    assert abs(model.prior - unlabelled_good) < 0.08
    out = Q.scored(table, model).join(docs.drop("score"), docs.doc_id == F.col("id")).collect()
    assert np.mean([r.predicted == int(r.truth) for r in out]) > 0.98
    assert all(0 <= r.score <= 1 for r in out)
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and abs(kept.count() - 1050) < 20


def test_negative_risk_is_never_left_below_zero(spark, planted):
    docs, labels = planted
    table = Q.learned_table(docs, labels)
    model = Q.fit(table, Q.QualityConfig(steps=40, ridge=1e-9))
    sums, taken = Q._step_sums(model.weights, model.center, model.scale)
    t = taken(Q._added(table, sums))
    assert np.isfinite(model.weights).all()
    assert t["minus_u"] - model.prior * t["minus_p"] > -0.05


def test_gradient_is_the_slope_of_the_risk():
    rng = np.random.default_rng(0)
    x, kind, w = rng.normal(size=(200, 4)), rng.integers(0, 2, 200), rng.normal(size=4)

    def risk(v):
        sums, taken = Q._step_sums(v, np.zeros(4), np.ones(4))
        t = taken(sums(kind, x))
        return 0.6 * t["plus_p"] + t["minus_u"] - 0.6 * t["minus_p"], t["s_u"] - 0.6 * t["x_p"]

    slope = [(risk(w + e)[0] - risk(w - e)[0]) / 2e-5 for e in np.eye(4) * 1e-5]
    assert np.allclose(slope, risk(w)[1], atol=1e-6)


def test_edge_rows(spark):
    docs = spark.createDataFrame(
        [(1, "good text here."), (2, None), (3, ""), (None, "no id at all"), (4, "w " * 60_000), (1, "good text here.")], "doc_id long, text string"
    )
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, 0), (2, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    table = Q.learned_table(docs, labels)
    assert sorted((str(r.id), r.kind) for r in table.collect()) == [("1", 1), ("1", 1), ("2", 0), ("3", 0), ("4", 0), ("None", 0)]
    out = Q.scored(table, Q.fit(table)).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    none = Q.learned_table(docs, labels.limit(0))
    assert {r.score for r in Q.scored(none, Q.fit(none)).collect()} == {0.5}
    empty = Q.learned_table(docs.limit(0), labels)
    assert Q.scored(empty, Q.fit(empty)).count() == 0 and Q.keep_good(docs.limit(0), labels).count() == 0


def test_features_do_not_depend_on_neighbours():
    texts = ["One two two.", "", "ÄÖ !!! ???", "LOUD LOUD words\n\n", "x" * 500]
    alone = np.concatenate([Q.features(*K.utf8(pa.array([t]))) for t in texts])
    assert np.allclose(alone, Q.features(*K.utf8(pa.array(texts))))


def test_held_out_accuracy(spark):
    out = op3_quality_scores(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in out]) > 0.95
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()
    assert out and len(docs) == op3_quality_scores(spark, SF).count()


def test_nothing_to_learn_from_keeps_all(spark):
    docs = spark.createDataFrame([(1, "good text here."), (2, None), (None, "no id")], "doc_id long, text string")
    good = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    for labels, skip in ((good.limit(0), None), (good.selectExpr("doc_id", "0 quality"), None), (good, F.col("doc_id").isNotNull())):
        with pytest.warns(UserWarning, match="all documents are kept"):
            kept = Q.keep_good(docs, labels, skip=skip)
        assert kept.columns == docs.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, docs.collect()))
    with pytest.warns(UserWarning, match="all documents are kept"):
        assert Q.keep_good(docs.filter("doc_id IS NOT NULL"), good).count() == 2
