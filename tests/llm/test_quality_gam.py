"""The additive quality classifier: held-out accuracy, tables against plain Python, hostile rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from conftest_data import HOSTILE
from pyspark.sql import functions as F

from returnlens.llm import queries, quality_gam
from returnlens.llm.shared import texts_of

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return quality_gam.fit(queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels"))


def test_held_out_accuracy(spark):
    found = queries.op13_quality_classifier(spark, SF)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    assert found.count() == queries.table(spark, SF, "documents").count()
    labels = queries.table(spark, SF, "labels").select(F.col("doc_id").alias("own"), "quality")
    rows = found.filter("held_out").join(labels, F.col("doc_id") == F.col("own")).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.97
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) >= 0.99


def by_hand(model, row):
    """Each bin looked up by itself, in plain Python."""

    def bin_of(edges, value):
        return sum(value >= e for e in edges)

    total = model.bias + sum(t[bin_of(e, v)] for t, e, v in zip(model.tables, model.edges, row))
    return total + sum(t[bin_of(model.grids[a], row[a]), bin_of(model.grids[b], row[b])] for a, b, t in model.pairs)


def test_scores_are_sums_of_table_entries(spark, model):
    texts = texts_of(pa.array([r.text or "" for r in queries.table(spark, SF, "documents").limit(40).collect()]))
    assert any(t.any() for t in model.tables)
    for row, score in zip(quality_gam.features(texts), model.scores(texts)):
        assert score == pytest.approx(1 / (1 + np.exp(-by_hand(model, row))), abs=1e-9)


def test_features_of_a_text():
    texts = ["", "Two WORDS two,  9!\nTwo\n", "\u00e9\u00e9", " ", "a a a b"]
    rows = quality_gam.features(texts_of(pa.array(texts)))
    found = [dict(zip(quality_gam.FEATURES, row)) for row in rows]
    assert not rows[0].any()
    one = found[1]
    assert one["upper_share"] == pytest.approx(7 / 14) and one["digit_share"] == pytest.approx(1 / 23)
    assert one["stop_share"] == one["shout_share"] == pytest.approx(1 / 5)
    assert one["capital_words"] == pytest.approx(3 / 5) and one["line_share"] == pytest.approx(2 / 5)
    assert found[2]["beyond_ascii_share"] == 1 and found[3]["space_share"] == 1
    assert found[4]["repeated_neighbours"] == 0.5 and found[4]["most_frequent_word"] == 0.75
    # However the texts are cut into batches.
    apart = np.concatenate([quality_gam.features(texts_of(pa.array([t]))) for t in texts])
    assert np.array_equal(rows, apart)


def test_a_pair_explains_what_no_feature_does():
    random = np.random.default_rng(1)
    matrix = random.random((3000, len(quality_gam.FEATURES)))
    label = ((matrix[:, 2] > 0.5) ^ (matrix[:, 5] > 0.5)).astype(float)
    found = quality_gam.boosted(matrix, label)
    assert found.pairs[0][:2] == (2, 5)
    assert np.mean((found.log_odds(matrix) > 0) == label) > 0.95
    assert found.log_odds(matrix[:20]) == pytest.approx([by_hand(found, row) for row in matrix[:20]])


def test_boosting_lowers_the_loss():
    random = np.random.default_rng(2)
    matrix = random.random((2000, len(quality_gam.FEATURES)))
    label = (random.random(2000) < 1 / (1 + np.exp(-6 * (matrix[:, 0] - 0.5)))).astype(float)
    odds = quality_gam.boosted(matrix, label).log_odds(matrix)
    loss = np.mean(np.log1p(np.exp(-np.where(label == 1, odds, -odds))))
    assert loss < 0.55


def test_hostile_rows(spark, model, texts):
    found = quality_gam.graded(texts(HOSTILE), model)
    assert found.columns[-1] == "predicted" and found.columns.count("score") == 1
    rows = found.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(k) for k, _ in HOSTILE)
    assert all(0 <= r.score <= 1 for r in rows)
    empty = model.scores(texts_of(pa.array([""])))[0]
    assert {r.score for r in rows if not r.text} == {empty}
    assert quality_gam.graded(texts(HOSTILE).limit(0), model).collect() == []


def test_labels_missing_repeated_or_of_one_class(spark):
    docs = spark.createDataFrame([(1, "a text"), (1, "another text"), (2, None), (None, "x")], "doc_id long, text string")
    everything = lambda key: key.isNotNull()
    for labels, share in (([], 0.0), ([(1, 1), (1, 0), (None, 0), (2, None)], 1.0), ([(2, 0)], 0.0)):
        known = spark.createDataFrame(labels, "doc_id long, quality int")
        model = quality_gam.fit(docs, known, train=everything)
        scores = {r.score for r in quality_gam.graded(docs, model).collect()}
        assert len(scores) == 1 and scores.pop() == pytest.approx(share, abs=1e-6)


def test_the_held_out_fold_is_never_learned_from(spark):
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    turned = labels.withColumn("quality", F.when(quality_gam.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = quality_gam.fit(docs, labels), quality_gam.fit(docs, turned)
    assert one.bias == two.bias and all(np.array_equal(a, b) for a, b in zip(one.tables, two.tables))
