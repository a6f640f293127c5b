import numpy as np
from pyspark.sql import functions as F

from quarry.llm import lang_id
from tests.llm.cases import ROWS, documents, empty, odd


def test_held_out_accuracy(spark, sf):
    docs = documents(spark, sf)
    held = lang_id.remainder(3) == 1
    model = lang_id.fit(docs.where(~held))
    rows = lang_id.predict(docs.where(held), model, ["doc_id", "lang"]).collect()
    assert len(rows) > 40 and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    # Neither lang, source nor id decide.
    other = docs.where(held).withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id") * 0).withColumn(
        "source", F.lit(None))
    assert sorted((r["lang_pred"], r["score"]) for r in rows) == sorted(
        (r["lang_pred"], r["score"]) for r in lang_id.predict(other, model, []).collect())


def test_document_frequencies_cover_all_training_rows(spark, sf):
    docs = documents(spark, sf)
    model = lang_id.fit(docs, max_train_docs=8)
    seen = np.zeros(lang_id.DIMS)
    texts = [r["text"] for r in docs.collect()]
    for t in texts:
        seen[lang_id.features(t)[0]] += 1
    assert np.allclose(model.idf, np.log((1 + len(texts)) / (1 + seen)) + 1)


def test_regulariser_leaves_unseen_features_at_zero():
    rng = np.random.default_rng(1)
    model = lang_id.Model(["a", "b"], np.ones(lang_id.DIMS), np.zeros((lang_id.DIMS + 1, 2)))
    rows = [(np.array([label, 2 + int(rng.integers(50))]), np.array([3, 1]), label) for label in rng.integers(0, 2, 400)]
    lang_id.ftrl(model, rows)
    assert (model.weights[100:-1] == 0).all() and model.weights[0, 0] > 0 > model.weights[1, 0]
    # Half of the calibration labels are wrong: the model must become less sure.
    before = [max(lang_id._softmax(model.logits(i, c))) for i, c, _ in rows]
    lang_id.calibrate(model, [(i, c, int(rng.integers(2))) for i, c, _ in rows])
    after = [max(lang_id._softmax(model.logits(i, c) / model.temperature)) for i, c, _ in rows]
    assert np.mean(after) < np.mean(before) and model.temperature > 1


def test_odd_rows(spark):
    model = lang_id.fit(odd(spark))
    assert model.labels == ["de", "en"]
    got = lang_id.predict(odd(spark), model, ["doc_id", "uid"]).collect()
    assert len(got) == len(ROWS) and {r["uid"] for r in got} == {"clash"}
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (2, 3, 6)} == {
        (2, "und", 0.0), (3, "und", 0.0), (6, "und", 0.0)}
    nothing = lang_id.fit(empty(spark))
    assert {r["lang_pred"] for r in lang_id.predict(odd(spark), nothing, []).collect()} == {"und"}
    assert lang_id.predict(empty(spark), model, ["doc_id"]).count() == 0
    one = lang_id.fit(odd(spark, ROWS[:1]))
    assert lang_id.predict(odd(spark, ROWS[:1]), one, []).first()["lang_pred"] == "en"
