"""Language and toxicity models: held-out accuracy, gradients, and the edge rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.llm import language, toxicity
from ledgerloom.llm.text import words

SF = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.op9_language_id(spark, SF).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97


def test_language_edges(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "12 34!"), (None, "der die und"), (5, "the and " * 5000), (5, "the and " * 5000)], "score string")
    model = language.fit(["the and of thing"] * 5 + ["der die und ein"] * 5, ["en"] * 5 + ["de"] * 5)
    found = language.detect(docs.withColumn("held_out", F.lit(False)), model).collect()
    assert [(r.doc_id, r.lang_pred) for r in found] == [(1, "und"), (2, "und"), (3, "und"), (None, "de"), (5, "en"), (5, "en")]
    assert all(0 <= r.score <= 1 for r in found) and [r.score for r in found[:3]] == [0, 0, 0]
    assert {r.lang_pred for r in language.detect(docs.withColumn("held_out", F.lit(False)), language.fit([], [])).collect()} == {"und"}


def test_toxicity_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = toxicity.op7_toxicity(spark, SF).join(labels, "doc_id")
    right = dict(map(tuple, found.groupBy("toxic").agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).collect()))
    assert right[0] >= 0.9 and right[1] >= 0.5


def test_toxicity_edges(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (None, "you idiot"), (4, "idiot " * 3000), (4, "idiot " * 3000)], "toxicity_note string")
    net = toxicity.fit(["you idiot there", "a fine day"] * 20, [1, 0] * 20, 0.5, epochs=3)
    found = toxicity.score(docs, net).collect()
    assert len(found) == 5 and all(0 <= r.toxicity <= 1 for r in found)
    labels = spark.createDataFrame([(1, None), (2, 0)], "doc_id long, toxic int")
    assert toxicity.fit_from(docs, labels) == 0.0
    assert {r.toxicity for r in toxicity.score(docs, 0.25).collect()} == {0.25}
    assert toxicity.score(docs.limit(0), net).count() == 0


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 200):
        split = words(pa.array([" ".join(f"w{i}" for i in range(n))]))
        codes, owner = toxicity.windows(split)
        assert set(codes.ravel().tolist()) - {len(split.distinct)} == set(range(n)) and (owner == 0).all()


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh(1)
    split = words(pa.array(["one two three four two", "five one"]))
    lexicon = toxicity.Lexicon.of(split.distinct)
    codes, _ = toxicity.windows(split)
    pull = rng.normal(size=len(codes)).astype(np.float32)

    def value():
        logit, _ = net.run(net.given(net.inputs(lexicon)), codes)
        return float((logit.astype(np.float64) * pull).sum())

    inputs = net.inputs(lexicon)
    _, tape = net.run(net.given(inputs), codes, keep=True)
    for name, grad in net.gradients(inputs, lexicon, pull, tape).items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        step, kept = 1e-2, net.weights[name][at]
        net.weights[name][at] = kept + step
        high = value()
        net.weights[name][at] = kept - step
        low = value()
        net.weights[name][at] = kept
        assert abs((high - low) / (2 * step) - grad[at]) < 0.03 * max(1, abs(grad[at])), name
