import math
import random

import numpy as np

from larder.llm import toxicity
from larder.llm.common import table
from conftest import DATA
from helpers import AWKWARD, CLASH, docs, prose, stored


def small(spark, tmp_path, n=240):
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(n):
        words, toxic = prose(i, rng.randrange(5, 200)).split(" "), i % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), "vile,")
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    df = stored(docs(spark, texts + AWKWARD, clash=True), tmp_path)
    known = spark.createDataFrame(labels + [(0, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    return df, known, dict(labels)


def test_held_out_accuracy_and_rejects(spark, tmp_path):
    df, labels, truth = small(spark, tmp_path)
    got = toxicity.scores(df, labels).collect()
    assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got)
    out = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(out) > 20
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in out) >= 0.95 * len(out)
    clean = toxicity.keep_clean(df, labels)
    assert clean.columns == df.columns
    assert sorted(r["doc_id"] for r in clean.select("doc_id").collect()) == sorted(r["doc_id"] for r in got if not r["predicted"])


def test_held_out_labels_change_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    df, labels, _ = small(spark, tmp_path, 60)
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(tuple, toxicity.scores(df, labels).collect())) == sorted(map(tuple, toxicity.scores(df, flipped).collect()))


def test_scores_are_those_of_the_formula(spark, tmp_path):
    df, labels, _ = small(spark, tmp_path, 60)
    model = toxicity.train(df, labels)
    full = model.dense()
    for r in df.select("doc_id", "text").join(toxicity.scores(df, labels), "doc_id").collect():
        raw = model.bias + sum(full[s] for s in set(toxicity.features((r["text"] or "").encode()).tolist()))
        assert abs(r["score"] - 1 / (1 + math.exp(-raw))) < 1e-9


def test_blocks_give_the_features_of_the_whole(monkeypatch):
    text = prose(3, 500).encode()
    want = toxicity.features(text)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert np.array_equal(toxicity.features(text), want)


def test_weights_are_sparse(spark):
    model = toxicity.train(table(spark, DATA, "documents"), table(spark, DATA, "labels"))
    assert 0 < len(model.slots) < 2000


def test_empty_tables(spark, tmp_path):
    df = stored(docs(spark, ["a b"]), tmp_path)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity.scores(df, none).collect()] == [0]
    assert toxicity.scores(df.limit(0), none).count() == 0
    assert len(CLASH) > 0
