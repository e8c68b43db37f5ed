"""Thresholds cover all labelled rows kept out of training, whatever the sample of the weights."""

import zlib

import numpy as np
import pytest

from formline.llm import toxicity


def test_thresholds_use_every_row(spark):
    words = [f"w{i}" for i in range(30)]
    rng = np.random.default_rng(3)
    # one clean text in four also holds the word, so scores overlap and the best limit depends on the share of labels
    rows = [(i, " ".join(rng.choice(words, 6)) + (" vile" if i % 10 == 0 or i % 4 == 1 else "") + (" ñandú" if i % 3 == 0 else ""),
             int(i % 10 == 0)) for i in range(2_000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    model = toxicity.learn(docs, labels, rows=60)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 4]
    assert len(held) > 200
    z = np.round(toxicity.Scorer(model).all_logits([r[1] for r in held]), 6)
    y = np.array([r[2] == 1 for r in held])
    own = np.array([toxicity.language(r[1]) for r in held])
    want = {"": toxicity.best_threshold(z, y)} | {k: toxicity.best_threshold(z[own == k], y[own == k]) for k in ("en", "es")}
    assert model.thresholds == pytest.approx(want, abs=2e-6)


def test_running_sums_equal_one_pass(spark):
    rng = np.random.default_rng(5)
    z = np.round(np.concatenate([rng.normal(0, 0.01, 300), rng.normal(1, 2, 100), [0.5] * 20]), 6)
    y = rng.random(len(z)) < 1 / (1 + np.exp(-z))
    rows = [("en", float(a), int(b), 1) for a, b in zip(z, y, strict=True)]
    counts = spark.createDataFrame(rows, "language string, logit double, toxic int, n int").groupBy("language", "logit").agg(
        {"toxic": "sum", "n": "sum"}).toDF("language", "logit", "toxic", "n")
    assert toxicity.best_thresholds(counts) == {"en": pytest.approx(toxicity.best_threshold(z, y))}
