import zlib

import numpy as np
import pytest

from formline.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    n = label.sum()
    return (rank[label].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_held_out_accuracy(spark):
    rows = queries.QUERIES["op9_toxicity"](spark, SF).collect()
    labels = {x.doc_id: x.toxic for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    y = np.array([labels[r.doc_id] == 1 for r in held])
    assert auc(np.array([r.score for r in held]), y) > 0.95
    hit = np.array([r.predicted == 1 for r in held])
    # some labels of this table contradict the texts
    assert (hit & y).sum() >= 0.75 * y.sum() and (hit & ~y).sum() <= 0.02 * (~y).sum()


def test_pooling_equals_loops():
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=(toxicity.PAD + 1, toxicity.DIM)), {
        k: rng.normal(size=(k, toxicity.DIM, toxicity.FILTERS)) for k in toxicity.WIDTHS}, rng.normal(size=12), rng.normal(size=12), 0.3)
    model.rows[toxicity.PAD] = 0
    texts = ["", "One", "one two", "a b c d e f g", "x y " * 50]
    want = []
    for t in texts:
        vectors = [model.rows[c >> toxicity.BITS] + model.rows[(c & (1 << toxicity.BITS) - 1) + (1 << toxicity.BITS)]
                   for c in toxicity.codes_of(t)] + [np.zeros(toxicity.DIM)] * 3
        top = [max(sum(vectors[i + o] @ model.filters[k][o][:, f] for o in range(k) if i + o < len(vectors))
                   for i in range(len(vectors))) for k in toxicity.WIDTHS for f in range(toxicity.FILTERS)]
        want.append(np.maximum(np.array(top) + model.bias, 0) @ model.out + model.shift)
    scorer = toxicity.Scorer(model)
    assert np.allclose(scorer.logits(texts), want, atol=1e-4)
    scorer.forget()
    assert np.allclose(scorer.scores(texts, characters=1), 1 / (1 + np.exp(-np.array(want))), atol=1e-4)


def test_labels_of_the_held_fold_are_never_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (sorted(map(tuple, toxicity.predict(docs, x).collect())) for x in (labels, other))
    assert a == b


def test_threshold_and_language():
    z, y = np.array([3.0, 2, 1, 0, -1]), np.array([1, 1, 0, 0, 0], bool)
    assert toxicity.best_threshold(z, y) == pytest.approx(1.5)
    assert toxicity.language("schön für größe") == "de" and toxicity.language("") == "en"


def test_edges(spark):
    rows = [(None, None, "a", 1), (1, "", "b", 2), (2, "w " * 100_000, "c", 3), (3, "bad bad", "d", 4), (3, "bad bad", "d", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, Score string, judged int")
    labels = spark.createDataFrame([(None, 1), (1, None), (7, 1), (7, 0)], "doc_id bigint, toxic int")
    got = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    assert [r.score for r in got] == [0.0] * 5 and got[0].__fields__ == ["doc_id", "text", "judged", "score", "predicted"]
    words = [f"w{i}" for i in range(40)]
    rng = np.random.default_rng(0)
    texts = [(i, " ".join(rng.choice(words, 12)) + (" vile" if i % 3 == 0 else "")) for i in range(300)]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    model = toxicity.learn(frame, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id bigint, toxic int"))
    for r in toxicity.score(frame, model).collect():
        assert r.predicted == int(r.doc_id % 3 == 0)
    assert len({r.score for r in toxicity.score(docs, model).collect()[-2:]}) == 1
    assert toxicity.predict(docs.limit(0).select("doc_id", "text"), labels).collect() == []
