import public_tokenizers
import sentencepiece

import corpus_pipeline
from formline.llm import quality
from tests.llm import test_decontam, test_line_dedup, test_ngram_join

SF = "/root/testdata/sf0.001"


def by_hand(spark, docs):
    """Rows (doc_id, text) through plain versions of all stages; the rules come from the learner, the rest from scratch."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    rules = quality.learn(frame, labels)
    kept = []
    for i, t in docs:
        counts = dict(zip(quality.COUNTS, quality.text_stats(t), strict=True))
        if counts["n_words"] < 20 or 100 * counts["n_repeat_words"] > 30 * counts["n_words"]:
            continue
        value = lambda f: counts[quality.FEATURES[f][0]] / max(counts[quality.FEATURES[f][1]], 1)  # noqa: E731, B023
        if not any(all(value(f) <= c if op == "<=" else value(f) > c for f, op, c in rule) for rule in rules):
            kept.append((i, t))
    cut = {k[0]: v for k, v in test_line_dedup.by_hand([d for d in kept if len(d[1]) < 6_000], 50).items()}
    assert len(cut) + sum(len(t) >= 6_000 for _, t in kept) == len(kept)
    return kept, cut


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    small = docs.where("length(text) < 6000")
    rows = [(d.doc_id, d.text) for d in small.collect()]
    kept, cut = by_hand(spark, rows)
    frame = small
    stages = dict(corpus_pipeline.STAGES)
    frame = stages["quality_rules"](spark, frame, SF)
    assert frame.columns == docs.columns
    got = {r.doc_id: r.text for r in frame.collect()}
    labels = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert labels and len(got) <= len(rows)
    frame = spark.createDataFrame([d for d in small.collect() if d.doc_id in dict(kept)], docs.schema)
    frame = stages["line_dedup"](spark, frame, SF)
    want = {i: t for i, t in cut.items() if t.split() or t == dict(kept)[i]}
    rows = frame.collect()
    assert {r.doc_id: r.text for r in rows} == want and frame.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in rows)
    frame = spark.createDataFrame(rows, docs.schema)
    groups = test_ngram_join.by_hand(sorted(want.items()), 5, 80)
    frame = stages["ngram_jaccard_join"](spark, frame, SF)
    stay = {g for _, n, g in groups if n} | {d for d, n, _ in groups if not n}
    assert sorted(r.doc_id for r in frame.collect()) == sorted(stay) and frame.schema == docs.schema
    frame = spark.createDataFrame(frame.collect(), docs.schema)
    items = [(b.item_id, b.text) for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ids = sorted(stay)
    found = test_decontam.by_hand([want[i] for i in ids], items)
    clean = {i for i, f in zip(ids, found, strict=True) if not f}
    frame = stages["decontamination"](spark, frame, SF)
    assert {r.doc_id for r in frame.collect()} == clean and frame.schema == docs.schema
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.PIECES))
    last = stages["sentencepiece"](spark, frame, SF).collect()
    assert {r.doc_id: r.ids for r in last} == {i: lib.encode(want[i]) for i in clean}
    assert all(r.parity and r.round_trip for r in last)


def test_run_and_edges(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.where("not parity or not round_trip").count() == 0
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, stats int, h bigint"
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, None, None, None, None, None, None), (1, "", "en", "s", 0, 1, 1), (2, text, None, None, None, 1, 1),
            (2, text, None, None, None, 1, 1), (3, text + " more", "en", "s", 5, 1, 1), (4, f"{text}\n{text}", "x", "y", 3, 1, 1)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name != "sentencepiece":
                assert docs.schema == spark.createDataFrame([], schema).schema
        ids = sorted(r.doc_id for r in docs.collect())
        assert ids == ([2] if some else [])
