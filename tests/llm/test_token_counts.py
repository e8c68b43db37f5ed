import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from formline.llm import queries, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = [
    None, "", " ", "  ", "   a", "\n\n  x", "a" * 3000, "é▁▁b  ", "<s></s><0x0A>", "ab\x00c", "執벨梦" * 400,
    "word " * 3000 + "x" * 1500, "\U0001F600 ́", "    " * 600, "Hello  world\t\n", "same", "same",
]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" ▁abcdehinorst\n<>0x"), st.characters(exclude_categories=["Cs"])), max_size=700)))
def test_counts_equal_the_library(texts):
    got = token_counts.count_batch(token_counts.transducer(PATH), texts)
    assert got.tolist() == [len(LIB.encode(t)) for t in texts]


def test_small_tables_start_afresh_without_changing_a_count(monkeypatch):
    machine = token_counts.Transducer(token_counts.read_pieces(PATH))
    monkeypatch.setattr(token_counts, "MAX_CELLS", 1)
    monkeypatch.setattr(token_counts, "SLICE", 50)
    texts = [t or "" for t in TEXTS]
    assert token_counts.count_batch(machine, texts).tolist() == [len(x) for x in LIB.encode(texts)]


def test_frame_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(i % 5 or None, t, 7, "z") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, extra string")
    got = token_counts.count_tokens(docs, PATH, limit=100)
    assert got.columns == ["doc_id", "extra", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((i or -1, len((t or "").encode()), n := len(LIB.encode(t or "")), n > 100) for i, t, _, _ in rows)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want


def test_empty_table(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id bigint, text string"), PATH).collect() == []


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r.n_tokens for r in queries.QUERIES["op6_token_counts"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got == {d.doc_id: len(LIB.encode(d.text)) for d in docs}


def test_unsupported_model_is_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.trainer_spec.model_type = 1
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="only BPE"):
        token_counts.read_pieces(str(tmp_path / "m"))
