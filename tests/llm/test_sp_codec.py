import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from formline.llm import queries, sp_codec

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = [None, "", " ", "   a  b ", "a\n\n b", "x▁y", "執벨 ❤\U0001F600é́", "\x00a", "<s> <unk></s><0x0A>",
         "word " * 20_000 + "end", "y" * 30_000, "same text", "same text"]
ALPHABET = st.one_of(st.sampled_from(" ▁abcdehinorst\n<>0x"), st.characters(exclude_categories=["Cs"]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=200), min_size=1, max_size=5))
def test_ids_and_texts_equal_the_library(texts):
    ids, parity, _ = sp_codec.codec(PATH).encode(texts)
    assert [x.tolist() for x in ids] == [LIB.encode(t) for t in texts] and parity.all()
    assert sp_codec.codec(PATH).decode([x.tolist() for x in ids]) == [LIB.decode(LIB.encode(t)) for t in texts]


def test_frame_round_trip_with_clashing_columns(spark):
    docs = spark.createDataFrame([(i, t, "p", 1) for i, t in enumerate(TEXTS)],
                                 "doc_id int, text string, Parity string, encoded int")
    got = sp_codec.encode(docs, PATH)
    assert got.columns == ["doc_id", "text", "encoded", "ids", "n_tokens", "round_trip", "parity"]
    for r in got.collect():
        assert r.ids == LIB.encode(TEXTS[r.doc_id] or "") and r.n_tokens == len(r.ids) and r.parity
        assert r.round_trip == (LIB.decode(r.ids) == (TEXTS[r.doc_id] or ""))
    back = sp_codec.decode(got.withColumn("decoded", got.n_tokens), PATH).collect()
    assert {r.doc_id: r.text for r in back} == {i: LIB.decode(LIB.encode(t or "")) for i, t in enumerate(TEXTS)}
    null = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.text for r in sp_codec.decode(null, PATH).collect()] == [None, ""]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert sp_codec.encode(none, PATH).collect() == []


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.01"
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op2_sentencepiece"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.ids == LIB.encode(docs[r.doc_id]) and r.parity and r.round_trip


def test_forgotten_words_change_nothing(monkeypatch):
    monkeypatch.setattr(sp_codec, "MAX_WORDS", 3)
    machine = sp_codec.Codec(PATH)
    for t in ("a b c d", "d e f", "a b"):
        assert machine.encode([t])[0][0].tolist() == LIB.encode(t)


@pytest.mark.parametrize("extra", [True, False])
def test_unigram_model_is_rebuilt(extra):
    model = sp_codec.read_model(PATH)
    small = type(model)()
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [(p, -1.0 - i / 7, 1) for i, p in enumerate(["▁", "▁the", "a", "b", "ab", "t", "h", "e", "he", "▁a", "abab", "é"])]
    for p, s, k in pieces:
        small.pieces.add(piece=p, score=s, type=k)
    small.trainer_spec.CopyFrom(model.trainer_spec)
    small.trainer_spec.model_type, small.trainer_spec.vocab_size = 1, len(pieces)
    small.normalizer_spec.CopyFrom(model.normalizer_spec)
    small.normalizer_spec.remove_extra_whitespaces = extra
    lib = sentencepiece.SentencePieceProcessor(model_proto=small.SerializeToString())
    ours = sp_codec.build(small)
    for t in ["the ab", "abab abé", "  the   a ", "xyz the", "hethe"]:
        assert ours.encode(t, add_special_tokens=False).ids == lib.encode(t), t


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" ▁ab\n<0x41>é執"), st.characters(exclude_categories=["Cs"])), max_size=30)))
def test_round_trip_by_words_is_that_of_whole_texts(texts):
    machine = sp_codec.codec(PATH)
    ids, parity, back = machine.encode(texts)
    assert back.tolist() == [a == b for a, b in zip(machine.decode([x.tolist() for x in ids]), texts, strict=True)]
    assert parity.all()


def test_new_words_are_encoded_in_parts(monkeypatch):
    """A text of many words that were not seen before does not hold the libraries' results of all of them at once."""
    monkeypatch.setattr(sp_codec, "LEARN", 50)
    machine, most = sp_codec.Codec(PATH), []
    whole = machine.encode_whole
    monkeypatch.setattr(machine, "encode_whole", lambda texts: (most.append(len(texts)), whole(texts))[1])
    text = " ".join(f"w{i}x" for i in range(333)) + " a\x00b"
    ids, parity, back = machine.encode([text, "w3x new", None])
    assert [x.tolist() for x in ids] == [LIB.encode(text), LIB.encode("w3x new"), []] and parity.all() and back.all()
    assert max(most) <= 50 and sum(most) == 335
