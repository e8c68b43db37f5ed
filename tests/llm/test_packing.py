import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from formline.llm import packing
from formline.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
MACHINE = packing.Encoder(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def check(rows, texts, length):
    """Pieces cover each document once, sequences have no gaps, and ids are the library's."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == texts.keys()
    for doc, pieces in by_doc.items():
        want, at = [*ids_of(texts[doc]), 1], 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(want)
            assert p["ids_crc32"] == zlib.crc32(np.array(want[at:at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(want)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for seq, pieces in by_seq.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at == length or (seq == len(by_seq) - 1 and at <= length)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    check(QUERIES["op11_packing"](spark, sf).collect(), texts, packing.LENGTH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(
    st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40),
    st.text(alphabet=" \n\tab'sé1.,<|>   ᠎", max_size=40),
    st.text(alphabet="ab", max_size=6).map(lambda t: f"{t}<|endoftext|> {t} <|endoftext|>"))))
def test_words_equal_the_library(texts):
    assert MACHINE.encode(texts) == [np.array(ids_of(t), "<u4").tobytes() for t in texts]


def test_memory_is_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "MAX_WORDS", 3)
    machine = packing.Encoder(PATH)
    text = "a b c d e f a b c " + "x" * 200 + " d e " + "x" * 200
    assert machine.encode([text]) == [np.array(ids_of(text), "<u4").tobytes()]
    assert len(machine.words) <= 3 and "x" * 200 not in machine.words


def test_other_tokenizers_get_whole_texts():
    assert not packing.splits_at_spaces(public_tokenizers.path("word_bpe_49k.json"))
    assert packing.splits_at_spaces(PATH)


def small(spark, rows, parts=2):
    return spark.createDataFrame(rows, "doc_id bigint, text string, length int, PART string, ids string, base int, n int").repartition(parts, "n")


def digest(pieces):
    return [{**r.asDict(), "ids_crc32": zlib.crc32(r["ids"])} for r in pieces.collect()]


def test_edges(spark):
    long = " ".join(str(i) for i in range(30_000))
    texts = {1: None, 2: "", 3: "one two three", 4: long, 5: "one two three", None: "x " * 40, 7: "a\n b  c\n"}
    rows = [(k, t, 9, "p", "i", 5, i) for i, (k, t) in enumerate(texts.items())]
    pieces = packing.pack(small(spark, rows), PATH, length=64)
    assert pieces.columns == ["doc_id", "PART", "base", "n", *packing.NEW]
    check(digest(pieces), texts, 64)
    assert {(r["PART"], r["base"]) for r in pieces.collect()} == {("p", 5)}
    # repeated rows are packed one by one
    twice = packing.pack(small(spark, [rows[2], rows[2]]), PATH)
    n = len(ids_of("one two three")) + 1
    assert sorted((r["offset"], r["length"]) for r in twice.collect()) == [(0, n), (n, n)]
    assert packing.pack(small(spark, []), PATH).count() == 0


def test_partitions_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_PARTS", 1)
    texts = {i: "word " * i for i in range(20)}
    check(digest(packing.pack(small(spark, [(k, t, 0, "", "", 0, k) for k, t in texts.items()], 5), PATH, length=16)), texts, 16)


def test_sequences_are_padded_but_for_powers_of_two(spark):
    def lengths(texts):
        pieces = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1), PATH, length=16)
        line = [i for r in sorted(pieces.collect(), key=lambda r: (r["sequence_id"], r["offset"])) for i in np.frombuffer(r["ids"], "<u4")]
        out = packing.sequences(pieces, 16, pad=7).orderBy("sequence_id").collect()
        whole = [np.frombuffer(r["ids"], "<u4").tolist() for r in out]
        assert [i for r, w in zip(out, whole) for i in w[:r["n_tokens"]]] == line
        assert all(i == 7 for r, w in zip(out, whole) for i in w[r["n_tokens"]:])
        return [len(w) for w in whole]

    one = "a"
    assert len(ids_of(one)) == 1
    assert lengths([one] * 8) == [16] and lengths([one] * 9) == [16, 2] and lengths([one] * 11) == [16, 16]
