"""Copies of a benchmark item that were edited, re-parameterised or had a word put in are still found."""

from formline.llm import decontam
from tests.llm.test_decontam import ITEM


def covers(spark, docs, items):
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return {(r.doc_id, r.item_id): r.covered for r in decontam.found_items(frame, bench).collect()}


def test_one_edit_costs_only_its_windows(spark):
    n = len(ITEM.split()) - decontam.WINDOW + 1
    name = ITEM.replace("Alice has", "Carol has")  # word 3: it stands in the first four windows
    number = ITEM.replace("5 apples to", "9 apples to").replace("12 apples", "9 apples")  # two numbers become one
    split = ITEM.replace("Alice has", "Carol has").replace("Alice walks", "Erin walks")  # one name becomes two
    stranger = "A farmer named Bo has 1 cow"
    got = covers(spark, [name, number, split, stranger, ITEM, ITEM], [ITEM])
    assert got[0, 0] == (n - 4) / n and got[1, 0] == 1.0 and 0.3 <= got[2, 0] < 1 and (3, 0) not in got and got[4, 0] == 1.0


def test_insertion_adds_up_over_alignments(spark):
    words = [f"w{i}x".replace("0", "zero").translate(str.maketrans("123456789", "abcdefghi")) for i in range(20)]
    item = " ".join(words)
    put_in = " ".join([*words[:10], "really", *words[10:]])
    # three windows on either side of the word, of thirteen
    assert covers(spark, [put_in, " ".join(words[:10])], [item]) == {(0, 0): 6 / 13}


def test_names_that_begin_sentences(spark):
    item = "Tom has 5 apples. Tom eats 2 apples. Tom buys 7 pears. Tom sells 3 pears."
    other = item.replace("Tom", "Anna").replace("5", "6").replace("7", "9")
    crossed = "Anna has 5 apples. Erin eats 2 apples. Finn buys 7 pears. Jack sells 3 pears."  # no one renaming
    lower = item.replace("Tom", "tom")
    got = covers(spark, [item, other, crossed, lower, "We saw it. " + other, "We know that " + other], [item])
    assert got == {(0, 0): 1.0, (1, 0): 1.0, (3, 0): 1.0, (4, 0): 1.0, (5, 0): 1.0}


def test_dense_slots_match_by_longer_windows(spark):
    item = "we add 3 4 5 6 7 8 and then take away 9 10 11 12 13 from all"
    other = "we add 13 14 15 16 17 18 and then take away 19 20 21 22 23 from all"
    short = "Points: Ann 4 Bob 5 Cid 6 are all there"  # whole, with four literal words
    bare = "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18"
    docs = [item, other, short, short.replace("4", "9").replace("Bob", "Eve"), bare, bare.replace("1", "2"), "so " + other]
    got = covers(spark, docs, [item, short, bare])
    assert set(got) == {(0, 0), (1, 0), (6, 0), (2, 1), (3, 1), (4, 2)} and got[1, 0] == got[6, 0] == got[3, 1] == 1.0
