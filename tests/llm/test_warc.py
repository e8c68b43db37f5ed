import gzip
import hashlib
from glob import glob

import pytest

from formline.llm import warc

SCHEMA = "page_id bigint, url string, html string, archive string, salt int, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def by_hand(rows):
    last = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and i is not None:
            last[data] = max(i, last.get(data, i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        to = last.get(data)
        to = None if to == i else to
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/ b\r\nX: y", "é" * 600), (2, "http://a", "é" * 600), (3, None, "é" * 600), (4, "u", None), (5, "u", ""),
    (6, "u", "short"), (7, "u", "short"), (8, "u", "WARC/1.1\r\n\r\n" * 200), (None, "u", "n" * 2000), (9, "u", "n" * 2000),
    (10, "u", "z" * 3_000_000), (11, "u", "t" * 1000), (11, "u", "t" * 1000), (12, "u", "k" * 999), (13, "u", "k" * 999),
    (None, "u", "m" * 1500),
]


def test_round_trip_equals_brute_force(spark):
    got = warc.round_trip(pages(spark, ROWS).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == by_hand(ROWS)


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_every_member_stands_alone_and_the_sidecar_finds_it(spark):
    index, folder = warc.archive_pages(pages(spark, ROWS))
    sides = glob(f"{folder}/members-*.idx")
    assert len(sides) == index.select("archive").distinct().count()
    seen = 0
    for side in sides:
        data = open(side.removesuffix(".idx"), "rb").read()
        end = 0
        for line in open(side).read().splitlines():
            at, size, name = line.split("\t")
            assert int(at) == end
            end += int(size)
            assert f"WARC-Record-ID: {name}".encode() in gzip.decompress(data[int(at):end])
            seen += 1
        assert end == len(data)
    assert seen == len(ROWS)


def test_payloads_come_back(spark):
    index, folder = warc.archive_pages(pages(spark, ROWS))
    got = {r.page_id: bytes(r.payload) for r in warc.read(index, folder, with_payload=True).where(
        "record_type = 'response' and page_id is not null").collect()}
    assert got[10] == b"z" * 3_000_000 and got[8] == b"WARC/1.1\r\n\r\n" * 200 and got[4] == b""


def test_truncated_archive_raises(spark, tmp_path):
    data = warc.record_bytes(1, "u", b"x" * 100, "d", None)
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(data[:-60]))
    cut = spark.createDataFrame([(str(tmp_path / "cut.warc.gz"),)], "archive string")
    with pytest.raises(Exception, match="ends inside a record"):
        warc.normalise(cut, str(tmp_path)).collect()
