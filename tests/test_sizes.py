"""What a task holds and what a plan repeats, with inputs taken as large."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from bindings import base, plans, selecting
from formline.operators.ordered import Frame, rolling

SF = "/root/testdata/sf0.001"
__spark_entry__.queries()


@contextmanager
def large(spark, task_bytes, **more):
    names = {"spark.formline.smallInputBytes": "0", "spark.formline.taskBytes": str(task_bytes), **more}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in names:
            spark.conf.unset(k)


def counted(monkeypatch, module, name):
    calls, old = [], getattr(module, name)

    def spy(*args, **kw):
        calls.append(args)
        return old(*args, **kw)

    monkeypatch.setattr(module, name, spy)
    return calls


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("split", [4_000_000, 400])
def test_large_input_is_dealt_by_its_size(spark, tmp_path, split):
    rows = spark.range(6000).selectExpr("if(id < 900, 0, id % 300) e", "id t", "double(id % 7) v")
    rows.write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    frames = [Frame("m", "mean", "v", 3), Frame("n", "count", "v", None)]
    want = rows_of(rolling(df, ["e"], ["t"], frames))
    spark.conf.set("spark.formline.splitRows", str(split))
    try:
        with large(spark, 1000):
            out = rolling(df, ["e"], ["t"], frames)
            got = rows_of(out)
            sizes = out.groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.formline.splitRows")
    assert got == want and sizes > 16


def test_raw_lines_are_dealt_by_their_size(spark):
    query = base.QUERIES["best_price"]
    want = rows_of(query(spark, SF))
    with large(spark, 1000, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        out = query(spark, SF)
        assert out.groupBy(F.spark_partition_id()).count().count() > 16
        assert rows_of(out) == want


def test_union_selected_runs_the_rows_once(spark, monkeypatch):
    want = rows_of(base.QUERIES["union_selected"](spark, SF))
    calls = counted(monkeypatch, selecting, "prop_rows")
    with large(spark, 10_000_000):
        assert rows_of(base.QUERIES["union_selected"](spark, SF)) == want
    assert len(calls) == 1


def test_build_dataset_makes_its_box_rows_once(spark, monkeypatch):
    want = base.QUERIES["build_dataset"](spark, SF)
    want = rows_of(want)
    calls = [counted(monkeypatch, m, "box") for m in (base, plans)]
    with large(spark, 10_000_000):
        assert rows_of(base.QUERIES["build_dataset"](spark, SF)) == want
    assert sum(map(len, calls)) == 1


def test_smart_filter_carries_what_it_reads(spark, monkeypatch):
    calls = counted(monkeypatch, selecting.T, "smart_filter")
    base.QUERIES["smart_filter"](spark, SF)
    assert set(calls[0][0].columns) == {"slate", "entity_id", "prop", "game_id", "line", "odds", "edge", "quality"}


def test_rows_of_all_types_are_made_once(spark, monkeypatch):
    """Each type reads what was written once, instead of joining and ranking all rows again; the rows are the same."""
    def one(rows):
        seen.append(rows)
        return rows.groupBy("game_date").agg(F.count("*").alias("n"), F.sum("outcome").alias("wins"), F.round(F.sum("l5"), 6).alias("l5"))

    seen = []
    want = rows_of(plans._by_type(spark, SF, one))
    with large(spark, 1 << 20):
        written, seen = counted(monkeypatch, plans, "staged"), []
        got = plans._by_type(spark, SF, one)
        assert len(written) == 1 and len(seen) == len(plans.STATS)
        for rows in seen:
            plan = rows._jdf.queryExecution().optimizedPlan().toString()
            assert "Window" not in plan and "Join" not in plan
        assert rows_of(got) == want and len(want) > 10
