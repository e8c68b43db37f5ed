"""Scans, payloads, sinks and increments on small files."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from formline.session import run_dir, shared_dir
from formline.sources import box as B
from formline.sources import increments as I
from formline.sources import odds as O
from formline.sources import sinks as K


def write(path, text):
    path.write_text(text)
    return str(path)


SCHEMA = "id long, gameDateTimeEst string, points int"


def test_csv_by_name_with_mixed_times(spark, tmp_path):
    path = write(tmp_path / "a.csv", "points,extra,id,gameDateTimeEst\n7,x,1,2025-01-02 19:00:00\nbad,y,2,2025-01-03T01:00:00Z\n,z,3,soon\n")
    rows = {r["id"]: r for r in B.scan_csv(spark, path, SCHEMA).collect()}
    assert rows[1]["points"] == 7 and rows[1]["game_date"] == datetime.date(2025, 1, 2)
    assert rows[2]["points"] is None and rows[2]["game_date"] == datetime.date(2025, 1, 3)
    assert rows[3]["game_date"] is None


def test_csv_missing_column_fails(spark, tmp_path):
    path = write(tmp_path / "b.csv", "id,points\n1,2\n")
    with pytest.raises(Exception, match="gameDateTimeEst"):
        B.scan_csv(spark, path, SCHEMA)


def test_csv_reads_only_needed_columns(spark, tmp_path):
    path = write(tmp_path / "c.csv", "id,gameDateTimeEst,points\n1,2025-01-02,2\n")
    plan = B.scan_csv(spark, path, SCHEMA).select("points")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<points:string>" in plan


def test_unknown_season(spark):
    df = spark.range(1).select(F.lit("2025-01-01").cast("date").alias("d"))
    assert B.filter_season(df, "d", "2024-25").count() == 1
    with pytest.raises(ValueError, match="2023-24"):
        B.filter_season(df, "d", "2023-24")


EVENT = {
    "id": "e1", "home_team": "H", "away_team": "A", "commence_time": "2025-01-01T00:00:00Z",
    "bookmakers": [
        {"key": "b1", "title": "B1", "markets": [
            {"key": "player_threes", "outcomes": [
                {"name": "Over", "description": "X Y", "point": 2.5, "price": -110},
                {"name": "Under", "description": "X Y", "point": 2.5, "price": -110},
                {"name": "Over", "description": None, "point": 1.5, "price": 100},
                {"name": "Over", "description": "Z", "point": None, "price": 100}]},
            {"key": "player_oddity", "outcomes": [{"name": "Over", "description": "X Y", "point": 9.5, "price": None}]},
            {"key": "spreads", "outcomes": [{"name": "H", "point": -7.5}, {"name": "A", "point": 7.5}]},
            {"key": "totals", "outcomes": [{"name": "Over", "point": 225.5}]}]},
        {"key": "b2", "title": "B2", "markets": [{"key": "spreads", "outcomes": [{"name": "H", "point": -3.0}]}]},
    ],
}


def test_payload(spark):
    docs = [(1, json.dumps(EVENT)), (2, json.dumps({**EVENT, "bookmakers": []})), (3, "not json")]
    events = O.parse_payload(spark.createDataFrame(docs, "k int, t string"), "t")
    rows = [(r["k"], r["prop"], r["player"], r["line"], r["odds"]) for r in O.flatten_odds_payload(events).collect()]
    assert sorted(rows) == [(1, "3PM", "X Y", 2.5, -110), (1, "ODDITY", "X Y", 9.5, None)]
    assert O.flatten_odds_payload(events, book="b9").count() == 0
    games = {r["k"]: (r["spread"], r["total"]) for r in O.flatten_game_lines(events).collect()}
    assert games == {1: (7.5, 225.5), 2: (None, None), 3: (None, None)}


def test_payload_is_parsed_once(spark):
    events = O.parse_payload(spark.createDataFrame([(1, "{}")], "k int, t string"), "t")
    plan = O.flatten_odds_payload(events)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1


def test_upsert_and_stored_replacement(spark):
    old = spark.createDataFrame([("2025-01-01", 1), ("2025-01-02", 2)], "d string, v int").withColumn("d", F.to_date("d"))
    new = spark.createDataFrame([("2025-01-02", 9), ("2025-01-03", 3)], "d string, v int").withColumn("d", F.to_date("d"))
    want = [1, 3, 9]
    assert sorted(r["v"] for r in I.upsert_by_date(old, new, "d").collect()) == want
    path = run_dir(spark, "t")
    I.write_dates(old, path, "d")
    I.write_dates(new, path, "d")
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == want


def test_season_cache_builds_only_missing(spark):
    path, built = run_dir(spark, "cache"), []

    def build(names):
        built.append(list(names))
        return spark.createDataFrame([(n, 1) for n in names], "season string, v int")

    I.season_cache(spark, path, ["a"], build)
    assert I.season_cache(spark, path, ["a", "b"], build).count() == 2
    I.season_cache(spark, path, ["b"], build)
    I.season_cache(spark, path, ["b"], build, force=True)
    assert built == [["a"], ["b"], ["b"]]


def test_picks_sink(spark):
    df = spark.createDataFrame([("X", "PTS", 20.5, "OVER", 8, 0.1), ("Y", "REB", 5.5, "UNDER", 3, -0.1)],
                               "player string, prop string, line double, side string, confidence int, edge double")
    out = K.sink_picks(df, run_dir(spark, "picks"))
    assert spark.read.csv(out["all"], header=True).count() == 2
    assert spark.read.csv(out["high"], header=True).first()["Player"] == "X"
    assert set(spark.read.json(out["json"]).columns) == {"Player", "Prop", "Line", "Pick", "Confidence", "Edge"}


def test_shared_dir_follows_the_session(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (named or shared_dir(spark))
    assert run_dir(spark, "x") != run_dir(spark, "x")


def test_files_of_one_folder_are_read_by_their_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,extra\n1,2,3\n")
    (tmp_path / "b.csv").write_text("y,x\n1,2\n")
    (tmp_path / "c.csv").write_text("x\n7\n")
    (tmp_path / "d.csv").write_text("")
    got = B.read_named(spark, str(tmp_path), "x long, y long").collect()
    assert sorted(map(tuple, got), key=repr) == [(1, 2), (2, 1), (7, None)]
    with pytest.raises(ValueError, match="no file has"):
        B.read_named(spark, str(tmp_path), "x long, z long")


def test_headers_of_many_files_are_read_in_one_job(spark, tmp_path):
    from formline.sources.box import by_header, read_named

    for i in range(300):
        head = ("" if i % 2 else "\ufeff") + "id,name,extra" if i % 3 == 0 else 'name,"id"' if i % 3 == 1 else "id,ID,name"
        row = {0: f"{i},n{i},x", 1: f"n{i},{i}", 2: f"{i},0,n{i}"}[i % 3]
        (tmp_path / f"part {i}.csv").write_text(f"\n{head}\n{row}\n" if i % 2 else f"{head}\n{row}\n", encoding="utf-8")
    (tmp_path / "empty.csv").write_text("")
    before = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    found = by_header(spark, str(tmp_path))
    jobs = before.getJobIdsForGroup("headers")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 2 and {k: len(v) for k, v in found.items()} == {
        ("id", "name", "extra"): 100, ("name", "id"): 100, ("id", "ID", "name"): 100}
    got = {r["name"]: r["id"] for r in read_named(spark, str(tmp_path), "id long, name string").collect()}
    # a name that two columns share is not there
    assert got == {f"n{i}": None if i % 3 == 2 else i for i in range(300)}


def test_profile_of_many_seasons_and_missing_keys(spark):
    from formline.operators.profile import profile_dataset

    rows = [(f"s{i % 70}" if i % 11 else None, ["A", "B"][i % 2], i % 90 if i % 7 else None, i % 13, i % 2) for i in range(900)]
    df = spark.createDataFrame(rows, "season string, prop string, game int, player int, y int").withColumn("day", F.lit("2024-01-01").cast("date"))
    got = {(r["scope"]): (r["records"], r["games"], r["players"], r["over_share"]) for r in
           profile_dataset(df, "day", "game", "player", "season", "prop", "y").collect()}
    scopes = {"all": rows, None: [r for r in rows if r[0] is None]}
    scopes |= {f"season {s}": [r for r in rows if r[0] == s] for s in {r[0] for r in rows} - {None}}
    scopes |= {f"type {p}": [r for r in rows if r[1] == p] for p in "AB"}
    assert got == {k: (len(v), len({r[2] for r in v} - {None}), len({r[3] for r in v}), sum(r[4] for r in v) / len(v)) for k, v in scopes.items()}
    empty = profile_dataset(df.limit(0), "day", "game", "player", "season", "prop", "y").collect()
    assert [(r["scope"], r["records"], r["games"]) for r in empty] == [("all", 0, 0)]


def test_a_write_that_dies_before_its_commit_is_not_there(spark, monkeypatch):
    from formline.sources import manifest

    path, built = run_dir(spark, "cache"), []

    def build(names):
        built.append(list(names))
        return spark.createDataFrame([(n, "2024-01-01") for n in names], "season string, d string").withColumn("d", F.col("d").cast("date"))

    real = manifest.commit
    monkeypatch.setattr(manifest, "commit", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    for _ in range(2):
        try:
            I.season_cache(spark, path, ["2001"], build)
        except OSError:
            pass
    assert manifest.newest(spark, path) == (0, {})
    monkeypatch.setattr(manifest, "commit", real)
    got = I.season_cache(spark, path, ["2001", "b"], build)
    assert sorted(r["season"] for r in got.collect()) == ["2001", "b"] and built == [["2001"], ["2001"], ["2001", "b"]]
    # a season stays while it has the day asked for, and is built again while it has not
    I.season_cache(spark, path, ["b"], build, day="d", must_have={"b": "2024-01-01"})
    assert len(built) == 3
    I.season_cache(spark, path, ["2001", "b"], build, day="d", must_have={"b": "2024-01-02"})
    assert built[3:] == [["b"]] and manifest.newest(spark, path)[0] == 2
    assert I.season_cache(spark, path, ["2001", "b"], build, day="d", between=("2024-01-02", "2024-02-01")).isEmpty()
    try:
        manifest.commit(spark, path, 1, {})
        raise AssertionError("a second writer of the same number")
    except RuntimeError:
        pass


def test_sessions_mark_new_days_once(spark, monkeypatch):
    from formline.sources import manifest

    path = run_dir(spark, "sessions")
    assert I.marked_dates(spark, path).isEmpty() and I.sessions(spark, path).isEmpty()
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-05')) d")
    I.mark_session(days, path, "d", "one", {"accuracy": "51.2"})
    I.mark_session(days.unionByName(days).withColumn("d", F.date_add("d", 3)), path, "d", "two", {})
    assert I.marked_dates(spark, path).count() == 8
    assert [(r["position"], r["session"], r["dates"], r["info"]) for r in I.sessions(spark, path).collect()] == [
        (0, "one", 5, {"accuracy": "51.2"}), (1, "two", 3, {})]
    assert [r["session"] for r in I.sessions(spark, path, 1).collect()] == ["two"]
    monkeypatch.setattr(manifest, "commit", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    try:
        I.mark_session(days.withColumn("d", F.date_add("d", 30)), path, "d", "three", {})
    except OSError:
        pass
    assert I.marked_dates(spark, path).count() == 8
