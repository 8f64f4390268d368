"""Sources, daily jobs and views over small written tables."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lagwell.plans import jobs as JB
from lagwell.sources import schemas as S
from lagwell.sources import tables as T


def test_conform_aliases_and_types(spark):
    d = spark.createDataFrame([(1, "12.0", "x", float("nan"))], "person_id int, ab string, h string, fantasy_points double")
    r = S.conform(d, "personId string, ab int, h int, fantasy_points float, k int").first()
    assert r.asDict() == {"personId": "1", "ab": 12, "h": None, "fantasy_points": None, "k": None}


def test_dates_and_seasons_are_replaced(spark, tmp_path):
    p = str(tmp_path / "t")
    mk = lambda d, v: spark.createDataFrame([(dt.datetime(2024, 5, d), v)], "game_date timestamp_ntz, v int")
    T.write_dates(mk(1, 1).unionByName(mk(2, 2)), p)
    T.write_dates(mk(2, 9), p)
    assert [(r["date_key"].isoformat(), r["v"]) for r in rows(spark.read.parquet(p), "date_key")] == [("2024-05-01", 1), ("2024-05-02", 9)]
    q = str(tmp_path / "s")
    T.write_season(spark.createDataFrame([(1, 2023), (2, 2024)], "v int, game_season int"), q)
    T.write_season(spark.createDataFrame([(5, 2024)], "v int, game_season int"), q)
    assert sorted((r["game_season"], r["v"]) for r in spark.read.parquet(q).collect()) == [(2023, 1), (2024, 5)]


def test_missing_and_latest(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        T.read_table(spark, str(tmp_path / "none"))
    assert T.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    p = str(tmp_path / "l")
    for i in (1, 2):
        spark.createDataFrame([(i,)], "a int").coalesce(1).write.mode("append").json(p)
    assert T.read_latest(spark, p, "a int", "json").count() == 1
    assert T.root_of("b", "test") == "b/test" and T.root_of("b", "test", "player_info") == "b"


def test_nested_documents(spark):
    odds = spark.read.schema(S.ODDS).json(spark.sparkContext.parallelize([
        '{"id":"1","home_team":"H","away_team":"A","bookmakers":[{"key":"dk","markets":[{"key":"h2h","outcomes":'
        '[{"name":"H","price":1.8},{"name":"A","price":2.1}]}]}]}', '{"id":"2","home_team":"X","away_team":"Y","bookmakers":[]}']))
    assert [(r["id"], r["name"], r["price"]) for r in rows(T.odds_lines(odds), "id", "name")] == [
        ("1", "A", 2.1), ("1", "H", 1.8), ("2", None, None)]


def test_snapshots_quota_and_status(spark, tmp_path):
    d = spark.createDataFrame([("a", dt.datetime(2024, 5, 1)), ("a", dt.datetime(2024, 5, 2))], "k string, game_date timestamp_ntz")
    assert T.write_snapshot(T.snapshot(d, "2024-06-01"), str(tmp_path / "x")) == "empty"

    def broken():
        raise RuntimeError("no input")

    code, st = JB.create_features(spark, {"good": lambda: d, "bad": broken, "none": lambda: d.limit(0)}, "2024-05-02", str(tmp_path / "f"))
    assert code == 207 and {r["transform"]: r["status"] for r in st.collect()} == {"good": "ok", "bad": "error", "none": "empty"}
    ready = JB.materialize_ready(spark, st, str(tmp_path / "f"), {"good": ["k"]}, None, "2024-05-03 00:00:00")
    assert list(ready) == ["good"] and ready["good"].count() == 1
    calls = spark.range(450).selectExpr("timestamp_ntz '2024-05-01' as t")
    q = T.monthly_quota(calls, "t", 500).first()
    assert (q["used"], q["warn"], q["stop"]) == (450, True, False)
    assert T.monthly_quota(calls, "t", 450).first()["stop"] is True


def test_slate_defaults_to_pending(spark):
    sched = spark.createDataFrame([(2, "H2", "A2", "2024-07-01T23:05:00Z", "V"), (1, "H1", "A1", "2024-07-01T17:05:00Z", "V")],
                                  "game_pk bigint, home_team_name string, away_team_name string, game_time_utc string, venue_name string")
    states = spark.createDataFrame([("1", "CONFIRMED")], "game_pk string, state string")
    odds = spark.createDataFrame([("H2", "A2")], "home_team string, away_team string")
    r = JB.slate(sched, states, odds).collect()
    assert [(x["game_pk"], x["lineup_status"], x["has_odds"], x["game_time_ct"]) for x in r] == [
        (1, "CONFIRMED", False, "12:05 PM"), (2, "PENDING", True, "6:05 PM")]


CARDS = [("fetch", "Fetch", "yesterday"), ("process", "Process", "yesterday"), ("odds", "Odds", "today")]


def test_pipeline_cards(spark):
    st = T.status_row(spark, function_name="fetch", run_date="2024-05-01", status="success", completed_at="z")
    c = {r["function_name"]: r for r in JB.pipeline_cards(st, "2024-05-02", CARDS).collect()}
    assert c["fetch"]["is_stale"] is False and c["odds"]["is_stale"] is True
    s = JB.pipeline_summary(JB.pipeline_cards(st, "2024-05-02", CARDS)).first()
    assert (s["ok_count"], s["stale_count"]) == (1, 2)


def test_process_day_round_trip(spark, tmp_path):
    base, day = str(tmp_path), "2024-05-01"
    put = lambda df, name: df.write.parquet(f"{base}/raw_data/{name}/2024/{day}.parquet")
    ts = dt.datetime(2024, 5, 1, 18)
    put(spark.createDataFrame([("1", ts, ts, "R"), ("2", ts, ts, "R")], "gamepk string, game_datetime timestamp_ntz, game_date timestamp_ntz, game_type string"),
        "games/schedule")
    put(spark.createDataFrame([("1", 2024)], "gamepk string, game_season int"), "games/game_info")
    put(spark.createDataFrame([("1", "7", 4, 2)], "gamepk string, personId string, ab int, h int"), "games/batter_boxscore")
    put(spark.createDataFrame([("1", "8", 6.1)], "gamepk string, personId string, ip double"), "games/pitcher_boxscore")
    put(spark.createDataFrame([("1", 1)], "gamepk string, play_id int"), "playbyplay")
    spark.createDataFrame([("7", "Seven")], "personId string, player_name string").write.parquet(f"{base}/reference/player_info/player_info.parquet")
    done = {r["table_name"]: r["games"] for r in JB.process_day(spark, base, day).collect()}
    assert done == {"schedule": 2, "batter_boxscore": 1, "pitcher_boxscore": 1, "playbyplay": 1}
    b = spark.read.parquet(f"{base}/processed_data/prepared/batter_boxscore").first()
    assert (b["player_name"], b["game_season"], b["h"]) == ("Seven", 2024, 2)
    gaps = spark.read.parquet(f"{base}/processed_data/gaps")
    assert gaps.filter(F.col("gamepk") == "2").count() == 3


def test_csv_predictions_and_run_log(spark, tmp_path):
    from lagwell.operators import evaluate as E
    from lagwell.operators import ml

    p = str(tmp_path / "preds")
    spark.createDataFrame([(1, 0.7), (0, 0.2)], "is_hit int, pred_prob double").write.option("header", True).csv(p)
    d = T.read_table(spark, p, "is_hit int, pred_prob double", "csv")
    m = E.probability_scores(d, "is_hit", "pred_prob")
    ml.log_run(m, {"model": "x"}, {"git_sha": "abc"}, str(tmp_path / "runs"))
    ml.log_run(m, {"model": "y"}, {}, str(tmp_path / "runs"))
    log = spark.read.parquet(str(tmp_path / "runs"))
    assert sorted(r["params"]["model"] for r in log.collect()) == ["x", "y"]
    T.write_report(E.quantile_calibration(d, "is_hit", "pred_prob", 2), m, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report" / "calibration")).count() == 2


def test_season_summary_job(spark, sf, tmp_path):
    from harness import tables as t

    p = str(tmp_path / "summaries")
    JB.season_summaries(t.batter_box(spark, sf), t.pitcher_box(spark, sf), t.pitches_raw(spark, sf), p)
    for name in ("batter_season_summary", "sp_season_summary", "team_season_summary"):
        assert spark.read.parquet(f"{p}/{name}").select("game_season").distinct().count() > 1
