"""Documents and statuses written, read back and turned into rows; seasons of drifting schemas; the daily transforms."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lagwell.plans import jobs as J
from lagwell.sources import schemas as S
from lagwell.sources import tables as T


def document(path, value):
    path.mkdir()
    (path / "part.json").write_text(json.dumps(value))
    return str(path)


def test_schedule_api_document_to_rows(spark, tmp_path):
    side = lambda i, n: {"team": {"id": i, "name": n}}
    game = {"gamePk": 7, "gameDate": "2024-05-01T17:05:00Z", "status": {"detailedState": "Scheduled"}, "teams": {"home": side(1, "H"), "away": side(2, "A")}, "venue": {"name": "V"}}
    api = T.read_table(spark, document(tmp_path / "api", {"dates": [{"date": "2024-05-01", "games": [game, {**game, "gamePk": 8}]}, {"date": "2024-05-02", "games": []}]}), S.SCHEDULE_API, "json")
    got = T.schedule_rows(api)
    assert {(f.name, f.dataType) for f in got.schema} == {(f.name, f.dataType) for f in S.struct(S.SCHEDULE_ROWS)}
    assert [(r["game_pk"], r["home_team_name"], r["away_team_id"]) for r in rows(got, "game_pk")] == [(7, "H", 2), (8, "H", 2)]


def test_states_and_lineups_keep_their_declared_shape(spark, tmp_path):
    doc = {"date": "2024-05-01", "last_checked": None, "games": {"7": "PENDING", "8": "CONFIRMED"}}
    states = T.read_table(spark, document(tmp_path / "states", doc), S.GAME_STATES, "json")
    assert [(r["game_pk"], r["state"]) for r in rows(J.state_rows(states), "game_pk")] == [("7", "PENDING"), ("8", "CONFIRMED")]
    from lagwell.streaming.lineups import payload
    confirmed = spark.range(1).selectExpr("7L AS game_pk", "'2024-05-01' AS date", "'t' AS confirmed_at", "1L AS home_team_id", "2L AS away_team_id", "array(5L, 6L) AS home_order",
                                          "array(9L) AS away_order", "3L AS home_pitcher_id", "4L AS away_pitcher_id")
    out = T.declared_fields(payload(confirmed), S.LINEUP)
    assert out.columns == [f.name for f in S.struct(S.LINEUP).fields]
    path = str(tmp_path / "lineup")
    out.write.json(path)
    back = T.read_table(spark, path, S.LINEUP, "json").first()
    assert [(x["batting_order"], x["player_id"]) for x in back["home_lineup"]] == [(1, 5), (2, 6)] and back["away_pitcher_id"] == 4


def test_statuses_append_by_job(spark, tmp_path):
    path = str(tmp_path / "status")
    for name, day in (("fetch", "2024-05-01"), ("fetch", "2024-05-02"), ("odds", "2024-05-02")):
        T.append_status(T.status_row(spark, function_name=name, run_date=day, completed_at=day, games_processed={"a": 3}), path)
    got = T.read_table(spark, path, S.RUN_STATUS, "json")
    cards = {r["function_name"]: r["is_stale"] for r in J.pipeline_cards(got, "2024-05-02", [("fetch", "F", "today"), ("odds", "O", "yesterday"), ("none", "N", "today")]).collect()}
    assert cards == {"fetch": False, "odds": True, "none": True}


def test_old_schedules_read_as_new_ones(spark):
    old = spark.createDataFrame([("7", "H", "A", "2024-05-01T17:05:00Z", "V", "Final")], "game_id string, home_name string, away_name string, game_datetime string, venue_name string, status string")
    r = T.legacy_schedule(old).first()
    assert (r["game_pk"], r["home_team_name"], r["game_time_utc"]) == (7, "H", "2024-05-01T17:05:00Z")


def test_seasons_of_one_schema_are_one_scan(spark, tmp_path):
    root = str(tmp_path)
    for y in (2021, 2022, 2023):
        d = spark.range(3).select(F.col("id").alias("k"), F.lit(y).alias("y"), F.lit("1.5" if y == 2022 else 1.5).cast("string" if y == 2022 else "double").alias("v"))
        d.write.parquet(f"{root}/t/{y}")
    got = T.read_seasons(spark, root, "t", [2021, 2022, 2023], "k bigint, y int, v double", {"v": "double"})
    assert got.count() == 9 and got.filter("v = 1.5").count() == 9
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2
    assert T.read_season(spark, root, "t", 2023).count() == 3
    with pytest.raises(FileNotFoundError):
        T.read_seasons(spark, root, "t", [1999])


def test_daily_transforms_are_built_only_when_called(spark):
    made = J.feature_transforms(None, None, None)
    assert set(made) == {"player_batter_base", "team_batter_base", "starting_pitcher_base", "bullpen_pitcher_base"}
