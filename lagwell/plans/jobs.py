"""Daily jobs and views: cleaning, features, summaries, slate and pipeline status."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwell.functions.text import local_clock, parse_utc
from lagwell.operators import base_features, season
from lagwell.operators.checks import completeness, games_processed
from lagwell.operators.joins import exists_flag
from lagwell.operators.pitches import starters
from lagwell.sources import schemas as S
from lagwell.sources import tables as T


def yesterday(today: dt.date | None = None) -> str:
    return ((today or dt.date.today()) - dt.timedelta(days=1)).isoformat()


def process_day(spark: SparkSession, base: str, date: str, env: str = "") -> DataFrame:
    """Clean, join and write one date's tables; returns the games processed per table."""
    root, year = T.root_of(base, env), date[:4]
    raw = lambda name: f"{root}/raw_data/{name}/{year}/{date}.parquet"
    sched = T.read_table(spark, raw("games/schedule"), S.SCHEDULE)
    info = T.read_table(spark, raw("games/game_info"), S.GAME_INFO)
    bat = T.read_table(spark, raw("games/batter_boxscore"), S.BATTER_BOX)
    pit = T.read_table(spark, raw("games/pitcher_boxscore"), S.PITCHER_BOX)
    pbp = T.read_table(spark, raw("playbyplay"))
    people = T.read_table(spark, f"{base}/reference/player_info/player_info.parquet", S.PLAYERS)
    prepared = {"batter_boxscore": S.prepare(bat, people, sched), "pitcher_boxscore": S.prepare(pit, people, sched),
                "playbyplay": pbp.join(sched.select("gamepk", "game_date", F.year("game_date").alias("game_season")), "gamepk", "left")}
    for name, df in {"games/schedule": sched, "games/game_info": info, "games/batter_boxscore": bat,
                     "games/pitcher_boxscore": pit, **{f"prepared/{k}": v for k, v in prepared.items()}}.items():
        df.withColumns({"year": F.lit(int(year)), "date_key": F.lit(date)}).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("year", "date_key").parquet(f"{root}/processed_data/{name}")
    gaps = completeness(sched, prepared)
    gaps.withColumn("date_key", F.lit(date)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "date_key").parquet(f"{root}/processed_data/gaps")
    return games_processed({"schedule": sched, **prepared})


def feature_transforms(batters: DataFrame, pitchers: DataFrame, pbp: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    """The four daily feature tables, each built only when called."""
    return {
        "player_batter_base": lambda: base_features.batter_features(batters),
        "team_batter_base": lambda: base_features.team_features(batters),
        "starting_pitcher_base": lambda: base_features.starter_features(pitchers, starters(pbp)),
        "bullpen_pitcher_base": lambda: base_features.bullpen_features(pitchers, starters(pbp)),
    }


def create_features(spark: SparkSession, transforms: dict[str, Callable[[], DataFrame]], date: str, path: str) -> tuple[int, DataFrame]:
    """Compute each table, write the date's snapshot, keep failures to themselves.

    Returns 200 or, if any failed, 207 with one status row per table.
    """
    rows, code = [], 200
    for name, make in transforms.items():
        try:
            status, error = T.write_snapshot(T.snapshot(make(), date), f"{path}/{name}"), None
        except Exception as e:
            status, error, code = "error", str(e), 207
        rows.append((name, date, status, error))
    return code, spark.createDataFrame(rows, "transform string, date string, status string, error string")


def materialize_ready(spark: SparkSession, statuses: DataFrame, path: str, keys: dict[str, list[str]], since: str | None,
                      until: str) -> dict[str, DataFrame]:
    """Latest rows per entity of the tables whose snapshot succeeded."""
    ok = [r["transform"] for r in statuses.filter("status = 'ok'").select("transform").collect()]  # at most four rows
    return {n: T.materialize(spark.read.parquet(f"{path}/{n}"), keys[n], since, until) for n in ok}


def season_summaries(batters: DataFrame, pitchers: DataFrame, pbp: DataFrame, path: str) -> None:
    """Batter, starter and team season tables; only the seasons present are replaced."""
    for name, df in {"batter_season_summary": season.batter_summary(batters),
                     "sp_season_summary": season.starter_summary(pitchers, starters(pbp)),
                     "team_season_summary": season.team_summary(batters, pitchers)}.items():
        T.write_season(df, f"{path}/{name}")


def slate(schedule: DataFrame, states: DataFrame, odds: DataFrame) -> DataFrame:
    """Games in start order with local time, lineup state (PENDING by default) and odds flag.

    states holds game_pk (text) and state, odds home_team and away_team.
    """
    d = schedule.withColumn("_k", F.col("game_pk").cast("string"))
    d = d.join(states.select(F.col("game_pk").cast("string").alias("_k"), "state"), "_k", "left")
    d = exists_flag(d, odds, {"home_team_name": "home_team", "away_team_name": "away_team"}, "has_odds")
    return d.select(
        "game_pk", F.col("away_team_name").alias("away_team"), F.col("home_team_name").alias("home_team"), "game_time_utc",
        local_clock(parse_utc("game_time_utc")).alias("game_time_ct"), F.col("venue_name").alias("venue"),
        F.coalesce("state", F.lit("PENDING")).alias("lineup_status"), "has_odds",
        F.lit(None).cast("double").alias("prediction")).orderBy("game_time_utc", "game_pk")


def state_rows(doc: DataFrame) -> DataFrame:
    """Game-state document (map of game to state) to rows."""
    return doc.select("date", "last_checked", F.explode("games").alias("game_pk", "state"))


def pipeline_cards(statuses: DataFrame, today: str, cards: list[tuple[str, str, str]]) -> DataFrame:
    """Latest run of each job with staleness; a job that never ran is stale with an error.

    cards lists (function_name, title, due), due being the day the job must have run for:
    'yesterday' or 'today'.
    """
    spark = statuses.sparkSession
    want = spark.createDataFrame(cards, "function_name string, title string, due string")
    last = T.latest_per_key(statuses, ["function_name"], "run_date", ["completed_at"])
    d = F.broadcast(want).join(last, "function_name", "left")
    day = F.lit(today).cast("date")
    due = F.when(F.col("due") == "yesterday", F.date_sub(day, 1)).otherwise(day)
    run = F.col("run_date").try_cast("date")
    return d.select(
        "function_name", "title", "run_date", "completed_at", "duration_seconds",
        F.coalesce(run != due, F.lit(True)).alias("is_stale"),
        F.when(F.col("run_date").isNull(), F.concat(F.lit("no status for "), "function_name")).otherwise(F.col("error")).alias("error"))


def pipeline_summary(cards: DataFrame) -> DataFrame:
    ok = ~F.col("is_stale") & (F.coalesce("error", F.lit("")) == "")
    return cards.agg(F.count_if(ok).alias("ok_count"), F.count_if("is_stale").alias("stale_count"))
