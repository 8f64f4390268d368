"""Table schemas and conforming: declared columns and types, aliases for renamed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names and types of the tables at rest.
SCHEDULE = """gamepk string, game_datetime timestamp_ntz, game_date timestamp_ntz, game_type string, status string,
away_name string, home_name string, away_id string, home_id string, game_num int, home_probable_pitcher string,
away_probable_pitcher string, away_score float, home_score float, venue_id string, venue_name string,
winning_team string, losing_team string, winning_pitcher string, losing_pitcher string"""
GAME_INFO = """gamepk string, game_season int, weather_condition string, weather_temp string, weather_wind string,
probable_pitcher_away_id string, probable_pitcher_away_fullName string, probable_pitcher_home_id string,
probable_pitcher_home_fullName string, game_duration_minutes float"""
BATTER_BOX = """gamepk string, batting_order string, personId string, team_id string, ab int, h int, r int, doubles int,
triples int, hr int, rbi int, sb int, bb int, k int, lob int, plate_appearances int, singles int, total_bases_from_h int,
total_bases int, fantasy_points float"""
PITCHER_BOX = """personId string, gamepk string, team_id string, ip float, h float, r float, er float, bb float, k float,
hr float, p float, s float, outcome string, fantasy_points float"""
PLAYERS = """personId string, player_name string, weight float, height_in_inches int, birthDate timestamp_ntz,
strikeZoneTop float, strikeZoneBottom float, batSide string, pitchHand string"""
RUN_STATUS = """function_name string, run_date string, status string, started_at string, completed_at string,
duration_seconds double, games_processed map<string,bigint>, error string"""
SCHEDULE_ROWS = """game_pk bigint, home_team_id bigint, away_team_id bigint, home_team_name string, away_team_name string,
game_time_utc string, venue_name string, status string"""
GAME_STATES = "date string, last_checked string, games map<string,string>"
LINEUP = """game_pk bigint, date string, confirmed_at string, home_team_id bigint, away_team_id bigint,
home_lineup array<struct<batting_order:int,player_id:bigint>>, away_lineup array<struct<batting_order:int,player_id:bigint>>,
home_pitcher_id bigint, away_pitcher_id bigint"""
TEAM = "team:struct<id:bigint,name:string>"
SCHEDULE_API = f"""dates array<struct<date:string,games:array<struct<gamePk:bigint,gameDate:string,
status:struct<detailedState:string>,teams:struct<home:struct<{TEAM}>,away:struct<{TEAM}>>,venue:struct<name:string>>>>>"""
OUTCOME = "array<struct<name:string,price:double,point:double>>"
ODDS = f"""id string, home_team string, away_team string, commence_time string,
bookmakers array<struct<key:string,markets:array<struct<key:string,outcomes:{OUTCOME}>>>>"""

# Other spellings of key columns.
ALIASES = {"personId": ["person_id", "player_id", "mlbam_id", "id"], "team_id": ["teamid", "teamId", "team"],
           "gamepk": ["gamePk", "game_pk", "game_id"]}


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def rename_aliases(df: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Rename the first known spelling of each key column to its standard name."""
    lower = {c.lower(): c for c in df.columns}
    for name, others in (aliases or ALIASES).items():
        if name in df.columns:
            continue
        hit = next((lower[o.lower()] for o in [name, *others] if o.lower() in lower), None)
        if hit:
            df = df.withColumnRenamed(hit, name)
    return df


def conform(df: DataFrame, ddl: str, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Select the declared columns with their types; absent or unparsable values are NULL.

    NaN becomes NULL, so that aggregates skip it.
    """
    df = rename_aliases(df, aliases)
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for f in struct(ddl).fields:
        if f.name not in have:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f.name)
        if isinstance(have[f.name], (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        if have[f.name] == f.dataType:
            out.append(c.alias(f.name))
        elif isinstance(f.dataType, T.IntegralType) and isinstance(have[f.name], T.StringType):
            # '12.0' and '12' both read as 12
            out.append(c.try_cast("double").try_cast(f.dataType).alias(f.name))
        else:
            out.append(c.try_cast(f.dataType).alias(f.name))
    return df.select(*out)


def prepare(box: DataFrame, players: DataFrame, schedule: DataFrame) -> DataFrame:
    """Attach player name and the game's type, dates and season."""
    p = players.groupBy("personId").agg(F.min("player_name").alias("player_name"))
    s = schedule.select("gamepk", "game_type", "game_date", "game_datetime",
                        F.year("game_date").cast("int").alias("game_season"))
    return box.join(p, "personId", "left").join(s, "gamepk", "left")
