"""Plate-appearance model frame: outcomes with season and rolling lookups by role."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwell.operators import partials as P
from lagwell.operators import rolling as R
from lagwell.operators import season as S
from lagwell.operators.clean import batting_order
from lagwell.operators.joins import in_game, role_key
from lagwell.plans.scale import parts, stage


def pa_outcomes(pbp: DataFrame, box: DataFrame, game_info: DataFrame, schedule: DataFrame, n: int | None = None) -> DataFrame:
    """Distinct outcomes per appearance with date, weather and lineup code; substitutes without a code drop out.

    Dealt into n partitions by game.
    """
    cols = ["gamepk", "batter_team_id", "play_id", "pitcher_id", "pitcher_name", "batter_id", "batter_name", "is_hit",
            "pitcher_throw_hand", "batter_bat_side", "pitcher_role", "pitcher_team_id"]
    n = n or parts(pbp)
    dealt = lambda df, *c: df.select("gamepk", *c).repartition(n, "gamepk")
    once = lambda df, *c: dealt(df, *c).groupBy("gamepk").agg(F.min_by(F.struct(*c), F.struct(*c)).alias("_r")).select("gamepk", "_r.*")
    d = dealt(pbp, *cols[1:]).distinct()
    d = d.join(once(schedule, "game_date"), "gamepk", "left")
    d = d.join(once(game_info, "game_season", "weather_condition", "weather_temp"), "gamepk", "left")
    return in_game(d, batting_order(dealt(box, "personId", "batting_order")), ["batter_id"], "inner")


def build(pbp: DataFrame, batter_box: DataFrame, pitcher_box: DataFrame, game_info: DataFrame, schedule: DataFrame,
          short: int = 10) -> DataFrame:
    """The whole frame: three season lookups and six rolling ones.

    pbp is the derived pitch table, pitcher_box holds decimal innings, game_info parsed weather. A reliever's hand is unknown
    before the game and stays NULL. Inputs that several branches read are staged once, narrow: partials of a game and role,
    which seasons and windows both start from, and boxscore lines. Windows deal them once by whom they follow. Every lookup is
    brought to the games it serves and dealt by game, where the appearances already are, and only rows that an appearance
    asks for travel: the frame itself, which grows by each lookup, is never dealt anew.
    """
    pbp, batter_box = stage(pbp), stage(batter_box)
    lines = stage(S.tag_roles(pitcher_box, pbp))
    n, windows = parts(pbp), ("season", short)
    pa = stage(role_key(pa_outcomes(pbp, batter_box, game_info, schedule, n)))
    batter, role = ["batter_id"], S.ROLE_KEY
    # game tables know which of their rows an appearance asks for, before windows make them wide
    met = lambda df, keys: stage(df.join(pa.select("gamepk", *keys).distinct().withColumn("_met", F.lit(True)), ["gamepk", *keys], "left"))
    games = met(P.pitcher_games(S.with_role_key(pbp, "pitcher_id", "pitcher_team_id"), role), role)
    rows = met(S.role_lines(lines, R.BOX_SUMS), role)
    box = met(batter_box.withColumnRenamed("personId", "batter_id"), batter).withColumnRenamed("batter_id", "personId")
    # season tables are looked up by the distinct keys of the games
    asked = lambda keys: pa.select("gamepk", "game_season", *keys).repartition("game_season", *keys).distinct()
    bs = asked(batter).join(S.batter_box_season(batter_box).withColumnRenamed("personId", "batter_id"), ["game_season", *batter], "left")
    ps = asked(role).join(S.pitcher_box_season_roles(lines), ["game_season", *role], "left")
    ps = ps.join(S.pitcher_season_of_games(games), ["game_season", *role], "left")
    br = R.batter_box_rolling(box, windows, ["_met"], n).withColumnRenamed("personId", "batter_id")
    pr = R.pitcher_box_rolling(rows, windows, role, ["_met"], n)
    pp = R.pitcher_games_rolling(games, windows, role, ["_met"], n)
    asked_for = lambda df: df.filter("_met").drop("_met", "game_date")
    d = pa.repartition(n, "gamepk")
    for t, keys in ((bs, batter), (ps, role), (asked_for(br), batter), (asked_for(pr), role), (asked_for(pp), role)):
        d = in_game(d, t.drop("game_season").repartition(n, "gamepk"), keys)
    return d
