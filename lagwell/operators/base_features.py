"""Daily base features: strictly lagged windows of batters, teams, starters and bullpens.

Frame names are kept as they are known: for batters and teams '3game' spans the two games
before and '7game' the six before, for starters and bullpens N means N. The season frame
is taken within the season, so several seasons can be computed at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwell.operators.clean import capped_rates, decimal_innings, drop_seasons
from lagwell.operators.joins import in_game
from lagwell.plans.frames import Feature, lagged, last, prior, spread

ORDER = ["game_date", "gamepk"]
SEASON = prior("game_season")
FULL = ("sum", "avg", "std", "median")
TEAM_SUMS = {
    "total_plate_appearances": "plate_appearances", "total_ab": "ab", "total_h": "h", "total_r": "r",
    "total_singles": "singles", "total_doubles": "doubles", "total_triples": "triples", "total_hr": "hr",
    "total_bases": "total_bases", "total_bases_from_h": "total_bases_from_h", "total_rbi": "rbi",
    "total_lob": "lob", "total_sb": "sb", "total_bb_bat": "bb", "total_k_bat": "k",
    "total_batter_fantasy_points": "fantasy_points",
}
RATES = ["era", "whip", "k9", "bb9", "hr9", "k_per_ip", "bb_per_ip", "hr_per_ip", "h_per_ip", "er_per_ip", "ip"]
BATTER_COUNTS = ["plate_appearances", "ab", "h", "r", "singles", "doubles", "triples", "hr", "total_bases",
                 "total_bases_from_h", "rbi", "lob", "sb", "bb", "k", "fantasy_points"]


def batter_features(box: DataFrame) -> DataFrame:
    """51 lagged columns per batter and game."""
    d = box.select("personId", "team_id", "gamepk", "game_date", "game_season", "player_name", "batting_order",
                   *[F.col(c).cast("double").alias(c) for c in BATTER_COUNTS])
    three, seven = last(2), last(6)
    feats: list[Feature] = []
    for c in ("h", "k"):
        feats += spread([c], FULL, three, "rolling_3game_{col}_{agg}")
        feats += spread([c], FULL, seven, "rolling_7game_{col}_{agg}")
        feats += spread([c], FULL, SEASON, "season_{col}_{agg}")
    tb, pa, mean = {"tb": "total_bases"}, {"pa": "plate_appearances"}, ("sum", "avg")
    feats += spread(tb, ("sum", "avg", "std"), three, "rolling_3game_{col}_{agg}")
    feats += spread(tb, ("sum", "avg", "std"), seven, "rolling_7game_{col}_{agg}")
    feats += spread(tb, mean, SEASON, "season_{col}_{agg}")
    for c in ("hr", "rbi", "bb"):
        feats += spread([c], mean, seven, "rolling_7game_{col}_{agg}")
        feats += spread([c], mean, SEASON, "season_{col}_{agg}")
    feats.append(Feature("season_games_played", "rows", None, SEASON))
    feats += spread(pa, mean, three, "rolling_3game_{col}_{agg}")
    feats += spread(pa, mean, seven, "rolling_7game_{col}_{agg}")
    feats += spread(pa, mean, SEASON, "season_{col}_{agg}")
    return lagged(d, "personId", ORDER, feats)


def team_games(box: DataFrame) -> DataFrame:
    """Team totals per game from batter lines."""
    return box.groupBy("team_id", "gamepk", "game_date", "game_season").agg(
        *[F.sum(c).cast("double").alias(n) for n, c in TEAM_SUMS.items()])


def team_features(box: DataFrame) -> DataFrame:
    """48 lagged columns per team and game."""
    cols = {"plate_appearances": "total_plate_appearances", "ab": "total_ab", "h": "total_h", "r": "total_r"}
    feats = (spread(cols, FULL, last(2), "rolling_3game_{col}_{agg}")
             + spread(cols, FULL, last(6), "rolling_7game_{col}_{agg}")
             + spread(cols, FULL, SEASON, "season_{col}_{agg}"))
    return lagged(team_games(box), "team_id", ORDER, feats)


def starter_games(box: DataFrame, starters: DataFrame) -> DataFrame:
    """Boxscore lines of the starters with decimal innings and capped rates."""
    s = starters.withColumnRenamed("starter_id", "personId")
    d = drop_seasons(box).drop("player_name").join(s, ["gamepk", "team_id", "personId"])
    return capped_rates(decimal_innings(d), suffix="_gm")


def starter_features(box: DataFrame, starters: DataFrame) -> DataFrame:
    """100 lagged columns per start."""
    d = starter_games(box, starters)
    cols = {c: (f"{c}_gm" if c in ("era", "whip", "k9", "bb9", "hr9") else c) for c in RATES}
    cols["ip"] = "ip_true"
    feats = [Feature("season_games_started", "rows", None, SEASON)]
    feats += spread(cols, ("avg",), last(1), "last_game_{col}")
    for n in (3, 5, 10):
        feats += spread(cols, ("avg", "std"), last(n), f"rolling_{n}start_{{col}}_{{agg}}")
    feats += spread(cols, ("avg", "std"), SEASON, "season_{col}_{agg}")
    d = d.select("personId", "team_id", "gamepk", "game_date", "game_season",
                 F.col("starter_name").alias("player_name"), *dict.fromkeys(cols.values()))
    return lagged(d, "personId", ORDER, feats)


def bullpen_games(box: DataFrame, starters: DataFrame) -> DataFrame:
    """Team totals per game over pitchers who did not start, with capped rates."""
    s = starters.select("gamepk", "team_id", F.col("starter_id").alias("personId"))
    # lines and starters meet in their game, whose totals stay where it was dealt: tasks are as many as the games need
    r = decimal_innings(in_game(drop_seasons(box), s, ["team_id", "personId"], "left_anti"))
    g = r.groupBy("team_id", "gamepk", "game_date", "game_season").agg(
        F.sum("ip_true").alias("ip_true"),
        *[F.sum(c).cast("double").alias(c) for c in ("h", "er", "bb", "k", "hr")],
        F.countDistinct("personId").alias("bp_pitchers"))
    g = capped_rates(g, prefix="bp_")
    return g.withColumnsRenamed({"ip_true": "bp_ip_sum", **{c: f"bp_{c}_sum" for c in ("h", "er", "bb", "k", "hr")}})


def bullpen_features(box: DataFrame, starters: DataFrame) -> DataFrame:
    """84 lagged columns per team and game over its relievers."""
    cols = {f"bp_{c}": f"bp_{c}" for c in RATES if c != "ip"} | {"bp_ip": "bp_ip_sum", "bp_pitchers": "bp_pitchers"}
    feats = spread(cols, ("avg",), last(1), "last_game_{col}")
    for n in (7, 14):
        feats += spread(cols, ("avg", "std"), last(n), f"rolling_{n}game_{{col}}_{{agg}}")
    feats += spread(cols, ("avg", "std"), SEASON, "season_{col}_{agg}")
    return lagged(bullpen_games(box, starters), "team_id", ORDER, feats)
