"""Team-run features: batting rates, opponent series, starter series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwell.functions.rates import babip, lob_pct, obp, safe_div, woba
from lagwell.operators.clean import capped_rates, drop_seasons
from lagwell.operators.joins import in_game, opponent, with_pythagorean
from lagwell.operators.pitches import starters
from lagwell.plans.frames import Feature, lagged, last

ORDER = ["game_date", "gamepk"]
COUNTS = ["ab", "r", "h", "doubles", "triples", "hr", "rbi", "bb", "k", "lob", "sb"]
ROLLED = ["h", "hr", "bb", "k", "avg", "obp", "slg", "ops", "bb_pct", "k_pct", "bb_k", "iso", "babip", "lob_pct"]
OPPONENT = ["r", "h", "hr", "bb", "k"]


def team_batting(box: DataFrame) -> DataFrame:
    """Team totals of a game with slash line, wOBA, discipline, power and luck rates."""
    g = box.groupBy("team_id", "gamepk", "game_season").agg(
        F.min("game_date").alias("game_date"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])
    c = F.col
    g = g.withColumn("total_bases", c("h") + c("doubles") + 2 * c("triples") + 3 * c("hr"))
    g = g.withColumn("pa", c("ab") + c("bb"))
    singles = c("h") - c("doubles") - c("triples") - c("hr")
    g = g.withColumns({
        "obp": obp("h", "bb", "ab"), "slg": safe_div("total_bases", "ab"), "avg": safe_div("h", "ab"),
        "woba": woba("bb", singles, "doubles", "triples", "hr", "ab"),
        "bb_pct": safe_div("bb", "pa"), "k_pct": safe_div("k", "pa"), "bb_k": safe_div("bb", "k"),
        "babip": babip("h", "hr", "ab", "k"), "lob_pct": lob_pct("h", "bb", "r", "hr")})
    return g.withColumns({"ops": c("obp") + c("slg"), "iso": c("slg") - c("avg")})


def _means(df, entity, cols: dict[str, str], windows, pattern):
    feats = [Feature(pattern.format(w=w, col=n), "avg", src, last(w, "game_season"))
             for n, src in cols.items() for w in windows]
    return lagged(df, entity, ORDER, feats)


def add_opponent(batting: DataFrame) -> DataFrame:
    """Opponent columns, Pythagorean expectation and the opponent's lagged means."""
    cols = ["r", "h", "hr", "bb", "k", "obp", "slg", "ops"]
    d = with_pythagorean(opponent(batting, "gamepk", "team_id", cols))
    return _means(d, "opp_team_id", {f"opp_{c}": f"opp_{c}" for c in OPPONENT}, (7, 14, 30), "rolling_{w}_{col}")


def add_team_rolling(batting: DataFrame) -> DataFrame:
    d = _means(drop_seasons(batting), "team_id", {c: c for c in ROLLED}, (7, 14, 30), "rolling_{w}_{col}")
    d = _means(d, "team_id", {"r": "r"}, (30,), "rolling_{w}_{col}")
    return _means(d, "team_id", {"woba": "woba", "pyth_exp": "pyth_exp"}, (14, 30), "{col}_{w}g")


def starter_series(pitchers: DataFrame, strategy: str = "innings_pitched") -> DataFrame:
    """Lagged 5- and 10-start means of capped rates for each game's starter.

    pitchers holds ip_true (decimal innings).
    """
    st = starters(pitchers, strategy).withColumnRenamed("starter_id", "personId")
    d = capped_rates(in_game(pitchers, st, ["team_id", "personId"], "left_semi"), suffix="_gm")
    cols = {f"sp_{c}": f"{c}_gm" for c in ("era", "whip", "k9", "bb9", "hr9")} | {"sp_ip": "ip_true"}
    return _means(d, "personId", cols, (5, 10), "{col}_{w}s").select(
        "gamepk", "team_id", *[f"{n}_{w}s" for n in cols for w in (5, 10)])


def build(batters: DataFrame, pitchers: DataFrame, strategy: str = "innings_pitched") -> DataFrame:
    """The team-runs frame: one row per team and game."""
    d = add_team_rolling(add_opponent(team_batting(batters)))
    sp = starter_series(pitchers, strategy).withColumnRenamed("team_id", "opp_team_id")
    return d.join(sp, ["gamepk", "opp_team_id"], "left")
