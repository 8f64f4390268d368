"""Rules baseline: last season, shrunk season to date and lineup slot, blended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwell.functions.rates import blend, half_even, safe_div, shrink_count
from lagwell.operators.joins import asof_season, season_lag
from lagwell.plans.frames import Feature, lagged, prior
from lagwell.plans.ranks import exact_quantiles
from lagwell.plans.scale import one_row, stage

WEIGHTS = {"comp_prev_season": 0.4, "comp_rolling_shrunk": 0.4, "comp_order_slot": 0.2}


def season_average(box: DataFrame) -> DataFrame:
    """Batting average per player and season, 3 places, half to even."""
    g = box.groupBy("personId", "game_season").agg(F.sum("h").alias("hits"), F.sum("ab").alias("abs"))
    return g.select("personId", "game_season", half_even(safe_div("hits", "abs"), 3).alias("ba"))


def last_season_average(pa: DataFrame, box: DataFrame) -> DataFrame:
    """last_season_ba from the latest season on record before the row's own."""
    t = season_average(box).select(F.col("personId").alias("batter_id"), "game_season", F.col("ba").alias("last_season_ba"))
    return asof_season(pa, t, ["batter_id"])


def _median_filled(df: DataFrame, col: str, out: str) -> DataFrame:
    m = exact_quantiles(df, col, [0.5]).agg(F.max("value").alias("_med"))
    return df.crossJoin(one_row(m)).withColumn(out, F.coalesce(col, "_med")).drop("_med")


def previous_season(pa: DataFrame) -> DataFrame:
    return _median_filled(pa, "last_season_ba", "comp_prev_season")


def season_to_date(pa: DataFrame, k: float = 100.0) -> DataFrame:
    """Hits and appearances strictly before this one, shrunk toward the season's mean."""
    d = lagged(pa, "batter_id", ["game_date", "gamepk", "play_id"], [
        Feature("_h", "sum", "is_hit", prior("game_season")), Feature("_n", "rows", None, prior("game_season"))])
    mean = pa.groupBy("game_season").agg(F.avg("is_hit").alias("_m"))  # one row per season
    d = d.join(F.broadcast(mean), "game_season", "left")
    return d.withColumn("comp_rolling_shrunk", shrink_count(F.coalesce("_h", F.lit(0)), "_n", "_m", k)).drop("_h", "_n", "_m")


def order_slot(pa: DataFrame) -> DataFrame:
    """The previous season's average of the lineup slot."""
    t = pa.groupBy("game_season", "batting_order").agg(F.avg("is_hit").alias("_slot"))
    t = t.filter("game_season is not null and batting_order is not null")
    return _median_filled(season_lag(pa, t, ["batting_order"]), "_slot", "comp_order_slot").drop("_slot")


def rules_baseline(pa: DataFrame, k: float = 100.0, weights: dict | None = None) -> DataFrame:
    """Three components and their blend xba_pred; pa holds last_season_ba and batting_order."""
    d = order_slot(season_to_date(previous_season(stage(pa)), k))
    return d.withColumn("xba_pred", blend(weights or WEIGHTS))
