"""Cleaning rules for raw tables: dedupe, text parsing, filters, derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwell.functions import constants as K
from lagwell.functions import text
from lagwell.functions.rates import cap, lookup, safe_div


def earliest_schedule(schedule: DataFrame, tie: str | None = None) -> DataFrame:
    """One row per game: the one with the earliest start, ties broken by `tie`."""
    at = F.struct("game_datetime", tie) if tie else F.struct("game_datetime")
    cols = [c for c in schedule.columns if c != "gamepk"]
    g = (schedule.withColumn("gamepk", F.col("gamepk").cast("string"))
         .filter(F.col("gamepk").isNotNull() & F.col("game_datetime").isNotNull())
         .groupBy("gamepk").agg(F.min_by(F.struct(*cols), at).alias("_r")))
    return g.select("gamepk", "_r.*").withColumn("game_date", F.col("game_date").cast("timestamp_ntz"))


def weather(game_info: DataFrame) -> DataFrame:
    """Temperature, wind speed and wind direction from free text."""
    return game_info.withColumns({
        "gamepk": F.col("gamepk").cast("string"),
        "weather_temp": text.first_int("weather_temp"),
        "weather_wind_speed": text.first_int(text.part("weather_wind", ",", 0)),
        "weather_wind_direction": text.part("weather_wind", ",", 1),
    }).drop("weather_wind")


def regular_games(df: DataFrame, types=None) -> DataFrame:
    return df.filter(F.col("game_type").isin(types or K.GAME_TYPES))


def drop_seasons(df: DataFrame, *seasons: int) -> DataFrame:
    seasons = seasons or (K.EXCLUDED_SEASON,)
    return df.filter(~F.col("game_season").isin(*seasons))


def batting_order(box: DataFrame) -> DataFrame:
    """Integer lineup code per game and batter; absent codes are dropped."""
    d = box.filter(F.col("batting_order").isNotNull())
    return d.groupBy("gamepk", F.col("personId").alias("batter_id")).agg(
        F.min(F.col("batting_order").try_cast("int")).alias("batting_order"))


def lineup_slots(box: DataFrame) -> DataFrame:
    """Slot 1-9 from the order code's last two digits; non-numeric codes give NULL."""
    return box.withColumn("batting_slot", text.order_slot("batting_order"))


def decimal_innings(box: DataFrame, on_bad: str = "keep", col: str = "ip", out: str = "ip_true") -> DataFrame:
    return box.withColumn(out, text.innings(col, on_bad))


def capped_rates(box: DataFrame, suffix: str = "", prefix: str = "") -> DataFrame:
    """Per-game pitching rates with their caps; zero innings give NULL."""
    c = F.col
    per9 = lambda x: safe_div(x, "ip_true") * 9
    raw = {
        "era": per9("er"), "whip": safe_div(c("h") + c("bb"), "ip_true"), "k9": per9("k"),
        "bb9": per9("bb"), "hr9": per9("hr"), "k_per_ip": safe_div("k", "ip_true"),
        "bb_per_ip": safe_div("bb", "ip_true"), "hr_per_ip": safe_div("hr", "ip_true"),
        "h_per_ip": safe_div("h", "ip_true"), "er_per_ip": safe_div("er", "ip_true"),
    }
    return box.withColumns({
        prefix + n + (suffix if "_per_ip" not in n else ""): cap(e, K.RATE_CAPS[n]) for n, e in raw.items()})


def park_factor(df: DataFrame) -> DataFrame:
    return df.withColumn("park_factor", lookup(
        F.col("venue_id").cast("string"), {k: float(v) for k, v in K.PARK_FACTORS.items()}, K.PARK_DEFAULT))


def rule_era(df: DataFrame, date: str = "game_date") -> DataFrame:
    """1 from the first day of the changed rules on; NULL dates give 0."""
    on = F.col(date) >= F.lit(K.RULE_CHANGE_DATE).cast("timestamp_ntz")
    return df.withColumn("post_shift_ban", F.coalesce(on, F.lit(False)).cast("int"))


def finite(df: DataFrame, cols) -> DataFrame:
    """NaN and infinities to NULL."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.withColumns({c: F.when(~bad(c), F.col(c)) for c in cols})


def boxscore_totals(box: DataFrame) -> DataFrame:
    """Singles and total bases from hit counts."""
    c = F.col
    d = box.withColumn("singles", c("h") - c("doubles") - c("triples") - c("hr"))
    return d.withColumn("total_bases_from_h",
                        c("singles") + 2 * c("doubles") + 3 * c("triples") + 4 * c("hr"))


def classic_slates(contests: DataFrame, games: DataFrame, contest_players: DataFrame):
    """Contests of the classic type with their games and players."""
    # Fixed value: type code of classic contests.
    keep = contests.filter(F.col("contest_type") == 28)
    g = games.join(keep.select("draft_group_id").distinct(), "draft_group_id", "left_semi")
    p = contest_players.join(g.select("draft_group_id", "competition_id").distinct(),
                             ["draft_group_id", "competition_id"], "left_semi")
    return keep, g, p
