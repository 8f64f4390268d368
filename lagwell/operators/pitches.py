"""Pitch-level derivation: flags, pre-pitch counts, roles, appearance numbers, hands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwell.functions import constants as K
from lagwell.functions.rates import flag, in_sql, named
from lagwell.plans.frames import Feature, back, lagged
from lagwell.plans.scale import parts

PA = ["gamepk", "play_id"]


def row_flags(pitches: DataFrame, target: str = "is_hit") -> DataFrame:
    """Row-level measures and flags; needs no order or grouping."""
    base = {
        "gamepk": "CAST(gamepk AS STRING)", "batter_id": "CAST(batter_id AS STRING)",
        "pitcher_id": "CAST(pitcher_id AS STRING)",
        target: f"CAST({in_sql('play_result', K.HITS)} AS INT)",
        "speed_retention": "try_divide(end_speed, start_speed)",
        "perceived_velo": "start_speed * try_divide(60.5D, 60.5D - extension)",
        "is_swinging_strike": in_sql("pitch_call", K.SWINGING_STRIKE_CALLS),
        "is_called_strike": "coalesce(pitch_call = 'Called Strike', false)",
        "is_swing": (f"{in_sql('pitch_call', K.SWINGING_STRIKE_CALLS + K.FOUL_CALLS)} "
                     "OR coalesce(is_in_play, false)"),
        "plate_z_normalized": "try_divide(plate_z - strike_zone_bottom, strike_zone_top - strike_zone_bottom)",
        "movement_magnitude": "sqrt(pfx_x * pfx_x + pfx_z * pfx_z)",
    }
    kept = [c for c in pitches.columns if c not in base]
    return pitches.selectExpr(*kept, *named(base)).selectExpr(
        "*", f"is_swing AND {in_sql('zone', K.OUT_ZONE)} AS is_chase",
        "is_swing AND coalesce(zone BETWEEN 1 AND 9, false) AS is_zone_swing")


def pitch_state(pitches: DataFrame) -> DataFrame:
    """Counts before the pitch, first-pitch flag, count state, last-pitch flag.

    The feed's counts are after the pitch; the previous pitch of the appearance supplies
    them and the first pitch starts at 0-0.
    """
    feats = [Feature("_balls", "value", "count_balls", back(1)),
             Feature("_strikes", "value", "count_strikes", back(1))]
    d = lagged(pitches, PA, "event_index", feats)
    d = d.selectExpr("*", "max(pitch_number) OVER (PARTITION BY gamepk, play_id) AS _last")
    state = {c: f"CASE WHEN pitch_number = 1 THEN 0 ELSE {lag} END"
             for c, lag in (("count_balls", "_balls"), ("count_strikes", "_strikes"))}
    kept = [c for c in pitches.columns if c not in state]
    text = lambda x: f"CAST(CAST({x} AS DOUBLE) AS STRING)"
    return d.selectExpr(*kept, *named(state), "pitch_number = _last AS is_last_pitch").selectExpr(
        "*", "coalesce(count_balls = 0 AND count_strikes = 0, false) AS is_first_pitch",
        f"concat({text('count_balls')}, '-', {text('count_strikes')}) AS count_state")


def lag_or_zero(pitches: DataFrame) -> DataFrame:
    """The other fill rule: pre-pitch counts are 0 wherever no previous pitch has one."""
    feats = [Feature("pre_count_balls", "value", "count_balls", back(1)),
             Feature("pre_count_strikes", "value", "count_strikes", back(1))]
    d = lagged(pitches, PA, "event_index", feats)
    return d.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("pre_count_balls", "pre_count_strikes")})


def starters(pitches: DataFrame, strategy: str = "inning") -> DataFrame:
    """Starting pitcher of each team in each game.

    strategy: 'inning' orders by (inning, event_index), 'play' by (play_id, event_index),
    'innings_pitched' takes the boxscore row with most innings, 'sequence' the rows whose
    gameSequence is 0. The event strategies put unknown innings last and take the first non-NULL value of each column.
    """
    if strategy in ("inning", "play"):
        lead = "inning" if strategy == "inning" else "play_id"
        at = F.struct(F.col(lead).isNull(), F.col(lead), F.col("event_index"))
        first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at))
        return (pitches.filter(F.col("gamepk").isNotNull() & F.col("pitcher_team_id").isNotNull())
                .groupBy("gamepk", F.col("pitcher_team_id").alias("team_id"))
                .agg(first("pitcher_id").alias("starter_id"), first("pitcher_name").alias("starter_name")))
    if strategy == "innings_pitched":
        at = F.struct(F.coalesce(F.col("ip_true"), F.lit(-1.0)), F.col("personId"))
        return pitches.groupBy("gamepk", "team_id").agg(F.max_by("personId", at).alias("starter_id"))
    if strategy == "sequence":
        return pitches.filter("gameSequence = 0").select(
            "gamepk", "team_id", F.col("personId").alias("starter_id"))
    raise ValueError(f"unknown starter strategy {strategy!r}")


def pitcher_role(pitches: DataFrame) -> DataFrame:
    """Role 'sp' where the pitcher is his team's first by play order, else 'bullpen'."""
    first = ("min_by(pitcher_id, CASE WHEN pitcher_id IS NOT NULL THEN struct(play_id IS NULL AS late, play_id, event_index) END) "
             "OVER (PARTITION BY gamepk, pitcher_team_id)")
    kept = pitches.columns
    return pitches.selectExpr("*", f"{first} AS _first").selectExpr(
        *kept, "CASE WHEN gamepk IS NOT NULL AND pitcher_team_id IS NOT NULL AND pitcher_id = _first THEN 'sp' ELSE 'bullpen' END AS pitcher_role")


def appearance_number(pitches: DataFrame) -> DataFrame:
    """Number of the plate appearance for the batter in the game, from 1."""
    known = "gamepk IS NOT NULL AND play_id IS NOT NULL AND batter_id IS NOT NULL"
    return pitches.selectExpr("*", f"CASE WHEN {known} THEN CAST(dense_rank() OVER (PARTITION BY gamepk, batter_id ORDER BY play_id) AS BIGINT) "
                              "END AS batter_pa_number")


def game_date(pitches: DataFrame, schedule: DataFrame) -> DataFrame:
    s = schedule.select("gamepk", "game_date")
    return pitches.join(s, "gamepk", "left").withColumn("game_season", F.year("game_date"))


def hands(pitches: DataFrame, players: DataFrame) -> DataFrame:
    """Static throwing hand of the pitcher and side of the batter."""
    pid = F.col("person_id").cast("string")
    p = players.select(pid.alias("pitcher_id"), F.col("pitchHand").alias("pitcher_throw_hand"))
    b = players.select(pid.alias("batter_id"), F.col("batSide").alias("batter_bat_side"))
    return pitches.join(p, "pitcher_id", "left").join(b, "batter_id", "left")


def game_sides(pitches: DataFrame, sides: DataFrame, n: int, values: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns of a player table (id, ...) for pitches dealt into n partitions by game.

    values: output -> (id column of the pitches, column of sides). Only the ids of a game travel, not its pitches; they come
    back as one row per game, which its pitches look up in place.
    """
    who = list(dict.fromkeys(w for w, _ in values.values()))
    ids = pitches.selectExpr("gamepk", f"explode(array({', '.join(who)})) AS id").filter("gamepk IS NOT NULL AND id IS NOT NULL").distinct()
    cols = [c for c in sides.columns if c != "id"]
    games = (ids.join(sides, "id").repartition(n, "gamepk").groupBy("gamepk")
             .agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct(*cols)))).alias("_sides")))
    return pitches.join(games, "gamepk", "left").selectExpr(
        *pitches.columns, *[f"try_element_at(_sides, {w}).{c} AS {out}" for out, (w, c) in values.items()])


def build_pitch_table(pitches: DataFrame, schedule: DataFrame, players: DataFrame,
                      target: str = "is_hit", dealt: int | None = None, by: str | None = None) -> DataFrame:
    """The whole chain from feed rows to the table all pitch-level features start from.

    Pitches are dealt by game once and every step stays inside that partitioning. `dealt` names the number of partitions
    when `pitches` come dealt by gamepk already. A player listed twice counts once, with the smaller code as in `resolve_hands`.
    by: column that the finished rows are dealt by, where all that follows belongs to one player; they travel before measures
    of a row, which need no order or grouping, make them wider.
    """
    d = pitches.withColumns({c: F.col(c).cast("string") for c in ("gamepk", "pitcher_id", "batter_id")})
    if dealt is None:
        dealt = parts(d)
        d = d.repartition(dealt, "gamepk")
    sides = players.filter("person_id IS NOT NULL").groupBy(F.col("person_id").cast("string").alias("id")).agg(
        F.min("pitchHand").alias("hand"), F.min("batSide").alias("side"))
    d = game_sides(d, sides, dealt, {"pitcher_throw_hand": ("pitcher_id", "hand"), "batter_bat_side": ("batter_id", "side")})
    d = appearance_number(pitcher_role(pitch_state(d)))
    if by:
        return row_flags(game_date(d, schedule).repartition(dealt, by), target)
    return game_date(row_flags(d, target), schedule)


def resolve_hands(df: DataFrame, players: DataFrame) -> DataFrame:
    """Switch pitchers count as R; switch batters bat opposite the resolved pitcher."""
    sides = players.select(F.col("personId").cast("string"), "batSide", "pitchHand")
    sides = sides.groupBy("personId").agg(F.min("batSide").alias("batSide"), F.min("pitchHand").alias("pitchHand"))
    d = df.join(sides.select(F.col("personId").alias("batter_id"), "batSide"), "batter_id", "left")
    d = d.join(sides.select(F.col("personId").alias("pitcher_id"), "pitchHand"), "pitcher_id", "left")
    ph = F.when(F.col("pitchHand") == "S", "R").otherwise(F.col("pitchHand"))
    bs = F.when(F.col("batSide") == "S", F.when(ph == "R", "L").otherwise("R")).otherwise(F.col("batSide"))
    return d.withColumns({"pitch_hand_resolved": ph, "bat_side_resolved": bs}).drop("batSide", "pitchHand")


def platoon(df: DataFrame, players: DataFrame) -> DataFrame:
    """platoon_advantage and same_hand, 0 when a hand is unknown."""
    d = resolve_hands(df, players)
    b, p = F.col("bat_side_resolved"), F.col("pitch_hand_resolved")
    return d.withColumns({
        "platoon_advantage": flag(((b == "L") & (p == "R")) | ((b == "R") & (p == "L"))),
        "same_hand": flag(b == p),
    }).drop("bat_side_resolved", "pitch_hand_resolved")
