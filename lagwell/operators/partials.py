"""Mergeable measures: sums, counts, central moments and maxima per group of pitches.

One grouped pass yields everything season tables and rolling tables need; rates and
deviations are divided out once, at the end, from merged sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwell.functions import constants as K
from lagwell.functions.rates import count_sql, in_sql, named_columns
from lagwell.plans.frames import moments_sql, totals

STUFF = ["start_speed", "end_speed", "perceived_velo", "spin_rate", "movement_magnitude", "pfx_z",
         "extension", "speed_retention"]
COMMAND = ["plate_x", "plate_z_normalized"]
SPREAD = ["start_speed", "extension", "plate_x", "plate_z_normalized"]
PEAK = ["start_speed", "end_speed", "perceived_velo", "spin_rate", "movement_magnitude", "pfx_z", "extension"]

# outcome counts on the last pitch of an appearance: name -> results
OUTCOMES = {
    "pa_strikeout_n": K.STRIKEOUTS, "pa_walk_n": K.WALKS, "pa_hbp_n": ["Hit By Pitch"],
    "pa_hit_n": K.HITS, "pa_hr_n": ["Home Run"], "pa_single_n": ["Single"], "pa_xbh_n": K.EXTRA_BASE_HITS,
    "pa_fip_bb_n": K.FIP_FREE_BASES,
}
PA_SUMS = ["pa_total", "pa_pitch_count_sum", "pa_pitch_count_sumsq", *OUTCOMES, "pa_final_balls_sum",
           "pa_final_balls_n", "pa_final_strikes_sum", "pa_final_strikes_n", "pa_full_count_n"]


def sum0(x: Column) -> Column:
    """Sum that is 0, not NULL, for a group without values."""
    return F.coalesce(F.sum(x), F.lit(0))


def _outcomes() -> dict[str, str]:
    end = "is_last_pitch"
    on = lambda x: f"CASE WHEN {end} THEN {x} END"
    return {
        "pa_rows": count_sql(end),
        "pa_total": f"count({on('play_result')})",
        "pa_pitch_count_sum": f"sum({on('pitch_number')})",
        "pa_pitch_count_sumsq": f"sum({on('CAST(pitch_number AS BIGINT) * pitch_number')})",
        **{name: count_sql(f"{end} AND {in_sql('play_result', rs)}") for name, rs in OUTCOMES.items()},
        "pa_final_balls_sum": f"sum({on('count_balls')})", "pa_final_balls_n": f"count({on('count_balls')})",
        "pa_final_strikes_sum": f"sum({on('count_strikes')})", "pa_final_strikes_n": f"count({on('count_strikes')})",
        "pa_full_count_n": count_sql(f"{end} AND count_balls = 3 AND count_strikes = 2"),
    }


def _launch(prefix: str) -> dict[str, str]:
    out = {}
    for x in ("speed", "angle"):
        hit = f"CASE WHEN is_in_play THEN launch_{x} END"
        out[f"{prefix}launch_{x}_sum"] = f"coalesce(sum({hit}), 0)"
        out[f"{prefix}launch_{x}_n"] = f"count({hit})"
    return out


def pitcher_measures() -> dict[str, str]:
    m: dict[str, str] = {}
    for x in STUFF + COMMAND:
        p = ("stuff_" if x in STUFF else "command_") + x
        m[p + "_sum"], m[p + "_n"] = f"coalesce(sum({x}), 0)", f"count({x})"
        if x in SPREAD:
            m[p + "_spread"] = moments_sql(x)
        if x in PEAK:
            m[p + "_max"] = f"max({x})"
    for name, cond in {
        "in_play": "is_in_play", "swinging_strike": "is_swinging_strike", "zone": in_sql("zone", K.IN_ZONE),
        "ball": "is_ball", "strike": "is_strike", "called_strike": "is_called_strike", "chase": "is_chase",
        "zone_swing": "is_zone_swing", "first_pitch_strike": "coalesce(is_first_pitch AND is_strike, false)",
    }.items():
        m[f"command_{name}_n"] = count_sql(cond)
        m[f"command_{name}_known"] = f"count({cond})"
    m["n_pitches"], m["thrown"] = "count(1)", count_sql("is_pitch")
    m.update(_outcomes())
    m["contact_rows"] = count_sql("is_in_play")
    m["contact_n"] = "count(CASE WHEN is_in_play THEN trajectory END)"
    m["contact_hard_hit_n"] = count_sql("is_in_play AND hardness = 'Hard'")
    for n, v in (("gb", "Ground Ball"), ("fb", "Fly Ball"), ("ld", "Line Drive")):
        m[f"contact_{n}_n"] = count_sql(f"is_in_play AND trajectory = '{v}'")
    m.update(_launch("contact_"))
    return m


# fields of the last appearance's last pitch: source column -> output
EXIT = {"inning": "last_inning_inning", "start_speed": "last_inning_velo", "is_ball": "last_inning_ball",
        "is_strike": "last_inning_strike", "count_balls": "last_inning_balls",
        "count_strikes": "last_inning_strikes", "count_outs": "last_inning_outs"}


def pitcher_games(pbp: DataFrame, entity="pitcher_id", role: str | None = None, extra=()) -> DataFrame:
    """Per-game partials of a pitcher, or of a team's staff with entity 'pitcher_team_id'; entity may be several columns.

    With extra split columns the exit state belongs only to the split that holds the
    game's last appearance.
    """
    extra, entity = list(extra), [entity] if isinstance(entity, str) else list(entity)
    d = pbp if role is None else pbp.filter(F.col("pitcher_role") == role)
    d = d.na.drop(subset=[*entity, "gamepk", "game_season", *extra])
    # one bigint orders the pitches of a game, so that every buffer is fixed-width and the
    # aggregation stays hash-based
    at = "CASE WHEN is_last_pitch THEN CAST(play_id AS BIGINT) * 4294967296 + event_index END"
    last = {out: f"max_by({'CAST(' + src + ' AS INT)' if src.startswith('is_') else src}, {at})" for src, out in EXIT.items()}
    keys = [*entity, "gamepk", "game_date", "game_season", *extra]
    g = d.groupBy(*keys).agg(*named_columns(pitcher_measures() | last | {"_at": f"max({at})"}))
    if extra:
        g = totals(g, [*entity, "gamepk"], {"_top": F.max("_at")})
        g = g.selectExpr(*[f"CASE WHEN _at = _top THEN {c} END AS {c}" if c in last else c
                           for c in g.columns if c not in ("_at", "_top")])
    return g.drop("_at")


def batter_measures() -> dict[str, str]:
    foul = "pitch_call = 'Foul'"
    either = f"({foul} OR is_in_play)"
    two = "is_swing AND count_strikes = 2"
    call = lambda cond: f"count(CASE WHEN {cond} THEN pitch_call END)"
    launch = _launch("")
    return {
        **_outcomes(),
        "chase_n": count_sql("is_chase"), "zone_swing_n": count_sql("is_zone_swing"),
        "swinging_strike_n": count_sql("is_swinging_strike"), "zone_n": count_sql(in_sql("zone", K.IN_ZONE)),
        "n_pitches": "count(1)", "swing_n": count_sql("is_swing"),
        "contact_n": count_sql("is_swing AND NOT is_swinging_strike"), "contact_rows": count_sql("is_in_play"),
        "hard_hit_n": count_sql("is_in_play AND launch_speed >= 95"),
        "sweet_spot_n": count_sql("is_in_play AND launch_angle BETWEEN 8 AND 32"),
        "launch_speed_valid_n": launch["launch_speed_n"], "launch_angle_valid_n": launch["launch_angle_n"],
        "launch_speed_sum": launch["launch_speed_sum"], "launch_angle_sum": launch["launch_angle_sum"],
        "gb_n": count_sql("is_in_play AND trajectory = 'Ground Ball'"),
        "fb_n": count_sql("is_in_play AND trajectory = 'Fly Ball'"),
        "ld_n": count_sql("is_in_play AND trajectory = 'Line Drive'"),
        "contact_trajectory_n": "count(CASE WHEN is_in_play THEN trajectory END)",
        "foul_n": count_sql(f"is_swing AND {foul}"), "foul_swing_n": call("is_swing"),
        "contact_foul_n": count_sql(foul), "foul_or_inplay_n": call(either), "foul_or_inplay_rows": count_sql(either),
        "two_strike_foul_n": count_sql(f"{two} AND {foul}"), "two_strike_swing_n": call(two),
        "two_strike_swing_rows": count_sql(two),
    }


def batter_groups(pbp: DataFrame, keys) -> DataFrame:
    """The batter measures over any grouping; rows with a NULL key are dropped."""
    return pbp.na.drop(subset=list(keys)).groupBy(*keys).agg(*named_columns(batter_measures()))


def batter_games(pbp: DataFrame) -> DataFrame:
    """Per-game batter partials; games in which the batter finished no appearance drop out."""
    g = batter_groups(pbp, ["batter_id", "gamepk", "game_date", "game_season"])
    return g.filter("pa_rows > 0")
