"""Pitches of a game in one pass: mergeable sums per play, measures read off them, and plate appearances.

`events` deals the pitches by game once; starters, counts before the pitch and pitches thrown so far are windows inside that
partitioning. `play_partials` keeps sums, counts and the first result of each (game, play, pitcher, batter); they
merge to any coarser key, so quality, process, hand and innings measures of a pitcher and discipline and hand measures
of a batter are one grouped pass each. A game is bounded by its nature; pitches without a game are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwell.functions import constants as K
from lagwell.functions.rates import count_sql, in_sql, named, named_columns, ratio1_sql
from lagwell.operators.pitches import game_sides

GP, GB = ["gamepk", "pitcher_id"], ["gamepk", "batter_id"]
SWING, MISS = in_sql("pitch_call_code", K.SWING_CODES), in_sql("pitch_call_code", K.MISS_CODES)
CONTACT = in_sql("pitch_call_code", K.CONTACT_CODES)
CALLED = f"coalesce(pitch_call_code = '{K.CALLED_CODE}', false)"
INZ, OUTZ, EDGE = in_sql("zone", K.IN_ZONE), in_sql("zone", K.OUT_ZONE), in_sql("zone", K.EDGE_ZONE)
HARD = "coalesce(launch_speed >= 95, false)"
TWO, AHEAD, BEHIND = "_strikes = 2", "_strikes > _balls", "_balls > _strikes"

#: Pitches of a play that hold a condition.
COUNTS = {
    "n": "true", "called": CALLED, "miss": MISS, "swing": SWING, "gb": "lower(trajectory) = 'ground_ball'", "play": "is_in_play",
    "barrel": "launch_speed >= 98 AND launch_angle BETWEEN 26 AND 30", "hard": HARD, "play_hard": f"is_in_play AND {HARD}",
    "play_sweet": "is_in_play AND launch_angle BETWEEN 8 AND 32", "fp": "pitch_number = 1",
    "fps": f"pitch_number = 1 AND ({CALLED} OR {MISS} OR {CONTACT})", "inz": INZ, "outz": OUTZ, "chase": f"{OUTZ} AND {SWING}",
    "inz_swing": f"{INZ} AND {SWING}", "inz_contact": f"{INZ} AND {SWING} AND {CONTACT}",
    "outz_contact": f"{OUTZ} AND {SWING} AND {CONTACT}", "two_swing": f"{TWO} AND {SWING}", "two_miss": f"{TWO} AND {MISS}",
    "ahead_swing": f"{AHEAD} AND {SWING}", "ahead_miss": f"{AHEAD} AND {MISS}", "behind_swing": f"{BEHIND} AND {SWING}",
    "behind_miss": f"{BEHIND} AND {MISS}", "edge": EDGE, "edge_called": f"{EDGE} AND {CALLED}", "n45": "inning IN (4, 5)",
}
#: Values of pitches that are averaged: (value, condition).
MEANS = {
    "velo": ("start_speed", "true"), "spin": ("spin_rate", "true"), "ext": ("release_pos_y", "true"),
    "hb": ("break_horizontal", "true"), "vb": ("break_vertical_induced", "true"), "ev": ("launch_speed", "is_in_play"),
}
SUMS = [*COUNTS, *(f"{m}_{x}" for m in MEANS for x in "sk")]


def _earliest(values: str, cond: str = "play_result IS NOT NULL") -> str:
    return f"min(CASE WHEN {cond} THEN struct(event_index, {values}) END)"


#: By what keys of a game's rows `events` may be kept to starters.
ONLY = {"starters": ["pitcher_id"], "faced": ["play_id"], "either": ["pitcher_id", "play_id"]}
#: Hands as they meet, from the sides as listed.
_HAND = "CASE WHEN _throw = 'S' THEN 'R' ELSE _throw END"
_SIDE = f"CASE WHEN _bat = 'S' THEN CASE WHEN {_HAND} = 'R' THEN 'L' ELSE 'R' END ELSE _bat END"


def _sides(players: DataFrame) -> DataFrame:
    return players.filter("personId IS NOT NULL").groupBy(F.col("personId").cast("string").alias("_id")).agg(
        F.min("batSide").alias("_bat"), F.min("pitchHand").alias("_throw"))


def _listed(df: DataFrame, players: DataFrame) -> DataFrame:
    """df with _bat and _throw, met by batter and by pitcher."""
    sides = _sides(players)
    d = df.join(sides.select(F.col("_id").alias("batter_id"), "_bat"), "batter_id", "left")
    return d.join(sides.select(F.col("_id").alias("pitcher_id"), "_throw"), "pitcher_id", "left")


def with_hands(ev: DataFrame, players: DataFrame) -> DataFrame:
    """Events that were made without players, with their hands; each is dealt by its batter and by its pitcher, so they should be few."""
    return _listed(ev.drop("_bat", "_throw", "_hand", "_side"), players).selectExpr("*", f"{_HAND} AS _hand", f"{_SIDE} AS _side")


def events(pbp: DataFrame, players: DataFrame | None = None, dealt: bool | int = False, only: str | None = None) -> DataFrame:
    """Pitches with what the rest of their game says about them, dealt by game.

    _starter: the pitcher is the first of the team by (inning, event_index), unknown innings last. _balls, _strikes: counts after the previous pitch of the play,
    0 without one. _before: pitches thrown in earlier plays, NULL where the pitcher throws none in this play. With
    players (personId, batSide, pitchHand), _bat and _throw are the sides as listed, _side and _hand as they meet.
    dealt: pbp is dealt by gamepk already and, without players, stays where it is; with players too where dealt is the number of its
    partitions: then only the ids of a game travel.
    only: 'starters' keeps what starters threw, 'faced' the plays in which a starter threw, 'either' both, with _theirs for the former; the
    rest goes once starters are known, before any other window. What these hold of a starter is what all events hold.
    """
    if only not in (None, *ONLY):
        raise ValueError(f"only must be one of {', '.join(ONLY)}, got {only!r}")
    d = pbp.filter("gamepk IS NOT NULL")
    placed = bool(dealt) and (players is None or dealt is not True)
    if players is None:
        d = d.withColumns({"_bat": F.lit(None).cast("string"), "_throw": F.lit(None).cast("string")})
    elif placed:
        d = game_sides(d, _sides(players).withColumnRenamed("_id", "id"), int(dealt), {"_bat": ("batter_id", "_bat"), "_throw": ("pitcher_id", "_throw")})
    else:
        d = _listed(d, players)
    first = "min(CASE WHEN pitcher_id IS NOT NULL AND pitcher_team_id IS NOT NULL THEN struct(inning IS NULL AS late, inning, event_index, pitcher_id) END)"
    play = "OVER (PARTITION BY gamepk, play_id, pitcher_id, is_pitch ORDER BY event_index)"
    thrown = f"sum({'CASE WHEN is_pitch THEN 1 ELSE 0 END'})"
    d = (d if placed else d.repartition("gamepk")).selectExpr("*", f"{first} OVER (PARTITION BY gamepk, pitcher_team_id) AS _first")
    if only:
        of = {k: f"max(coalesce(_first.pitcher_id = pitcher_id, false)) OVER (PARTITION BY gamepk, {k})" for k in ONLY[only]}
        d = d.selectExpr("*", *[f"{e} AS _of_{k}" for k, e in of.items()]).filter(" OR ".join(f"_of_{k}" for k in of))
        d = d.withColumnRenamed("_of_pitcher_id", "_theirs") if only == "either" else d
        d = d.drop(*[f"_of_{k}" for k in of])
    d = d.selectExpr(
        "*", f"coalesce(lag(count_balls) {play}, 0) AS _balls", f"coalesce(lag(count_strikes) {play}, 0) AS _strikes",
        f"{thrown} OVER (PARTITION BY gamepk, pitcher_id ORDER BY play_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _earlier",
        f"{thrown} OVER (PARTITION BY gamepk, pitcher_id, play_id) AS _now")
    kept = [c for c in d.columns if c not in ("_first", "_earlier", "_now")]
    return d.selectExpr(
        *kept, "coalesce(_first.pitcher_id = pitcher_id, false) AS _starter",
        "CASE WHEN _now > 0 THEN coalesce(_earlier, 0) END AS _before", f"{_HAND} AS _hand", f"{_SIDE} AS _side")


def play_partials(ev: DataFrame) -> DataFrame:
    """Sums and first results per (gamepk, play_id, pitcher_id, batter_id); sums add up and first results merge by min."""
    on = lambda cond: f"is_pitch AND {cond}"
    cols = {c: count_sql(on(cond)) for c, cond in COUNTS.items()}
    for m, (x, cond) in MEANS.items():
        cols |= {f"{m}_s": f"sum(CASE WHEN {on(cond)} THEN CAST({x} AS DOUBLE) END)", f"{m}_k": f"count(CASE WHEN {on(cond)} THEN {x} END)"}
    cols |= {"result": _earliest("play_result, _side, _hand"), "result45": _earliest("play_result", "play_result IS NOT NULL AND inning IN (4, 5)"),
             "side": "min(_side)", "starter": "max(_starter)"}
    return ev.groupBy("gamepk", "play_id", "pitcher_id", "batter_id").agg(*named_columns(cols))


def _merged(parts: DataFrame, keys: list[str], by_side: bool, dealt: bool) -> DataFrame:
    """Partials of whole plays per key: one row per (keys, play). dealt: parts are dealt by gamepk already and stay there."""
    cols = {c: f"sum({c})" for c in SUMS} | {"result": "min(result)", "result45": "min(result45)", "starter": "max(starter)"}
    if by_side:
        cols |= {f"{c}_{s}": f"sum(CASE WHEN side = '{s}' THEN {c} ELSE 0 END)" for c in ("n", "miss", "swing") for s in "LR"}
    return (parts if dealt else parts.repartition(*keys)).groupBy(*keys, "play_id").agg(*named_columns(cols))


QUALITY = {
    "gb_pct": ("gb", "play"), "csw_pct": ("(called + miss)", "n"), "whiff_rate": ("miss", "swing"), "barrel_pct": ("barrel", "play"),
    "hard_hit_pct": ("hard", "play"), "first_pitch_strike_pct": ("fps", "fp"), "p_per_pa": ("n", "nullif(pa, 0)"),
}
PROCESS_MEANS = {"avg_velo": "velo", "avg_spin_rate": "spin", "avg_extension": "ext", "avg_h_break": "hb", "avg_v_break": "vb"}
PROCESS_RATES = {
    "zone_pct": ("inz", "n"), "chase_induced_pct": ("chase", "outz"), "two_strike_whiff_pct": ("two_miss", "two_swing"),
    "whiff_rate_ahead": ("ahead_miss", "ahead_swing"), "whiff_rate_behind": ("behind_miss", "behind_swing"),
    "called_strike_edge_pct": ("edge_called", "edge"),
}
CONTACTS = {"inplay_exit_velo": "ev", "inplay_hard_hit_pct": "hard", "contact_exit_velo": "ev", "contact_hard_hit_pct": "hard",
            "contact_sweet_spot_pct": "sweet"}
INNINGS = ["inn45_pitches", "inn45_pa", "inn45_onbase"]
PITCHER_SPLITS = [f"{c}_vs_{s}" for s in "LR" for c in ("k_rate", "bb_rate", "obp_allowed", "whiff_rate", "pa_count")]
BATTER_SPLITS = [f"{c}_vs_{s}" for s in "LR" for c in ("k_rate", "obp", "iso", "tb_rate", "pa_count")]


def pitcher_measures(parts: DataFrame, dealt: bool = False) -> DataFrame:
    """Per (gamepk, pitcher_id): is_starter, total_pitches and all quality, process, innings 4-5 and hand measures.

    Quality and process are NULL without a pitch, contact measures below two balls in play, innings measures where their count is 0, hand
    measures without a result against that side.
    """
    agg = {c: f"sum({c})" for c in [*SUMS, *(f"{c}_{s}" for c in ("n", "miss", "swing") for s in "LR")]}
    agg |= {"is_starter": "max(starter)", "pa": "count(result)", "pa45": "count(result45)",
            "on45": count_sql(in_sql("result45.play_result", K.ON_BASE))}
    groups = {"k": K.STRIKEOUTS, "bb": K.WALKS, "on": K.ON_BASE}
    for s in "LR":
        at = f"result._side = '{s}'"
        agg |= {f"pa_{s}": count_sql(at)} | {f"{g}_{s}": count_sql(f"{at} AND {in_sql('result.play_result', r)}") for g, r in groups.items()}
    g = _merged(parts, GP, True, dealt).groupBy(*GP).agg(*named_columns(agg))
    some = lambda e: f"CASE WHEN n > 0 THEN {e} END"
    mean = lambda m: f"try_divide({m}_s, {m}_k)"
    contact = {"ev": mean("ev"), "hard": ratio1_sql("play_hard", "play"), "sweet": ratio1_sql("play_sweet", "play")}
    out = {"total_pitches": some("n"), "pa_count": some("nullif(pa, 0)"), **{c: some(ratio1_sql(*r)) for c, r in QUALITY.items()}}
    out |= {c: some(mean(m)) for c, m in PROCESS_MEANS.items()} | {c: f"CASE WHEN play >= 2 THEN {contact[m]} END" for c, m in CONTACTS.items()}
    out |= {"contact_count": some("CAST(play AS DOUBLE)"), **{c: some(ratio1_sql(*r)) for c, r in PROCESS_RATES.items()}}
    out |= {"inn45_pitches": "nullif(n45, 0)", "inn45_pa": "nullif(pa45, 0)", "inn45_onbase": "CASE WHEN pa45 > 0 THEN on45 END"}
    for s in "LR":
        met = lambda e: f"CASE WHEN pa_{s} > 0 THEN {e} END"
        out |= {f"{c}_vs_{s}": met(ratio1_sql(f"{x}_{s}", f"pa_{s}")) for c, x in (("k_rate", "k"), ("bb_rate", "bb"), ("obp_allowed", "on"))}
        out |= {f"whiff_rate_vs_{s}": f"CASE WHEN pa_{s} > 0 AND n_{s} > 0 THEN {ratio1_sql(f'miss_{s}', f'swing_{s}')} END",
                f"pa_count_vs_{s}": met(f"CAST(pa_{s} AS DOUBLE)")}
    out["obp_allowed"] = f"CASE WHEN pa_L > 0 OR pa_R > 0 THEN {ratio1_sql('(on_L + on_R)', '(pa_L + pa_R)')} END"
    return g.selectExpr(*GP, "is_starter", *named(out))


def quality(measures: DataFrame) -> DataFrame:
    return measures.filter("total_pitches > 0").select(*GP, "pa_count", "total_pitches", *QUALITY)


def process(measures: DataFrame) -> DataFrame:
    return measures.filter("is_starter AND total_pitches > 0").select(*GP, *PROCESS_MEANS, *CONTACTS, "contact_count", *PROCESS_RATES)


def innings_four_five(measures: DataFrame) -> DataFrame:
    return measures.filter("inn45_pitches > 0 OR inn45_pa > 0").select(*GP, *INNINGS)


def pitcher_splits(measures: DataFrame) -> DataFrame:
    return measures.filter("obp_allowed IS NOT NULL").select(*GP, *PITCHER_SPLITS, "obp_allowed")


DISCIPLINE = ["chase_rate", "z_contact_pct", "o_contact_pct", "chase_n", "out_zone_n", "z_swing_n", "z_contact_n", "pitches_seen"]


def batter_measures(parts: DataFrame, dealt: bool = False) -> DataFrame:
    """Per (gamepk, batter_id): discipline, NULL without a pitch, and hand measures, NULL without a result against that hand."""
    r = "result.play_result"
    extra = f"CASE {r} WHEN 'Double' THEN 1 WHEN 'Triple' THEN 2 WHEN 'Home Run' THEN 3 ELSE 0 END"
    bases = f"CASE {r} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.BASES.items()) + " ELSE 0 END"
    agg = {c: f"sum({c})" for c in ("n", "outz", "chase", "inz_swing", "inz_contact", "outz_contact")}
    for s in "LR":
        at = f"result._hand = '{s}'"
        agg |= {f"pa_{s}": count_sql(at), f"k_{s}": count_sql(f"{at} AND {in_sql(r, K.STRIKEOUTS)}"),
                f"on_{s}": count_sql(f"{at} AND {in_sql(r, K.ON_BASE)}"), f"tb_{s}": f"sum(CASE WHEN {at} THEN {bases} END)",
                f"xb_{s}": f"sum(CASE WHEN {at} THEN {extra} END)"}
    g = _merged(parts, GB, False, dealt).groupBy(*GB).agg(*named_columns(agg))
    some = lambda e: f"CASE WHEN n > 0 THEN {e} END"
    out = {"chase_rate": some(ratio1_sql("chase", "outz")), "z_contact_pct": some(ratio1_sql("inz_contact", "inz_swing")),
           "o_contact_pct": some(ratio1_sql("outz_contact", "chase")), "chase_n": some("chase"), "out_zone_n": some("outz"),
           "z_swing_n": some("inz_swing"), "z_contact_n": some("inz_contact"), "pitches_seen": some("n")}
    for s in "LR":
        met = lambda e: f"CASE WHEN pa_{s} > 0 THEN {e} END"
        out |= {f"{c}_vs_{s}": met(ratio1_sql(f"{x}_{s}", f"pa_{s}")) for c, x in (("k_rate", "k"), ("obp", "on"), ("iso", "xb"), ("tb_rate", "tb"))}
        out[f"pa_count_vs_{s}"] = met(f"CAST(pa_{s} AS DOUBLE)")
    out["obp_per_game"] = f"CASE WHEN pa_L > 0 OR pa_R > 0 THEN {ratio1_sql('(on_L + on_R)', '(pa_L + pa_R)')} END"
    return g.selectExpr(*GB, *named(out))


def discipline(measures: DataFrame) -> DataFrame:
    return measures.filter("pitches_seen > 0").select(*GB, *DISCIPLINE)


def batter_splits(measures: DataFrame) -> DataFrame:
    return measures.filter("obp_per_game IS NOT NULL").select(*GB, *BATTER_SPLITS, "obp_per_game")


def appearances(ev: DataFrame, players: DataFrame | None = None) -> DataFrame:
    """Plate appearances that starters faced: per play the last non-NULL value of every column, with its context in the game.

    Adds target_bases, reached_base, times_through_order (at most 3), pitch_count_in_game, platoon_advantage and same_hand (0
    where a hand is unknown). With players, hands are looked up once per appearance and not per event; `events` then needs none.
    """
    keys = ["gamepk", "play_id"]
    own = ("_starter", "_balls", "_strikes", "_before", "_hand", "_side", "_bat", "_throw", "_theirs")
    rest = [c for c in ev.columns if c not in (*keys, *own, "event_index")]
    latest = lambda value, col: f"max_by({value}, CASE WHEN {col} IS NOT NULL THEN event_index END)"
    cols = {c: latest(c, c) for c in rest} | {"event_index": "max(event_index)"}
    cols |= {"_p": latest("struct(_starter, _before, _throw)", "pitcher_id"), "_bat": latest("_bat", "batter_id")}
    d = ev.filter("play_id IS NOT NULL").groupBy(*keys).agg(*named_columns(cols)).filter("play_result IS NOT NULL AND _p._starter")
    bases = "CASE play_result " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.BASES.items()) + " ELSE 0 END"
    d = d.selectExpr(
        *keys, *rest, "event_index", f"{bases} AS target_bases", f"CAST(({bases}) > 0 AS INT) AS reached_base",
        "CAST(least(count(1) OVER (PARTITION BY gamepk, pitcher_id, batter_id ORDER BY event_index ROWS UNBOUNDED PRECEDING), 3) AS INT) AS times_through_order",
        "_p._before AS pitch_count_in_game", "_bat", "_p._throw AS _throw")
    if players is not None:
        d = _listed(d.drop("_bat", "_throw"), players)
    hand, side = _HAND, _SIDE
    return d.selectExpr(
        *keys, *rest, "event_index", "target_bases", "reached_base", "times_through_order", "pitch_count_in_game",
        f"CAST(coalesce(({side} = 'L' AND {hand} = 'R') OR ({side} = 'R' AND {hand} = 'L'), false) AS INT) AS platoon_advantage",
        f"CAST(coalesce({side} = {hand}, false) AS INT) AS same_hand")
