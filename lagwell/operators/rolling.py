"""Rolling tables: lagged sums of per-game partials, divided once at the end.

window is 'season' (everything earlier in the season) or a number of games, which runs
across seasons. In season mode a missing value in the previous game blanks the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwell.functions.rates import fip_sql, named, ratio_sql
from lagwell.operators import partials as P
from lagwell.operators.season import ROLE_KEY, role_lines, with_role_key
from lagwell.plans.frames import Feature, deviation_sql, integer_deviation_sql, lagged, last, prior

ORDER = ["game_date", "gamepk"]


def check_window(window) -> None:
    if window == "season":
        return
    if not isinstance(window, int) or isinstance(window, bool) or window <= 0:
        raise ValueError(f"window must be 'season' or a positive int, got {window!r}")


def window_prefix(entity: str, window) -> str:
    return f"{entity}_roll_season_" if window == "season" else f"{entity}_roll_last{window}g_"


def _list(x) -> list:
    return list(x) if isinstance(x, (list, tuple)) else [x]


def roll(df: DataFrame, entity, window, sums=(), maxes=(), states=(), keep: bool = False) -> DataFrame:
    """Replace the columns by their lagged rolling sum, maximum or merged state; keep leaves the columns themselves as _own_ ones."""
    check_window(window)
    season, entity = window == "season", _list(entity)
    frame = prior("game_season") if season else last(window)
    feats = [Feature("_r_" + c, agg, c, frame, need_prev=season)
             for agg, cols in (("sum", sums), ("max", maxes), ("moments", states)) for c in cols]
    d = lagged(df.na.drop(subset=entity), entity, ORDER, feats)
    rolled = {f.col: f.name for f in feats}
    own = [f"{c} AS _own_{c}" for c in rolled] if keep else []
    return d.selectExpr(*[f"{rolled[c]} AS {c}" if c in rolled else c for c in df.columns], *own)


def rolled(df: DataFrame, entity, windows, keys: list[str], rates, sums=(), maxes=(), states=(), n: int | None = None) -> DataFrame:
    """keys and rates(window) of one or several windows. Windows of one entity share its partitioning: the partials stay beside
    the rates until the last window has read them. With n, partials are dealt once, while narrow, into n partitions by entity."""
    windows, cols, done = _list(windows), [*sums, *maxes, *states], []
    d = df.select(*keys, *cols)
    if n:  # a window by season would deal by season too, and the next window the wide rows anew
        d = d.na.drop(subset=_list(entity)).repartition(n, *_list(entity))
    for i, w in enumerate(windows):
        more, out = i + 1 < len(windows), rates(w)
        d = roll(d, entity, w, sums, maxes, states, more)
        d = d.selectExpr(*keys, *done, *named(out), *[f"_own_{c} AS {c}" for c in cols if more])
        done += out
    return d


def batter_box_rolling(box: DataFrame, window, also=(), n: int | None = None) -> DataFrame:
    """window: one window or a list of them; also: columns of box that stay as they are; n: see `rolled`."""
    stats = ["h", "k", "bb", "hr", "ab", "plate_appearances", "total_bases_from_h"]
    ba, slg = ratio_sql("h", "ab"), ratio_sql("total_bases_from_h", "ab")
    num = lambda c: f"CAST({c} AS DOUBLE)"
    rates = {"ba": ba, "slg": slg, "iso": f"{slg} - {ba}",
             "babip": ratio_sql(f"({num('h')} - {num('hr')})", f"({num('ab')} - {num('k')} - {num('hr')})")}
    return rolled(box, "personId", window, ["personId", "gamepk", "game_date", "game_season", *also],
                  lambda w: {window_prefix("batter", w) + c: e for c, e in ({c: c for c in stats} | rates).items()}, stats, n=n)


BOX_SUMS = ["h", "r", "er", "bb", "hr", "k", "p", "s", "ip"]


def pitcher_box_rolling(box: DataFrame, window, entity="personId", also=(), n: int | None = None) -> DataFrame:
    """window: one window or a list of them; entity: one column or a list of them; also, n: as in `batter_box_rolling`."""
    rates = {"whip": ratio_sql("(bb + h)", "ip"), "k_rate": ratio_sql("k", "ip"), "bb_rate": ratio_sql("bb", "ip"),
             "strike_rate": ratio_sql("s", "p"), "hr_rate": ratio_sql("hr", "ip")}
    return rolled(box, entity, window, [*_list(entity), "gamepk", "game_date", "game_season", *also],
                  lambda w: {window_prefix("pitcher", w) + c: e for c, e in ({c: c for c in BOX_SUMS} | rates).items()}, BOX_SUMS, n=n)


def pitcher_box_rolling_roles(tagged: DataFrame, window) -> DataFrame:
    """Starters by pitcher; relievers summed to their team's game before rolling. Lines are tagged with their role (`tag_roles`)."""
    return pitcher_box_rolling(role_lines(tagged, BOX_SUMS), window, ROLE_KEY)


PITCHER_SUMS = (
    [f"stuff_{x}_{t}" for x in P.STUFF for t in ("sum", "n")]
    + [f"command_{x}_{t}" for x in P.COMMAND for t in ("sum", "n")]
    + [f"command_{x}_n" for x in ("in_play", "swinging_strike", "zone", "ball", "strike", "called_strike", "chase",
                                  "zone_swing", "first_pitch_strike")]
    + ["n_pitches", *P.PA_SUMS]
    + ["games_n", "last_inning_inning", "last_inning_inning_sumsq", "last_inning_velo", "last_inning_ball",
       "last_inning_strike", "last_inning_balls", "last_inning_strikes", "pitch_count_sumsq"]
    + [f"contact_{x}" for x in ("n", "hard_hit_n", "gb_n", "fb_n", "ld_n", "launch_speed_sum", "launch_speed_n",
                                "launch_angle_sum", "launch_angle_n")])
PITCHER_STATES = ["stuff_start_speed_spread", "stuff_extension_spread", "command_plate_x_spread", "command_plate_z_normalized_spread"]
PITCHER_MAXES = [f"stuff_{x}_max" for x in P.PEAK] + ["last_inning_outs", "pitch_count_max"]


def _rates(pairs) -> dict[str, str]:
    return {n: ratio_sql(a, b) for n, a, b in pairs}


def _pa_rates() -> list:
    r = [("pa_pitch_count_mean", "pa_pitch_count_sum", "pa_total")]
    r += [(f"pa_{x}_rate", f"pa_{x}_n", "pa_total") for x in ("strikeout", "walk", "hbp", "hit", "hr", "single", "xbh")]
    return r + [("pa_avg_final_balls", "pa_final_balls_sum", "pa_final_balls_n"),
                ("pa_avg_final_strikes", "pa_final_strikes_sum", "pa_final_strikes_n"),
                ("pa_full_count_rate", "pa_full_count_n", "pa_total")]


def pitcher_pitch_rolling(pbp: DataFrame, window, role: str | None = None, entity="pitcher_id") -> DataFrame:
    """Rolling stuff, command, outcomes, exit state, workload and contact of a pitcher or staff.

    window: one window or a list of them; entity: one column or a list of them.
    """
    return pitcher_games_rolling(P.pitcher_games(pbp, entity, role), window, entity)


def pitcher_games_rolling(games: DataFrame, window, entity="pitcher_id", also=(), n: int | None = None) -> DataFrame:
    """The same from per-game partials; also, n: as in `batter_box_rolling`."""
    for w in _list(window):
        check_window(w)
    keys = [*_list(entity), "gamepk", "game_date", "game_season", *also]
    derived = {
        **{c: f"CASE WHEN pa_rows > 0 THEN {c} END" for c in P.PA_SUMS},
        "games_n": "1", "pitch_count_sumsq": "n_pitches * n_pitches", "pitch_count_max": "n_pitches",
        "last_inning_inning_sumsq": "CAST(last_inning_inning AS BIGINT) * last_inning_inning"}
    g = games.selectExpr(*keys, *[f"{derived.get(c, c)} AS {c}" for c in PITCHER_SUMS + PITCHER_MAXES + PITCHER_STATES])
    return rolled(g, entity, window, keys, _pitch_rates, PITCHER_SUMS, PITCHER_MAXES, PITCHER_STATES, n)


def _pitch_rates(window) -> dict[str, str]:
    std, exact = deviation_sql, integer_deviation_sql
    out = {}
    for x in P.STUFF:
        s = f"stuff_{x}"
        out[s + "_mean"] = ratio_sql(s + "_sum", s + "_n")
        if x in P.PEAK:
            out[s + "_max"] = s + "_max"
        if x in P.SPREAD:
            out[s + "_std"] = std(s + "_spread")
    for x in P.COMMAND:
        out[f"command_{x}_std"] = std(f"command_{x}_spread")
    out.update(_rates([(f"command_{x}_rate", f"command_{x}_n", "n_pitches") for x in (
        "in_play", "swinging_strike", "zone", "ball", "strike", "called_strike", "chase", "zone_swing",
        "first_pitch_strike")]))
    out.update(_rates(_pa_rates()))
    out["pa_pitch_count_std"] = exact("pa_total", "pa_pitch_count_sum", "pa_pitch_count_sumsq")
    out["pa_fip"] = fip_sql("pa_hr_n", "pa_fip_bb_n", "pa_strikeout_n", "pa_total")
    out.update(_rates([
        ("last_inning_avg", "last_inning_inning", "games_n"), ("last_inning_avg_velo", "last_inning_velo", "games_n"),
        ("last_inning_ball_rate", "last_inning_ball", "games_n"),
        ("last_inning_strike_rate", "last_inning_strike", "games_n"),
        ("last_inning_avg_balls", "last_inning_balls", "games_n"),
        ("last_inning_avg_strikes", "last_inning_strikes", "games_n"), ("pitch_count_avg", "n_pitches", "games_n")]))
    out["last_inning_std"] = exact("games_n", "last_inning_inning", "last_inning_inning_sumsq")
    out["last_inning_outs"] = "last_inning_outs"
    out["pitch_count_std"] = exact("games_n", "n_pitches", "pitch_count_sumsq")
    out["pitch_count_max"] = "pitch_count_max"
    out.update(_rates([(f"contact_{x}_rate", f"contact_{x}_n", "contact_n") for x in ("hard_hit", "gb", "fb", "ld")]))
    out.update(_rates([(f"contact_avg_launch_{x}", f"contact_launch_{x}_sum", f"contact_launch_{x}_n")
                       for x in ("speed", "angle")]))
    p = window_prefix("pitcher", window)
    return {p + n: e for n, e in out.items()}


def pitcher_pitch_rolling_roles(pbp: DataFrame, window) -> DataFrame:
    """Starters by pitcher and relief by team, in one pass over the pitches."""
    return pitcher_pitch_rolling(with_role_key(pbp, "pitcher_id", "pitcher_team_id"), window, None, ROLE_KEY)


BATTER_SUMS = [x for x in P.PA_SUMS if x != "pa_fip_bb_n"] + [
    "chase_n", "zone_swing_n", "swinging_strike_n", "zone_n", "n_pitches", "swing_n", "contact_n", "hard_hit_n",
    "launch_speed_valid_n", "sweet_spot_n", "launch_angle_valid_n", "gb_n", "fb_n", "ld_n", "contact_trajectory_n",
    "launch_speed_sum", "launch_angle_sum", "foul_n", "foul_swing_n", "contact_foul_n", "foul_or_inplay_n",
    "two_strike_foul_n", "two_strike_swing_n"]


def batter_pitch_rolling(pbp: DataFrame, window) -> DataFrame:
    """Rolling outcomes, plate discipline, contact and fouls of a batter."""
    check_window(window)
    keys = ["batter_id", "gamepk", "game_date", "game_season"]
    d = roll(P.batter_games(pbp).select(*keys, *BATTER_SUMS), "batter_id", window, BATTER_SUMS)
    out = _rates(_pa_rates())
    out["pa_pitch_count_std"] = integer_deviation_sql("pa_total", "pa_pitch_count_sum", "pa_pitch_count_sumsq")
    out.update(_rates([
        ("o_swing_rate", "chase_n", "n_pitches"), ("z_swing_rate", "zone_swing_n", "n_pitches"),
        ("swinging_strike_rate", "swinging_strike_n", "n_pitches"), ("zone_rate", "zone_n", "n_pitches"),
        ("contact_rate", "contact_n", "swing_n"), ("contact_hard_hit_rate", "hard_hit_n", "launch_speed_valid_n"),
        ("contact_sweet_spot_rate", "sweet_spot_n", "launch_angle_valid_n"),
        ("contact_gb_rate", "gb_n", "contact_trajectory_n"), ("contact_fb_rate", "fb_n", "contact_trajectory_n"),
        ("contact_ld_rate", "ld_n", "contact_trajectory_n"),
        ("contact_avg_launch_speed", "launch_speed_sum", "launch_speed_valid_n"),
        ("contact_avg_launch_angle", "launch_angle_sum", "launch_angle_valid_n"),
        ("foul_rate", "foul_n", "foul_swing_n"), ("contact_foul_rate", "contact_foul_n", "foul_or_inplay_n"),
        ("two_strike_foul_rate", "two_strike_foul_n", "two_strike_swing_n")]))
    p = window_prefix("batter", window)
    return d.selectExpr(*keys, *named({p + n: e for n, e in out.items()}))
