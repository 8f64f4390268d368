"""Season tables, splits and summaries; rolling pitch-level tables share their measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness import tables as t
from harness.q_lagging import TAGGED, _pbox, raw_std_sql, roll_sql, std_sql
from harness.registry import query
from lagwell.operators import season as S
from lagwell.operators.pitches import pitcher_role

HITS = "('Single','Double','Triple','Home Run')"
KS = "('Strikeout','Strikeout Double Play')"

# per-pitch measures of a pitcher, spelled out for SQL
STUFF = ["start_speed", "end_speed", "perceived_velo", "spin_rate", "movement_magnitude", "pfx_z", "extension",
         "speed_retention"]
PEAK = STUFF[:-1]
SPREAD = [("stuff", "start_speed"), ("stuff", "extension"), ("command", "plate_x"), ("command", "plate_z_normalized")]
FLAGS = {"in_play": "is_in_play", "swinging_strike": "is_swinging_strike", "zone": "coalesce(zone BETWEEN 1 AND 9, false)",
         "ball": "is_ball", "strike": "is_strike", "called_strike": "is_called_strike", "chase": "is_chase",
         "zone_swing": "is_zone_swing", "first_pitch_strike": "is_first_pitch AND is_strike"}
OUT = {"strikeout": KS, "walk": "('Walk','Intent Walk')", "hbp": "('Hit By Pitch')", "hit": HITS, "hr": "('Home Run')",
       "single": "('Single')", "xbh": "('Double','Triple','Home Run')"}
L = "FILTER (is_last_pitch)"


def direct(keys, p, extra=""):
    """Season rates of a pitcher straight from pitches: no game-level partials involved."""
    ks = ", ".join(keys)
    stuff = ", ".join(
        [f"avg({x}) AS {p}stuff_{x}_mean" for x in STUFF] + [f"max({x}) AS {p}stuff_{x}_max" for x in PEAK]
        + [f"stddev({x}) AS {p}{g}_{x}_std" for g, x in SPREAD]
        + [f"avg(CAST({c} AS INTEGER)) AS {p}command_{n}_rate" for n, c in FLAGS.items()])
    pa = ", ".join(
        [f"avg(pitch_number) {L} AS {p}pa_pitch_count_mean", f"stddev(pitch_number) {L} AS {p}pa_pitch_count_std",
         f"CASE WHEN count(*) {L} > 0 THEN count(play_result) {L} END AS {p}pa_total"]
        + [f"avg(CASE WHEN play_result IN {v} THEN 1 ELSE 0 END) {L} AS {p}pa_{n}_rate" for n, v in OUT.items()]
        + [f"sum(CASE WHEN play_result IN {KS} THEN 1 ELSE 0 END) {L} AS {p}pa_fip_k",
           f"sum(CASE WHEN play_result IN ('Walk','Hit By Pitch') THEN 1 ELSE 0 END) {L} AS {p}pa_fip_bb",
           f"sum(CASE WHEN play_result = 'Home Run' THEN 1 ELSE 0 END) {L} AS {p}pa_fip_hr",
           f"avg(count_balls) {L} AS {p}pa_avg_final_balls", f"avg(count_strikes) {L} AS {p}pa_avg_final_strikes",
           f"avg(CASE WHEN count_balls = 3 AND count_strikes = 2 THEN 1 ELSE 0 END) {L} AS {p}pa_full_count_rate"])
    contact = ", ".join(
        [f"avg(CASE WHEN hardness = 'Hard' THEN 1 ELSE 0 END) FILTER (is_in_play) AS {p}contact_hard_hit_rate"]
        + [f"avg(CASE WHEN trajectory = '{v}' THEN 1 ELSE 0 END) FILTER (is_in_play) AS {p}contact_{n}_rate"
           for n, v in (("gb", "Ground Ball"), ("fb", "Fly Ball"), ("ld", "Line Drive"))]
        + [f"avg(launch_{x}) FILTER (is_in_play) AS {p}contact_avg_launch_{x}" for x in ("speed", "angle")])
    return ks, stuff, pa, contact


def pitcher_season_sql(entity, where="true", hand=None, p="pitcher_season_"):
    keys = [entity, "game_season"] + ([hand] if hand else [])
    ks, stuff, pa, contact = direct(keys, p)
    nn = f"{hand} IS NOT NULL" if hand else "true"
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    on2 = " AND ".join(f"a.{k} = c.{k}" for k in keys)
    return f"""
SELECT a.*, (13 * {p}pa_fip_hr + 3 * {p}pa_fip_bb - 2 * {p}pa_fip_k)::DOUBLE / nullif({p}pa_total, 0) + 3.10 AS {p}pa_fip,
  b.* EXCLUDE ({ks}), c.* EXCLUDE ({ks})
FROM (SELECT {ks}, {stuff}, {pa}, {contact} FROM pbp WHERE {where} AND {nn} GROUP BY ALL) a
LEFT JOIN (
  SELECT {ks}, avg(inning) AS {p}avg_last_inning, stddev(inning) AS {p}std_last_inning,
    avg(start_speed) AS {p}avg_last_inning_velo, avg(CAST(is_ball AS INTEGER)) AS {p}last_inning_ball_rate,
    avg(CAST(is_strike AS INTEGER)) AS {p}last_inning_strike_rate, avg(count_balls) AS {p}last_inning_avg_balls,
    avg(count_strikes) AS {p}last_inning_avg_strikes, max(count_outs) AS {p}last_inning_outs
  FROM (SELECT *, row_number() OVER (PARTITION BY {entity}, gamepk ORDER BY play_id DESC, event_index DESC) AS rn
        FROM pbp WHERE {where} AND {nn} AND is_last_pitch) WHERE rn = 1 GROUP BY ALL) b ON {on}
LEFT JOIN (
  SELECT {ks}, avg(n) AS {p}game_avg_pitch_count, stddev(n) AS {p}game_std_pitch_count, max(n) AS {p}game_max_pitch_count
  FROM (SELECT {ks}, gamepk, sum(CAST(is_pitch AS INTEGER)) AS n FROM pbp WHERE {where} AND {nn} GROUP BY ALL)
  GROUP BY ALL) c ON {on2}"""


def last_season(sql, cols, keys):
    """Season + 1 and season_ -> last_season_ over named columns."""
    items = [f"game_season + 1 AS game_season" if k == "game_season" else k for k in keys]
    items += [f"{c} AS {c.replace('season_', 'last_season_')}" for c in cols]
    return f"SELECT {', '.join(items)} FROM ({sql})"


P = "pitcher_season_"
PITCHER_COLS = (
    [f"{P}stuff_{x}_mean" for x in STUFF] + [f"{P}stuff_{x}_max" for x in PEAK] + [f"{P}{g}_{x}_std" for g, x in SPREAD]
    + [f"{P}command_{n}_rate" for n in FLAGS] + [f"{P}pa_pitch_count_mean", f"{P}pa_pitch_count_std", f"{P}pa_total"]
    + [f"{P}pa_{n}_rate" for n in OUT] + [f"{P}pa_fip_k", f"{P}pa_fip_bb", f"{P}pa_fip_hr", f"{P}pa_avg_final_balls",
                                          f"{P}pa_avg_final_strikes", f"{P}pa_full_count_rate", f"{P}pa_fip"]
    + [f"{P}{x}" for x in ("avg_last_inning", "std_last_inning", "avg_last_inning_velo", "last_inning_ball_rate",
                           "last_inning_strike_rate", "last_inning_avg_balls", "last_inning_avg_strikes",
                           "last_inning_outs", "game_avg_pitch_count", "game_std_pitch_count", "game_max_pitch_count")]
    + [f"{P}contact_{x}_rate" for x in ("hard_hit", "gb", "fb", "ld")]
    + [f"{P}contact_avg_launch_{x}" for x in ("speed", "angle")])
FAMILIES = {
    "season_physics": [c for c in PITCHER_COLS if "stuff_" in c or "command_" in c],
    "season_pa_outcomes": [c for c in PITCHER_COLS if "_pa_" in c],
    "season_exit_state": [c for c in PITCHER_COLS if "last_inning" in c],
    "season_two_level": [c for c in PITCHER_COLS if "_game_" in c],
    "season_contact": [c for c in PITCHER_COLS if "contact_" in c],
}


def _families():
    for name, cols in FAMILIES.items():
        def fn(spark, d, cols=cols):
            s = S.pitcher_season(t.pitches(spark, d), last=False)
            return s.select("pitcher_id", "game_season", *cols)
        query(name, ["pitcher_id"], f"SELECT pitcher_id, game_season, {', '.join(cols)} FROM "
              f"({pitcher_season_sql('pitcher_id')})", ["pbp"])(fn)


_families()


def _role(entity, role):
    sql = pitcher_season_sql(entity, f"pitcher_role = '{role}'")
    return (f"SELECT {entity} AS pitcher_key_id, '{role}' AS pitcher_role, * EXCLUDE ({entity}) FROM "
            f"({last_season(sql, PITCHER_COLS, [entity, 'game_season'])})")


@query("season_pitch_roles", ["pitcher_key_id", "pitcher_role"],
       _role("pitcher_id", "sp") + " UNION ALL BY NAME " + _role("pitcher_team_id", "bullpen"), ["pbp"])
def season_pitch_roles(spark, d):
    return S.pitcher_season_roles(t.pitches(spark, d))


def pivot_sql(sql, hand, tags, cols, keys, prefix):
    items = [f"max(CASE WHEN {hand} = '{code}' THEN {c} END) AS {c.replace(prefix, prefix + tag + '_', 1)}"
             for code, tag in tags.items() for c in cols]
    codes = ", ".join(f"'{c}'" for c in tags)
    return f"SELECT {', '.join(keys)}, {', '.join(items)} FROM ({sql}) WHERE {hand} IN ({codes}) GROUP BY ALL"


def pivot_names(cols, tags, prefix):
    return [c.replace(prefix, prefix + tag + "_", 1) for tag in tags.values() for c in cols]


BT = {"L": "vs_lhb", "R": "vs_rhb", "S": "vs_switch"}
PT = {"L": "vs_lhp", "R": "vs_rhp"}


@query("pivot_pitcher_by_batter_hand", ["pitcher_id"], last_season(
    pivot_sql(pitcher_season_sql("pitcher_id", hand="batter_bat_side"), "batter_bat_side", BT, PITCHER_COLS,
              ["pitcher_id", "game_season"], P), pivot_names(PITCHER_COLS, BT, P), ["pitcher_id", "game_season"]), ["pbp"])
def pivot_pitcher_by_batter_hand(spark, d):
    return S.pitcher_season_by_hand(t.pitches(spark, d))


BAT = {
    "o_swing_rate": "avg(CAST(is_chase AS INTEGER))", "z_swing_rate": "avg(CAST(is_zone_swing AS INTEGER))",
    "swinging_strike_rate": "avg(CAST(is_swinging_strike AS INTEGER))",
    "zone_rate": "avg(CASE WHEN zone BETWEEN 1 AND 9 THEN 1 ELSE 0 END)",
    "contact_rate": "avg(CAST(NOT is_swinging_strike AS INTEGER)) FILTER (is_swing)",
    "contact_hard_hit_rate": "avg(CASE WHEN launch_speed >= 95 THEN 1 ELSE 0 END) FILTER (is_in_play AND launch_speed IS NOT NULL)",
    "contact_sweet_spot_rate": "avg(CASE WHEN launch_angle BETWEEN 8 AND 32 THEN 1 ELSE 0 END) FILTER (is_in_play AND launch_angle IS NOT NULL)",
    "contact_gb_rate": "avg(CASE WHEN trajectory = 'Ground Ball' THEN 1 ELSE 0 END) FILTER (is_in_play)",
    "contact_fb_rate": "avg(CASE WHEN trajectory = 'Fly Ball' THEN 1 ELSE 0 END) FILTER (is_in_play)",
    "contact_ld_rate": "avg(CASE WHEN trajectory = 'Line Drive' THEN 1 ELSE 0 END) FILTER (is_in_play)",
    "contact_avg_launch_speed": "avg(launch_speed) FILTER (is_in_play)",
    "contact_avg_launch_angle": "avg(launch_angle) FILTER (is_in_play)",
    "foul_rate": "avg(CASE WHEN pitch_call = 'Foul' THEN 1 ELSE 0 END) FILTER (is_swing)",
    "contact_foul_rate": "avg(CASE WHEN pitch_call = 'Foul' THEN 1 ELSE 0 END) FILTER (pitch_call = 'Foul' OR is_in_play)",
    "two_strike_foul_rate": "avg(CASE WHEN pitch_call = 'Foul' THEN 1 ELSE 0 END) FILTER (count_strikes = 2 AND is_swing)",
}


def pa_items(p):
    return ([f"avg(pitch_number) {L} AS {p}pa_pitch_count_mean", f"stddev(pitch_number) {L} AS {p}pa_pitch_count_std",
             f"count(play_result) {L} AS {p}pa_total"]
            + [f"avg(CASE WHEN play_result IN {v} THEN 1 ELSE 0 END) {L} AS {p}pa_{n}_rate" for n, v in OUT.items()]
            + [f"avg(count_balls) {L} AS {p}pa_avg_final_balls", f"avg(count_strikes) {L} AS {p}pa_avg_final_strikes",
               f"avg(CASE WHEN count_balls = 3 AND count_strikes = 2 THEN 1 ELSE 0 END) {L} AS {p}pa_full_count_rate"])


def batter_sql(keys, p):
    nn = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    items = pa_items(p) + [f"{e} AS {p}{n}" for n, e in BAT.items()]
    return (f"SELECT {', '.join(keys)}, {', '.join(items)} FROM pbp WHERE {nn} GROUP BY {', '.join(keys)} "
            f"HAVING count(*) {L} > 0")


def batter_cols(p):
    return [x.split(" AS ")[-1] for x in pa_items(p)] + [p + n for n in BAT]


@query("season_discipline", ["batter_id"], last_season(batter_sql(["batter_id", "game_season"], "batter_season_"),
                                                       batter_cols("batter_season_"), ["batter_id", "game_season"]), ["pbp"])
def season_discipline(spark, d):
    return S.batter_season(t.pitches(spark, d))


BC = batter_cols("batter_season_")


@query("pivot_by_hand", ["batter_id"], last_season(
    pivot_sql(batter_sql(["batter_id", "game_season", "pitcher_throw_hand"], "batter_season_"), "pitcher_throw_hand", PT,
              BC, ["batter_id", "game_season"], "batter_season_"), pivot_names(BC, PT, "batter_season_"),
    ["batter_id", "game_season"]), ["pbp"])
def pivot_by_hand(spark, d):
    return S.batter_season_by_hand(t.pitches(spark, d))


LK = ["game_season", "pitcher_throw_hand", "batter_bat_side"]


@query("league_by_hand", LK[1:], last_season(batter_sql(LK, "league_season_"), batter_cols("league_season_"), LK), ["pbp"])
def league_by_hand(spark, d):
    return S.league_by_hand(t.pitches(spark, d))


@query("hand_grouping_sets", LK[1:], f"""
SELECT game_season, coalesce(pitcher_throw_hand, 'all') AS pitcher_throw_hand,
  coalesce(batter_bat_side, 'all') AS batter_bat_side, {", ".join(pa_items("league_season_"))}
FROM pbp WHERE pitcher_throw_hand IS NOT NULL AND batter_bat_side IS NOT NULL
GROUP BY GROUPING SETS ((game_season, pitcher_throw_hand, batter_bat_side), (game_season, pitcher_throw_hand),
  (game_season, batter_bat_side), (game_season))""", ["pbp"])
def hand_grouping_sets(spark, d):
    return S.hand_levels(t.pitches(spark, d))


# ---- boxscore seasons -------------------------------------------------------------------

R2 = "round_even(({}) * 100, 0) / 100"


@query("season_box_rates", ["personId"], last_season(f"""
SELECT personId, game_season, h AS batter_season_h, k AS batter_season_k, bb AS batter_season_bb, hr AS batter_season_hr,
  ab AS batter_season_ab, plate_appearances AS batter_season_plate_appearances,
  total_bases_from_h AS batter_season_total_bases_from_h, ba AS batter_season_ba, slg AS batter_season_slg,
  {R2.format("slg - ba")} AS batter_season_iso,
  {R2.format("(h - hr)::DOUBLE / nullif(ab - k - hr, 0)")} AS batter_season_babip
FROM (SELECT *, {R2.format("h::DOUBLE / nullif(ab, 0)")} AS ba, {R2.format("total_bases_from_h::DOUBLE / nullif(ab, 0)")} AS slg
  FROM (SELECT personId, game_season, sum(h) AS h, sum(k) AS k, sum(bb) AS bb, sum(hr) AS hr, sum(ab) AS ab,
    sum(plate_appearances) AS plate_appearances, sum(total_bases_from_h) AS total_bases_from_h
    FROM batter_box GROUP BY ALL))""", [f"batter_season_{c}" for c in (
    "h", "k", "bb", "hr", "ab", "plate_appearances", "total_bases_from_h", "ba", "slg", "iso", "babip")],
    ["personId", "game_season"]), ["batter_box"])
def season_box_rates(spark, d):
    return S.batter_box_season(t.batter_box(spark, d))


def _pbox_season(entity, role):
    p = "pitcher_season_"
    sums = ["h", "r", "er", "bb", "hr", "k", "p", "s"]
    rates = {"whip": "(bb + h)::DOUBLE / nullif(ip, 0)", "k_rate": "k::DOUBLE / nullif(ip, 0)",
             "bb_rate": "bb::DOUBLE / nullif(ip, 0)", "strike_rate": "s::DOUBLE / nullif(p, 0)",
             "hr_rate": "hr::DOUBLE / nullif(ip, 0)"}
    # innings in exact thirds, so a rate on a rounding tie falls the same way in any sum order
    return last_season(f"""
SELECT {entity} AS pitcher_key_id, game_season, '{role}' AS pitcher_role, {", ".join(f"{c} AS {p}{c}" for c in sums)},
  ip AS {p}ip, {", ".join(f"{R2.format(e)} AS {p}{n}" for n, e in rates.items())}
FROM (SELECT {entity}, game_season, {", ".join(f"sum({c}) AS {c}" for c in sums)}, round(sum(ip) * 3) / 3 AS ip
  FROM {TAGGED} WHERE pitcher_role = '{role}' GROUP BY ALL)""",
                       [p + c for c in [*sums, "ip", *rates]], ["pitcher_key_id", "game_season", "pitcher_role"])


@query("season_role_stacked", ["pitcher_key_id", "pitcher_role"],
       _pbox_season("personId", "sp") + " UNION ALL " + _pbox_season("team_id", "bullpen"), ["pitcher_ip", "roles"])
def season_role_stacked(spark, d):
    return S.pitcher_box_season_roles(S.tag_roles(_pbox(spark, d), pitcher_role(t.pitches_raw(spark, d))))


SUMS = {"pa": "plate_appearances", "ab": "ab", "h": "h", "singles": "singles", "doubles": "doubles", "triples": "triples",
        "hr": "hr", "tb": "total_bases", "rbi": "rbi", "bb": "bb", "k": "k", "sb": "sb", "lob": "lob"}
SLASH = """(season_h + season_bb)::DOUBLE / nullif(season_ab + season_bb, 0) AS obp,
  season_tb::DOUBLE / nullif(season_ab, 0) AS slg,
  season_tb::DOUBLE / nullif(season_ab, 0) - season_h::DOUBLE / nullif(season_ab, 0) AS iso,
  (0.69 * season_bb + 0.89 * season_singles + 1.27 * season_doubles + 1.62 * season_triples + 2.10 * season_hr)::DOUBLE
    / nullif(season_ab + season_bb, 0) AS woba"""


@query("season_summary_batter", ["personId", "player_name"], f"""
SELECT *, {", ".join(f"season_{s}::DOUBLE / nullif(season_pa, 0) AS {n}" for n, s in (
    ("hit_rate", "h"), ("k_rate", "k"), ("hr_rate", "hr"), ("bb_rate", "bb"), ("tb_rate", "tb"), ("rbi_rate", "rbi")))},
  {SLASH}, {", ".join(f"season_{s} AS beta_alpha_{n}, season_pa - season_{s} AS beta_beta_{n}" for n, s in (
    ("hits", "h"), ("k", "k"), ("hr", "hr"), ("tb", "tb")))}
FROM (SELECT personId, player_name, game_season, count(*) AS season_games,
    {", ".join(f"sum({c}) AS season_{n}" for n, c in SUMS.items())}
  FROM batter_box WHERE game_type = 'R' AND game_season <> 2020 GROUP BY ALL)""", ["batter_box"])
def season_summary_batter(spark, d):
    return S.batter_summary(t.batter_box(spark, d))


@query("season_summary_pitcher", ["personId", "player_name"], """
SELECT *, season_er / nullif(season_ip, 0) * 9 AS era, (season_h_allowed + season_bb_allowed) / nullif(season_ip, 0) AS whip,
  season_k / nullif(season_ip, 0) * 9 AS k9, season_bb_allowed / nullif(season_ip, 0) * 9 AS bb9,
  season_hr_allowed / nullif(season_ip, 0) * 9 AS hr9, season_k / nullif(season_ip, 0) AS k_per_ip,
  season_bb_allowed / nullif(season_ip, 0) AS bb_per_ip, season_hr_allowed / nullif(season_ip, 0) AS hr_per_ip,
  season_h_allowed / nullif(season_ip, 0) AS h_per_ip, season_er / nullif(season_ip, 0) AS er_per_ip
FROM (SELECT p.personId, s.starter_name AS player_name, p.game_season, count(*) AS season_starts,
    sum(ip_true) AS season_ip, sum(h)::DOUBLE AS season_h_allowed, sum(er)::DOUBLE AS season_er,
    sum(bb)::DOUBLE AS season_bb_allowed, sum(k)::DOUBLE AS season_k, sum(hr)::DOUBLE AS season_hr_allowed,
    avg(ip_true) AS avg_ip_per_start, stddev(ip_true) AS std_ip_per_start
  FROM pitcher_ip p JOIN starters s ON p.gamepk = s.gamepk AND p.team_id = s.team_id AND p.personId = s.starter_id
  WHERE p.game_season <> 2020 GROUP BY ALL)""", ["pitcher_ip", "starters"])
def season_summary_pitcher(spark, d):
    from lagwell.operators.pitches import starters
    return S.starter_summary(t.pitcher_box(spark, d), starters(t.pitches_raw(spark, d)))


TSUMS = {**SUMS, "r": "r"}
TPITCH = {"era_allowed": "season_er_allowed * 9", "whip_allowed": "(season_h_allowed + season_bb_allowed)",
          "k9_pitched": "season_k_pitched * 9", "bb9_allowed": "season_bb_allowed * 9", "hr9_allowed": "season_hr_allowed * 9",
          "k_per_ip_pitched": "season_k_pitched", "bb_per_ip_allowed": "season_bb_allowed",
          "hr_per_ip_allowed": "season_hr_allowed", "h_per_ip_allowed": "season_h_allowed"}


@query("season_summary_team", ["team_id"], f"""
SELECT o.*, {SLASH}, season_h::DOUBLE / nullif(season_pa, 0) AS hit_rate, season_k::DOUBLE / nullif(season_pa, 0) AS k_rate,
  season_bb::DOUBLE / nullif(season_pa, 0) AS bb_rate, season_r::DOUBLE / nullif(season_games, 0) AS r_per_game,
  p.* EXCLUDE (team_id, game_season), {", ".join(f"{e}::DOUBLE / nullif(season_ip_pitched, 0) AS {n}" for n, e in TPITCH.items())}
FROM (SELECT team_id, game_season, count(DISTINCT gamepk) AS season_games,
    {", ".join(f"sum({c}) AS season_{n}" for n, c in TSUMS.items())}
  FROM batter_box WHERE game_type = 'R' AND game_season <> 2020 GROUP BY ALL) o
JOIN (SELECT team_id, game_season, sum(ip_true) AS season_ip_pitched, sum(h) AS season_h_allowed,
    sum(er) AS season_er_allowed, sum(bb) AS season_bb_allowed, sum(k) AS season_k_pitched, sum(hr) AS season_hr_allowed
  FROM pitcher_ip WHERE game_type = 'R' AND game_season <> 2020 GROUP BY ALL) p
ON o.team_id = p.team_id AND o.game_season = p.game_season""", ["batter_box", "pitcher_ip"])
def season_summary_team(spark, d):
    return S.team_summary(t.batter_box(spark, d), t.pitcher_box(spark, d))


# ---- rolling pitch-level tables ---------------------------------------------------------

PA_CASE = "CASE WHEN count(*) FILTER (is_last_pitch) > 0 THEN {} END"
PA_AGG = {
    "pa_total": f"count(play_result) {L}", "pa_pitch_count_sum": f"sum(pitch_number) {L}",
    "pa_pitch_count_sumsq": f"sum(pitch_number * pitch_number) {L}",
    **{f"pa_{n}_n": f"count(*) FILTER (is_last_pitch AND play_result IN {v})" for n, v in OUT.items()},
    "pa_fip_bb_n": "count(*) FILTER (is_last_pitch AND play_result IN ('Walk','Hit By Pitch'))",
    "pa_final_balls_sum": f"sum(count_balls) {L}", "pa_final_balls_n": f"count(count_balls) {L}",
    "pa_final_strikes_sum": f"sum(count_strikes) {L}", "pa_final_strikes_n": f"count(count_strikes) {L}",
    "pa_full_count_n": "count(*) FILTER (is_last_pitch AND count_balls = 3 AND count_strikes = 2)",
}
PGAME = {
    **{f"{g}_{x}_{s}": f"{'coalesce(sum' if s == 'sum' else '(count'}({x}){', 0)' if s == 'sum' else ')'}"
       for g, x in [("stuff", x) for x in STUFF] + [("command", "plate_x"), ("command", "plate_z_normalized")]
       for s in ("sum", "n")},
    **{f"{g}_{x}_sumsq": f"coalesce(sum({x} * {x}), 0)" for g, x in SPREAD},
    **{f"command_{n}_n": f"count(*) FILTER ({c})" for n, c in FLAGS.items()},
    "n_pitches": "count(*)", "games_n": "1", "pitch_count_sumsq": "count(*) * count(*)",
    **{n: PA_CASE.format(e) for n, e in PA_AGG.items()},
    "contact_n": "count(trajectory) FILTER (is_in_play)", "contact_hard_hit_n": "count(*) FILTER (is_in_play AND hardness = 'Hard')",
    **{f"contact_{n}_n": f"count(*) FILTER (is_in_play AND trajectory = '{v}')" for n, v in (
        ("gb", "Ground Ball"), ("fb", "Fly Ball"), ("ld", "Line Drive"))},
    **{f"contact_launch_{x}_sum": f"coalesce(sum(launch_{x}) FILTER (is_in_play), 0)" for x in ("speed", "angle")},
    **{f"contact_launch_{x}_n": f"count(launch_{x}) FILTER (is_in_play)" for x in ("speed", "angle")},
}
EXITS = {"last_inning_inning": "inning", "last_inning_inning_sumsq": "inning * inning", "last_inning_velo": "start_speed",
         "last_inning_ball": "CAST(is_ball AS INTEGER)", "last_inning_strike": "CAST(is_strike AS INTEGER)",
         "last_inning_balls": "count_balls", "last_inning_strikes": "count_strikes"}
PMAX = {**{f"stuff_{x}_max": f"max({x})" for x in PEAK}, "pitch_count_max": "count(*)"}


SQUARES = [f"{g}_{x}_sumsq" for g, x in SPREAD]


def pgame_sql(entity, where):
    return f"""
SELECT a.*, {", ".join(f"b.{n}" for n in [*EXITS, "last_inning_outs"])} FROM (
  SELECT {entity}, gamepk, game_date, game_season, {", ".join(f"{e} AS {n}" for n, e in {**PGAME, **PMAX}.items())}
  FROM pbp WHERE {where} GROUP BY {entity}, gamepk, game_date, game_season) a
LEFT JOIN (SELECT {entity}, gamepk, {", ".join(f"{e} AS {n}" for n, e in EXITS.items())}, count_outs AS last_inning_outs
  FROM (SELECT *, row_number() OVER (PARTITION BY {entity}, gamepk ORDER BY play_id DESC, event_index DESC) AS rn
        FROM pbp WHERE {where} AND is_last_pitch) WHERE rn = 1) b
ON a.{entity} = b.{entity} AND a.gamepk = b.gamepk"""


def ratio(pairs):
    return [(n, f"{a}::DOUBLE / nullif({b}, 0)") for n, a, b in pairs]


PA_RATES = ([("pa_pitch_count_mean", "pa_pitch_count_sum", "pa_total")]
            + [(f"pa_{x}_rate", f"pa_{x}_n", "pa_total") for x in OUT]
            + [("pa_avg_final_balls", "pa_final_balls_sum", "pa_final_balls_n"),
               ("pa_avg_final_strikes", "pa_final_strikes_sum", "pa_final_strikes_n"),
               ("pa_full_count_rate", "pa_full_count_n", "pa_total")])


def rolling_pitcher_sql(entity, window, where, p, role=None):
    sums, maxes = [c for c in [*PGAME, *EXITS] if c not in SQUARES], [*PMAX, "last_inning_outs"]
    items = ratio([(f"stuff_{x}_mean", f"stuff_{x}_sum", f"stuff_{x}_n") for x in STUFF]
                  + [(f"command_{n}_rate", f"command_{n}_n", "n_pitches") for n in FLAGS] + PA_RATES
                  + [("last_inning_avg", "last_inning_inning", "games_n"),
                     ("last_inning_avg_velo", "last_inning_velo", "games_n"),
                     ("last_inning_ball_rate", "last_inning_ball", "games_n"),
                     ("last_inning_strike_rate", "last_inning_strike", "games_n"),
                     ("last_inning_avg_balls", "last_inning_balls", "games_n"),
                     ("last_inning_avg_strikes", "last_inning_strikes", "games_n"),
                     ("pitch_count_avg", "n_pitches", "games_n")]
                  + [(f"contact_{x}_rate", f"contact_{x}_n", "contact_n") for x in ("hard_hit", "gb", "fb", "ld")]
                  + [(f"contact_avg_launch_{x}", f"contact_launch_{x}_sum", f"contact_launch_{x}_n") for x in ("speed", "angle")])
    items += [(m, m) for m in maxes]
    items += [(f"{g}_{x}_std", f"s_{x}") for g, x in SPREAD]
    items += [("pa_pitch_count_std", std_sql("pa_total", "pa_pitch_count_sum", "pa_pitch_count_sumsq")),
              ("last_inning_std", std_sql("games_n", "last_inning_inning", "last_inning_inning_sumsq")),
              ("pitch_count_std", std_sql("games_n", "n_pitches", "pitch_count_sumsq")),
              ("pa_fip", "(13 * pa_hr_n + 3 * pa_fip_bb_n - 2 * pa_strikeout_n)::DOUBLE / nullif(pa_total, 0) + 3.10")]
    head = f"a.{entity} AS pitcher_key_id, '{role}' AS pitcher_role" if role else f"a.{entity}"
    return f"""
SELECT {head}, a.gamepk, game_season, {", ".join(f"{e} AS {p}{n}" for n, e in items)} FROM (
  SELECT {entity}, gamepk, game_season, {roll_sql(sums, entity, window, None)}, {roll_sql(maxes, entity, window, None, "max")}
  FROM ({pgame_sql(entity, where)})) a
JOIN ({raw_std_sql([x for _, x in SPREAD], entity, window, where)}) r ON a.{entity} = r.{entity} AND a.gamepk = r.gamepk"""


@query("per_game_partials", ["pitcher_id", "gamepk"],
       f"SELECT * EXCLUDE (game_date) FROM ({pgame_sql('pitcher_id', 'true')})", ["pbp"])
def per_game_partials(spark, d):
    from lagwell.operators.partials import PA_SUMS, pitcher_games
    from lagwell.plans.frames import squares_sql
    g = pitcher_games(t.pitches(spark, d))
    g = g.withColumns({c: F.when(F.col("pa_rows") > 0, F.col(c)) for c in PA_SUMS})
    g = g.withColumns({c: F.expr(squares_sql(c.replace("_sumsq", "_spread"))) for c in SQUARES})
    g = g.withColumns({"games_n": F.lit(1), "pitch_count_sumsq": F.col("n_pitches") * F.col("n_pitches"),
                       "pitch_count_max": F.col("n_pitches"),
                       "last_inning_inning_sumsq": F.col("last_inning_inning") * F.col("last_inning_inning")})
    return g.select("pitcher_id", "gamepk", "game_season", *PGAME, *PMAX, *EXITS, "last_inning_outs")


@query("rolling_pbp", ["pitcher_id", "gamepk"],
       rolling_pitcher_sql("pitcher_id", 10, "true", "pitcher_roll_last10g_"), ["pbp"])
def rolling_pbp(spark, d):
    from lagwell.operators.rolling import pitcher_pitch_rolling
    return pitcher_pitch_rolling(t.pitches(spark, d, "pitcher_id"), 10).drop("game_date")


@query("rolling_pbp_roles", ["pitcher_key_id", "gamepk", "pitcher_role"],
       rolling_pitcher_sql("pitcher_id", "season", "pitcher_role = 'sp'", "pitcher_roll_season_", "sp") + " UNION ALL "
       + rolling_pitcher_sql("pitcher_team_id", "season", "pitcher_role = 'bullpen'", "pitcher_roll_season_", "bullpen"),
       ["pbp"])
def rolling_pbp_roles(spark, d):
    from lagwell.operators.rolling import pitcher_pitch_rolling_roles
    return pitcher_pitch_rolling_roles(t.pitches(spark, d), "season").drop("game_date")


SW, FO = "is_swing", "pitch_call = 'Foul'"
BGAME = {
    **{n: e for n, e in PA_AGG.items() if n != "pa_fip_bb_n"},
    "chase_n": "count(*) FILTER (is_chase)", "zone_swing_n": "count(*) FILTER (is_zone_swing)",
    "swinging_strike_n": "count(*) FILTER (is_swinging_strike)", "zone_n": "count(*) FILTER (zone BETWEEN 1 AND 9)",
    "n_pitches": "count(*)", "swing_n": "count(*) FILTER (is_swing)",
    "contact_n": "count(*) FILTER (is_swing AND NOT is_swinging_strike)",
    "hard_hit_n": "count(*) FILTER (is_in_play AND launch_speed >= 95)",
    "launch_speed_valid_n": "count(launch_speed) FILTER (is_in_play)",
    "sweet_spot_n": "count(*) FILTER (is_in_play AND launch_angle BETWEEN 8 AND 32)",
    "launch_angle_valid_n": "count(launch_angle) FILTER (is_in_play)",
    **{f"{n}_n": f"count(*) FILTER (is_in_play AND trajectory = '{v}')" for n, v in (
        ("gb", "Ground Ball"), ("fb", "Fly Ball"), ("ld", "Line Drive"))},
    "contact_trajectory_n": "count(trajectory) FILTER (is_in_play)",
    "launch_speed_sum": "coalesce(sum(launch_speed) FILTER (is_in_play), 0)",
    "launch_angle_sum": "coalesce(sum(launch_angle) FILTER (is_in_play), 0)",
    "foul_n": f"count(*) FILTER ({SW} AND {FO})", "foul_swing_n": f"count(pitch_call) FILTER ({SW})",
    "contact_foul_n": f"count(*) FILTER ({FO})", "foul_or_inplay_n": f"count(pitch_call) FILTER ({FO} OR is_in_play)",
    "two_strike_foul_n": f"count(*) FILTER (count_strikes = 2 AND {SW} AND {FO})",
    "two_strike_swing_n": f"count(pitch_call) FILTER (count_strikes = 2 AND {SW})",
}
BRATES = PA_RATES + [
    ("o_swing_rate", "chase_n", "n_pitches"), ("z_swing_rate", "zone_swing_n", "n_pitches"),
    ("swinging_strike_rate", "swinging_strike_n", "n_pitches"), ("zone_rate", "zone_n", "n_pitches"),
    ("contact_rate", "contact_n", "swing_n"), ("contact_hard_hit_rate", "hard_hit_n", "launch_speed_valid_n"),
    ("contact_sweet_spot_rate", "sweet_spot_n", "launch_angle_valid_n"), ("contact_gb_rate", "gb_n", "contact_trajectory_n"),
    ("contact_fb_rate", "fb_n", "contact_trajectory_n"), ("contact_ld_rate", "ld_n", "contact_trajectory_n"),
    ("contact_avg_launch_speed", "launch_speed_sum", "launch_speed_valid_n"),
    ("contact_avg_launch_angle", "launch_angle_sum", "launch_angle_valid_n"), ("foul_rate", "foul_n", "foul_swing_n"),
    ("contact_foul_rate", "contact_foul_n", "foul_or_inplay_n"),
    ("two_strike_foul_rate", "two_strike_foul_n", "two_strike_swing_n")]


def rolling_batter_sql(window, p):
    items = ratio(BRATES) + [("pa_pitch_count_std", std_sql("pa_total", "pa_pitch_count_sum", "pa_pitch_count_sumsq"))]
    return f"""
SELECT batter_id, gamepk, game_season, {", ".join(f"{e} AS {p}{n}" for n, e in items)} FROM (
  SELECT batter_id, gamepk, game_season, {roll_sql(list(BGAME), "batter_id", window, None)} FROM (
    SELECT batter_id, gamepk, game_date, game_season, {", ".join(f"{e} AS {n}" for n, e in BGAME.items())}
    FROM pbp GROUP BY batter_id, gamepk, game_date, game_season HAVING count(*) {L} > 0))"""


@query("rolling_pbp_batter", ["batter_id", "gamepk"], rolling_batter_sql("season", "batter_roll_season_"), ["pbp"])
def rolling_pbp_batter(spark, d):
    from lagwell.operators.rolling import batter_pitch_rolling
    return batter_pitch_rolling(t.pitches(spark, d), "season").drop("game_date")
