"""Starter plate-appearance features: game aggregates, windows, blends, state machine."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness import tables as t
from harness.oracle import cte
from harness.q_lagging import PRIOR, frame_sql, same, windows_sql
from harness.registry import query
from lagwell.operators import appearances as P
from lagwell.operators import starter_pa as A
from lagwell.plans.scale import stage


# Fixed values, stated apart from the library so that a wrong list there shows.
SWING = "pitch_call_code IN ('S', 'W', 'T', 'F', 'X', 'D', 'E', 'L', 'M')"
MISS, CONTACT = "pitch_call_code IN ('S', 'W', 'T')", "pitch_call_code IN ('F', 'X', 'T', 'D', 'E')"
CALLED = "pitch_call_code = 'C'"
INZ, OUTZ = "coalesce(zone BETWEEN 1 AND 9, false)", "coalesce(zone BETWEEN 11 AND 14, false)"
KS, BB = "('Strikeout', 'Strikeout Double Play')", "('Walk', 'Intent Walk')"
ON = ("('Single', 'Double', 'Triple', 'Home Run', 'Walk', 'Intent Walk', 'Hit By Pitch', 'Field Error', "
      "'Catcher Interference')")
BASES = ("CASE WHEN play_result IN ('Single', 'Walk', 'Intent Walk', 'Hit By Pitch', 'Field Error', 'Catcher Interference') THEN 1 "
         "WHEN play_result = 'Double' THEN 2 WHEN play_result = 'Triple' THEN 3 WHEN play_result = 'Home Run' THEN 4 ELSE 0 END")
SP = ["k_rate", "bb_rate", "hr_rate", "gb_pct", "csw_pct", "whiff_rate", "barrel_pct", "hard_hit_pct", "first_pitch_strike_pct",
      "p_per_pa"]
BAT = ["k_rate", "bb_rate", "hr_rate", "iso", "tb_rate", "chase_rate", "z_contact_pct", "o_contact_pct"]
PROCESS = {"avg_velo": "avg_velo", "avg_spin_rate": "avg_spin_rate", "avg_extension": "avg_extension",
           "contact_exit_velo": "contact_exit_velo", "hard_contact_pct": "contact_hard_hit_pct",
           "sweet_spot_pct": "contact_sweet_spot_pct", "zone_pct": "zone_pct", "chase_induced_pct": "chase_induced_pct",
           "whiff_rate_ahead": "whiff_rate_ahead", "whiff_rate_behind": "whiff_rate_behind",
           "called_strike_edge_pct": "called_strike_edge_pct"}
SP_LAST = ({c: c for c in SP} | {"ip": "ip", "pitches": "total_pitches"} | PROCESS
           | {c: c for c in ("avg_h_break", "avg_v_break", "inplay_exit_velo", "two_strike_whiff_pct")})
SP_MEAN = ({c: c for c in SP if c != "first_pitch_strike_pct"}
           | {"k_bb": "k_bb_ratio", "fps_pct": "first_pitch_strike_pct", "avg_ip": "ip", "avg_pitches": "total_pitches",
              "avg_batters_faced": "pa_count"} | PROCESS)
BC = {c: c for c in BAT[:6]} | {"z_contact": "z_contact_pct", "o_contact": "o_contact_pct"}
TC = {c: f"team_{c}" for c in ("k_rate", "bb_rate", "hr_rate", "obp", "iso", "tb_rate", "chase_rate", "z_contact_pct", "p_per_pa")}
SP_SPLITS = [f"{s}_vs_{h}" for s in ("k_rate", "bb_rate", "obp_allowed", "whiff_rate") for h in "LR"]
BAT_SPLITS = [f"{s}_vs_{h}" for s in ("obp", "k_rate", "iso", "tb_rate") for h in "LR"]
SHRINK = {"spytd": {"k_rate": 50, "bb_rate": 120, "obp_allowed": 150, "whiff_rate": 75},
          "batytd": {"obp": 150, "k_rate": 50, "iso": 200, "tb_rate": 150}}


def n(cond):
    return f"count(*) FILTER ({cond})"


def over1(a, b):
    return f"({a})::DOUBLE / greatest({b}, 1)"


def _people(spark, d):
    return t.players(spark, d).withColumnRenamed("person_id", "personId")


def _parts(spark, d):
    return P.play_partials(P.events(t.pitches_raw(spark, d), _people(spark, d)))


def _handless(spark, d, only=None):
    """Pitches of a game without hands: where no measure reads them, no player is looked up and pitches stay as they were dealt."""
    return P.events(t.pitches_raw(spark, d), dealt=True, only=only)


def _pitchers(spark, d):
    return P.pitcher_measures(_parts(spark, d))


def _pitchers_handless(spark, d, starters=False):
    return P.pitcher_measures(P.play_partials(_handless(spark, d, "starters" if starters else None)), dealt=True)


cte("quality", ("raw",), f"""
SELECT gamepk, pitcher_id, nullif(pa, 0) AS pa_count, total_pitches, {over1("gb", "play")} AS gb_pct,
  {over1("called + miss", "total_pitches")} AS csw_pct, {over1("miss", "swing")} AS whiff_rate,
  {over1("barrel", "play")} AS barrel_pct, {over1("hard", "play")} AS hard_hit_pct,
  {over1("fps", "fp")} AS first_pitch_strike_pct,
  CASE WHEN pa > 0 THEN total_pitches::DOUBLE / pa END AS p_per_pa
FROM (SELECT gamepk, pitcher_id, {n("is_pitch")} AS total_pitches, {n(f"is_pitch AND {CALLED}")} AS called,
    {n(f"is_pitch AND {MISS}")} AS miss, {n(f"is_pitch AND {SWING}")} AS swing,
    {n("is_pitch AND lower(trajectory) = 'ground_ball'")} AS gb, {n("is_pitch AND is_in_play")} AS play,
    {n("is_pitch AND launch_speed >= 98 AND launch_angle BETWEEN 26 AND 30")} AS barrel,
    {n("is_pitch AND launch_speed >= 95")} AS hard,
    {n(f"is_pitch AND pitch_number = 1 AND ({CALLED} OR {MISS} OR {CONTACT})")} AS fps,
    {n("is_pitch AND pitch_number = 1")} AS fp,
    count(DISTINCT play_id) FILTER (play_result IS NOT NULL) AS pa
  FROM raw GROUP BY ALL) WHERE total_pitches > 0""")


@query("game_quality", ["gamepk", "pitcher_id"], "SELECT * FROM quality", ["quality"])
def game_quality(spark, d):
    return P.quality(_pitchers_handless(spark, d))


cte("discipline", ("raw",), f"""
SELECT gamepk, batter_id, {over1("chase_n", "out_zone_n")} AS chase_rate, {over1("z_contact_n", "z_swing_n")} AS z_contact_pct,
  {over1("o_contact_n", "chase_n")} AS o_contact_pct, chase_n, out_zone_n, z_swing_n, z_contact_n, pitches_seen
FROM (SELECT gamepk, batter_id, {n(OUTZ)} AS out_zone_n, {n(f"{OUTZ} AND {SWING}")} AS chase_n,
    {n(f"{INZ} AND {SWING}")} AS z_swing_n, {n(f"{INZ} AND {SWING} AND {CONTACT}")} AS z_contact_n,
    {n(f"{OUTZ} AND {SWING} AND {CONTACT}")} AS o_contact_n, count(*) AS pitches_seen
  FROM raw WHERE is_pitch GROUP BY ALL)""")


@query("game_discipline", ["gamepk", "batter_id"], "SELECT * FROM discipline", ["discipline"])
def game_discipline(spark, d):
    return P.discipline(P.batter_measures(P.play_partials(_handless(spark, d)), dealt=True))


cte("inn45", ("raw",), f"""
SELECT coalesce(a.gamepk, b.gamepk) AS gamepk, coalesce(a.pitcher_id, b.pitcher_id) AS pitcher_id,
  inn45_pitches, inn45_pa, inn45_onbase
FROM (SELECT gamepk, pitcher_id, count(*) AS inn45_pitches FROM raw WHERE inning IN (4, 5) AND is_pitch GROUP BY ALL) a
FULL JOIN (SELECT gamepk, pitcher_id, count(*) AS inn45_pa, {n(f"play_result IN {ON}")} AS inn45_onbase
  FROM (SELECT *, row_number() OVER (PARTITION BY gamepk, pitcher_id, play_id ORDER BY event_index) AS rn
        FROM raw WHERE inning IN (4, 5) AND play_result IS NOT NULL) WHERE rn = 1 GROUP BY ALL) b
ON a.gamepk = b.gamepk AND a.pitcher_id = b.pitcher_id""")


@query("subset_counts_outer", ["gamepk", "pitcher_id"], "SELECT * FROM inn45", ["inn45"])
def subset_counts_outer(spark, d):
    return P.innings_four_five(_pitchers_handless(spark, d))


cte("process", ("raw", "starters"), f"""
SELECT gamepk, pitcher_id, avg_velo, avg_spin_rate, avg_extension, avg_h_break, avg_v_break,
  CASE WHEN c >= 2 THEN ev END AS inplay_exit_velo, CASE WHEN c >= 2 THEN ch::DOUBLE / c END AS inplay_hard_hit_pct,
  CASE WHEN c >= 2 THEN ev END AS contact_exit_velo, CASE WHEN c >= 2 THEN ch::DOUBLE / c END AS contact_hard_hit_pct,
  CASE WHEN c >= 2 THEN cs::DOUBLE / c END AS contact_sweet_spot_pct, c AS contact_count,
  {over1("zi", "al")} AS zone_pct, {over1("zc", "zo")} AS chase_induced_pct, {over1("tm", "ts")} AS two_strike_whiff_pct,
  {over1("am", "asw")} AS whiff_rate_ahead, {over1("bm", "bsw")} AS whiff_rate_behind, {over1("ec", "e")} AS called_strike_edge_pct
FROM (SELECT gamepk, pitcher_id, avg(start_speed) AS avg_velo, avg(spin_rate) AS avg_spin_rate,
    avg(release_pos_y) AS avg_extension, avg(break_horizontal) AS avg_h_break, avg(break_vertical_induced) AS avg_v_break,
    {n(INZ)} AS zi, count(*) AS al, {n(OUTZ)} AS zo, {n(f"{OUTZ} AND {SWING}")} AS zc,
    {n(f"ps = 2 AND {SWING}")} AS ts, {n(f"ps = 2 AND {MISS}")} AS tm, {n("is_in_play")} AS c,
    {n("is_in_play AND launch_speed >= 95")} AS ch, {n("is_in_play AND launch_angle BETWEEN 8 AND 32")} AS cs,
    {n(f"ps > pb AND {SWING}")} AS asw, {n(f"ps > pb AND {MISS}")} AS am, {n(f"pb > ps AND {SWING}")} AS bsw,
    {n(f"pb > ps AND {MISS}")} AS bm, {n("zone IN (1,2,3,4,6,7,8,9)")} AS e,
    {n(f"zone IN (1,2,3,4,6,7,8,9) AND {CALLED}")} AS ec, avg(launch_speed) FILTER (is_in_play) AS ev
  FROM (SELECT r.*, coalesce(lag(post_balls) OVER w, 0) AS pb, coalesce(lag(post_strikes) OVER w, 0) AS ps
        FROM raw r WHERE is_pitch AND (gamepk, pitcher_id) IN (SELECT (gamepk, starter_id) FROM starters)
        WINDOW w AS (PARTITION BY gamepk, play_id ORDER BY event_index))
  GROUP BY ALL)""")


@query("process_quality", ["gamepk", "pitcher_id"], "SELECT * FROM process", ["process"])
def process_quality(spark, d):
    return P.process(_pitchers_handless(spark, d, starters=True))


cte("resolved", ("raw", "players"), """
SELECT *, CASE WHEN bs = 'S' THEN CASE WHEN ph = 'R' THEN 'L' ELSE 'R' END ELSE bs END AS bside FROM (
  SELECT r.*, CASE WHEN p.pitchHand = 'S' THEN 'R' ELSE p.pitchHand END AS ph, b.batSide AS bs
  FROM raw r LEFT JOIN players p ON r.pitcher_id = p.person_id LEFT JOIN players b ON r.batter_id = b.person_id)""")


def split_sql(s):
    return f"""
SELECT a.*, m.whiff_rate_vs_{s} FROM (
  SELECT gamepk, pitcher_id, {n(f"play_result IN {KS}")}::DOUBLE / count(*) AS k_rate_vs_{s},
    {n(f"play_result IN {BB}")}::DOUBLE / count(*) AS bb_rate_vs_{s},
    {n(f"play_result IN {ON}")}::DOUBLE / count(*) AS obp_allowed_vs_{s}, count(*) AS pa_count_vs_{s}
  FROM (SELECT *, row_number() OVER (PARTITION BY gamepk, pitcher_id, play_id ORDER BY event_index) AS rn
        FROM resolved WHERE play_result IS NOT NULL) WHERE rn = 1 AND bside = '{s}' GROUP BY ALL) a
LEFT JOIN (SELECT gamepk, pitcher_id, {over1(n(MISS), n(SWING))} AS whiff_rate_vs_{s}
  FROM resolved WHERE is_pitch AND bside = '{s}' GROUP BY ALL) m ON a.gamepk = m.gamepk AND a.pitcher_id = m.pitcher_id"""


cte("pitcher_split", ("resolved",), f"""
SELECT *, (coalesce(obp_allowed_vs_L, 0) * coalesce(pa_count_vs_L, 0) + coalesce(obp_allowed_vs_R, 0) * coalesce(pa_count_vs_R, 0))
  / greatest(coalesce(pa_count_vs_L, 0) + coalesce(pa_count_vs_R, 0), 1) AS obp_allowed
FROM ({split_sql("L")}) FULL JOIN ({split_sql("R")}) USING (gamepk, pitcher_id)""")


@query("platoon_weighted_obp", ["gamepk", "pitcher_id"], "SELECT * FROM pitcher_split", ["pitcher_split"])
def platoon_weighted_obp(spark, d):
    return P.pitcher_splits(_pitchers(spark, d))


XB = "CASE play_result WHEN 'Double' THEN 1 WHEN 'Triple' THEN 2 WHEN 'Home Run' THEN 3 ELSE 0 END"


def bsplit_sql(s):
    return f"""
SELECT gamepk, batter_id, {n(f"play_result IN {KS}")}::DOUBLE / count(*) AS k_rate_vs_{s},
  {n(f"play_result IN {ON}")}::DOUBLE / count(*) AS obp_vs_{s}, sum({XB})::DOUBLE / count(*) AS iso_vs_{s},
  sum({BASES})::DOUBLE / count(*) AS tb_rate_vs_{s}, count(*) AS pa_count_vs_{s}
FROM (SELECT *, row_number() OVER (PARTITION BY gamepk, batter_id, play_id ORDER BY event_index) AS rn
      FROM resolved WHERE play_result IS NOT NULL) WHERE rn = 1 AND ph = '{s}' GROUP BY ALL"""


cte("batter_split", ("resolved",), f"""
SELECT *, (coalesce(obp_vs_L, 0) * coalesce(pa_count_vs_L, 0) + coalesce(obp_vs_R, 0) * coalesce(pa_count_vs_R, 0))
  / greatest(coalesce(pa_count_vs_L, 0) + coalesce(pa_count_vs_R, 0), 1) AS obp_per_game
FROM ({bsplit_sql("L")}) FULL JOIN ({bsplit_sql("R")}) USING (gamepk, batter_id)""")


@query("platoon_batter", ["gamepk", "batter_id"], "SELECT * FROM batter_split", ["batter_split"])
def platoon_batter(spark, d):
    return P.batter_splits(P.batter_measures(_parts(spark, d)))


cte("sp_pa", ("raw", "starters"), """
SELECT p.* FROM (SELECT gamepk, play_id, max(event_index) AS event_index,
    arg_max(pitcher_id, event_index) AS pitcher_id, arg_max(batter_id, event_index) AS batter_id,
    arg_max(batter_team_id, event_index) AS batter_team_id, arg_max(half_inning, event_index) AS half_inning,
    arg_max(inning, event_index) AS inning,
    arg_max(play_result, event_index) FILTER (play_result IS NOT NULL) AS play_result,
    arg_max(event_type, event_index) FILTER (event_type IS NOT NULL) AS event_type,
    arg_max(launch_speed, event_index) FILTER (launch_speed IS NOT NULL) AS launch_speed
  FROM raw GROUP BY ALL) p
WHERE play_result IS NOT NULL AND (gamepk, pitcher_id) IN (SELECT (gamepk, starter_id) FROM starters)""")


def _sp_pa(spark, d):
    return P.appearances(_handless(spark, d, "faced"), _people(spark, d))


@query("last_nonnull_row", ["gamepk", "play_id", "batter_id", "pitcher_id", "play_result"], f"""
SELECT gamepk, play_id, batter_id, pitcher_id, play_result, launch_speed, event_index, {BASES} AS target_bases,
  CASE WHEN {BASES} > 0 THEN 1 ELSE 0 END AS reached_base FROM sp_pa""", ["sp_pa"])
def last_nonnull_row(spark, d):
    return P.appearances(_handless(spark, d, "faced")).select("gamepk", "play_id", "batter_id", "pitcher_id", "play_result",
                                                     "launch_speed", "event_index", "target_bases", "reached_base")


@query("running_number", ["gamepk", "play_id"], """
SELECT gamepk, play_id, least(row_number() OVER (PARTITION BY gamepk, pitcher_id, batter_id ORDER BY event_index), 3)
  AS times_through_order FROM sp_pa""", ["sp_pa"])
def running_number(spark, d):
    return P.appearances(_handless(spark, d, "faced")).select("gamepk", "play_id", "times_through_order")


@query("exclusive_cumsum", ["gamepk", "play_id"], f"""
SELECT p.gamepk, p.play_id, c.pitch_count_in_game FROM sp_pa p LEFT JOIN (
  SELECT gamepk, pitcher_id, play_id, coalesce(sum(x) OVER (PARTITION BY gamepk, pitcher_id ORDER BY play_id {PRIOR}), 0)
    AS pitch_count_in_game
  FROM (SELECT gamepk, pitcher_id, play_id, count(*) AS x FROM raw WHERE is_pitch GROUP BY ALL)) c
ON p.gamepk = c.gamepk AND p.pitcher_id = c.pitcher_id AND p.play_id = c.play_id""", ["sp_pa"])
def exclusive_cumsum(spark, d):
    return P.appearances(_handless(spark, d, "faced")).select("gamepk", "play_id", "pitch_count_in_game")


OUTS, ONB = "s // 8", "s % 8"
STEP = f"""CASE
  WHEN e = 'home_run' THEN {OUTS} * 8 WHEN e = 'triple' THEN {OUTS} * 8 + 4 WHEN e = 'double' THEN {OUTS} * 8 + 2
  WHEN e = 'single' THEN {OUTS} * 8 + 1 + (s & 1) * 2
  WHEN e IN ('walk','hit_by_pitch') THEN (s | 1) | CASE WHEN s & 3 = 3 THEN 4 WHEN s & 1 = 1 THEN 2 ELSE 0 END
  WHEN e IN ('strikeout','strikeout_double_play','field_out') THEN least({OUTS} + 1, 3) * 8 + {ONB}
  WHEN e = 'grounded_into_double_play' THEN least({OUTS} + 2, 3) * 8 + (s & 6)
  WHEN e = 'sac_fly' THEN least({OUTS} + 1, 3) * 8 + (s & 3)
  WHEN e = 'field_error' THEN s | 1 ELSE s END"""


cte("states", ("sp_pa",), f"""
WITH RECURSIVE q AS (SELECT gamepk, half_inning, inning, event_index, event_type AS e,
    row_number() OVER (PARTITION BY gamepk, half_inning, inning ORDER BY event_index) AS rn FROM sp_pa),
w AS (SELECT gamepk, half_inning, inning, event_index, e, rn, 0::BIGINT AS s FROM q WHERE rn = 1
  UNION ALL
  SELECT q.gamepk, q.half_inning, q.inning, q.event_index, q.e, q.rn, x.s2 FROM
    (SELECT gamepk, half_inning, inning, rn, ({STEP})::BIGINT AS s2 FROM w) x JOIN q
  ON q.gamepk = x.gamepk AND q.half_inning = x.half_inning AND q.inning = x.inning AND q.rn = x.rn + 1)
SELECT gamepk, half_inning, inning, event_index, s AS base_out_state, s // 8 AS outs_when_up FROM w""")


@query("state_machine", ["gamepk", "half_inning", "inning", "event_index"], "SELECT * FROM states", ["states"])
def state_machine(spark, d):
    from lagwell.operators.base_out import base_out_state
    pa = P.appearances(_handless(spark, d, "faced")).select("gamepk", "half_inning", "inning", "event_index", "event_type")
    return base_out_state(pa).drop("event_type")


@query("hand_resolution", ["gamepk", "play_id"], """
SELECT p.gamepk, p.play_id,
  CASE WHEN (bside = 'L' AND ph = 'R') OR (bside = 'R' AND ph = 'L') THEN 1 ELSE 0 END AS platoon_advantage,
  CASE WHEN bside = ph THEN 1 ELSE 0 END AS same_hand
FROM sp_pa p JOIN resolved r ON p.gamepk = r.gamepk AND p.event_index = r.event_index""", ["sp_pa", "resolved"])
def hand_resolution(spark, d):
    return _sp_pa(spark, d).select("gamepk", "play_id", "platoon_advantage", "same_hand")


# ---- game tables and windows ------------------------------------------------------------

cte("pg", ("pitcher_ip", "starters", "quality", "process", "pitcher_split"), f"""
SELECT b.* EXCLUDE (ip, ip_true), b.ip_true AS ip, q.* EXCLUDE (gamepk, pitcher_id), pr.* EXCLUDE (gamepk, pitcher_id),
  sp.* EXCLUDE (gamepk, pitcher_id),
  k::DOUBLE / greatest(pa_count, CASE WHEN pa_count IS NULL THEN NULL ELSE 1 END) AS k_rate,
  bb::DOUBLE / pa_count AS bb_rate, hr::DOUBLE / pa_count AS hr_rate, k::DOUBLE / nullif(bb, 0) AS k_bb_ratio
FROM (SELECT * FROM pitcher_ip WHERE (gamepk, personId) IN (SELECT (gamepk, starter_id) FROM starters)) b
LEFT JOIN quality q ON b.gamepk = q.gamepk AND b.personId = q.pitcher_id
LEFT JOIN process pr ON b.gamepk = pr.gamepk AND b.personId = pr.pitcher_id
LEFT JOIN pitcher_split sp ON b.gamepk = sp.gamepk AND b.personId = sp.pitcher_id""")
cte("bg", ("batter_box", "discipline", "batter_split"), f"""
SELECT b.*, d.* EXCLUDE (gamepk, batter_id), sp.* EXCLUDE (gamepk, batter_id), {", ".join(
    f"{over1(e, 'plate_appearances')} AS {c}" for c, e in {"k_rate": "k", "bb_rate": "bb", "hr_rate": "hr",
    "iso": "doubles + 2 * triples + 3 * hr", "tb_rate": "total_bases"}.items())}
FROM batter_box b LEFT JOIN discipline d ON b.gamepk = d.gamepk AND b.personId = d.batter_id
LEFT JOIN batter_split sp ON b.gamepk = sp.gamepk AND b.personId = sp.batter_id""")


def _pg(spark, d, hands=True):
    from lagwell.functions.text import innings
    return A.pitcher_game(t.pitcher_box(spark, d).withColumn("ip", innings("ip")), _pitchers(spark, d) if hands else _pitchers_handless(spark, d, starters=True))


def _bg(spark, d):
    return A.batter_game(t.batter_box(spark, d), P.batter_measures(_parts(spark, d)))


LAG = "(PARTITION BY personId ORDER BY game_date, gamepk)"
cte("pw", ("pg", "inn45"), f"""
SELECT *, (sp_last_start_pitches)::DOUBLE / CASE WHEN days_rest < 1 THEN 1 ELSE days_rest END AS fatigue_score,
  sp_last_start_avg_velo - sp10_avg_velo AS sp_velo_trend, sp_last_start_avg_spin_rate - sp10_avg_spin_rate AS sp_spin_trend,
  sp_last_start_contact_exit_velo - sp10_contact_exit_velo AS sp_contact_velo_trend
FROM (
SELECT g.personId, g.gamepk, g.game_date, g.game_season, g.team_id,
  datediff('day', lag(game_date) OVER {LAG}, game_date) - 1 AS days_rest,
  coalesce(sum(prev) OVER (PARTITION BY personId ORDER BY game_date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), 0)
    - coalesce(sum(prev) OVER (PARTITION BY personId, game_date ORDER BY gamepk ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)
    AS cumulative_ip_last_7d,
  {frame_sql(SP_LAST, ("avg",), "w1", "sp_last_start_{col}")}, {frame_sql(SP_MEAN, ("avg",), "w10", "sp10_{col}")},
  sum(total_pitches) OVER w10 AS sp10_total_pitches, sum(pa_count) OVER w10 AS sp10_pa_count, count(*) OVER w10 AS sp10_n_starts,
  avg(CASE WHEN inn45_pa > 0 THEN inn45_pitches::DOUBLE / inn45_pa END) OVER w10 AS sp10_p_per_pa_inn4_5,
  avg(CASE WHEN inn45_pa > 0 THEN inn45_onbase::DOUBLE / inn45_pa END) OVER w10 AS sp10_obp_allowed_inn4_5,
  {frame_sql(SP_MEAN, ("avg",), "wytd", "spytd_{col}")}, sum(pa_count) OVER wytd AS spytd_pa_count,
  count(*) OVER wytd AS spytd_n_starts,
  datediff('day', lag(game_date, 3) OVER {LAG}, lag(game_date, 1) OVER {LAG}) / 2.0 AS sp_avg_days_between_starts_3,
  datediff('day', lag(game_date, 10) OVER {LAG}, lag(game_date, 1) OVER {LAG}) / 9.0 AS sp_avg_days_between_starts_10,
  {", ".join(SP)}, pa_count, ip
FROM (SELECT *, lag(ip) OVER {LAG} AS prev FROM pg) g LEFT JOIN
  (SELECT gamepk AS i_game, pitcher_id AS i_pitcher, inn45_pitches, inn45_pa, inn45_onbase FROM inn45) i
  ON g.gamepk = i.i_game AND g.personId = i.i_pitcher
{windows_sql("personId", {"w1": 1, "w10": 10, "wytd": None})})""")


@query("pitcher_windows", ["personId", "gamepk", "team_id"], "SELECT * EXCLUDE (game_date) FROM pw", ["pw"])
def pitcher_windows(spark, d):
    return A.pitcher_windows(_pg(spark, d, hands=False)).drop("game_date")


for _name, _cols in {"days_rest": ["days_rest"], "range_7d": ["cumulative_ip_last_7d"],
                     "spacing_lags": ["sp_avg_days_between_starts_3", "sp_avg_days_between_starts_10"],
                     "trend_delta": ["sp_velo_trend", "sp_spin_trend", "sp_contact_velo_trend", "fatigue_score"]}.items():
    def _fn(spark, d, cols=tuple(_cols)):
        return A.pitcher_windows(_pg(spark, d, hands=False)).select("personId", "gamepk", *cols)
    query(_name, ["personId", "gamepk"], f"SELECT personId, gamepk, {', '.join(_cols)} FROM pw", ["pw"])(_fn)


cte("pplat", ("pg",), f"""
SELECT personId, gamepk, {frame_sql(same(*SP_SPLITS), ("avg",), "w1", "sp_last_start_{col}")},
  {frame_sql(same(*SP_SPLITS), ("avg",), "w10", "sp10_{col}")}, {frame_sql(same(*SP_SPLITS), ("avg",), "wytd", "spytd_{col}")},
  {frame_sql(same("pa_count_vs_L", "pa_count_vs_R"), ("sum",), "wytd", "spytd_{col}")}, avg(obp_allowed) OVER wytd AS spytd_obp_allowed
FROM pg {windows_sql("personId", {"w1": 1, "w10": 10, "wytd": None})}""")
cte("bplat", ("bg",), f"""
SELECT personId, gamepk, {frame_sql(same(*BAT_SPLITS), ("avg",), "wytd", "batytd_{col}")},
  {frame_sql(same("pa_count_vs_L", "pa_count_vs_R"), ("sum",), "wytd", "batytd_{col}")}, avg(obp_per_game) OVER wytd AS batytd_obp
FROM bg {windows_sql("personId", {"wytd": None})}""")


def shrunk(tag, *stats):
    return ", ".join(
        f"(coalesce({tag}_pa_count_vs_{h}, 0) / (coalesce({tag}_pa_count_vs_{h}, 0) + {SHRINK[tag][s]}.0)) * {tag}_{s}_vs_{h} + "
        f"(1 - coalesce({tag}_pa_count_vs_{h}, 0) / (coalesce({tag}_pa_count_vs_{h}, 0) + {SHRINK[tag][s]}.0)) * {tag}_{s} "
        f"AS {tag}_{s}_vs_{h}_shrunk" for s in stats for h in "LR")


@query("platoon_windows", ["personId", "gamepk"], f"SELECT *, {shrunk('spytd', 'obp_allowed')} FROM pplat", ["pplat"])
def platoon_windows(spark, d):
    return A.shrink_splits(A.pitcher_platoon_windows(_pg(spark, d)), "spytd_", ["obp_allowed"])


cte("bw", ("bg",), f"""
SELECT personId, gamepk, game_date, game_season, TRY_CAST(batting_order AS INTEGER) AS batting_order_int,
  datediff('day', lag(game_date) OVER {LAG}, game_date) AS bat_days_since_last_game,
  {frame_sql(BC, ("avg",), "w1", "bat_last_game_{col}")},
  {", ".join(frame_sql(BC, ("avg",), w, p + "_{col}") + f", sum(plate_appearances) OVER {w} AS {p}_pa_count, count(*) OVER {w} AS {p}_n_games"
             for w, p in (("w15", "bat15"), ("w50", "bat50"), ("wytd", "batytd")))},
  {", ".join(BAT)}, plate_appearances
FROM bg {windows_sql("personId", {"w1": 1, "w15": 15, "w50": 50, "wytd": None})}""")


@query("batter_windows", ["personId", "gamepk"], "SELECT * EXCLUDE (game_date) FROM bw", ["bw"])
def batter_windows(spark, d):
    return A.batter_windows(_bg(spark, d)).drop("game_date")


@query("batter_platoon_shrunk", ["personId", "gamepk"], f"SELECT *, {shrunk('batytd', 'obp')} FROM bplat", ["bplat"])
def batter_platoon_shrunk(spark, d):
    return A.shrink_splits(A.batter_platoon_windows(_bg(spark, d)), "batytd_", ["obp"])


cte("tg", ("batter_box", "discipline", "sp_pa"), f"""
SELECT g.*, p.* EXCLUDE (team_id, gamepk), {over1("team_pitches_seen", "team_pa")} AS team_p_per_pa FROM (
  SELECT *, {over1("team_k", "team_pa")} AS team_k_rate, {over1("team_bb", "team_pa")} AS team_bb_rate,
    {over1("team_hr", "team_pa")} AS team_hr_rate, {over1("team_doubles + 2 * team_triples + 3 * team_hr", "team_pa")} AS team_iso,
    {over1("team_total_bases", "team_pa")} AS team_tb_rate, {over1("team_total_bases", "team_pa")} AS team_obp
  FROM (SELECT team_id, gamepk, game_date, game_season, sum(plate_appearances) AS team_pa, sum(k) AS team_k,
      sum(bb) AS team_bb, sum(hr) AS team_hr, sum(total_bases) AS team_total_bases, sum(doubles) AS team_doubles,
      sum(triples) AS team_triples, sum(hbp) AS team_hbp FROM batter_box GROUP BY ALL)) g
LEFT JOIN (SELECT *, {over1("team_chase_n", "team_out_zone_n")} AS team_chase_rate,
    {over1("team_z_contact_n", "team_z_swing_n")} AS team_z_contact_pct FROM (
  SELECT w.batter_team_id AS team_id, d.gamepk, sum(chase_n) AS team_chase_n, sum(out_zone_n) AS team_out_zone_n,
    sum(z_swing_n) AS team_z_swing_n, sum(z_contact_n) AS team_z_contact_n, sum(pitches_seen) AS team_pitches_seen
  FROM discipline d JOIN (SELECT DISTINCT gamepk, batter_id, batter_team_id FROM sp_pa) w
  ON d.gamepk = w.gamepk AND d.batter_id = w.batter_id GROUP BY ALL)) p
ON g.team_id = p.team_id AND g.gamepk = p.gamepk""")


def _tg(spark, d):
    return A.team_game(t.batter_box(spark, d), P.discipline(P.batter_measures(_parts(spark, d))), _sp_pa(spark, d))


@query("team_rates_from_sums", ["team_id", "gamepk"], "SELECT * EXCLUDE (game_date) FROM tg", ["tg"])
def team_rates_from_sums(spark, d):
    return _tg(spark, d).drop("game_date")


cte("tw", ("tg",), f"""
SELECT team_id, gamepk, game_season, {frame_sql(TC, ("avg",), "w1", "team_last_game_{col}")},
  {frame_sql(TC, ("avg",), "w10", "team_10g_{col}")}, count(*) OVER w10 AS team_10g_n_games,
  {frame_sql(TC, ("avg",), "wytd", "team_ytd_{col}")}, sum(team_pa) OVER wytd AS team_ytd_pa_count,
  count(*) OVER wytd AS team_ytd_n_games FROM tg {windows_sql("team_id", {"w1": 1, "w10": 10, "wytd": None})}""")


@query("team_windows", ["team_id", "gamepk"], "SELECT * FROM tw", ["tw"])
def team_windows(spark, d):
    return A.team_windows(_tg(spark, d)).drop("game_date")


def career_sql(src, stats, out):
    means = f"(SELECT personId, game_season, {', '.join(f'avg({c}) AS {c}' for c in stats)} FROM {src} GROUP BY ALL)"
    def item(c):
        v = [("s0", 3), ("s1", 2), ("s2", 1)]
        top = " + ".join(f"coalesce({s}.{c}, 0) * {w}" for s, w in v)
        low = " + ".join(f"CASE WHEN {s}.{c} IS NULL THEN 0 ELSE {w} END" for s, w in v)
        return f"({top}) / nullif({low}, 0) AS {out}3yr_wtd_{c}"
    return f"""SELECT s0.personId, s0.game_season, {', '.join(item(c) for c in stats)} FROM {means} s0
LEFT JOIN {means} s1 ON s0.personId = s1.personId AND s0.game_season = s1.game_season + 1
LEFT JOIN {means} s2 ON s0.personId = s2.personId AND s0.game_season = s2.game_season + 2"""


@query("career_321", ["personId"], career_sql("bg", BAT, "bat_"), ["bg"])
def career_321(spark, d):
    return A.career_weighted(_bg(spark, d), A.BATTER_STATS, "bat_")


FALL = [c for c in BAT if c in BC]


@query("career_fallback", ["personId", "gamepk"], f"""
SELECT w.personId, w.gamepk, {", ".join(
    f"CASE WHEN coalesce(batytd_pa_count, 0) < 30 THEN c.bat_3yr_wtd_{c} ELSE batytd_{c} END AS batytd_{c}" if c in FALL
    else f"batytd_{c}" for c in BC)}, {", ".join(f"bat_3yr_wtd_{c}" for c in BAT)},
  {", ".join(f"l.{c} AS bat_last_szn_{c}" for c in BAT)}
FROM bw w LEFT JOIN ({career_sql("bg", BAT, "bat_")}) c ON w.personId = c.personId AND w.game_season = c.game_season
LEFT JOIN (SELECT personId, game_season, {", ".join(f"avg({c}) AS {c}" for c in BAT)} FROM bg GROUP BY ALL) l
ON w.personId = l.personId AND w.game_season = l.game_season + 1""", ["bw"])
def career_fallback(spark, d):
    w = A.career_fallback(A.batter_windows(_bg(spark, d), seasons=A.BATTER_STATS), A.BATTER_STATS, "batytd_pa_count", "batytd_", "bat_")
    return w.select("personId", "gamepk", *[f"batytd_{c}" for c in BC], *[f"bat_3yr_wtd_{c}" for c in BAT],
                    *[f"bat_last_szn_{c}" for c in BAT])


def _starter_frame(spark, d, complete):
    from lagwell.functions.text import innings
    box = stage(t.pitcher_box(spark, d).withColumn("ip", innings("ip")))
    return A.build(t.pitches_raw(spark, d), box, stage(t.batter_box(spark, d)), t.schedule_raw(spark, d), _people(spark, d),
                   complete_only=complete, dealt=t.dealt(spark, d))


def l5_item(s, dflt):
    lg, b, p = f"coalesce(lg_{s}_rate, {dflt})", f"batytd_{s}_rate", f"spytd_{s}_rate"
    top = f"({b} * {p} / {lg})"
    return f"CASE WHEN {top} + (1 - {b}) * (1 - {p}) / (1 - {lg}) > 0 THEN {top} / ({top} + (1 - {b}) * (1 - {p}) / (1 - {lg})) END AS log5_expected_{s}"


def l5(s, dflt):
    lg = f"coalesce(lg_{s}, {dflt})"
    top = f"(b_{s} * p_{s} / {lg})"
    return f"CASE WHEN {top} + (1 - b_{s}) * (1 - p_{s}) / (1 - {lg}) > 0 THEN {top} / ({top} + (1 - b_{s}) * (1 - p_{s}) / (1 - {lg})) END AS log5_expected_{s}"


@query("log5", ["gamepk", "play_id"], f"""
SELECT gamepk, play_id, {l5("k", 0.220)}, {l5("bb", 0.085)}, {l5("hr", 0.034)} FROM (
  SELECT a.gamepk, a.play_id, {", ".join(
      f"CASE WHEN coalesce(p.spytd_pa_count, 0) < 30 THEN pc.sp_3yr_wtd_{s}_rate ELSE p.spytd_{s}_rate END AS p_{s}, "
      f"CASE WHEN coalesce(b.batytd_pa_count, 0) < 30 THEN bc.bat_3yr_wtd_{s}_rate ELSE b.batytd_{s}_rate END AS b_{s}, l.lg_{s}"
      for s in ("k", "bb", "hr"))}
  FROM sp_pa a LEFT JOIN games g ON a.gamepk = g.gamepk
  LEFT JOIN pw p ON a.gamepk = p.gamepk AND a.pitcher_id = p.personId
  LEFT JOIN bw b ON a.gamepk = b.gamepk AND a.batter_id = b.personId
  LEFT JOIN ({career_sql("pg", SP, "sp_")}) pc ON a.pitcher_id = pc.personId AND g.game_season = pc.game_season
  LEFT JOIN ({career_sql("bg", BAT, "bat_")}) bc ON a.batter_id = bc.personId AND g.game_season = bc.game_season
  LEFT JOIN (SELECT game_season + 1 AS game_season, avg(k_rate) AS lg_k, avg(bb_rate) AS lg_bb, avg(hr_rate) AS lg_hr
             FROM pg GROUP BY ALL) l ON g.game_season = l.game_season)""", ["sp_pa", "games", "pw", "bw"])
def log5_features(spark, d):
    return _starter_frame(spark, d, False).select("gamepk", "play_id", "log5_expected_k", "log5_expected_bb", "log5_expected_hr")


TEXT = ["batter_id", "batter_name", "batter_team_id", "pitcher_id", "pitcher_name", "pitcher_team_id", "half_inning", "play_result",
        "event_type", "pitch_call", "pitch_call_code", "trajectory", "hardness"]
NUMBERS = {"pitch_number": "pitch_number", "inning": "inning", "post_balls": "count_balls", "post_strikes": "count_strikes",
           **same("count_outs", "is_pitch", "is_in_play", "is_strike", "is_ball", "zone", "start_speed", "end_speed", "extension",
                  "spin_rate", "pfx_x", "pfx_z", "break_horizontal", "break_vertical_induced", "release_pos_y", "plate_x", "plate_z",
                  "strike_zone_bottom", "strike_zone_top", "launch_speed", "launch_angle")}
cte("sp_all", ("raw", "starters"), f"""
SELECT * FROM (SELECT gamepk, play_id, max(event_index) AS event_index, {", ".join(
    f"arg_max({c}, event_index) FILTER ({c} IS NOT NULL) AS {o}" for c, o in (same(*TEXT) | NUMBERS).items())} FROM raw GROUP BY ALL)
WHERE play_result IS NOT NULL AND (gamepk, pitcher_id) IN (SELECT (gamepk, starter_id) FROM starters)""")


def side_sql(windows, plat, src, stats, swapped, pre, ytd):
    """A side's windows with the career fallback, last season and shrunk hand splits; rates of the game itself left out."""
    swap = ", ".join(f"CASE WHEN coalesce({ytd}_pa_count, 0) < 30 THEN c.{pre}_3yr_wtd_{x} ELSE {ytd}_{x} END AS {ytd}_{x}" for x in swapped)
    means = f"(SELECT personId, game_season, {', '.join(f'avg({x}) AS {pre}_last_szn_{x}' for x in stats)} FROM {src} GROUP BY ALL)"
    return f"""SELECT *, {shrunk(ytd, *SHRINK[ytd])} FROM (
  SELECT w.* EXCLUDE (game_date, game_season, {", ".join(stats)}) REPLACE ({swap}),
    c.* EXCLUDE (personId, game_season), l.* EXCLUDE (personId, game_season), p.* EXCLUDE (personId, gamepk)
  FROM {windows} w LEFT JOIN ({career_sql(src, stats, pre + "_")}) c ON w.personId = c.personId AND w.game_season = c.game_season
  LEFT JOIN {means} l ON w.personId = l.personId AND w.game_season = l.game_season + 1
  LEFT JOIN {plat} p ON w.personId = p.personId AND w.gamepk = p.gamepk)"""


cte("sp_side", ("pw", "pplat"), side_sql("pw", "pplat", "pg", SP, [x for x in SP if x != "first_pitch_strike_pct"], "sp", "spytd"))
cte("bat_side", ("bw", "bplat"), side_sql("bw", "bplat", "bg", BAT, FALL, "bat", "batytd"))
TW = [f"team_{w}_{c}" for w in ("last_game", "10g", "ytd") for c in TC] + ["team_10g_n_games", "team_ytd_pa_count", "team_ytd_n_games"]
cte("frame", ("sp_all", "raw", "pitcher_box", "sched_raw", "states", "resolved", "sp_side", "bat_side", "tw", "pg"), f"""
SELECT *, {", ".join(l5_item(s, dflt) for s, dflt in (("k", 0.220), ("bb", 0.085), ("hr", 0.034)))} FROM (
SELECT a.*, {BASES} AS target_bases, CASE WHEN {BASES} > 0 THEN 1 ELSE 0 END AS reached_base,
  least(row_number() OVER (PARTITION BY a.gamepk, a.pitcher_id, a.batter_id ORDER BY a.event_index), 3) AS times_through_order,
  n.pitch_count_in_game, CASE WHEN (r.bside = 'L' AND r.ph = 'R') OR (r.bside = 'R' AND r.ph = 'L') THEN 1 ELSE 0 END AS platoon_advantage,
  CASE WHEN r.bside = r.ph THEN 1 ELSE 0 END AS same_hand, st.base_out_state, st.outs_when_up, m.game_date, m.game_season,
  v.venue_id, CASE WHEN v.gamepk IS NOT NULL THEN CASE v.venue_id WHEN '1' THEN 103 WHEN '3' THEN 96 WHEN '4' THEN 102 WHEN '5' THEN 100 WHEN '7' THEN 98 WHEN '10' THEN 97
    WHEN '12' THEN 103 WHEN '14' THEN 101 WHEN '15' THEN 97 WHEN '17' THEN 102 WHEN '19' THEN 98 WHEN '20' THEN 100 WHEN '21' THEN 96
    WHEN '22' THEN 102 WHEN '28' THEN 97 WHEN '31' THEN 100 WHEN '32' THEN 97 WHEN '34' THEN 100 WHEN '36' THEN 98 ELSE 100 END END AS park_factor,
  {", ".join(f"{t}.{c} AS {tag}_{c}" for t, tag in (("o", "opp"), ("w", "own")) for c in TW)},
  s.* EXCLUDE (personId, gamepk, team_id, pa_count, ip), b.* EXCLUDE (personId, gamepk, plate_appearances), lg_k_rate, lg_bb_rate, lg_hr_rate,
  CASE WHEN m.game_date >= TIMESTAMP '2023-03-30' THEN 1 ELSE 0 END AS post_shift_ban, CAST(NULL AS DOUBLE) AS team_oaa_season
FROM sp_all a
LEFT JOIN (SELECT gamepk, min(game_date) AS game_date, min(game_season) AS game_season FROM pitcher_box GROUP BY ALL) m ON a.gamepk = m.gamepk
LEFT JOIN (SELECT gamepk, min(venue_id) AS venue_id FROM sched_raw GROUP BY ALL) v ON a.gamepk = v.gamepk
LEFT JOIN (SELECT gamepk, pitcher_id, play_id, coalesce(sum(x) OVER (PARTITION BY gamepk, pitcher_id ORDER BY play_id {PRIOR}), 0) AS pitch_count_in_game
  FROM (SELECT gamepk, pitcher_id, play_id, count(*) AS x FROM raw WHERE is_pitch GROUP BY ALL)) n
  ON a.gamepk = n.gamepk AND a.pitcher_id = n.pitcher_id AND a.play_id = n.play_id
LEFT JOIN states st ON a.gamepk = st.gamepk AND a.half_inning = st.half_inning AND a.inning = st.inning AND a.event_index = st.event_index
LEFT JOIN (SELECT gamepk AS r_game, event_index AS r_event, bside, ph FROM resolved) r ON a.gamepk = r_game AND a.event_index = r_event
LEFT JOIN tw o ON a.gamepk = o.gamepk AND a.batter_team_id = o.team_id
LEFT JOIN tw w ON a.gamepk = w.gamepk AND a.pitcher_team_id = w.team_id
LEFT JOIN sp_side s ON a.gamepk = s.gamepk AND a.pitcher_id = s.personId
LEFT JOIN bat_side b ON a.gamepk = b.gamepk AND a.batter_id = b.personId
LEFT JOIN (SELECT game_season + 1 AS game_season, avg(k_rate) AS lg_k_rate, avg(bb_rate) AS lg_bb_rate, avg(hr_rate) AS lg_hr_rate
  FROM pg WHERE game_season IS NOT NULL GROUP BY ALL) l ON m.game_season = l.game_season)""")


@query("starter_pa_frame", ["gamepk", "play_id", "game_date", "venue_id", *TEXT], "SELECT * FROM frame", ["frame"])
def starter_pa_frame(spark, d):
    return _starter_frame(spark, d, False)


REQUIRED = ([f"sp10_{c}" for c in [*SP_MEAN, *SP_SPLITS, "total_pitches", "pa_count", "n_starts", "p_per_pa_inn4_5", "obp_allowed_inn4_5"]]
            + [f"spytd_{c}" for c in [*SP_MEAN, *SP_SPLITS, "pa_count_vs_L", "pa_count_vs_R", "obp_allowed", "pa_count", "n_starts"]]
            + [f"spytd_{s}_vs_{h}_shrunk" for s in SHRINK["spytd"] for h in "LR"] + [f"bat_last_game_{c}" for c in BC]
            + [f"bat{w}_{c}" for w in ("15", "50", "ytd") for c in [*BC, "pa_count", "n_games"]]
            + [f"batytd_{c}" for c in [*BAT_SPLITS, "pa_count_vs_L", "pa_count_vs_R", "obp"]]
            + [f"batytd_{s}_vs_{h}_shrunk" for s in SHRINK["batytd"] for h in "LR"])
GONE = "CASE WHEN " + " OR ".join(f"{c} IS NULL" for c in REQUIRED) + " THEN 1 ELSE 0 END"


@query("dropped_rows_report", ["part", "key"], f"""
WITH f AS (SELECT *, {GONE} AS gone FROM frame)
SELECT 'season' AS part, CAST(game_season AS VARCHAR) AS key, sum(gone) AS dropped, count(*) AS rows FROM f GROUP BY ALL
UNION ALL SELECT 'month', CAST(month(game_date) AS VARCHAR), sum(gone), count(*) FROM f GROUP BY ALL
UNION ALL SELECT * FROM (SELECT 'pitcher', pitcher_id, sum(gone) AS g, count(*) FROM f GROUP BY ALL HAVING sum(gone) > 0 ORDER BY g DESC, pitcher_id LIMIT 10)
UNION ALL SELECT 'column', key, sum(gone), count(*) FROM (
  {" UNION ALL ".join(f"SELECT '{c}' AS key, CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS gone FROM frame" for c in REQUIRED)}) GROUP BY key""", ["frame"])
def dropped_rows_report(spark, d):
    return A.dropped_report(_starter_frame(spark, d, False))


@query("starter_pa_complete", ["gamepk", "play_id"], f"SELECT gamepk, play_id, target_bases FROM (SELECT *, {GONE} AS gone FROM frame) WHERE gone = 0", ["frame"])
def starter_pa_complete(spark, d):
    return _starter_frame(spark, d, True).select("gamepk", "play_id", "target_bases")
