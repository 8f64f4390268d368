"""Lagged frames: the flagship, and the registered window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness import tables as t
from harness.registry import query
from lagwell.plans.frames import Feature, last, lagged, prior

PRIOR = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query("lagged_order_features", ["o_orderkey", "o_custkey"], f"""
SELECT o_orderkey, o_custkey,
  sum(x) OVER w3 AS price_sum_3, avg(x) OVER w3 AS price_avg_3, stddev(x) OVER w3 AS price_std_3,
  median(x) OVER w3 AS price_median_3,
  sum(x) OVER wa AS price_sum_all, avg(x) OVER wa AS price_avg_all, stddev(x) OVER wa AS price_std_all,
  median(x) OVER wa AS price_median_all, count(*) OVER wa AS orders_before
FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18,4)) AS x FROM orders)
WINDOW w3 AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
       wa AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey {PRIOR})""")
def lagged_order_features(spark, d):
    o = t.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                          F.col("o_totalprice").cast("decimal(18,4)").alias("x"))
    feats = []
    for tag, frame in (("3", last(3)), ("all", prior())):
        for agg in ("sum", "avg", "std", "median"):
            feats.append(Feature(f"price_{agg}_{tag}", agg, "x", frame))
    feats.append(Feature("orders_before", "rows", None, prior()))
    return lagged(o, "o_custkey", ["o_orderdate", "o_orderkey"], feats).drop("o_orderdate", "x")


@query("pitch_table", ["gamepk", "play_id", "event_index", "pitcher_role", "count_state", "is_swing", "is_chase",
                       "is_zone_swing", "is_first_pitch", "is_last_pitch", "pitcher_throw_hand", "batter_bat_side"],
       """SELECT gamepk, play_id, event_index, pitcher_role, count_state, is_swing, is_chase, is_zone_swing,
  is_first_pitch, is_last_pitch, pitcher_throw_hand, batter_bat_side, is_hit, speed_retention, perceived_velo,
  plate_z_normalized, movement_magnitude, count_balls, count_strikes, batter_pa_number, game_season FROM pbp""",
       ["pbp"])
def pitch_table(spark, d):
    return t.pitches(spark, d).select(
        "gamepk", "play_id", "event_index", "pitcher_role", "count_state", "is_swing", "is_chase", "is_zone_swing",
        "is_first_pitch", "is_last_pitch", "pitcher_throw_hand", "batter_bat_side", "is_hit", "speed_retention",
        "perceived_velo", "plate_z_normalized", "movement_magnitude", "count_balls", "count_strikes",
        "batter_pa_number", "game_season")


def frame_sql(cols: dict[str, str], aggs, window: str, pattern: str) -> str:
    """SELECT items for every (column, aggregate) pair over a named window."""
    fn = {"sum": "sum", "avg": "avg", "std": "stddev", "median": "median", "max": "max"}
    return ", ".join(f"{fn[a]}({src}) OVER {window} AS {pattern.format(col=c, agg=a)}"
                     for c, src in cols.items() for a in aggs)


def windows_sql(entity: str, frames: dict[str, int | None]) -> str:
    """WINDOW clause: a row count, or None for the season so far."""
    out = []
    for name, n in frames.items():
        part = entity if n else f"{entity}, game_season"
        rows = f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING" if n else PRIOR
        out.append(f"{name} AS (PARTITION BY {part} ORDER BY game_date, gamepk {rows})")
    return "WINDOW " + ", ".join(out)


def same(*cols):
    return {c: c for c in cols}


FULL = ("sum", "avg", "std", "median")
HK = same("h", "k")
TB, PAC = {"tb": "total_bases"}, {"pa": "plate_appearances"}
R3, R7, SZN = "rolling_3game_{col}_{agg}", "rolling_7game_{col}_{agg}", "season_{col}_{agg}"
BATTER_KEEP = ["personId", "team_id", "gamepk", "player_name", "batting_order"]


@query("lagged_batter", BATTER_KEEP, f"""
SELECT personId, team_id, gamepk, player_name, batting_order, game_season, plate_appearances, ab, h, r, singles,
  doubles, triples, hr, total_bases, total_bases_from_h, rbi, lob, sb, bb, k, fantasy_points,
  {frame_sql(HK, FULL, "w3", R3)}, {frame_sql(HK, FULL, "w7", R7)}, {frame_sql(HK, FULL, "ws", SZN)},
  {frame_sql(TB, ("sum", "avg", "std"), "w3", R3)}, {frame_sql(TB, ("sum", "avg", "std"), "w7", R7)},
  {frame_sql(TB, ("sum", "avg"), "ws", SZN)},
  {frame_sql(same("hr", "rbi", "bb"), ("sum", "avg"), "w7", R7)},
  {frame_sql(same("hr", "rbi", "bb"), ("sum", "avg"), "ws", SZN)},
  count(*) OVER ws AS season_games_played,
  {frame_sql(PAC, ("sum", "avg"), "w3", R3)}, {frame_sql(PAC, ("sum", "avg"), "w7", R7)},
  {frame_sql(PAC, ("sum", "avg"), "ws", SZN)}
FROM batter_box {windows_sql("personId", {"w3": 2, "w7": 6, "ws": None})}""", ["batter_box"])
def lagged_batter(spark, d):
    from lagwell.operators.base_features import batter_features
    return batter_features(t.batter_box(spark, d)).drop("game_date")


TEAM_TOTALS = """
SELECT team_id, gamepk, game_date, game_season, sum(plate_appearances) AS total_plate_appearances,
  sum(ab) AS total_ab, sum(h) AS total_h, sum(r) AS total_r, sum(singles) AS total_singles,
  sum(doubles) AS total_doubles, sum(triples) AS total_triples, sum(hr) AS total_hr, sum(total_bases) AS total_bases,
  sum(total_bases_from_h) AS total_bases_from_h, sum(rbi) AS total_rbi, sum(lob) AS total_lob, sum(sb) AS total_sb,
  sum(bb) AS total_bb_bat, sum(k) AS total_k_bat, sum(fantasy_points) AS total_batter_fantasy_points
FROM batter_box GROUP BY ALL"""
TEAM_COLS = {"plate_appearances": "total_plate_appearances", "ab": "total_ab", "h": "total_h", "r": "total_r"}


@query("team_game_totals", ["team_id", "gamepk"], f"SELECT * EXCLUDE (game_date) FROM ({TEAM_TOTALS})", ["batter_box"])
def team_game_totals(spark, d):
    from lagwell.operators.base_features import team_games
    return team_games(t.batter_box(spark, d)).drop("game_date")


@query("lagged_team", ["team_id", "gamepk"], f"""
SELECT * EXCLUDE (game_date), {frame_sql(TEAM_COLS, FULL, "w3", R3)}, {frame_sql(TEAM_COLS, FULL, "w7", R7)},
  {frame_sql(TEAM_COLS, FULL, "ws", SZN)}
FROM ({TEAM_TOTALS}) {windows_sql("team_id", {"w3": 2, "w7": 6, "ws": None})}""", ["batter_box"])
def lagged_team(spark, d):
    from lagwell.operators.base_features import team_features
    return team_features(t.batter_box(spark, d)).drop("game_date")


def capped_sql(prefix="", suffix="", ip="ip_true"):
    def c(expr, top):
        return f"CASE WHEN {expr} > {top} THEN {top} ELSE {expr} END"
    safe = f"nullif({ip}, 0)"
    items = {"era" + suffix: (f"(er::DOUBLE / {safe} * 9)", 27), "whip" + suffix: (f"((h + bb)::DOUBLE / {safe})", 9),
             "k9" + suffix: (f"(k::DOUBLE / {safe} * 9)", 27), "bb9" + suffix: (f"(bb::DOUBLE / {safe} * 9)", 27),
             "hr9" + suffix: (f"(hr::DOUBLE / {safe} * 9)", 9), "k_per_ip": (f"(k::DOUBLE / {safe})", 3),
             "bb_per_ip": (f"(bb::DOUBLE / {safe})", 3), "hr_per_ip": (f"(hr::DOUBLE / {safe})", 1),
             "h_per_ip": (f"(h::DOUBLE / {safe})", 4), "er_per_ip": (f"(er::DOUBLE / {safe})", 3)}
    return ", ".join(f"{c(e, top)} AS {prefix}{n}" for n, (e, top) in items.items())


SP_COLS = {"era": "era_gm", "whip": "whip_gm", "k9": "k9_gm", "bb9": "bb9_gm", "hr9": "hr9_gm",
           **same("k_per_ip", "bb_per_ip", "hr_per_ip", "h_per_ip", "er_per_ip"), "ip": "ip_true"}
SP_GAMES = f"""
SELECT p.personId, p.team_id, p.gamepk, p.game_date, p.game_season, s.starter_name AS player_name, ip_true,
  {capped_sql(suffix="_gm")}
FROM pitcher_ip p JOIN starters s ON p.gamepk = s.gamepk AND p.team_id = s.team_id AND p.personId = s.starter_id
WHERE p.game_season <> 2020"""


@query("lagged_rates_capped", ["personId", "team_id", "gamepk", "player_name"], f"""
SELECT * EXCLUDE (game_date), count(*) OVER ws AS season_games_started,
  {frame_sql(SP_COLS, ("avg",), "w1", "last_game_{col}")},
  {", ".join(frame_sql(SP_COLS, ("avg", "std"), f"w{n}", f"rolling_{n}start_{{col}}_{{agg}}") for n in (3, 5, 10))},
  {frame_sql(SP_COLS, ("avg", "std"), "ws", SZN)}
FROM ({SP_GAMES}) {windows_sql("personId", {"w1": 1, "w3": 3, "w5": 5, "w10": 10, "ws": None})}""",
       ["pitcher_ip", "starters"])
def lagged_rates_capped(spark, d):
    from lagwell.operators.base_features import starter_features
    from lagwell.operators.pitches import starters
    return starter_features(t.pitcher_box(spark, d), starters(t.pitches_raw(spark, d))).drop("game_date")


BP_GAMES = f"""
SELECT team_id, gamepk, game_date, game_season, ip_true AS bp_ip_sum, h AS bp_h_sum, er AS bp_er_sum,
  bb AS bp_bb_sum, k AS bp_k_sum, hr AS bp_hr_sum, bp_pitchers, {capped_sql(prefix="bp_")}
FROM (SELECT team_id, gamepk, game_date, game_season, sum(ip_true) AS ip_true, sum(h) AS h, sum(er) AS er,
        sum(bb) AS bb, sum(k) AS k, sum(hr) AS hr, count(DISTINCT personId) AS bp_pitchers
      FROM pitcher_ip p WHERE game_season <> 2020 AND NOT EXISTS (
        SELECT 1 FROM starters s WHERE p.gamepk = s.gamepk AND p.team_id = s.team_id AND p.personId = s.starter_id)
      GROUP BY ALL)"""
BP_COLS = {f"bp_{c}": f"bp_{c}" for c in ("era", "whip", "k9", "bb9", "hr9", "k_per_ip", "bb_per_ip", "hr_per_ip",
                                          "h_per_ip", "er_per_ip")} | {"bp_ip": "bp_ip_sum", "bp_pitchers": "bp_pitchers"}


@query("bullpen_game_totals", ["team_id", "gamepk"], f"SELECT * EXCLUDE (game_date) FROM ({BP_GAMES})",
       ["pitcher_ip", "starters"])
def bullpen_game_totals(spark, d):
    from lagwell.operators.base_features import bullpen_games
    from lagwell.operators.pitches import starters
    return bullpen_games(t.pitcher_box(spark, d), starters(t.pitches_raw(spark, d))).drop("game_date")


@query("lagged_bullpen", ["team_id", "gamepk"], f"""
SELECT * EXCLUDE (game_date), {frame_sql(BP_COLS, ("avg",), "w1", "last_game_{col}")},
  {", ".join(frame_sql(BP_COLS, ("avg", "std"), f"w{n}", f"rolling_{n}game_{{col}}_{{agg}}") for n in (7, 14))},
  {frame_sql(BP_COLS, ("avg", "std"), "ws", SZN)}
FROM ({BP_GAMES}) {windows_sql("team_id", {"w1": 1, "w7": 7, "w14": 14, "ws": None})}""", ["pitcher_ip", "starters"])
def lagged_bullpen(spark, d):
    from lagwell.operators.base_features import bullpen_features
    from lagwell.operators.pitches import starters
    return bullpen_features(t.pitcher_box(spark, d), starters(t.pitches_raw(spark, d))).drop("game_date")


@query("lagged_count", ["o_orderkey"], f"""
SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey {PRIOR})
  AS season_orders_before, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
  ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS orders_in_last_10 FROM orders""")
def lagged_count(spark, d):
    o = t.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.year("o_orderdate").alias("season"))
    return lagged(o, "o_custkey", ["o_orderdate", "o_orderkey"], [
        Feature("season_orders_before", "rows", None, prior("season")),
        Feature("orders_in_last_10", "rows", None, last(10))]).select(
        "o_orderkey", "season_orders_before", "orders_in_last_10")


def roll_sql(cols, entity, window, src, agg="sum"):
    """Rolled columns in the two window modes; season mode blanks after a missing value."""
    if window == "season":
        w = f"(PARTITION BY {entity}, game_season ORDER BY game_date, gamepk"
        items = [f"CASE WHEN lag({c}) OVER {w}) IS NOT NULL THEN {agg}({c}) OVER {w} {PRIOR}) END AS {c}" for c in cols]
    else:
        w = f"(PARTITION BY {entity} ORDER BY game_date, gamepk ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)"
        items = [f"{agg}({c}) OVER {w} AS {c}" for c in cols]
    return ", ".join(items)


NULLED = "(SELECT gamepk, personId, game_date, game_season, nullif(h, 2) AS h, nullif(ab, 1) AS ab FROM batter_box)"


def _nulled(spark, d):
    return t.batter_box(spark, d).select("gamepk", "personId", "game_date", "game_season",
                                         F.expr("nullif(h, 2)").alias("h"), F.expr("nullif(ab, 1)").alias("ab"))


def _register_rolls():
    from lagwell.operators.rolling import roll
    for name, window, agg in (("rolling_sum_n", 5, "sum"), ("rolling_sum_season", "season", "sum"),
                              ("rolling_max", 5, "max"), ("rolling_max_season", "season", "max")):
        def fn(spark, d, window=window, agg=agg):
            r = roll(_nulled(spark, d), "personId", window, **{"sums" if agg == "sum" else "maxes": ["h", "ab"]})
            return r.drop("game_date")
        query(name, ["gamepk", "personId"], f"""
SELECT gamepk, personId, game_season, {roll_sql(["h", "ab"], "personId", window, None, agg)} FROM {NULLED}""",
              ["batter_box"])(fn)


_register_rolls()


def std_sql(n, s, q):
    """Deviation from sums of integers, which are exact; NULL where the count makes it negative."""
    top = f"({q}::HUGEINT * {n} - {s}::HUGEINT * {s})"
    return f"CASE WHEN {n} > 1 AND {top} >= 0 THEN sqrt({top}::DOUBLE / ({n}::DOUBLE * ({n} - 1))) END"


def raw_std_sql(cols, entity, window, where="true"):
    """Deviations of all pitches thrown in the earlier games of the window, straight from the pitches: one row per game."""
    season = window == "season"
    part = f"{entity}, game_season" if season else entity
    frame = f"RANGE BETWEEN {'UNBOUNDED' if season else window} PRECEDING AND 1 PRECEDING"
    return f"""SELECT {entity}, gamepk, {", ".join(f"any_value(s_{x}) AS s_{x}" for x in cols)} FROM (
  SELECT {entity}, gamepk, {", ".join(f"stddev_samp({x}) OVER (PARTITION BY {part} ORDER BY gi {frame}) AS s_{x}" for x in cols)}
  FROM (SELECT *, dense_rank() OVER (PARTITION BY {part} ORDER BY game_date, gamepk) AS gi FROM pbp WHERE {where})) GROUP BY ALL"""


@query("pooled_std", ["pitcher_id", "gamepk"], f"""
SELECT g.pitcher_id, g.gamepk, game_season, n, s, r.s_start_speed AS speed_std, t.s_start_speed AS season_speed_std FROM (
  SELECT pitcher_id, gamepk, game_season, {roll_sql(["n", "s"], "pitcher_id", 10, None)} FROM (
    SELECT pitcher_id, gamepk, game_date, game_season, count(start_speed) AS n, coalesce(sum(start_speed), 0) AS s
    FROM pbp GROUP BY ALL)) g
JOIN ({raw_std_sql(["start_speed"], "pitcher_id", 10)}) r ON g.pitcher_id = r.pitcher_id AND g.gamepk = r.gamepk
JOIN ({raw_std_sql(["start_speed"], "pitcher_id", "season")}) t ON g.pitcher_id = t.pitcher_id AND g.gamepk = t.gamepk""", ["pbp"])
def pooled(spark, d):
    from lagwell.operators.rolling import roll
    from lagwell.plans.frames import deviation_sql, moments_sql
    g = t.pitches(spark, d).groupBy("pitcher_id", "gamepk", "game_date", "game_season").agg(
        F.expr("count(start_speed)").alias("n"), F.expr("coalesce(sum(start_speed), 0D)").alias("s"),
        F.expr(moments_sql("start_speed")).alias("w"), F.expr(moments_sql("start_speed")).alias("z"))
    r = roll(g, "pitcher_id", 10, ["n", "s"], states=["w"])
    z = roll(g, "pitcher_id", "season", states=["z"]).select("pitcher_id", "gamepk", "z")
    return r.drop("z").join(z, ["pitcher_id", "gamepk"]).selectExpr(
        "pitcher_id", "gamepk", "game_season", "n", "s", f"{deviation_sql('w')} AS speed_std", f"{deviation_sql('z')} AS season_speed_std")


BOX_STATS = ["h", "k", "bb", "hr", "ab", "plate_appearances", "total_bases_from_h"]


def _batter_box_roll(window, p):
    return f"""
SELECT personId, gamepk, game_season, {", ".join(f"{c} AS {p}{c}" for c in BOX_STATS)},
  h::DOUBLE / nullif(ab, 0) AS {p}ba, total_bases_from_h::DOUBLE / nullif(ab, 0) AS {p}slg,
  total_bases_from_h::DOUBLE / nullif(ab, 0) - h::DOUBLE / nullif(ab, 0) AS {p}iso,
  (h - hr)::DOUBLE / nullif(ab - k - hr, 0) AS {p}babip
FROM (SELECT personId, gamepk, game_season, {roll_sql(BOX_STATS, "personId", window, None)} FROM batter_box)"""


@query("rolling_rate_finalize", ["personId", "gamepk"], _batter_box_roll("season", "batter_roll_season_"), ["batter_box"])
def rolling_rate_finalize(spark, d):
    from lagwell.operators.rolling import batter_box_rolling
    return batter_box_rolling(t.batter_box(spark, d), "season").drop("game_date")


@query("rolling_box", ["personId", "gamepk"], _batter_box_roll(10, "batter_roll_last10g_"), ["batter_box"])
def rolling_box(spark, d):
    from lagwell.operators.rolling import batter_box_rolling
    return batter_box_rolling(t.batter_box(spark, d), 10).drop("game_date")


PIT_STATS = ["h", "r", "er", "bb", "hr", "k", "p", "s", "ip"]


def _pitcher_box_roll(window, p, entity, src, role):
    return f"""
SELECT {entity} AS pitcher_key_id, gamepk, game_season, '{role}' AS pitcher_role,
  {", ".join(f"{c} AS {p}{c}" for c in PIT_STATS)}, (bb + h)::DOUBLE / nullif(ip, 0) AS {p}whip,
  k::DOUBLE / nullif(ip, 0) AS {p}k_rate, bb::DOUBLE / nullif(ip, 0) AS {p}bb_rate,
  s::DOUBLE / nullif(p, 0) AS {p}strike_rate, hr::DOUBLE / nullif(ip, 0) AS {p}hr_rate
FROM (SELECT {entity}, gamepk, game_season, {roll_sql(PIT_STATS, entity, window, None)} FROM {src})"""


TAGGED = """(SELECT b.* EXCLUDE (ip, ip_true), b.ip_true AS ip, r.pitcher_role FROM pitcher_ip b
  LEFT JOIN roles r ON b.gamepk = r.gamepk AND b.personId = r.personId)"""
SP_LINES = f"(SELECT * FROM {TAGGED} WHERE pitcher_role = 'sp')"
BP_TEAM = f"""(SELECT team_id, gamepk, game_date, game_season, {", ".join(f"sum({c}) AS {c}" for c in PIT_STATS)}
  FROM {TAGGED} WHERE pitcher_role = 'bullpen' GROUP BY ALL)"""


def _pbox(spark, d):
    from lagwell.functions.text import innings
    return t.pitcher_box(spark, d).withColumn("ip", innings("ip", "raise"))


@query("rolling_role_collapsed", ["pitcher_key_id", "gamepk", "pitcher_role"],
       _pitcher_box_roll("season", "pitcher_roll_season_", "personId", SP_LINES, "sp") + " UNION ALL "
       + _pitcher_box_roll("season", "pitcher_roll_season_", "team_id", BP_TEAM, "bullpen"), ["pitcher_ip", "roles"])
def rolling_role_collapsed(spark, d):
    from lagwell.operators.pitches import pitcher_role
    from lagwell.operators.rolling import pitcher_box_rolling_roles
    from lagwell.operators.season import tag_roles
    return pitcher_box_rolling_roles(tag_roles(_pbox(spark, d), pitcher_role(t.pitches_raw(spark, d))), "season").drop("game_date")
