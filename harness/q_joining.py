"""Join operators on game, season and time keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness import tables as t
from harness.registry import query
from lagwell.operators import joins as J
from lagwell.operators import pitches as PT


@query("join_inner_composite", ["gamepk", "team_id", "personId", "starter_name"], """
SELECT p.gamepk, p.team_id, p.personId, s.starter_name, k, bb, p FROM pitcher_box p JOIN starters s
ON p.gamepk = s.gamepk AND p.team_id = s.team_id AND p.personId = s.starter_id""", ["pitcher_box", "starters"])
def join_inner_composite(spark, d):
    s = PT.starters(t.pitches_raw(spark, d)).withColumnRenamed("starter_id", "personId")
    return t.pitcher_box(spark, d).join(s, ["gamepk", "team_id", "personId"]).select(
        "gamepk", "team_id", "personId", "starter_name", "k", "bb", "p")


@query("join_left_indicator_role", ["pitcher_role", "pitcher_team_id"], """
SELECT pitcher_role, pitcher_team_id, count(*) AS n FROM pbp GROUP BY ALL""", ["pbp"])
def join_left_indicator_role(spark, d):
    p = t.pitches_raw(spark, d)
    s = PT.starters(p, "play").withColumnsRenamed({"team_id": "pitcher_team_id", "starter_id": "pitcher_id"})
    r = J.indicator(p, s, ["gamepk", "pitcher_team_id", "pitcher_id"], "pitcher_role", "sp", "bullpen")
    return r.groupBy("pitcher_role", "pitcher_team_id").agg(F.count(F.lit(1)).alias("n"))


@query("join_anti_reliever", ["gamepk", "team_id", "personId"], """
SELECT gamepk, team_id, personId, k, p FROM pitcher_box b WHERE NOT EXISTS (SELECT 1 FROM starters s
WHERE b.gamepk = s.gamepk AND b.team_id = s.team_id AND b.personId = s.starter_id)""", ["pitcher_box", "starters"])
def join_anti_reliever(spark, d):
    s = PT.starters(t.pitches_raw(spark, d)).withColumnRenamed("starter_id", "personId")
    return t.pitcher_box(spark, d).join(s, ["gamepk", "team_id", "personId"], "left_anti").select(
        "gamepk", "team_id", "personId", "k", "p")


@query("join_semi_pair", ["gamepk", "play_id", "pitcher_id"], """
SELECT gamepk, play_id, pitcher_id, event_index FROM raw WHERE (gamepk, pitcher_id) IN (SELECT (gamepk, starter_id) FROM starters)""",
       ["raw", "starters"])
def join_semi_pair(spark, d):
    p = t.pitches_raw(spark, d)
    s = PT.starters(p).select("gamepk", F.col("starter_id").alias("pitcher_id"))
    return p.join(s, ["gamepk", "pitcher_id"], "left_semi").select("gamepk", "play_id", "pitcher_id", "event_index")


@query("join_full_platoon", ["personId", "missing_side"], """
SELECT coalesce(l.personId, r.personId) AS personId, l.n AS n_left, r.n AS n_right,
  CASE WHEN l.n IS NULL THEN 'L' WHEN r.n IS NULL THEN 'R' ELSE 'none' END AS missing_side
FROM (SELECT batter_id AS personId, count(*) AS n FROM pbp WHERE pitcher_throw_hand = 'L' GROUP BY ALL) l
FULL JOIN (SELECT batter_id AS personId, count(*) AS n FROM pbp WHERE pitcher_throw_hand = 'R' GROUP BY ALL) r
ON l.personId = r.personId""", ["pbp"])
def join_full_platoon(spark, d):
    p = t.pitches(spark, d)
    side = lambda h, n: p.filter(F.col("pitcher_throw_hand") == h).groupBy(F.col("batter_id").alias("personId")).agg(
        F.count(F.lit(1)).alias(n))
    j = side("L", "n_left").join(side("R", "n_right"), "personId", "full")
    return j.withColumn("missing_side", F.when(F.col("n_left").isNull(), "L").when(F.col("n_right").isNull(), "R").otherwise("none"))


OPP = ["r", "h", "hr", "bb", "k"]
TB = "(SELECT team_id, gamepk, sum(r) AS r, sum(h) AS h, sum(hr) AS hr, sum(bb) AS bb, sum(k) AS k FROM batter_box GROUP BY ALL)"


@query("join_opponent_theta", ["gamepk", "team_id", "opp_team_id"], f"""
SELECT a.*, b.team_id AS opp_team_id, {", ".join(f"b.{c} AS opp_{c}" for c in OPP)},
  pow(a.r, 1.83) / nullif(pow(a.r, 1.83) + pow(b.r, 1.83), 0) AS pyth_exp
FROM {TB} a JOIN {TB} b ON a.gamepk = b.gamepk AND a.team_id <> b.team_id""", ["batter_box"])
def join_opponent_theta(spark, d):
    g = t.batter_box(spark, d).groupBy("team_id", "gamepk").agg(*[F.sum(c).alias(c) for c in OPP])
    return J.with_pythagorean(J.opponent(g, "gamepk", "team_id", OPP))


SEASON = """(SELECT o_custkey, year(o_orderdate) AS season, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total
  FROM orders GROUP BY ALL)"""


def _season(spark, d):
    return t.read(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("game_season")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))


@query("join_season_lag", [], f"""
SELECT s.o_custkey, s.season AS game_season, s.n, s.total, a.n AS s1_n, a.total AS s1_total, b.n AS s2_n, b.total AS s2_total
FROM {SEASON} s LEFT JOIN {SEASON} a ON s.o_custkey = a.o_custkey AND s.season = a.season + 1
LEFT JOIN {SEASON} b ON s.o_custkey = b.o_custkey AND s.season = b.season + 2""")
def join_season_lag(spark, d):
    s = _season(spark, d)
    return J.season_lag(J.season_lag(s, s, ["o_custkey"], 1, prefix="s1_"), s, ["o_custkey"], 2, prefix="s2_")


# seasons 1997 and 1999 are withheld from the lookup, so the latest one before bridges a gap
GAP = f"(SELECT * FROM {SEASON} WHERE season NOT IN (1997, 1999))"


@query("join_asof_season", [], f"""
SELECT s.o_custkey, s.season AS game_season, g.n AS last_n, g.total AS last_total FROM {SEASON} s
LEFT JOIN (SELECT s.season, max(g.season) AS src FROM (SELECT DISTINCT season FROM {SEASON}) s
  JOIN (SELECT DISTINCT season FROM {GAP}) g ON g.season < s.season GROUP BY ALL) m ON s.season = m.season
LEFT JOIN {GAP} g ON g.o_custkey = s.o_custkey AND g.season = m.src""")
def join_asof_season(spark, d):
    s = _season(spark, d)
    look = s.filter("game_season not in (1997, 1999)").select("o_custkey", "game_season", F.col("n").alias("last_n"),
                                                             F.col("total").alias("last_total"))
    return J.asof_season(s, look, ["o_custkey"]).select("o_custkey", "game_season", "last_n", "last_total")


@query("join_asof_season_entity", [], f"""
SELECT s.o_custkey, s.season AS game_season, g.n AS last_n, g.total AS last_total
FROM {SEASON} s ASOF LEFT JOIN {GAP} g ON s.o_custkey = g.o_custkey AND s.season > g.season""")
def join_asof_season_entity(spark, d):
    s = _season(spark, d)
    look = s.filter("game_season not in (1997, 1999)").select("o_custkey", "game_season", F.col("n").alias("last_n"),
                                                             F.col("total").alias("last_total"))
    return J.asof_season(s, look, ["o_custkey"], per_entity=True).select("o_custkey", "game_season", "last_n", "last_total")


@query("join_asof_ttl", [], """
SELECT e.user_id, e.event_id, CASE WHEN e.ts - f.ts <= INTERVAL 7 DAY THEN f.value END AS value,
  CASE WHEN e.ts - f.ts <= INTERVAL 7 DAY THEN f.feature_id END AS feature_id
FROM (SELECT * FROM events WHERE event_type <> 'purchase') e
ASOF LEFT JOIN (SELECT user_id, ts, value, event_id AS feature_id FROM events WHERE event_type = 'purchase') f
ON e.user_id = f.user_id AND e.ts >= f.ts""")
def join_asof_ttl(spark, d):
    e = t.read(spark, d, "events")
    f = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("fts"), "value", F.col("event_id").alias("feature_id"))
    r = J.asof_latest(e.filter("event_type <> 'purchase'"), f, ["user_id"], "ts", "fts", ["value", "feature_id"],
                      "event_id", 7 * 86400)
    return r.select("user_id", "event_id", "value", "feature_id")


@query("join_dual_role", ["gamepk", "batter_team_id", "pitcher_team_id"], """
SELECT r.gamepk, r.batter_team_id, r.pitcher_team_id, r.n, a.h AS opp_h, a.k AS opp_k, b.h AS own_h, b.k AS own_k
FROM (SELECT gamepk, batter_team_id, pitcher_team_id, count(*) AS n FROM raw GROUP BY ALL) r
LEFT JOIN (SELECT team_id, gamepk, sum(h) AS h, sum(k) AS k FROM batter_box GROUP BY ALL) a
  ON r.gamepk = a.gamepk AND r.batter_team_id = a.team_id
LEFT JOIN (SELECT team_id, gamepk, sum(h) AS h, sum(k) AS k FROM batter_box GROUP BY ALL) b
  ON r.gamepk = b.gamepk AND r.pitcher_team_id = b.team_id""", ["raw", "batter_box"])
def join_dual_role(spark, d):
    p = t.pitches_raw(spark, d).groupBy("gamepk", "batter_team_id", "pitcher_team_id").agg(F.count(F.lit(1)).alias("n"))
    g = t.batter_box(spark, d).groupBy("team_id", "gamepk").agg(F.sum("h").alias("h"), F.sum("k").alias("k"))
    for role, tag in (("batter_team_id", "opp_"), ("pitcher_team_id", "own_")):
        p = p.join(g.select("gamepk", F.col("team_id").alias(role), F.col("h").alias(tag + "h"), F.col("k").alias(tag + "k")),
                   ["gamepk", role], "left")
    return p


@query("join_exists_flag", ["gamepk", "has_odds"], """
SELECT s.gamepk, EXISTS (SELECT 1 FROM sched o WHERE o.game_type = 'S' AND o.home_id = s.home_id
  AND o.away_id = s.away_id) AS has_odds FROM sched s""", ["sched"], exact=True)
def join_exists_flag(spark, d):
    from lagwell.operators.clean import earliest_schedule
    s = earliest_schedule(t.schedule_raw(spark, d), tie="schedule_row")
    odds = s.filter("game_type = 'S'").select(F.col("home_id").alias("home_team"), F.col("away_id").alias("away_team"))
    return J.exists_flag(s, odds, {"home_id": "home_team", "away_id": "away_team"}, "has_odds")


@query("join_role_key", ["pitcher_key_id", "pitcher_role", "pitcher_throw_hand"], """
SELECT CASE WHEN pitcher_role = 'sp' THEN pitcher_id ELSE pitcher_team_id END AS pitcher_key_id, pitcher_role,
  CASE WHEN pitcher_role = 'sp' THEN pitcher_throw_hand END AS pitcher_throw_hand, count(*) AS n FROM pbp GROUP BY ALL""", ["pbp"])
def join_role_key(spark, d):
    return J.role_key(t.pitches(spark, d)).groupBy("pitcher_key_id", "pitcher_role", "pitcher_throw_hand").agg(
        F.count(F.lit(1)).alias("n"))


@query("fanout_guard", ["gamepk"], "SELECT gamepk, count(*) AS rows FROM sched_raw GROUP BY ALL HAVING count(*) > 1", ["sched_raw"])
def fanout_guard(spark, d):
    return J.duplicate_keys(t.schedule_raw(spark, d), ["gamepk"])


@query("unique_lookup", ["gamepk", "venue_id"], """
SELECT r.gamepk, s.venue_id, count(*) AS n FROM raw r LEFT JOIN sched s ON r.gamepk = s.gamepk GROUP BY ALL""", ["raw", "sched"])
def unique_lookup(spark, d):
    from lagwell.operators.clean import earliest_schedule
    s = earliest_schedule(t.schedule_raw(spark, d), tie="schedule_row").select("gamepk", "venue_id")
    return J.unique_lookup(t.pitches_raw(spark, d), s, ["gamepk"]).groupBy("gamepk", "venue_id").agg(F.count(F.lit(1)).alias("n"))


@query("join_scalar_cross", [], """
SELECT o_orderkey, o_totalprice - m AS over_mean FROM orders, (SELECT avg(o_totalprice) AS m FROM orders)""")
def join_scalar_cross(spark, d):
    from lagwell.plans.scale import one_row
    o = t.read(spark, d, "orders")
    m = o.agg(F.avg("o_totalprice").alias("m"))
    return o.crossJoin(one_row(m)).select("o_orderkey", (F.col("o_totalprice") - F.col("m")).alias("over_mean"))
