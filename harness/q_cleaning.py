"""Cleaning rules over the raw tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness import tables as t
from harness.registry import query
from lagwell.functions import text as X
from lagwell.operators import clean as C


@query("conform_cast", ["o_orderpriority", "team_id", "missing_col"], """
SELECT CAST(o_orderkey AS VARCHAR) AS team_id, CAST(o_orderkey AS INTEGER) AS ab,
  TRY_CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) AS h, CAST(o_totalprice AS FLOAT) AS fp, o_orderpriority,
  CAST(NULL AS VARCHAR) AS missing_col FROM orders""")
def conform_cast(spark, d):
    from lagwell.sources.schemas import conform
    o = t.read(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("teamId"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")).alias("ab"),
        F.split("o_orderpriority", "-")[0].alias("h"), F.col("o_totalprice").alias("fp"), "o_orderpriority")
    return conform(o, "team_id string, ab int, h int, fp float, o_orderpriority string, missing_col string")


@query("season_filter", ["gamepk", "game_type"], """
SELECT gamepk, game_type, game_season FROM games WHERE game_type IN ('R','F','D','L','W') AND game_season NOT IN (2000, 2001)""", ["games"])
def season_filter(spark, d):
    return C.drop_seasons(C.regular_games(t._games(spark, d)), 2000, 2001).select("gamepk", "game_type", "game_season")


@query("text_extract", ["gamepk", "weather_condition", "weather_wind_direction"], r"""
SELECT gamepk, info_row, weather_condition, CAST(nullif(regexp_extract(weather_temp, '(\d+)', 1), '') AS DOUBLE) AS weather_temp,
  CAST(nullif(regexp_extract(split_part(weather_wind, ',', 1), '(\d+)', 1), '') AS DOUBLE) AS weather_wind_speed,
  CASE WHEN contains(weather_wind, ',') THEN split_part(weather_wind, ',', 2) END AS weather_wind_direction FROM info""", ["info"])
def text_extract(spark, d):
    return C.weather(t.game_info(spark, d)).drop("game_season")


@query("height_style_parse", ["person_id"], r"""
SELECT person_id, CAST(regexp_extract(height, '(\d+)''', 1) AS INTEGER) * 12
  + CAST(regexp_extract(height, ''' (\d+)"', 1) AS INTEGER) AS height_in_inches FROM players""", ["players"])
def height_style_parse(spark, d):
    return t.players(spark, d).select("person_id", X.height_inches("height").alias("height_in_inches"))


@query("earliest_per_key", ["gamepk", "game_type", "venue_id", "day"], """
SELECT gamepk, game_type, venue_id, strftime(game_date, '%Y-%m-%d') AS day, schedule_row FROM sched""", ["sched"])
def earliest_per_key(spark, d):
    return C.earliest_schedule(t.schedule_raw(spark, d), tie="schedule_row").select(
        "gamepk", "game_type", "venue_id", F.date_format("game_date", "yyyy-MM-dd").alias("day"), "schedule_row")


@query("ip_notation", ["gamepk", "personId"], "SELECT gamepk, personId, ip, ip_true FROM pitcher_ip", ["pitcher_ip"])
def ip_notation(spark, d):
    return C.decimal_innings(t.pitcher_box(spark, d), "raise").select("gamepk", "personId", "ip", "ip_true")


@query("clip_caps", ["gamepk", "personId"], """
SELECT gamepk, personId, CASE WHEN era > 27 THEN 27 ELSE era END AS era_gm, CASE WHEN whip > 9 THEN 9 ELSE whip END AS whip_gm,
  CASE WHEN hr > 1 THEN 1 ELSE hr END AS hr_per_ip
FROM (SELECT gamepk, personId, er::DOUBLE / nullif(ip_true, 0) * 9 AS era, (h + bb)::DOUBLE / nullif(ip_true, 0) AS whip,
  hr::DOUBLE / nullif(ip_true, 0) AS hr FROM pitcher_ip)""", ["pitcher_ip"])
def clip_caps(spark, d):
    return C.capped_rates(C.decimal_innings(t.pitcher_box(spark, d)), suffix="_gm").select(
        "gamepk", "personId", "era_gm", "whip_gm", "hr_per_ip")


@query("small_sample_null", ["gamepk", "pitcher_id"], """
SELECT gamepk, pitcher_id, n, CASE WHEN n >= 2 THEN v END AS exit_velo FROM (
  SELECT gamepk, pitcher_id, count(*) FILTER (is_in_play) AS n, avg(launch_speed) FILTER (is_in_play) AS v FROM raw GROUP BY ALL)""", ["raw"])
def small_sample_null(spark, d):
    g = t.pitches_raw(spark, d).groupBy("gamepk", "pitcher_id").agg(
        F.expr("count_if(is_in_play)").alias("n"), F.expr("avg(case when is_in_play then launch_speed end)").alias("v"))
    return g.select("gamepk", "pitcher_id", "n", F.when(F.col("n") >= 2, F.col("v")).alias("exit_velo"))


PARK = "CASE venue_id WHEN '1' THEN 103 WHEN '3' THEN 96 WHEN '4' THEN 102 WHEN '5' THEN 100 WHEN '7' THEN 98 WHEN '10' THEN 97 " \
       "WHEN '12' THEN 103 WHEN '14' THEN 101 WHEN '15' THEN 97 WHEN '17' THEN 102 WHEN '19' THEN 98 WHEN '20' THEN 100 " \
       "WHEN '21' THEN 96 WHEN '22' THEN 102 WHEN '28' THEN 97 WHEN '31' THEN 100 WHEN '32' THEN 97 WHEN '34' THEN 100 " \
       "WHEN '36' THEN 98 ELSE 100 END"


@query("map_lookup_default", ["gamepk", "venue_id"], f"""
SELECT gamepk, venue_id, {PARK} AS park_factor, CASE WHEN game_date >= TIMESTAMP '2023-03-30' THEN 1 ELSE 0 END AS post_shift_ban
FROM sched""", ["sched"])
def map_lookup_default(spark, d):
    s = C.earliest_schedule(t.schedule_raw(spark, d), tie="schedule_row")
    return C.rule_era(C.park_factor(s)).select("gamepk", "venue_id", "park_factor", "post_shift_ban")


@query("batting_order", ["gamepk", "batter_id"], """
SELECT gamepk, personId AS batter_id, CAST(batting_order AS INTEGER) AS batting_order FROM batter_box
WHERE batting_order IS NOT NULL""", ["batter_box"])
def batting_order(spark, d):
    return C.batting_order(t.batter_box(spark, d))


@query("lineup_slots", ["gamepk", "personId"], """
SELECT gamepk, personId, CAST(batting_order AS INTEGER) % 100 AS batting_slot FROM batter_box""", ["batter_box"])
def lineup_slots(spark, d):
    return C.lineup_slots(t.batter_box(spark, d)).select("gamepk", "personId", "batting_slot")


@query("boxscore_totals", ["gamepk", "personId"], """
SELECT gamepk, personId, h - doubles - triples - hr AS singles, h + doubles + 2 * triples + 3 * hr AS total_bases_from_h
FROM batter_box""", ["batter_box"])
def boxscore_totals(spark, d):
    return C.boxscore_totals(t.batter_box(spark, d)).select("gamepk", "personId", "singles", "total_bases_from_h")


@query("finite_values", [], """
SELECT l_orderkey, count(*) AS n, count(x) AS finite, sum(x) AS total FROM (
  SELECT l_orderkey, CASE WHEN l_discount = 0 OR l_tax = 0 THEN NULL ELSE round(l_tax * 100) / round(l_discount * 100) END AS x FROM lineitem) GROUP BY ALL""")
def finite_values(spark, d):
    # the ratio is written so that zero discounts give NaN and zero taxes give infinity
    x = t.read(spark, d, "lineitem").select("l_orderkey", F.expr(
        "case when l_discount = 0 then double('NaN') when l_tax = 0 then double('Infinity') "
        "else round(l_tax * 100) / round(l_discount * 100) end").alias("x"))
    return C.finite(x, ["x"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("finite"),
                                                        F.sum("x").alias("total"))


@query("pa_outcome_table", ["gamepk", "batter_id", "pitcher_role", "weather_condition"], r"""
SELECT p.gamepk, p.batter_id, p.pitcher_role, i.weather_condition, count(*) AS n, sum(is_hit) AS hits, max(i.weather_temp) AS weather_temp,
  max(b.batting_order) AS batting_order, max(i.game_season) AS game_season
FROM (SELECT DISTINCT gamepk, batter_team_id, play_id, pitcher_id, pitcher_name, batter_id, batter_name, is_hit, pitcher_throw_hand,
        batter_bat_side, pitcher_role, pitcher_team_id FROM pbp) p
LEFT JOIN (SELECT gamepk, game_season, weather_condition, weather_temp FROM (
    SELECT *, row_number() OVER (PARTITION BY gamepk ORDER BY game_season, weather_condition NULLS FIRST, weather_temp NULLS FIRST) AS rn
    FROM (SELECT gamepk, game_season, weather_condition, CAST(nullif(regexp_extract(weather_temp, '(\d+)', 1), '') AS DOUBLE) AS weather_temp
          FROM info)) WHERE rn = 1) i ON p.gamepk = i.gamepk
JOIN (SELECT gamepk, personId, CAST(batting_order AS INTEGER) AS batting_order FROM batter_box WHERE batting_order IS NOT NULL) b
  ON p.gamepk = b.gamepk AND p.batter_id = b.personId
GROUP BY ALL""", ["pbp", "info", "batter_box"])
def pa_outcome_table(spark, d):
    from lagwell.operators.model_frame import pa_outcomes
    o = pa_outcomes(t.pitches(spark, d), t.batter_box(spark, d), C.weather(t.game_info(spark, d)),
                    C.earliest_schedule(t.schedule_raw(spark, d), tie="schedule_row"))
    return o.groupBy("gamepk", "batter_id", "pitcher_role", "weather_condition").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_hit").alias("hits"), F.max("weather_temp").alias("weather_temp"),
        F.max("batting_order").alias("batting_order"), F.max("game_season").alias("game_season"))


@query("contract_violations", ["check", "subject", "ok", "detail"], """
SELECT 'type' AS "check", 'l_orderkey' AS subject, false AS ok, 'bigint' AS detail
UNION ALL SELECT 'column', 'l_comment', false, 'absent'
UNION ALL SELECT 'null_rate', 'l_discount', false, CAST(round(avg((nullif(l_discount, 0) IS NULL)::INT), 6) AS VARCHAR) FROM lineitem
UNION ALL SELECT 'date', 'l_shipdate', false, CAST(count(*) AS VARCHAR) FROM lineitem WHERE CAST(l_shipdate AS DATE) <> DATE '1998-01-01'""",
       exact=True)
def contract_violations(spark, d):
    from lagwell.operators.checks import contract, violations
    l = t.read(spark, d, "lineitem").withColumn("l_discount", F.expr("nullif(l_discount, 0)"))
    return violations(contract(l, {"l_orderkey": "string", "l_comment": "string", "l_tax": "double"}, ["l_orderkey"],
                               {"l_discount": 0.01, "l_tax": 0.5}, ("l_shipdate", "1998-01-01")))


@query("completeness_gaps", ["table_name", "gamepk"], """
SELECT 'first_role' AS table_name, gamepk FROM (SELECT gamepk FROM sched EXCEPT SELECT gamepk FROM raw WHERE event_type = 'triple')
UNION ALL SELECT 'pitches', gamepk FROM (SELECT gamepk FROM sched EXCEPT SELECT gamepk FROM raw)""", ["sched", "raw"], exact=True)
def completeness_gaps(spark, d):
    from lagwell.operators.checks import completeness
    p = t.pitches_raw(spark, d)
    return completeness(t.schedule_raw(spark, d), {"first_role": p.filter("event_type = 'triple'"), "pitches": p})


@query("games_processed", ["table_name"], """
SELECT 'pitches' AS table_name, count(DISTINCT gamepk) AS games FROM raw UNION ALL SELECT 'schedule', count(DISTINCT gamepk) FROM sched_raw""",
       ["raw", "sched_raw"])
def games_processed(spark, d):
    from lagwell.operators.checks import games_processed as g
    return g({"pitches": t.pitches_raw(spark, d), "schedule": t.schedule_raw(spark, d)})


@query("team_oaa_season", ["team_id"], """
SELECT concat('t', s_nationkey) AS team_id, year(l_shipdate) AS game_season, sum(CAST(l_quantity AS BIGINT) - 25) AS team_oaa_season
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""")
def team_oaa_season(spark, d):
    from lagwell.operators.starter_pa import team_oaa
    x = t.read(spark, d, "lineitem").join(t.read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return team_oaa(x.selectExpr("concat('t', s_nationkey) as team_id", "year(l_shipdate) as game_season",
                                 "cast(l_quantity as bigint) - 25 as outs_above_average"))


@query("classic_slates", ["kind"], """
SELECT kind, count(*) AS n, sum(id) AS total FROM (
  SELECT 'contest' AS kind, c_custkey AS id FROM customer WHERE 20 + c_nationkey = 28
  UNION ALL SELECT 'game', o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 8)
  UNION ALL SELECT 'player', l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (
    SELECT c_custkey FROM customer WHERE c_nationkey = 8))) GROUP BY ALL""")
def classic_slates(spark, d):
    contests = t.read(spark, d, "customer").selectExpr("c_custkey as draft_group_id", "20 + c_nationkey as contest_type")
    orders = t.read(spark, d, "orders").selectExpr("o_custkey as draft_group_id", "o_orderkey as competition_id")
    people = t.read(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("competition_id")).select(
        "draft_group_id", "competition_id", "l_suppkey")
    c, g, p = C.classic_slates(contests, orders, people)
    row = lambda df, kind, key: df.agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("total")).withColumn("kind", F.lit(kind))
    return row(c, "contest", "draft_group_id").unionByName(row(g, "game", "competition_id")).unionByName(row(p, "player", "l_suppkey"))
