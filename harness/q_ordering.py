"""Ordered operators at pitch and appearance grain, sequences and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness import tables as t
from harness.registry import query
from lagwell.operators import pitches as PT
from lagwell.operators import sequence as Q
from lagwell.plans.frames import Feature, lagged, prior, totals


@query("last_pitch", ["gamepk", "play_id", "pitcher_id"], """
SELECT gamepk, play_id, pitcher_id, pitch_number, event_index FROM pbp WHERE is_last_pitch""", ["pbp"])
def last_pitch(spark, d):
    p = totals(t.pitches_raw(spark, d), ["gamepk", "play_id"], {"_m": F.max("pitch_number")})
    return p.filter("pitch_number = _m").select("gamepk", "play_id", "pitcher_id", "pitch_number", "event_index")


@query("first_row_starter", ["gamepk", "team_id", "starter_id", "starter_name"], "SELECT * FROM starters", ["starters"], exact=True)
def first_row_starter(spark, d):
    return PT.starters(t.pitches_raw(spark, d))


@query("starter_by_innings", ["gamepk", "team_id", "starter_id"], """
SELECT gamepk, team_id, personId AS starter_id FROM (SELECT *, row_number() OVER (PARTITION BY gamepk, team_id
  ORDER BY ip_true DESC, personId DESC) AS rn FROM pitcher_ip) WHERE rn = 1""", ["pitcher_ip"], exact=True)
def starter_by_innings(spark, d):
    from lagwell.operators.clean import decimal_innings
    return PT.starters(decimal_innings(t.pitcher_box(spark, d)), "innings_pitched")


@query("lag_state", ["gamepk", "play_id", "count_state"], """
SELECT gamepk, play_id, event_index, count_balls, count_strikes, count_state FROM pbp""", ["pbp"])
def lag_state(spark, d):
    p = t.pitches_raw(spark, d).select("gamepk", "play_id", "event_index", "pitch_number", "count_balls", "count_strikes")
    return PT.pitch_state(p).select("gamepk", "play_id", "event_index", "count_balls", "count_strikes", "count_state")


@query("lag_state_zero_fill", ["gamepk", "play_id"], """
SELECT gamepk, play_id, event_index, coalesce(lag(post_balls) OVER w, 0) AS pre_count_balls,
  coalesce(lag(post_strikes) OVER w, 0) AS pre_count_strikes FROM raw WINDOW w AS (PARTITION BY gamepk, play_id ORDER BY event_index)""", ["raw"])
def lag_state_zero_fill(spark, d):
    return PT.lag_or_zero(t.pitches_raw(spark, d)).select("gamepk", "play_id", "event_index", "pre_count_balls", "pre_count_strikes")


@query("appearance_numbers", ["gamepk", "batter_id"], "SELECT * FROM pa_numbers", ["pa_numbers"])
def appearance_numbers(spark, d):
    p = t.pitches_raw(spark, d).select("gamepk", "play_id", "batter_id")
    return PT.appearance_number(p).distinct()


@query("group_mean", [], """
SELECT o_orderkey, avg(o_totalprice) OVER (PARTITION BY year(o_orderdate)) AS season_mean FROM orders""")
def group_mean(spark, d):
    o = t.read(spark, d, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("season"))
    m = o.groupBy("season").agg(F.avg("o_totalprice").alias("season_mean"))  # one row per season
    return o.join(F.broadcast(m), "season").select("o_orderkey", "season_mean")


@query("row_at_max", ["pitcher_id", "gamepk"], """
SELECT pitcher_id, gamepk, inning, count_outs, start_speed FROM (SELECT *, row_number() OVER (PARTITION BY pitcher_id, gamepk
  ORDER BY play_id DESC, event_index DESC) AS rn FROM pbp WHERE is_last_pitch) WHERE rn = 1""", ["pbp"])
def row_at_max(spark, d):
    p = t.pitches(spark, d).filter("is_last_pitch").groupBy("pitcher_id", "gamepk").agg(
        F.max_by(F.struct("inning", "count_outs", "start_speed"), F.struct("play_id", "event_index")).alias("r"))
    return p.select("pitcher_id", "gamepk", "r.*")


@query("running_before", [], """
SELECT o_orderkey, coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w, 0) AS spent_before, count(*) OVER w AS orders_before
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def running_before(spark, d):
    o = t.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("x"))
    r = lagged(o, "o_custkey", ["o_orderdate", "o_orderkey"], [Feature("s", "sum", "x", prior()), Feature("orders_before", "rows", None, prior())])
    return r.select("o_orderkey", F.coalesce("s", F.lit(0)).alias("spent_before"), "orders_before")


@query("pitch_sequences", ["gamepk", "sequence"], """
SELECT gamepk, play_id, string_agg(pitch_call_code, ',' ORDER BY event_index) AS sequence FROM raw GROUP BY gamepk, play_id""", ["raw"])
def pitch_sequences(spark, d):
    s = Q.sequences(t.pitches_raw(spark, d), ["gamepk", "play_id"], "event_index", "pitch_call_code")
    return s.withColumn("sequence", F.array_join("sequence", ","))


@query("bigram_transitions", ["from", "to"], """
SELECT "from", "to", count(*) AS n FROM (
  SELECT coalesce(lag(event_type) OVER w, 'START') AS "from", event_type AS "to" FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
  UNION ALL SELECT arg_max(event_type, ts), 'END' FROM events GROUP BY user_id) GROUP BY ALL""")
def bigram_transitions(spark, d):
    return Q.transitions(t.read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("pitch_transitions", ["from", "to"], """
SELECT "from", "to", count(*) AS n FROM (
  SELECT coalesce(lag(pitch_call_code) OVER w, 'START') AS "from", pitch_call_code AS "to" FROM raw
    WINDOW w AS (PARTITION BY gamepk, play_id ORDER BY event_index)
  UNION ALL SELECT arg_max(pitch_call_code, event_index), 'END' FROM raw GROUP BY gamepk, play_id) GROUP BY ALL""", ["raw"])
def pitch_transitions(spark, d):
    return Q.transitions(t.pitches_raw(spark, d), ["gamepk", "play_id"], ["event_index"], "pitch_call_code")


@query("value_counts", ["play_result"], """
SELECT play_result, count(*) AS n, count(DISTINCT batter_id) AS batters, count(DISTINCT gamepk) AS games FROM raw GROUP BY ALL""", ["raw"])
def value_counts(spark, d):
    return t.pitches_raw(spark, d).groupBy("play_result").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("batter_id").alias("batters"), F.countDistinct("gamepk").alias("games"))


@query("dedupe_appearances", ["gamepk", "batter_id", "play_result"], """
SELECT gamepk, play_id, batter_id, play_result FROM (SELECT *, row_number() OVER (PARTITION BY gamepk, play_id ORDER BY event_index) AS rn
FROM raw) WHERE rn = 1""", ["raw"])
def dedupe_appearances(spark, d):
    g = t.pitches_raw(spark, d).groupBy("gamepk", "play_id").agg(
        F.min_by(F.struct("batter_id", "play_result"), "event_index").alias("r"))
    return g.select("gamepk", "play_id", "r.*")


@query("union_roles", ["key", "role"], """
SELECT pitcher_id AS "key", 'sp' AS role, count(*) AS n FROM pbp WHERE pitcher_role = 'sp' GROUP BY ALL
UNION ALL SELECT pitcher_team_id, 'bullpen', count(*) FROM pbp WHERE pitcher_role = 'bullpen' GROUP BY ALL""", ["pbp"])
def union_roles(spark, d):
    p = t.pitches(spark, d)
    side = lambda role, key: p.filter(F.col("pitcher_role") == role).groupBy(F.col(key).alias("key")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("role", F.lit(role))
    return side("sp", "pitcher_id").unionByName(side("bullpen", "pitcher_team_id"))


@query("distinct_people", ["person"], """
SELECT personId AS person FROM batter_box UNION SELECT personId FROM pitcher_box UNION SELECT batter_id FROM raw UNION SELECT pitcher_id FROM raw""",
       ["batter_box", "pitcher_box", "raw"], exact=True)
def distinct_people(spark, d):
    from lagwell.operators.checks import distinct_ids
    p = t.pitches_raw(spark, d)
    return distinct_ids([(t.batter_box(spark, d), "personId"), (t.pitcher_box(spark, d), "personId"), (p, "batter_id"), (p, "pitcher_id")], "person")


@query("except_games", ["gamepk"], """
SELECT gamepk FROM sched EXCEPT SELECT gamepk FROM raw WHERE play_result = 'Triple' AND is_in_play""", ["sched", "raw"], exact=True)
def except_games(spark, d):
    s = t.schedule_raw(spark, d).select("gamepk").distinct()
    return s.subtract(t.pitches_raw(spark, d).filter("play_result = 'Triple' and is_in_play").select("gamepk"))


@query("union_seasons", ["season_label"], """
SELECT concat('s', year(o_orderdate)) AS season_label, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY ALL""")
def union_seasons(spark, d):
    from uuid import uuid4
    from lagwell.plans.scale import scratch
    from lagwell.sources import tables as S
    o = t.read(spark, d, "orders").select("o_totalprice", F.year("o_orderdate").alias("game_season"), F.concat(F.lit("s"), F.year("o_orderdate")).alias("season_label"))
    at = f"{scratch(spark)}/seasons-{uuid4().hex}"
    S.write_season(o, f"{at}/orders")
    years = [r[0] for r in o.select("game_season").distinct().collect()]  # one row per season
    names = [f"game_season={'__HIVE_DEFAULT_PARTITION__' if y is None else y}" for y in years]
    return S.read_seasons(spark, at, "orders", names).groupBy("season_label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
