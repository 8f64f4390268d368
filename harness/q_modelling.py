"""Preparation, rules baseline, model frame and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness import tables as t
from harness.oracle import cte
from harness.registry import query
from lagwell.operators import prep as P
from lagwell.operators import rules as R

# orders with gaps: prices of small orders and one segment are blanked
cte("gappy", (), """
SELECT o_orderkey, year(o_orderdate) AS game_season, CASE WHEN o_totalprice < 50000 THEN NULL ELSE o_totalprice END AS price,
  nullif(c_acctbal, round(c_acctbal, 0)) AS balance, CASE WHEN year(o_orderdate) > 1999 AND o_orderstatus = 'P' THEN 'new-status'
  ELSE nullif(o_orderstatus, 'O') END AS status, nullif(c_mktsegment, 'BUILDING') AS segment
FROM orders JOIN customer ON o_custkey = c_custkey""")


def gappy(spark, d):
    o = t.read(spark, d, "orders").join(t.read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.selectExpr(
        "o_orderkey", "year(o_orderdate) as game_season", "case when o_totalprice < 50000 then null else o_totalprice end as price",
        "nullif(c_acctbal, round(c_acctbal, 0)) as balance",
        "case when year(o_orderdate) > 1999 and o_orderstatus = 'P' then 'new-status' else nullif(o_orderstatus, 'O') end as status",
        "nullif(c_mktsegment, 'BUILDING') as segment")


FIT, VAL = (1995, 1996, 1997, 1998), (2000,)


def _split(spark, d):
    return P.split_seasons(gappy(spark, d), FIT, VAL)


@query("temporal_split", ["part"], """
SELECT CASE WHEN game_season IN (1995, 1996, 1997, 1998) THEN 'fit' ELSE 'val' END AS part, count(*) AS n, min(game_season) AS first_season,
  max(game_season) AS last_season FROM gappy WHERE game_season IN (1995, 1996, 1997, 1998, 2000) GROUP BY ALL""", ["gappy"])
def temporal_split(spark, d):
    a, b = _split(spark, d)
    row = lambda x, n: x.agg(F.count(F.lit(1)).alias("n"), F.min("game_season").alias("first_season"),
                             F.max("game_season").alias("last_season")).withColumn("part", F.lit(n))
    return row(a, "fit").unionByName(row(b, "val"))


@query("missing_indicators", ["price_isnull", "segment_isnull"], """
SELECT price IS NULL AS price_isnull, segment IS NULL AS segment_isnull, count(*) AS n FROM gappy GROUP BY ALL""", ["gappy"])
def missing_indicators(spark, d):
    return P.add_missing_indicators(gappy(spark, d), ["price", "segment"]).groupBy("price_isnull", "segment_isnull").agg(
        F.count(F.lit(1)).alias("n"))


@query("null_columns", ["price", "segment", "o_orderkey"], """
SELECT bool_or(price IS NULL) AS price, bool_or(segment IS NULL) AS segment, bool_or(o_orderkey IS NULL) AS o_orderkey FROM gappy""",
       ["gappy"], exact=True)
def null_columns(spark, d):
    return P.null_flags(gappy(spark, d), ["price", "segment", "o_orderkey"])


MODE = "(SELECT {c} FROM gappy WHERE {c} IS NOT NULL AND game_season < 1999 GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("impute_median_mode", ["status", "segment"], f"""
SELECT o_orderkey, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM gappy WHERE game_season < 1999)) AS price,
  coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM gappy WHERE game_season < 1999)) AS balance,
  coalesce(status, {MODE.format(c="status")}) AS status, coalesce(segment, {MODE.format(c="segment")}) AS segment
FROM gappy WHERE game_season = 2000""", ["gappy"])
def impute_median_mode(spark, d):
    a, b = _split(spark, d)
    m = P.impute_mode(a, [b], ["status", "segment"])[1]
    return P.impute_median(a, [m], ["price", "balance"])[1].select("o_orderkey", "price", "balance", "status", "segment")


def code_sql(c):
    cats = f"(SELECT DISTINCT coalesce({c}, 'missing') AS v FROM gappy WHERE game_season < 1999)"
    return (f"CASE WHEN coalesce(g.{c}, 'missing') IN (SELECT v FROM {cats}) THEN (SELECT count(*) FROM {cats} x "
            f"WHERE x.v < coalesce(g.{c}, 'missing')) ELSE -1 END AS {c}")


@query("ordinal_encode", [], f"SELECT o_orderkey, {code_sql('status')}, {code_sql('segment')} FROM gappy g WHERE game_season = 2000", ["gappy"])
def ordinal_encode(spark, d):
    a, b = _split(spark, d)
    return P.encode(a, [b], ["status", "segment"])[1].select("o_orderkey", "status", "segment")


@query("standardize", [], """
SELECT o_orderkey, (price - (SELECT avg(price) FROM gappy WHERE game_season < 1999)) / (SELECT stddev_pop(price) FROM gappy
  WHERE game_season < 1999) AS price FROM gappy WHERE game_season = 2000""", ["gappy"])
def standardize(spark, d):
    a, b = _split(spark, d)
    return P.standardize(a, [b], ["price"])[1].select("o_orderkey", "price")


@query("incomplete_report", ["status"], """
SELECT status, count(*) AS dropped FROM gappy WHERE price IS NULL OR segment IS NULL GROUP BY ALL""", ["gappy"])
def incomplete_report(spark, d):
    return P.incomplete_report(gappy(spark, d), ["price", "segment"], "status")


# ---- rules baseline ---------------------------------------------------------------------

cte("pa0", ("raw", "games", "batter_box"), """
SELECT p.gamepk, p.play_id, p.batter_id, p.is_hit, g.game_date, g.game_season, o.batting_order FROM (
  SELECT gamepk, play_id, arg_min(batter_id, event_index) AS batter_id,
    CASE WHEN arg_min(play_result, event_index) FILTER (play_result IS NOT NULL) IN ('Single','Double','Triple','Home Run') THEN 1 ELSE 0 END AS is_hit
  FROM raw GROUP BY gamepk, play_id) p
JOIN games g ON p.gamepk = g.gamepk
LEFT JOIN (SELECT gamepk, personId, CAST(batting_order AS INTEGER) AS batting_order FROM batter_box WHERE batting_order IS NOT NULL) o
  ON p.gamepk = o.gamepk AND p.batter_id = o.personId""")
cte("pa", ("pa0", "batter_box"), """
SELECT a.*, b.ba AS last_season_ba FROM pa0 a
LEFT JOIN (SELECT s.game_season, max(f.game_season) AS src FROM (SELECT DISTINCT game_season FROM pa0) s
  JOIN (SELECT DISTINCT game_season FROM batter_box) f ON f.game_season < s.game_season GROUP BY ALL) m ON a.game_season = m.game_season
LEFT JOIN (SELECT personId, game_season, round_even(sum(h)::DOUBLE / nullif(sum(ab), 0) * 1000, 0) / 1000 AS ba FROM batter_box GROUP BY ALL) b
  ON a.batter_id = b.personId AND b.game_season = m.src""")
cte("rules", ("pa",), """
SELECT *, 0.4 * comp_prev_season + 0.4 * comp_rolling_shrunk + 0.2 * comp_order_slot AS xba_pred FROM (
  SELECT gamepk, play_id, game_season, is_hit, coalesce(last_season_ba, quantile_cont(last_season_ba, 0.5) OVER ()) AS comp_prev_season,
    (coalesce(sum(is_hit) OVER w, 0) + 100 * avg(is_hit) OVER (PARTITION BY game_season)) / (count(*) OVER w + 100) AS comp_rolling_shrunk,
    coalesce(slot, quantile_cont(slot, 0.5) OVER ()) AS comp_order_slot
  FROM (SELECT p.*, s.slot FROM pa p LEFT JOIN (SELECT game_season + 1 AS game_season, batting_order, avg(is_hit) AS slot FROM pa
          WHERE batting_order IS NOT NULL GROUP BY ALL) s ON p.game_season = s.game_season AND p.batting_order = s.batting_order)
  WINDOW w AS (PARTITION BY batter_id, game_season ORDER BY game_date, gamepk, play_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")


def appearances(spark, d):
    from lagwell.functions.rates import in_sql
    from lagwell.functions.constants import HITS
    from lagwell.operators.clean import batting_order
    p = t.pitches_raw(spark, d).groupBy("gamepk", "play_id").agg(
        F.min_by("batter_id", "event_index").alias("batter_id"),
        F.expr("min_by(play_result, case when play_result is not null then event_index end)").alias("r"))
    p = p.selectExpr("gamepk", "play_id", "batter_id", f"cast({in_sql('r', HITS)} as int) as is_hit")
    p = p.join(t._games(spark, d).drop("game_type"), "gamepk")
    box = t.batter_box(spark, d)
    p = p.join(batting_order(box), ["gamepk", "batter_id"], "left")
    return R.last_season_average(p, box)


@query("rules_baseline", ["gamepk", "play_id"], "SELECT * FROM rules", ["rules"])
def rules_baseline(spark, d):
    return R.rules_baseline(appearances(spark, d)).select(
        "gamepk", "play_id", "game_season", "is_hit", "comp_prev_season", "comp_rolling_shrunk", "comp_order_slot", "xba_pred")


@query("slot_rate_prior_season", [], """
SELECT game_season + 1 AS game_season, batting_order, avg(is_hit) AS slot_ba FROM pa WHERE batting_order IS NOT NULL GROUP BY ALL""", ["pa"])
def slot_rate_prior_season(spark, d):
    pa = appearances(spark, d).filter("batting_order is not null")
    return pa.groupBy((F.col("game_season") + 1).alias("game_season"), "batting_order").agg(F.avg("is_hit").alias("slot_ba"))


@query("shrinkage_blend", ["gamepk", "play_id"], "SELECT gamepk, play_id, comp_rolling_shrunk FROM rules", ["rules"])
def shrinkage_blend(spark, d):
    return R.season_to_date(appearances(spark, d)).select("gamepk", "play_id", "comp_rolling_shrunk")


@query("component_scores", ["component"], """
SELECT component, avg(-(is_hit * ln(p) + (1 - is_hit) * ln(1 - p))) AS log_loss, avg((p - is_hit) ** 2) AS brier FROM (
  SELECT component, is_hit, least(greatest(p, 1e-6), 1 - 1e-6) AS p FROM rules UNPIVOT (p FOR component IN
    (comp_prev_season, comp_rolling_shrunk, comp_order_slot, xba_pred))) GROUP BY ALL""", ["rules"])
def component_scores(spark, d):
    from lagwell.operators.evaluate import component_scores as c
    return c(R.rules_baseline(appearances(spark, d)), "is_hit", ["comp_prev_season", "comp_rolling_shrunk", "comp_order_slot", "xba_pred"])


# ---- model frame and models -------------------------------------------------------------

def _frame(spark, d):
    from harness.q_lagging import _pbox
    from lagwell.operators import model_frame as M
    from lagwell.operators.clean import earliest_schedule, weather
    return M.build(t.pitches(spark, d), t.batter_box(spark, d), _pbox(spark, d), weather(t.game_info(spark, d)),
                   earliest_schedule(t.schedule_raw(spark, d), tie="schedule_row"))


@query("model_frame", ["gamepk", "pitcher_role"])
def model_frame(spark, d):
    return P_numeric(_frame(spark, d))


def P_numeric(f):
    keep = ["gamepk", "pitcher_role"]
    return f.select(*keep, *P.numeric_features(f, exclude=keep))


def _xy(spark, d):
    """Orders as model rows: large order or not, and the number of its lines."""
    l = t.read(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("lines"), F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    o = t.read(spark, d, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    o = o.selectExpr("o_orderkey", "year(o_orderdate) as game_season", "cast(o_totalprice > 250000 as int) as y", "lines",
                     "quantity", "discount", "cast(month(o_orderdate) as double) as month", "o_totalprice / 100000 as price")
    return P.split_seasons(o, (1995, 1996, 1997, 1998, 1999), (2000,))


COLS = ["quantity", "discount", "month"]


@query("prior_model", [], """
SELECT o_orderkey, (SELECT avg((o_totalprice > 250000)::INT) FROM orders WHERE year(o_orderdate) < 2000 AND o_orderkey IN
  (SELECT l_orderkey FROM lineitem)) AS probability
FROM orders WHERE year(o_orderdate) = 2000 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def prior_model(spark, d):
    from lagwell.operators.ml import prior_model as m
    a, b = _xy(spark, d)
    return m(a, b, "y").select("o_orderkey", "probability")


def _model(name, fn):
    @query(name, [])
    def run(spark, d):
        from lagwell.operators import ml
        a, b = _xy(spark, d)
        return fn(ml, spark, a, b)


_model("logreg", lambda ml, s, a, b: ml.logistic(a, b, "y", COLS)[1].select("o_orderkey", "y", "probability"))
_model("random_forest", lambda ml, s, a, b: ml.forest(a, b, "y", COLS)[1].select("o_orderkey", "y", "probability"))
_model("gbt", lambda ml, s, a, b: ml.boosted(a, b, "y", COLS)[1].select("o_orderkey", "y", "probability"))
_model("poisson_glm", lambda ml, s, a, b: ml.residuals(ml.poisson(a, b, "lines", ["quantity", "discount"])[1], "lines", "prediction").select(
    "o_orderkey", "lines", "prediction", "residual", "abs_residual"))


@query("permutation_importance", ["feature"])
def permutation_importance(spark, d):
    from lagwell.operators import ml
    a, b = _xy(spark, d)
    model, _ = ml.poisson(a, b, "lines", ["quantity", "discount"])
    return ml.permutation_importance(model, b, "lines", ["quantity", "discount"], ["o_orderkey"])


@query("tree_importances", ["feature"])
def tree_importances(spark, d):
    from lagwell.operators import ml
    a, b = _xy(spark, d)
    return ml.importances(ml.forest(a, b, "y", COLS)[0], COLS, spark)


# the frame's oracle joins the oracles of its parts
from harness import q_lagging as QL  # noqa: E402
from harness import q_seasons as QS  # noqa: E402
from harness.oracle import oracle  # noqa: E402
from harness.registry import ORACLES  # noqa: E402


def _roll_box(w, p):
    return (QL._pitcher_box_roll(w, p, "personId", QL.SP_LINES, "sp") + " UNION ALL "
            + QL._pitcher_box_roll(w, p, "team_id", QL.BP_TEAM, "bullpen"))


def _roll_pitch(w, p):
    return (QS.rolling_pitcher_sql("pitcher_id", w, "pitcher_role = 'sp'", p, "sp") + " UNION ALL "
            + QS.rolling_pitcher_sql("pitcher_team_id", w, "pitcher_role = 'bullpen'", p, "bullpen"))



def _model_frame_sql():
    import re
    box = re.search(r"res AS \((.*)\)\nSELECT", ORACLES["season_box_rates"], re.S).group(1)
    parts = [
        (f"SELECT personId AS j1, game_season AS j2, * EXCLUDE (personId, game_season) FROM ({box})", "j1 = batter_id AND j2 = game_season", "j1, j2"),
        (QS._pbox_season("personId", "sp") + " UNION ALL " + QS._pbox_season("team_id", "bullpen"), None, "season"),
        (QS._role("pitcher_id", "sp") + " UNION ALL BY NAME " + QS._role("pitcher_team_id", "bullpen"), None, "season"),
        (f"SELECT personId AS j1, gamepk AS j2, * EXCLUDE (personId, gamepk, game_season) FROM ({QL._batter_box_roll('season', 'batter_roll_season_')})",
         "j1 = batter_id AND j2 = gamepk", "j1, j2"),
        (f"SELECT personId AS j1, gamepk AS j2, * EXCLUDE (personId, gamepk, game_season) FROM ({QL._batter_box_roll(10, 'batter_roll_last10g_')})",
         "j1 = batter_id AND j2 = gamepk", "j1, j2"),
        (_roll_box("season", "pitcher_roll_season_"), None, "game"), (_roll_box(10, "pitcher_roll_last10g_"), None, "game"),
        (_roll_pitch("season", "pitcher_roll_season_"), None, "game"), (_roll_pitch(10, "pitcher_roll_last10g_"), None, "game"),
    ]
    base = r"""
SELECT p.gamepk, p.play_id, p.batter_id, p.is_hit, p.pitcher_role, i.game_season, i.weather_temp, b.batting_order,
  CASE WHEN p.pitcher_role = 'sp' THEN p.pitcher_id ELSE p.pitcher_team_id END AS pitcher_key_id
FROM (SELECT DISTINCT gamepk, batter_team_id, play_id, pitcher_id, pitcher_name, batter_id, batter_name, is_hit, pitcher_throw_hand,
        batter_bat_side, pitcher_role, pitcher_team_id FROM pbp) p
LEFT JOIN (SELECT gamepk, game_season, weather_temp FROM (
    SELECT *, row_number() OVER (PARTITION BY gamepk ORDER BY game_season, weather_condition NULLS FIRST, weather_temp NULLS FIRST) AS rn
    FROM (SELECT gamepk, game_season, weather_condition, CAST(nullif(regexp_extract(weather_temp, '(\d+)', 1), '') AS DOUBLE) AS weather_temp
          FROM info)) WHERE rn = 1) i ON p.gamepk = i.gamepk
JOIN (SELECT gamepk, personId, CAST(batting_order AS INTEGER) AS batting_order FROM batter_box WHERE batting_order IS NOT NULL) b
  ON p.gamepk = b.gamepk AND p.batter_id = b.personId"""
    sql = base
    for body, on, kind in parts:
        if kind == "season":
            body = f"SELECT pitcher_key_id AS j1, game_season AS j2, pitcher_role AS j3, * EXCLUDE (pitcher_key_id, game_season, pitcher_role) FROM ({body})"
            on, kind = "j1 = pitcher_key_id AND j2 = game_season AND j3 = pitcher_role", "j1, j2, j3"
        elif kind == "game":
            body = f"SELECT pitcher_key_id AS j1, gamepk AS j2, pitcher_role AS j3, * EXCLUDE (pitcher_key_id, gamepk, pitcher_role, game_season) FROM ({body})"
            on, kind = "j1 = pitcher_key_id AND j2 = gamepk AND j3 = pitcher_role", "j1, j2, j3"
        sql = f"SELECT * EXCLUDE ({kind}) FROM ({sql}) x LEFT JOIN ({body}) y ON {on}"
    return f"SELECT * EXCLUDE (batter_id, pitcher_key_id) FROM ({sql})"


ORACLES["model_frame"] = oracle(_model_frame_sql(), "pbp", "info", "batter_box", "pitcher_ip", "roles", keep=["gamepk", "pitcher_role"])
