"""Team-runs features."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness import tables as t
from harness.oracle import cte
from harness.q_lagging import capped_sql
from harness.registry import query
from lagwell.operators import team_runs as R

cte("tb", ("batter_box",), """
SELECT *, slg + obp AS ops, slg - avg AS iso FROM (
SELECT *, (h + bb)::DOUBLE / nullif(ab + bb, 0) AS obp, total_bases::DOUBLE / nullif(ab, 0) AS slg, h::DOUBLE / nullif(ab, 0) AS avg,
  (0.69 * bb + 0.89 * (h - doubles - triples - hr) + 1.27 * doubles + 1.62 * triples + 2.10 * hr)::DOUBLE / nullif(ab + bb, 0) AS woba,
  bb::DOUBLE / nullif(pa, 0) AS bb_pct, k::DOUBLE / nullif(pa, 0) AS k_pct, bb::DOUBLE / nullif(k, 0) AS bb_k,
  (h - hr)::DOUBLE / nullif(ab - k - hr, 0) AS babip, (h + bb - r)::DOUBLE / nullif((h + bb - 1.4 * hr)::DOUBLE, 0) AS lob_pct
FROM (SELECT *, h + doubles + 2 * triples + 3 * hr AS total_bases, ab + bb AS pa FROM (
  SELECT team_id, gamepk, game_season, min(game_date) AS game_date, sum(ab) AS ab, sum(r) AS r, sum(h) AS h, sum(doubles) AS doubles,
    sum(triples) AS triples, sum(hr) AS hr, sum(rbi) AS rbi, sum(bb) AS bb, sum(k) AS k, sum(lob) AS lob, sum(sb) AS sb
  FROM batter_box GROUP BY team_id, gamepk, game_season)))""")


@query("team_batting_rates", ["team_id", "gamepk"], "SELECT * EXCLUDE (game_date) FROM tb", ["tb"])
def team_batting_rates(spark, d):
    return R.team_batting(t.batter_box(spark, d)).drop("game_date")


def mean(col, w, part, name):
    return (f"avg({col}) OVER (PARTITION BY {part}, game_season ORDER BY game_date, gamepk ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS {name}")


OPP = ["r", "h", "hr", "bb", "k", "obp", "slg", "ops"]
cte("opp", ("tb",), f"""
SELECT a.*, b.team_id AS opp_team_id, {", ".join(f"b.{c} AS opp_{c}" for c in OPP)},
  pow(a.r, 1.83) / nullif(pow(a.r, 1.83) + pow(b.r, 1.83), 0) AS pyth_exp
FROM tb a JOIN tb b ON a.gamepk = b.gamepk AND a.team_id <> b.team_id""")
ROLL_OPP = ", ".join(mean(f"opp_{c}", w, "opp_team_id", f"rolling_{w}_opp_{c}") for c in R.OPPONENT for w in (7, 14, 30))


@query("rolling_mean_opponent", ["team_id", "gamepk", "opp_team_id"], f"""
SELECT team_id, gamepk, opp_team_id, pyth_exp, {ROLL_OPP} FROM opp""", ["opp"])
def rolling_mean_opponent(spark, d):
    o = R.add_opponent(R.team_batting(t.batter_box(spark, d)))
    return o.select("team_id", "gamepk", "opp_team_id", "pyth_exp", *[c for c in o.columns if c.startswith("rolling_")])


SP = {"sp_era": "era_gm", "sp_whip": "whip_gm", "sp_k9": "k9_gm", "sp_bb9": "bb9_gm", "sp_hr9": "hr9_gm", "sp_ip": "ip_true"}
SP_SQL = f"""(SELECT gamepk, team_id, {", ".join(mean(src, w, "personId", f"{n}_{w}s") for n, src in SP.items() for w in (5, 10))} FROM (
  SELECT gamepk, team_id, personId, game_date, game_season, ip_true, {capped_sql(suffix="_gm")} FROM (
    SELECT *, row_number() OVER (PARTITION BY gamepk, team_id ORDER BY ip_true DESC, personId DESC) AS rn FROM pitcher_ip) WHERE rn = 1))"""


@query("team_runs_frame", ["team_id", "gamepk", "opp_team_id"], f"""
SELECT o.* EXCLUDE (game_date), s.* EXCLUDE (gamepk, team_id) FROM (
  SELECT *, {", ".join(mean(c, w, "team_id", f"rolling_{w}_{c}") for c in R.ROLLED for w in (7, 14, 30))},
    {mean("r", 30, "team_id", "rolling_30_r")}, {", ".join(mean(c, w, "team_id", f"{c}_{w}g") for c in ("woba", "pyth_exp") for w in (14, 30))}
  FROM (SELECT *, {ROLL_OPP} FROM opp) WHERE game_season <> 2020) o
LEFT JOIN {SP_SQL} s ON o.gamepk = s.gamepk AND o.opp_team_id = s.team_id""", ["opp", "pitcher_ip"])
def team_runs_frame(spark, d):
    from lagwell.operators.clean import decimal_innings
    return R.build(t.batter_box(spark, d), decimal_innings(t.pitcher_box(spark, d))).drop("game_date")


@query("pythagorean", ["team_id"], """
SELECT team_id, game_season, r, ra, pow(r, 1.83) / nullif(pow(r, 1.83) + pow(ra, 1.83), 0) AS pyth_exp FROM (
  SELECT team_id, game_season, sum(r) AS r, sum(opp_r) AS ra FROM opp GROUP BY ALL)""", ["opp"])
def pythagorean(spark, d):
    from lagwell.functions.rates import pythagorean as p
    o = R.add_opponent(R.team_batting(t.batter_box(spark, d)))
    return o.groupBy("team_id", "game_season").agg(F.sum("r").alias("r"), F.sum("opp_r").alias("ra")).withColumn("pyth_exp", p("r", "ra"))


@query("fip_woba", ["team_id"], """
SELECT team_id, game_season, (13 * sum(hr) + 3 * sum(bb) - 2 * sum(k))::DOUBLE / nullif(sum(pa), 0) + 3.10 AS fip,
  (0.69 * sum(bb) + 0.89 * sum(h - doubles - triples - hr) + 1.27 * sum(doubles) + 1.62 * sum(triples) + 2.10 * sum(hr))::DOUBLE
    / nullif(sum(ab) + sum(bb), 0) AS woba FROM tb GROUP BY ALL""", ["tb"])
def fip_woba(spark, d):
    from lagwell.functions import rates as X
    b = R.team_batting(t.batter_box(spark, d)).groupBy("team_id", "game_season").agg(
        *[F.sum(c).alias(c) for c in ("hr", "bb", "k", "pa", "h", "doubles", "triples", "ab")])
    c = F.col
    return b.select("team_id", "game_season", F.expr(X.fip_sql("hr", "bb", "k", "pa")).alias("fip"),
                    X.woba("bb", c("h") - c("doubles") - c("triples") - c("hr"), "doubles", "triples", "hr", "ab").alias("woba"))
