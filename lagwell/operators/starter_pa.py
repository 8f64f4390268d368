"""Plate-appearance features for starting pitchers: game tables, windows, blends and the whole frame.

Measures of a game come from `appearances`, in one pass over its pitches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwell.functions import constants as K
from lagwell.functions.rates import log5, named, named_columns, ratio1_sql, ratio_sql, shrink
from lagwell.operators import appearances as P
from lagwell.operators.base_out import base_out_state
from lagwell.operators.clean import park_factor, rule_era
from lagwell.operators.prep import drop_incomplete
from lagwell.operators.joins import in_game
from lagwell.plans.scale import parts, stage
from lagwell.plans.frames import Feature, back, lagged, last, prior, seven_day_sum, spread

GP, GB = P.GP, P.GB
ORDER = ["game_date", "gamepk"]
YTD = prior("game_season")
STARTER_STATS = ["k_rate", "bb_rate", "hr_rate", "gb_pct", "csw_pct", "whiff_rate", "barrel_pct", "hard_hit_pct",
                 "first_pitch_strike_pct", "p_per_pa"]
BATTER_STATS = ["k_rate", "bb_rate", "hr_rate", "iso", "tb_rate", "chase_rate", "z_contact_pct", "o_contact_pct"]


# ---- per-game stat tables ---------------------------------------------------------------

def pitcher_game(box: DataFrame, measures: DataFrame) -> DataFrame:
    """Starters' boxscore lines with all their measures and rates per batter faced."""
    m = measures.filter("is_starter").drop("is_starter").withColumnRenamed("pitcher_id", "personId")
    return box.join(m, ["gamepk", "personId"]).selectExpr("*", *named({
        "k_rate": ratio1_sql("k", "pa_count"), "bb_rate": ratio1_sql("bb", "pa_count"),
        "hr_rate": ratio1_sql("hr", "pa_count"), "k_bb_ratio": ratio_sql("k", "bb")}))


def batter_game(box: DataFrame, measures: DataFrame) -> DataFrame:
    pa = "plate_appearances"
    d = box.selectExpr("*", *named({
        "k_rate": ratio1_sql("k", pa), "bb_rate": ratio1_sql("bb", pa), "hr_rate": ratio1_sql("hr", pa),
        "iso": ratio1_sql("(doubles + 2 * triples + 3 * hr)", pa), "tb_rate": ratio1_sql("total_bases", pa)}))
    return d.join(measures.withColumnRenamed("batter_id", "personId"), ["gamepk", "personId"], "left")


def team_game(box: DataFrame, discipline: DataFrame, appearances: DataFrame) -> DataFrame:
    """Team rates per game from team sums; the OBP formula follows the columns present."""
    keys = ["team_id", "gamepk", "game_date", "game_season"]
    sums = {"team_pa": "plate_appearances", "team_k": "k", "team_bb": "bb", "team_hr": "hr",
            "team_total_bases": "total_bases", "team_doubles": "doubles", "team_triples": "triples"}
    has_hits, has_hbp = "hits" in box.columns, "hbp" in box.columns
    if has_hits:
        sums["team_hits"] = "hits"
    if has_hbp:
        sums["team_hbp"] = "hbp"
    # dealt by team and game once: the sums, the join and the discipline of the same game share it
    g = box.repartition("team_id", "gamepk").groupBy(*keys).agg(*named_columns({n: f"coalesce(sum({c}), 0)" for n, c in sums.items()}))
    rates = {"team_k_rate": ratio1_sql("team_k", "team_pa"), "team_bb_rate": ratio1_sql("team_bb", "team_pa"),
             "team_hr_rate": ratio1_sql("team_hr", "team_pa"),
             "team_iso": ratio1_sql("(team_doubles + 2 * team_triples + 3 * team_hr)", "team_pa"),
             "team_tb_rate": ratio1_sql("team_total_bases", "team_pa")}
    if has_hits and has_hbp:
        rates["team_obp"] = ratio1_sql("(team_hits + team_bb + team_hbp)", "team_pa")
    elif has_hits:
        rates["team_obp"] = ratio1_sql("(team_hits + team_bb)", "team_pa")
    else:
        rates["team_obp"] = rates["team_tb_rate"]
    g = g.selectExpr("*", *named(rates))
    who = appearances.select("gamepk", "batter_id", F.col("batter_team_id").alias("team_id")).repartition(*GB).distinct()
    p = discipline.join(who, GB).repartition("team_id", "gamepk").groupBy("team_id", "gamepk").agg(*named_columns({
        "team_chase_n": "sum(chase_n)", "team_out_zone_n": "sum(out_zone_n)", "team_z_swing_n": "sum(z_swing_n)",
        "team_z_contact_n": "sum(z_contact_n)", "team_pitches_seen": "sum(pitches_seen)"}))
    p = p.selectExpr("*", *named({"team_chase_rate": ratio1_sql("team_chase_n", "team_out_zone_n"),
                                  "team_z_contact_pct": ratio1_sql("team_z_contact_n", "team_z_swing_n")}))
    return g.join(p, ["team_id", "gamepk"], "left").selectExpr(
        "*", f"{ratio1_sql('team_pitches_seen', 'team_pa')} AS team_p_per_pa")


# ---- windows ----------------------------------------------------------------------------

TEAM_RATES = ["k_rate", "bb_rate", "hr_rate", "obp", "iso", "tb_rate", "chase_rate", "z_contact_pct", "p_per_pa"]


def team_windows(games: DataFrame) -> DataFrame:
    cols = {c: f"team_{c}" for c in TEAM_RATES}
    feats = (spread(cols, ("avg",), last(1), "team_last_game_{col}") + spread(cols, ("avg",), last(10), "team_10g_{col}")
             + [Feature("team_10g_n_games", "rows", None, last(10))] + spread(cols, ("avg",), YTD, "team_ytd_{col}")
             + [Feature("team_ytd_pa_count", "sum", "team_pa", YTD), Feature("team_ytd_n_games", "rows", None, YTD)])
    return lagged(games, "team_id", ORDER, feats).select("team_id", *ORDER, "game_season", *[f.name for f in feats])


PROCESS = {"avg_velo": "avg_velo", "avg_spin_rate": "avg_spin_rate", "avg_extension": "avg_extension",
           "contact_exit_velo": "contact_exit_velo", "hard_contact_pct": "contact_hard_hit_pct",
           "sweet_spot_pct": "contact_sweet_spot_pct", "zone_pct": "zone_pct", "chase_induced_pct": "chase_induced_pct",
           "whiff_rate_ahead": "whiff_rate_ahead", "whiff_rate_behind": "whiff_rate_behind",
           "called_strike_edge_pct": "called_strike_edge_pct"}
PROCESS_LAST = PROCESS | {"avg_h_break": "avg_h_break", "avg_v_break": "avg_v_break",
                          "inplay_exit_velo": "inplay_exit_velo", "two_strike_whiff_pct": "two_strike_whiff_pct"}
MEANS = {**{c: c for c in STARTER_STATS if c != "first_pitch_strike_pct"}, "k_bb": "k_bb_ratio",
         "fps_pct": "first_pitch_strike_pct", "avg_ip": "ip", "avg_pitches": "total_pitches",
         "avg_batters_faced": "pa_count"}


PITCHER_SPLITS = [f"{s}_vs_{h}" for s in ("k_rate", "bb_rate", "obp_allowed", "whiff_rate") for h in "LR"]
BATTER_SPLITS = [f"{s}_vs_{h}" for s in ("obp", "k_rate", "iso", "tb_rate") for h in "LR"]


def pitcher_split_features() -> list[Feature]:
    return (spread(PITCHER_SPLITS, ("avg",), last(1), "sp_last_start_{col}") + spread(PITCHER_SPLITS, ("avg",), last(10), "sp10_{col}")
            + spread(PITCHER_SPLITS, ("avg",), YTD, "spytd_{col}")
            + spread(["pa_count_vs_L", "pa_count_vs_R"], ("sum",), YTD, "spytd_{col}")
            + [Feature("spytd_obp_allowed", "avg", "obp_allowed", YTD)])


def batter_split_features() -> list[Feature]:
    return (spread(BATTER_SPLITS, ("avg",), YTD, "batytd_{col}")
            + spread(["pa_count_vs_L", "pa_count_vs_R"], ("sum",), YTD, "batytd_{col}")
            + [Feature("batytd_obp", "avg", "obp_per_game", YTD)])


def season_means(stats, back_by: int) -> list:
    """Means of whole seasons as frames over the season's number: back_by 0 is the row's own season, 1 the one before."""
    over = f"OVER (PARTITION BY personId ORDER BY game_season RANGE BETWEEN {back_by} PRECEDING AND {back_by} PRECEDING)"
    if not back_by:
        over = "OVER (PARTITION BY personId ORDER BY game_season RANGE BETWEEN CURRENT ROW AND CURRENT ROW)"
    known = "personId IS NOT NULL AND game_season IS NOT NULL"
    return [f"CASE WHEN {known} THEN avg({c}) {over} END AS _s{back_by}_{c}" for c in stats]


def _seasons(stats) -> list:
    return [e for k in (0, 1, 2) for e in season_means(stats, k)]


def pitcher_windows(games: DataFrame, also: list[Feature] | None = None, seasons=(), keep=()) -> DataFrame:
    """Last start, ten starts and season so far, with rest, spacing, seven-day innings and trends.

    also: further features in the same pass. seasons: statistics whose season means are added for `career_fallback`.
    keep: columns of games that stay.
    """
    also = also or []
    d = games.selectExpr("*", f"{ratio_sql('inn45_pitches', 'inn45_pa')} AS inn45_p_per_pa_rate",
                         f"{ratio_sql('inn45_onbase', 'inn45_pa')} AS inn45_obp_rate", *_seasons(seasons))
    d = seven_day_sum(d, "personId", "game_date", "gamepk", "ip", "cumulative_ip_last_7d")
    last1 = {c: c for c in STARTER_STATS} | {"ip": "ip", "pitches": "total_pitches"} | PROCESS_LAST
    feats = spread(last1, ("avg",), last(1), "sp_last_start_{col}")
    feats += spread(MEANS | PROCESS, ("avg",), last(10), "sp10_{col}")
    feats += [Feature("sp10_total_pitches", "sum", "total_pitches", last(10)),
              Feature("sp10_pa_count", "sum", "pa_count", last(10)), Feature("sp10_n_starts", "rows", None, last(10)),
              Feature("sp10_p_per_pa_inn4_5", "avg", "inn45_p_per_pa_rate", last(10)),
              Feature("sp10_obp_allowed_inn4_5", "avg", "inn45_obp_rate", last(10))]
    feats += spread(MEANS | PROCESS, ("avg",), YTD, "spytd_{col}")
    feats += [Feature("spytd_pa_count", "sum", "pa_count", YTD), Feature("spytd_n_starts", "rows", None, YTD)]
    lags = [Feature(f"_d{n}", "value", "game_date", back(n)) for n in (1, 3, 10)]
    w = lagged(d, "personId", ORDER, feats + also + lags)
    raw = ["k_rate", "bb_rate", "hr_rate", *STARTER_STATS[3:], "pa_count", "ip"]
    rest = "(datediff(game_date, _d1) - 1)"
    return w.selectExpr(
        "personId", *ORDER, "game_season", "team_id", *keep, f"{rest} AS days_rest", "cumulative_ip_last_7d",
        *[f.name for f in feats + also], *_season_names(seasons), "datediff(_d1, _d3) / 2.0D AS sp_avg_days_between_starts_3",
        "datediff(_d1, _d10) / 9.0D AS sp_avg_days_between_starts_10", *raw, *named({
            "fatigue_score": ratio1_sql("sp_last_start_pitches", rest),
            "sp_velo_trend": "sp_last_start_avg_velo - sp10_avg_velo",
            "sp_spin_trend": "sp_last_start_avg_spin_rate - sp10_avg_spin_rate",
            "sp_contact_velo_trend": "sp_last_start_contact_exit_velo - sp10_contact_exit_velo"}))


def _season_names(stats) -> list[str]:
    return [f"_s{k}_{c}" for k in (0, 1, 2) for c in stats]


def batter_windows(games: DataFrame, also: list[Feature] | None = None, seasons=(), keep=()) -> DataFrame:
    """Last game, 15 and 50 games, season so far, and days since the previous game."""
    cols = {c: c for c in BATTER_STATS[:6]} | {"z_contact": "z_contact_pct", "o_contact": "o_contact_pct"}
    feats = spread(cols, ("avg",), last(1), "bat_last_game_{col}")
    for tag, frame in (("bat15", last(15)), ("bat50", last(50)), ("batytd", YTD)):
        feats += spread(cols, ("avg",), frame, tag + "_{col}")
        feats += [Feature(f"{tag}_pa_count", "sum", "plate_appearances", frame), Feature(f"{tag}_n_games", "rows", None, frame)]
    feats += also or []
    d = games.selectExpr("*", *_seasons(seasons))
    w = lagged(d, "personId", ORDER, feats + [Feature("_d1", "value", "game_date", back(1))])
    return w.selectExpr("personId", *ORDER, "game_season", *keep, "try_cast(batting_order AS INT) AS batting_order_int",
                        "datediff(game_date, _d1) AS bat_days_since_last_game", *[f.name for f in feats],
                        *_season_names(seasons), *BATTER_STATS, "plate_appearances")


def pitcher_platoon_windows(games: DataFrame) -> DataFrame:
    feats = pitcher_split_features()
    return lagged(games, "personId", ORDER, feats).select("personId", "gamepk", *[f.name for f in feats])


def batter_platoon_windows(games: DataFrame) -> DataFrame:
    feats = batter_split_features()
    return lagged(games, "personId", ORDER, feats).select("personId", "gamepk", *[f.name for f in feats])


# ---- blends -----------------------------------------------------------------------------

def _weighted(stats, out: str, mode: str) -> dict[str, str]:
    if mode not in ("reference", "strict"):
        raise ValueError(f"mode must be reference or strict, got {mode!r}")
    weights = {0: 3, 1: 2, 2: 1} if mode == "reference" else {1: 2, 2: 1}
    cols = {}
    for c in stats:
        top = " + ".join(f"coalesce(_s{k}_{c}, 0) * {w}" for k, w in weights.items())
        low = " + ".join(f"CASE WHEN _s{k}_{c} IS NULL THEN 0 ELSE {w} END" for k, w in weights.items())
        cols[f"{out}3yr_wtd_{c}"] = ratio_sql(f"({top})", f"({low})")
    return cols


def career_weighted(games: DataFrame, stats, out: str, mode: str = "reference") -> DataFrame:
    """3-2-1 weighted season means. mode 'reference' weighs the current full season too,
    which sees the future; 'strict' uses only the two seasons before, weighted 2-1."""
    m = games.na.drop(subset=["personId", "game_season"]).repartition("personId").groupBy("personId", "game_season").agg(
        *[F.avg(c).alias(c) for c in stats])
    d = m.selectExpr("personId", "game_season", *_seasons(stats))
    return d.selectExpr("personId", "game_season", *named(_weighted(stats, out, mode)))


def career_fallback(windows: DataFrame, stats, pa: str, ytd: str, out: str, threshold: int = 30, mode: str = "reference") -> DataFrame:
    """Season-to-date means under `threshold` appearances take the career mean instead; adds career and last-season means.

    windows holds the season means of stats (`seasons=`). Only statistics whose season column carries the same name are
    replaced.
    """
    d = windows.selectExpr("*", *named(_weighted(stats, out, mode)), *[f"_s1_{c} AS {out}last_szn_{c}" for c in stats])
    swap = {ytd + c: f"CASE WHEN coalesce({pa}, 0) < {threshold} THEN {out}3yr_wtd_{c} ELSE {ytd}{c} END"
            for c in stats if ytd + c in windows.columns}
    return d.selectExpr(*[f"{swap[c]} AS {c}" if c in swap else c for c in d.columns if not c.startswith("_s")])


def shrink_splits(df: DataFrame, ytd: str, stats) -> DataFrame:
    """Pull both hands' season rates toward the overall rate by sample size."""
    return df.withColumns({
        f"{ytd}{s}_vs_{h}_shrunk": shrink(f"{ytd}{s}_vs_{h}", f"{ytd}{s}", f"{ytd}pa_count_vs_{h}", K.PLATOON_K[s])
        for s in stats for h in "LR"})


def league_rates(games: DataFrame) -> DataFrame:
    """League means of a season, keyed by the season after."""
    return games.filter("game_season IS NOT NULL").groupBy((F.col("game_season") + 1).alias("game_season")).agg(
        *[F.avg(f"{s}_rate").alias(f"lg_{s}_rate") for s in ("k", "bb", "hr")])


def add_log5(features: DataFrame, games: DataFrame) -> DataFrame:
    d = features.join(F.broadcast(league_rates(games)), "game_season", "left")  # one row per season
    return d.withColumns({
        f"log5_expected_{s}": log5(f"batytd_{s}_rate", f"spytd_{s}_rate",
                                   F.coalesce(f"lg_{s}_rate", F.lit(K.LEAGUE_DEFAULTS[f"{s}_rate"])))
        for s in ("k", "bb", "hr")})


def team_oaa(rows: DataFrame) -> DataFrame:
    return rows.groupBy("team_id", "game_season").agg(F.sum("outs_above_average").alias("team_oaa_season"))


# ---- the whole frame --------------------------------------------------------------------

def per_game(df: DataFrame, names: list[str]) -> DataFrame:
    """One row per game: `sides`, its two teams' columns as an array of (team_id, names)."""
    rows = df.filter("team_id IS NOT NULL").groupBy("gamepk")
    return rows.agg(F.collect_list(F.struct("team_id", F.struct(*names).alias("v"))).alias("sides"))


def build(pbp: DataFrame, pitcher_box: DataFrame, batter_box: DataFrame, schedule: DataFrame, players: DataFrame,
          oaa: DataFrame | None = None, complete_only: bool = True, mode: str = "reference", dealt: int | None = None) -> DataFrame:
    """Every plate appearance faced by a starter, with pitcher, batter, team and matchup features.

    players holds personId, batSide, pitchHand; innings in pitcher_box are decimal. Pitches are dealt by game and read twice where they
    lie: what concerns starters is staged as events, what batters saw as measures of a game. dealt names the number of partitions when
    pbp comes dealt by gamepk already. Game tables know which of their rows an appearance asks for; only these travel, once windows
    have made them wide, to the appearances, which are dealt by game alone and never anew.
    """
    n = dealt or parts(pbp)
    if not dealt:
        pbp = pbp.repartition(n, "gamepk")
    faced = stage(P.events(pbp, dealt=True, only="either"))
    pa = stage(base_out_state(P.appearances(faced, players).drop("game_date", "game_season")))
    asked = lambda key: pa.select("gamepk", F.col(key).alias("personId")).distinct().withColumn("_met", F.lit(True))
    starters = P.pitcher_measures(P.play_partials(P.with_hands(faced.filter("_theirs"), players).repartition(*GP)), dealt=True)
    pg = stage(pitcher_game(pitcher_box, starters).join(asked("pitcher_id"), ["gamepk", "personId"], "left"))
    measures = stage(P.batter_measures(P.play_partials(P.events(pbp, players, dealt=n)), dealt=True))
    bg = stage(batter_game(batter_box, measures).join(asked("batter_id"), ["gamepk", "personId"], "left"))

    sp = pitcher_windows(pg.repartition(n, "personId"), pitcher_split_features(), STARTER_STATS, ["_met"]).filter("_met").drop("_met")
    sp = career_fallback(sp, STARTER_STATS, "spytd_pa_count", "spytd_", "sp_", mode=mode)
    sp = shrink_splits(sp, "spytd_", ["k_rate", "bb_rate", "obp_allowed", "whiff_rate"])
    sp = sp.drop(*STARTER_STATS, "pa_count", "ip", "game_date", "game_season", "team_id")
    bat = batter_windows(bg.repartition(n, "personId"), batter_split_features(), BATTER_STATS, ["_met"]).filter("_met").drop("_met")
    bat = career_fallback(bat, BATTER_STATS, "batytd_pa_count", "batytd_", "bat_", mode=mode)
    bat = shrink_splits(bat, "batytd_", ["obp", "k_rate", "iso", "tb_rate"])
    bat = bat.drop(*BATTER_STATS, "plate_appearances", "game_date", "game_season")
    tw = team_windows(team_game(batter_box, P.discipline(measures), pa))

    meta = pitcher_box.select("gamepk", "game_date", "game_season").groupBy("gamepk").agg(
        F.min("game_date").alias("game_date"), F.min("game_season").alias("game_season"))
    venue = schedule.select("gamepk", "venue_id").groupBy("gamepk").agg(F.min("venue_id").alias("venue_id"))
    names = [c for c in tw.columns if c.startswith("team_") and c != "team_id"]
    game = lambda df: df.repartition(n, "gamepk")
    d = game(pa).join(meta, "gamepk", "left").join(park_factor(venue), "gamepk", "left").join(per_game(game(tw), names), "gamepk", "left")
    side = lambda role: f"get(filter(sides, x -> x.team_id = {role}), 0).v"
    d = d.selectExpr("* EXCEPT (sides)", f"{side('batter_team_id')} AS _opp", f"{side('pitcher_team_id')} AS _own")
    d = d.selectExpr("* EXCEPT (_opp, _own)", *[f"_{tag}.{c} AS {tag}_{c}" for tag in ("opp", "own") for c in names])
    d = in_game(d, game(sp.withColumnRenamed("personId", "pitcher_id")), ["pitcher_id"])
    d = in_game(d, game(bat.withColumnRenamed("personId", "batter_id")), ["batter_id"])
    d = rule_era(add_log5(d, pg))
    if oaa is not None:
        d = d.join(team_oaa(oaa).withColumnRenamed("team_id", "pitcher_team_id"), ["pitcher_team_id", "game_season"], "left")
    else:
        d = d.withColumn("team_oaa_season", F.lit(None).cast("double"))
    return drop_incomplete(d, required_columns(d)) if complete_only else d


def required_columns(df: DataFrame) -> list[str]:
    tags = ("sp10_", "spytd_", "bat_last_game_", "bat15_", "bat50_", "batytd_")
    return [c for c in df.columns if c.startswith(tags)]


def dropped_report(df: DataFrame, cols=None, top: int = 10) -> DataFrame:
    """Rows that lack a required column, counted per season, per month and for the pitchers who lose most, and how often each column is missing.

    Rows are (part, key, dropped, rows): 'season', 'month', the `top` of 'pitcher' (ties by id) and 'column'. One pass counts
    each (season, month, pitcher); the parts add those counts up.
    """
    cols = cols or required_columns(df)
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    keys = [F.col("game_season").cast("string").alias("season"), F.month("game_date").cast("string").alias("month"), F.col("pitcher_id").alias("pitcher")]
    base = stage(df.groupBy(*keys).agg(F.count(F.when(missing, 1)).alias("dropped"), F.count(F.lit(1)).alias("rows"),
                                       *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"c_{c}") for c in cols]))
    part = lambda name: base.groupBy(F.col(name).alias("key")).agg(F.sum("dropped").alias("dropped"), F.sum("rows").alias("rows"))
    tag = lambda d, name: d.select(F.lit(name).alias("part"), "key", "dropped", "rows")
    worst = part("pitcher").filter("dropped > 0").orderBy(F.desc("dropped"), "key").limit(top)
    whole = base.agg(F.sum("rows").alias("rows"), *[F.sum(f"c_{c}").alias(c) for c in cols])
    pairs = ", ".join(f"struct('{c}' AS key, {c} AS dropped)" for c in cols)
    columns = whole.select("rows", F.explode(F.expr(f"array({pairs})")).alias("x")).select("x.key", "x.dropped", "rows")
    out = tag(part("season"), "season").unionByName(tag(part("month"), "month"))
    return out.unionByName(tag(worst, "pitcher")).unionByName(tag(columns, "column"))
