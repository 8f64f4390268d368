"""Season tables: boxscore rates, pitch-derived rates, role and hand splits, league rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwell.functions import constants as K
from lagwell.functions.rates import (
    babip, dbl, fip_sql, half_even, named, named_columns, obp, ratio_sql, safe_div, slg, woba,
)
from lagwell.functions.text import whole_thirds
from lagwell.operators import partials as P
from lagwell.operators.clean import decimal_innings, drop_seasons
from lagwell.plans.frames import deviation_sql, integer_deviation_sql, merged_sql


# ---- naming -----------------------------------------------------------------------------

def prefix_columns(df: DataFrame, prefix: str, keys) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in keys})


def as_last_season(df: DataFrame) -> DataFrame:
    """Move a season table one season on and mark its columns as last season's."""
    d = df.withColumn("game_season", F.col("game_season") + 1)
    return d.withColumnsRenamed({c: c.replace("season_", "last_season_") for c in d.columns if "season_" in c})


def pivot_hands(df: DataFrame, hand: str, tags: dict[str, str], keys, entity_prefix: str) -> DataFrame:
    """Long (key, hand) rows to one wide row per key; codes without a tag are dropped."""
    stats = [c for c in df.columns if c not in [*keys, hand]]

    def name(c, tag):
        return c.replace(entity_prefix, f"{entity_prefix}{tag}_", 1) if c.startswith(entity_prefix) else c

    aggs = {name(c, tag): f"max(CASE WHEN {hand} = '{code}' THEN {c} END)"
            for code, tag in tags.items() for c in stats}
    return df.filter(F.col(hand).isin(*tags)).groupBy(*keys).agg(*named_columns(aggs))


# ---- boxscore seasons -------------------------------------------------------------------

def batter_box_season(box: DataFrame, last: bool = True) -> DataFrame:
    """BA, SLG, ISO, BABIP of a season, each rounded to 2 places, half to even."""
    sums = ["h", "k", "bb", "hr", "ab", "plate_appearances", "total_bases_from_h"]
    keys = ["personId", "game_season"]
    d = box.na.drop(subset=keys).groupBy(*keys).agg(*[P.sum0(F.col(c)).alias(c) for c in sums])
    d = d.withColumns({"ba": half_even(safe_div("h", "ab"), 2),
                       "slg": half_even(safe_div("total_bases_from_h", "ab"), 2)})
    d = d.withColumns({"iso": half_even(F.col("slg") - F.col("ba"), 2),
                       "babip": half_even(babip("h", "hr", "ab", "k"), 2)})
    d = prefix_columns(d, "batter_season_", keys)
    return as_last_season(d) if last else d


def pitcher_box_season(box: DataFrame, entity="personId", last: bool = True) -> DataFrame:
    """WHIP and strikeout, walk, home-run and strike rates; ip must be decimal already."""
    sums = ["h", "r", "er", "bb", "hr", "k", "p", "s", "ip"]
    keys = [*([entity] if isinstance(entity, str) else entity), "game_season"]
    d = box.na.drop(subset=keys).groupBy(*keys).agg(*[P.sum0(F.col(c)).alias(c) for c in sums])
    d = d.withColumn("ip", whole_thirds("ip"))
    c = F.col
    d = d.withColumns({
        "whip": half_even(safe_div(c("bb") + c("h"), "ip"), 2), "k_rate": half_even(safe_div("k", "ip"), 2),
        "bb_rate": half_even(safe_div("bb", "ip"), 2), "strike_rate": half_even(safe_div("s", "p"), 2),
        "hr_rate": half_even(safe_div("hr", "ip"), 2)})
    d = prefix_columns(d, "pitcher_season_", keys)
    return as_last_season(d) if last else d


def tag_roles(box: DataFrame, pbp: DataFrame) -> DataFrame:
    """Role of each boxscore line, from the pitch table; ids compared as strings.

    Roles travel as one row per game, which the lines of the game look up in place: tables dealt by game stay where they are.
    """
    role = F.struct(F.col("pitcher_id").cast("string").alias("personId"), "pitcher_role").alias("_r")
    games = pbp.select(F.col("gamepk").cast("string"), role).groupBy("gamepk").agg(F.collect_set("_r").alias("_roles"))
    b = box.withColumns({c: F.col(c).cast("string") for c in ("personId", "gamepk")})
    return b.join(games, "gamepk", "left").selectExpr(
        *b.columns, "explode_outer(filter(_roles, r -> r.personId = personId).pitcher_role) AS pitcher_role")


#: Who a row counts for: a starter himself, a reliever's team.
ROLE_KEY = ["pitcher_key_id", "pitcher_role"]


def with_role_key(df: DataFrame, pitcher: str, team: str) -> DataFrame:
    return df.filter("pitcher_role IN ('sp', 'bullpen')").withColumn(
        "pitcher_key_id", F.expr(f"CASE pitcher_role WHEN 'sp' THEN {pitcher} ELSE {team} END"))


def pitcher_box_season_roles(tagged: DataFrame) -> DataFrame:
    """Starters by pitcher and relief by team, in one pass over lines tagged with their role."""
    return pitcher_box_season(with_role_key(tagged, "personId", "team_id"), ROLE_KEY)


def role_lines(tagged: DataFrame, stats: list[str]) -> DataFrame:
    """Lines of ROLE_KEY and game in one pass: a starter's as they are, relief summed to its team's game."""
    keys = [*ROLE_KEY, "gamepk", "game_date", "game_season"]
    d = with_role_key(tagged, "personId", "team_id").select(*keys, *stats)
    whole = " AND ".join(f"{c} IS NOT NULL" for c in keys)
    d = d.filter(f"pitcher_role = 'sp' OR ({whole})")
    kinds = {f.name: f.dataType.simpleString() for f in d.agg(*[F.sum(c).alias(c) for c in stats]).schema}
    line = ", ".join(f"'{c}', CAST({c} AS {k})" for c, k in kinds.items())
    total = ", ".join(f"'{c}', CAST(coalesce(sum({c}), 0) AS {k})" for c, k in kinds.items())
    g = d.groupBy(*keys).agg(*named_columns({
        "_own": f"collect_list(CASE WHEN pitcher_role = 'sp' THEN named_struct({line}) END)", "_sum": f"named_struct({total})"}))
    return g.selectExpr(*keys, "inline(CASE WHEN pitcher_role = 'sp' THEN _own ELSE array(_sum) END)")


# ---- pitch-derived seasons --------------------------------------------------------------

def _pitcher_groups(pbp: DataFrame, keys, entity, extra=(), bounded: bool = False) -> DataFrame:
    """Measures of a season straight from pitches, so that Spark's own states merge and no game-level table is built.

    Per-game parts (exit state, workload) sit on one pitch of each game and split, marked by windows over the game.
    bounded: an entity is one player, whose pitches travel as rows, narrower than a hundred sums a player and task.
    """
    d = pbp.na.drop(subset=list(dict.fromkeys([*entity, "gamepk", *keys])))
    at = "CASE WHEN is_last_pitch THEN CAST(play_id AS BIGINT) * 4294967296 + event_index END"
    game, end = ", ".join([*entity, "gamepk"]), ", ".join(dict.fromkeys([*entity, "gamepk", "game_date", "game_season", *extra]))
    first = f"row_number() OVER (PARTITION BY {end} ORDER BY _at DESC)"
    top = [f"max(_at) OVER (PARTITION BY {game}) AS _top"] if extra else ["_at AS _top"]
    d = d.selectExpr("*", f"{at} AS _at").selectExpr("*", f"{first} AS _row", f"count_if(is_pitch) OVER (PARTITION BY {end}) AS _n").selectExpr("*", *top)
    last = lambda c: f"CASE WHEN _row = 1 AND _at = _top THEN {c} END"
    thrown = "CASE WHEN _row = 1 THEN _n END"
    m = P.pitcher_measures() | {
        "avg_last_inning": f"avg({last('inning')})", "std_last_inning": f"stddev_samp({last('inning')})",
        "avg_last_inning_velo": f"avg({last('start_speed')})", "last_inning_ball_rate": f"avg({last('CAST(is_ball AS INT)')})",
        "last_inning_strike_rate": f"avg({last('CAST(is_strike AS INT)')})", "last_inning_avg_balls": f"avg({last('count_balls')})",
        "last_inning_avg_strikes": f"avg({last('count_strikes')})", "last_inning_outs": f"max({last('count_outs')})",
        "game_avg_pitch_count": f"avg({thrown})", "game_std_pitch_count": f"stddev_samp({thrown})",
        "game_max_pitch_count": f"max({thrown})"}
    return (d.repartition(*entity) if bounded else d).groupBy(*keys).agg(*named_columns(m))


def _outcome_rates(p: str, fip_parts: bool) -> dict[str, str]:
    """Outcome rates over all finished appearances (not only those with a result)."""
    rows = "pa_rows"
    some = lambda x: f"CASE WHEN {rows} > 0 THEN {x} END"
    out = {
        p + "pitch_count_mean": ratio_sql("pa_pitch_count_sum", rows),
        p + "pitch_count_std": integer_deviation_sql(rows, "pa_pitch_count_sum", "pa_pitch_count_sumsq"),
        p + "total": some("pa_total"),
    }
    for x in ("strikeout", "walk", "hbp", "hit", "hr", "single", "xbh"):
        out[f"{p}{x}_rate"] = ratio_sql(f"pa_{x}_n", rows)
    out[p + "avg_final_balls"] = ratio_sql("pa_final_balls_sum", "pa_final_balls_n")
    out[p + "avg_final_strikes"] = ratio_sql("pa_final_strikes_sum", "pa_final_strikes_n")
    out[p + "full_count_rate"] = ratio_sql("pa_full_count_n", rows)
    if fip_parts:
        out[p + "fip_k"] = some("pa_strikeout_n")
        out[p + "fip_bb"] = some("pa_fip_bb_n")
        out[p + "fip_hr"] = some("pa_hr_n")
        out[p + "fip"] = fip_sql("pa_hr_n", "pa_fip_bb_n", "pa_strikeout_n", "pa_total")
    return out


def _pitcher_columns() -> dict[str, str]:
    p = "pitcher_season_"
    out = {}
    for x in P.STUFF:
        s = f"stuff_{x}"
        out[f"{p}{s}_mean"] = ratio_sql(s + "_sum", s + "_n")
        if x in P.PEAK:
            out[f"{p}{s}_max"] = s + "_max"
        if x in P.SPREAD:
            out[f"{p}{s}_std"] = deviation_sql(s + "_spread")
    for x in P.COMMAND:
        out[f"{p}command_{x}_std"] = deviation_sql(f"command_{x}_spread")
    for x in ("in_play", "swinging_strike", "zone", "ball", "strike", "called_strike", "chase", "zone_swing",
              "first_pitch_strike"):
        out[f"{p}command_{x}_rate"] = ratio_sql(f"command_{x}_n", f"command_{x}_known")
    out.update(_outcome_rates(p + "pa_", True))
    for x in ("avg_last_inning", "std_last_inning", "avg_last_inning_velo", "last_inning_ball_rate",
              "last_inning_strike_rate", "last_inning_avg_balls", "last_inning_avg_strikes", "last_inning_outs",
              "game_avg_pitch_count", "game_std_pitch_count", "game_max_pitch_count"):
        out[p + x] = x
    for x in ("hard_hit", "gb", "fb", "ld"):
        out[f"{p}contact_{x}_rate"] = ratio_sql(f"contact_{x}_n", "contact_rows")
    for x in ("speed", "angle"):
        out[f"{p}contact_avg_launch_{x}"] = ratio_sql(f"contact_launch_{x}_sum", f"contact_launch_{x}_n")
    return out


def pitcher_season(pbp: DataFrame, role: str | None = None, entity: str = "pitcher_id", extra=(),
                   last: bool = True) -> DataFrame:
    """Stuff, command, outcomes, exit state, workload and contact quality of a season."""
    keys = [entity, "game_season", *extra]
    d = pbp if role is None else pbp.filter(F.col("pitcher_role") == role)
    d = _pitcher_groups(d, keys, [entity], extra, entity == "pitcher_id").selectExpr(*keys, *named(_pitcher_columns()))
    return as_last_season(d) if last else d


def pitcher_season_roles(pbp: DataFrame) -> DataFrame:
    """Starters by pitcher and relief by team, in one pass over the pitches."""
    d, cols = with_role_key(pbp, "pitcher_id", "pitcher_team_id"), _pitcher_columns()
    d = _pitcher_groups(d, [*ROLE_KEY, "game_season"], ROLE_KEY)
    return as_last_season(d.selectExpr("pitcher_key_id", "game_season", *named(cols), "pitcher_role"))


def pitcher_season_of_games(games: DataFrame) -> DataFrame:
    """The table of `pitcher_season_roles` from partials per ROLE_KEY and game (`partials.pitcher_games`), where these are at hand."""
    merge = lambda c: merged_sql(c) if c.endswith("_spread") else f"max({c})" if c.endswith("_max") else f"sum({c})"
    m = {c: merge(c) for c in P.pitcher_measures()} | {
        "avg_last_inning": "avg(last_inning_inning)", "std_last_inning": "stddev_samp(last_inning_inning)",
        "avg_last_inning_velo": "avg(last_inning_velo)", "last_inning_ball_rate": "avg(last_inning_ball)",
        "last_inning_strike_rate": "avg(last_inning_strike)", "last_inning_avg_balls": "avg(last_inning_balls)",
        "last_inning_avg_strikes": "avg(last_inning_strikes)", "last_inning_outs": "max(last_inning_outs)",
        "game_avg_pitch_count": "avg(thrown)", "game_std_pitch_count": "stddev_samp(thrown)", "game_max_pitch_count": "max(thrown)"}
    d = games.groupBy(*ROLE_KEY, "game_season").agg(*named_columns(m))
    return as_last_season(d.selectExpr("pitcher_key_id", "game_season", *named(_pitcher_columns()), "pitcher_role"))


def pitcher_season_by_hand(pbp: DataFrame, role: str | None = None) -> DataFrame:
    d = pitcher_season(pbp, role, extra=["batter_bat_side"], last=False)
    return as_last_season(pivot_hands(d, "batter_bat_side", K.BATTER_HAND_TAGS, ["pitcher_id", "game_season"],
                                      "pitcher_season_"))


def _batter_columns(p: str) -> dict[str, str]:
    out = _outcome_rates(p + "pa_", False)
    for name, num, den in (
        ("o_swing_rate", "chase_n", "n_pitches"), ("z_swing_rate", "zone_swing_n", "n_pitches"),
        ("swinging_strike_rate", "swinging_strike_n", "n_pitches"), ("zone_rate", "zone_n", "n_pitches"),
        ("contact_rate", "contact_n", "swing_n"),
        ("contact_hard_hit_rate", "hard_hit_n", "launch_speed_valid_n"),
        ("contact_sweet_spot_rate", "sweet_spot_n", "launch_angle_valid_n"),
        ("contact_gb_rate", "gb_n", "contact_rows"), ("contact_fb_rate", "fb_n", "contact_rows"),
        ("contact_ld_rate", "ld_n", "contact_rows"),
        ("contact_avg_launch_speed", "launch_speed_sum", "launch_speed_valid_n"),
        ("contact_avg_launch_angle", "launch_angle_sum", "launch_angle_valid_n"),
        ("foul_rate", "foul_n", "swing_n"), ("contact_foul_rate", "contact_foul_n", "foul_or_inplay_rows"),
        ("two_strike_foul_rate", "two_strike_foul_n", "two_strike_swing_rows"),
    ):
        out[p + name] = ratio_sql(num, den)
    return out


def _batter_table(pbp, keys, prefix):
    g = P.batter_groups(pbp, keys).filter("pa_rows > 0")
    return g.selectExpr(*keys, *named(_batter_columns(prefix)))


def batter_season(pbp: DataFrame, last: bool = True) -> DataFrame:
    d = _batter_table(pbp, ["batter_id", "game_season"], "batter_season_")
    return as_last_season(d) if last else d


def batter_season_by_hand(pbp: DataFrame) -> DataFrame:
    keys = ["batter_id", "game_season"]
    d = _batter_table(pbp, [*keys, "pitcher_throw_hand"], "batter_season_")
    return as_last_season(pivot_hands(d, "pitcher_throw_hand", K.PITCHER_HAND_TAGS, keys, "batter_season_"))


def league_by_hand(pbp: DataFrame) -> DataFrame:
    """Population rates per (season, pitcher hand, batter side)."""
    return as_last_season(_batter_table(pbp, ["game_season", "pitcher_throw_hand", "batter_bat_side"],
                                        "league_season_"))


def hand_levels(pbp: DataFrame) -> DataFrame:
    """The same outcome measures at every level of the hand split in one pass: both hands,
    pitcher hand only, batter side only, and the season as a whole."""
    h, b = "pitcher_throw_hand", "batter_bat_side"
    d = pbp.filter(F.col(h).isNotNull() & F.col(b).isNotNull() & F.col("game_season").isNotNull())
    sets = [[F.col("game_season"), F.col(h), F.col(b)], [F.col("game_season"), F.col(h)],
            [F.col("game_season"), F.col(b)], [F.col("game_season")]]
    m = P.batter_measures()
    need = [n for n in m if n.startswith("pa_")]
    g = d.groupingSets(sets, F.col("game_season"), F.col(h), F.col(b)).agg(*named_columns({n: m[n] for n in need}))
    cols = _outcome_rates("league_season_pa_", False)
    return g.selectExpr("game_season", f"coalesce({h}, 'all') AS {h}", f"coalesce({b}, 'all') AS {b}", *named(cols))


# ---- season summaries -------------------------------------------------------------------

def _sums(names: dict[str, str]):
    return [F.sum(src).alias(out) for out, src in names.items()]


def batter_summary(box: DataFrame) -> DataFrame:
    """Totals, rates and beta prior counts of regular-season games."""
    d = drop_seasons(box.filter("game_type = 'R'"))
    src = {"season_pa": "plate_appearances", "season_ab": "ab", "season_h": "h", "season_singles": "singles",
           "season_doubles": "doubles", "season_triples": "triples", "season_hr": "hr", "season_tb": "total_bases",
           "season_rbi": "rbi", "season_bb": "bb", "season_k": "k", "season_sb": "sb", "season_lob": "lob"}
    g = d.groupBy("personId", "player_name", "game_season").agg(F.count(F.lit(1)).alias("season_games"), *_sums(src))
    pa = "season_pa"
    cols = {n: safe_div(s, pa) for n, s in (("hit_rate", "season_h"), ("k_rate", "season_k"),
                                            ("hr_rate", "season_hr"), ("bb_rate", "season_bb"),
                                            ("tb_rate", "season_tb"), ("rbi_rate", "season_rbi"))}
    cols.update(_slash("season_"))
    for tag, s in (("hits", "season_h"), ("k", "season_k"), ("hr", "season_hr"), ("tb", "season_tb")):
        cols[f"beta_alpha_{tag}"] = dbl(s)
        cols[f"beta_beta_{tag}"] = dbl(pa) - dbl(s)
    return g.withColumns(cols)


def _slash(p: str) -> dict:
    c = lambda x: F.col(p + x)
    return {"obp": obp(c("h"), c("bb"), c("ab")), "slg": slg(c("tb"), c("ab")),
            "iso": slg(c("tb"), c("ab")) - safe_div(c("h"), c("ab")),
            "woba": woba(c("bb"), c("singles"), c("doubles"), c("triples"), c("hr"), c("ab"))}


def starter_summary(box: DataFrame, starters: DataFrame) -> DataFrame:
    """Season totals and rates over a pitcher's starts."""
    s = starters.withColumnRenamed("starter_id", "personId")
    d = drop_seasons(decimal_innings(box).drop("player_name").join(s, ["gamepk", "team_id", "personId"]))
    g = d.groupBy("personId", F.col("starter_name").alias("player_name"), "game_season").agg(
        F.count(F.lit(1)).alias("season_starts"), F.sum("ip_true").alias("season_ip"),
        *_sums({"season_h_allowed": "h", "season_er": "er", "season_bb_allowed": "bb", "season_k": "k",
                "season_hr_allowed": "hr"}),
        F.avg("ip_true").alias("avg_ip_per_start"), F.stddev_samp("ip_true").alias("std_ip_per_start"))
    per = lambda x: safe_div(x, "season_ip")
    return g.withColumns({
        "era": per("season_er") * 9, "whip": per(F.col("season_h_allowed") + F.col("season_bb_allowed")),
        "k9": per("season_k") * 9, "bb9": per("season_bb_allowed") * 9, "hr9": per("season_hr_allowed") * 9,
        "k_per_ip": per("season_k"), "bb_per_ip": per("season_bb_allowed"), "hr_per_ip": per("season_hr_allowed"),
        "h_per_ip": per("season_h_allowed"), "er_per_ip": per("season_er")})


def team_summary(batters: DataFrame, pitchers: DataFrame) -> DataFrame:
    """Offence and pitching of a team's regular season, joined."""
    reg = lambda df: drop_seasons(df.filter("game_type = 'R'"))
    keys = ["team_id", "game_season"]
    off = reg(batters).groupBy(*keys).agg(
        F.countDistinct("gamepk").alias("season_games"),
        *_sums({"season_pa": "plate_appearances", "season_ab": "ab", "season_h": "h", "season_singles": "singles",
                "season_doubles": "doubles", "season_triples": "triples", "season_hr": "hr",
                "season_tb": "total_bases", "season_r": "r", "season_rbi": "rbi", "season_bb": "bb",
                "season_k": "k", "season_sb": "sb", "season_lob": "lob"}))
    off = off.withColumns({**_slash("season_"), "hit_rate": safe_div("season_h", "season_pa"),
                           "k_rate": safe_div("season_k", "season_pa"), "bb_rate": safe_div("season_bb", "season_pa"),
                           "r_per_game": safe_div("season_r", "season_games")})
    p = decimal_innings(reg(pitchers)).groupBy(*keys).agg(
        F.sum("ip_true").alias("season_ip_pitched"),
        *_sums({"season_h_allowed": "h", "season_er_allowed": "er", "season_bb_allowed": "bb",
                "season_k_pitched": "k", "season_hr_allowed": "hr"}))
    per = lambda x: safe_div(x, "season_ip_pitched")
    p = p.withColumns({
        "era_allowed": per("season_er_allowed") * 9,
        "whip_allowed": per(F.col("season_h_allowed") + F.col("season_bb_allowed")),
        "k9_pitched": per("season_k_pitched") * 9, "bb9_allowed": per("season_bb_allowed") * 9,
        "hr9_allowed": per("season_hr_allowed") * 9, "k_per_ip_pitched": per("season_k_pitched"),
        "bb_per_ip_allowed": per("season_bb_allowed"), "hr_per_ip_allowed": per("season_hr_allowed"),
        "h_per_ip_allowed": per("season_h_allowed")})
    return off.join(p, keys)
