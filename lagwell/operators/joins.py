"""Joins with the reference semantics: roles, opponents, season lags, as-of, guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwell.functions.rates import pythagorean
from lagwell.plans.frames import Feature, Split, lagged, through
from lagwell.plans.scale import small_side


def indicator(left: DataFrame, right: DataFrame, keys, name: str, yes="both", no="left_only") -> DataFrame:
    """Left join on keys that keeps only whether a match exists; right is made unique."""
    r = right.select(*keys).distinct().withColumn("_hit", F.lit(True))
    d = left.join(r, list(keys), "left")
    return d.withColumn(name, F.when(F.col("_hit"), F.lit(yes)).otherwise(F.lit(no))).drop("_hit")


def exists_flag(left: DataFrame, right: DataFrame, on: dict[str, str], name: str) -> DataFrame:
    """Boolean of whether the key pair occurs on the right; on maps left to right columns."""
    r = right.select(*[F.col(b).alias(a) for a, b in on.items()]).distinct().withColumn(name, F.lit(True))
    return left.join(small_side(r), list(on), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def opponent(df: DataFrame, game: str, team: str, cols: list[str], prefix: str = "opp_") -> DataFrame:
    """Attach the other team's columns in games of exactly two teams.

    The pair is found by one grouped pass (first and last team of the game), so no game
    ever expands into pairs; games with another number of teams drop out.
    """
    row = F.struct(team, *cols)
    g = df.groupBy(game).agg(F.min_by(row, team).alias("_a"), F.max_by(row, team).alias("_b"),
                             F.count(F.lit(1)).alias("_n"))
    g = g.filter((F.col("_n") == 2) & (F.col(f"_a.{team}") != F.col(f"_b.{team}"))).drop("_n")
    other = F.when(F.col(team) == F.col(f"_a.{team}"), F.col("_b")).otherwise(F.col("_a"))
    d = df.join(g, game).withColumn("_o", other)
    return d.select(*df.columns, *[F.col(f"_o.{c}").alias(f"{prefix}{c}") for c in [team, *cols]])


def odd_games(df: DataFrame, game: str, team: str) -> DataFrame:
    """Games that do not have exactly two teams."""
    g = df.groupBy(game).agg(F.countDistinct(team).alias("teams"))
    return g.filter(F.col("teams") != 2)


def with_pythagorean(df: DataFrame) -> DataFrame:
    return df.withColumn("pyth_exp", pythagorean("r", "opp_r"))


def in_game(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", game: str = "gamepk") -> DataFrame:
    """Join on game and keys of tables that are dealt by game alike; further keys are compared among the rows of a game.

    Neither side is dealt anew, however wide it is.
    """
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in [game, *keys]})
    # a range of one value: an equality would make it a key that both sides have to be dealt by
    same = [F.col(k).between(F.col(f"_r_{k}"), F.col(f"_r_{k}")) for k in keys]
    return left.join(r, reduce(lambda a, b: a & b, same, F.col(game) == F.col(f"_r_{game}")), how).drop(*[f"_r_{c}" for c in [game, *keys]])


def season_lag(df: DataFrame, table: DataFrame, keys: list[str], k: int = 1, season: str = "game_season",
               prefix: str = "") -> DataFrame:
    """Look up a season table k seasons back."""
    stats = [c for c in table.columns if c not in [*keys, season]]
    t = table.select(*keys, (F.col(season) + k).alias(season), *[F.col(c).alias(prefix + c) for c in stats])
    return df.join(t, [*keys, season], "left")


def asof_season(df: DataFrame, table: DataFrame, keys: list[str], season: str = "game_season",
                per_entity: bool = False) -> DataFrame:
    """Look up the latest season before the row's own.

    By default the season is the latest one the table holds for anyone (so a player who
    sat it out gets NULL, and missing years are bridged); per_entity takes each entity's
    own latest.
    """
    stats = [c for c in table.columns if c not in [*keys, season]]
    if per_entity:
        a = df.select(*keys, season).distinct().withColumn("_row", F.lit(None).cast(
            table.select(F.struct(season, *stats)).schema[0].dataType)).withColumn("_k", F.lit(0))
        b = table.select(*keys, season, F.struct(season, *stats).alias("_row"), F.lit(1).alias("_k"))
        u = lagged(a.unionByName(b), keys, [season, "_k"], [Feature("_best", "max", "_row", through())],
                   bucket=F.col(season))
        # the asking row sorts before a table row of its own season, so that one is not seen
        u = u.filter("_k = 0").select(*keys, season, "_best")
        d = df.join(u, [*keys, season], "left")
        return d.select(*df.columns, *[F.col(f"_best.{c}").alias(c) for c in stats])
    have = table.select(F.col(season).alias("_src")).distinct()
    want = df.select(season).distinct()
    # both sides are one row per season
    pairs = want.join(F.broadcast(have), F.col("_src") < F.col(season)).groupBy(season).agg(F.max("_src").alias("_src"))
    t = table.withColumnRenamed(season, "_src").join(F.broadcast(pairs), "_src").drop("_src")
    return df.join(t, [*keys, season], "left")


def asof_latest(events: DataFrame, features: DataFrame, keys: list[str], event_time: str, feature_time: str,
                cols: list[str], event_id: str, ttl_seconds: int | None = None,
                split: Split = Split()) -> DataFrame:
    """Latest feature row at or before each event, within a time to live.

    Events and features are stacked and swept once in time order, so the work is linear in
    both inputs and no event is ever paired with more than one feature row. A key may hold any number of rows.
    """
    payload = F.struct(F.col(feature_time).alias("_ft"), *[F.col(c) for c in cols])
    f = features.select(*keys, F.col(feature_time).alias("_t"), F.lit(0).alias("_k"),
                        F.lit(None).cast(events.schema[event_id].dataType).alias(event_id), payload.alias("_p"))
    e = events.select(*keys, F.col(event_time).alias("_t"), F.lit(1).alias("_k"), event_id,
                      F.lit(None).cast(f.schema["_p"].dataType).alias("_p"))
    s = lagged(e.unionByName(f), keys, ["_t", "_k", event_id], [Feature("_best", "max", "_p", through())], split)
    s = s.filter("_k = 1")
    best = F.col("_best")
    if ttl_seconds is not None:
        age = F.unix_micros(F.col("_t").cast("timestamp")) - F.unix_micros(best["_ft"].cast("timestamp"))
        best = F.when(age <= ttl_seconds * 1_000_000, best)
    return s.select(*keys, event_id, F.col("_t").alias(event_time), best["_ft"].alias(feature_time),
                    *[best[c].alias(c) for c in cols])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that would fan out a join."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def unique_lookup(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fails the job when the right side holds a key twice."""
    n = F.count(F.lit(1))
    cols = [c for c in right.columns if c not in keys]
    r = right.groupBy(*keys).agg(n.alias("_n"), *[F.max(c).alias(c) for c in cols])
    bad = F.raise_error(F.concat(F.lit("lookup key not unique: "), F.to_json(F.struct(*keys))))
    r = r.withColumn("_ok", F.when(F.col("_n") > 1, bad.cast("boolean")).otherwise(True)).filter("_ok")
    return left.join(r.drop("_n", "_ok"), list(keys), "left")


def role_key(df: DataFrame) -> DataFrame:
    """Join key by role: the pitcher for starters, his team for relievers, whose hand is unknown."""
    sp = F.col("pitcher_role") == "sp"
    return df.withColumns({
        "pitcher_key_id": F.when(sp, F.col("pitcher_id")).otherwise(F.col("pitcher_team_id")),
        "pitcher_throw_hand": F.when(sp, F.col("pitcher_throw_hand"))})
