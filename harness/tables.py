"""Sports-shaped tables derived from the given star-schema tables.

A game is four consecutive orders, a batter a customer on one side of the game, a pitcher
a supplier on the other side, a pitch a line item and a plate appearance two consecutive
line numbers of an order. `harness.oracle` states the same derivation in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lagwell.plans.scale import parts

# Codes spelled out per small integer of the source columns.
RESULTS = ["Strikeout", "Groundout", "Single", "Walk", "Flyout", "Double", "Home Run", "Lineout",
           "Hit By Pitch", "Triple", "Field Error", "Sac Fly", "Pop Out", "Grounded Into DP",
           "Strikeout Double Play", None]
EVENTS = ["strikeout", "field_out", "single", "walk", "field_out", "double", "home_run", "field_out",
          "hit_by_pitch", "triple", "field_error", "sac_fly", "field_out", "grounded_into_double_play",
          "strikeout_double_play", None]
CALLS = ["Swinging Strike", "Called Strike", "Ball", "Foul", "In play, out(s)", "In play, no out",
         "Foul Tip", "Missed Bunt", "Ball In Dirt"]
CODES = ["S", "C", "B", "F", "X", "T", "W", "D", "E", "L", "M"]
TRAJECTORIES = ["Ground Ball", "Fly Ball", "Line Drive", "ground_ball"]
HARDNESS = ["Hard", "Medium", "Soft"]


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pick(items, index: str) -> str:
    values = ", ".join("null" if x is None else f"'{x}'" for x in items)
    return f"element_at(array({values}), cast({index} as int) + 1)"


def schedule_raw(spark, d) -> DataFrame:
    """Four rows per game, one per order."""
    return read(spark, d, "orders").select(
        F.expr("cast(o_orderkey div 4 as string)").alias("gamepk"),
        F.col("o_orderdate").alias("game_datetime"),
        F.col("o_orderdate").alias("game_date"),
        F.expr("case o_orderstatus when 'P' then 'S' else 'R' end").alias("game_type"),
        F.expr("cast(o_custkey % 40 as string)").alias("venue_id"),
        F.expr("concat('t', (o_orderkey div 4) % 25)").alias("home_id"),
        F.expr("concat('t', ((o_orderkey div 4) % 25 + 1 + (o_orderkey div 100) % 24) % 25)").alias("away_id"),
        F.col("o_orderkey").alias("schedule_row"),
    )


def dealt(spark, d) -> int:
    """Number of partitions the pitches are dealt into by game."""
    return parts(read(spark, d, "lineitem"))


def pitches_raw(spark, d) -> DataFrame:
    """Pitch events without date, role or hand, as a feed would deliver them; dealt by game while the rows are still narrow."""
    n, game = dealt(spark, d), "cast({} div 4 as string) as gamepk"
    o = read(spark, d, "orders").filter("o_orderkey is not null").selectExpr(game.format("o_orderkey"), "struct(o_orderkey, o_custkey) as o")
    l = read(spark, d, "lineitem").selectExpr("*", game.format("l_orderkey"), "(l_linenumber + 1) div 2 as play")
    # a game's few orders in one row, so that the join needs no other key than the game
    x = l.repartition(n, "gamepk").join(o.repartition(n, "gamepk").groupBy("gamepk").agg(F.collect_list("o").alias("_o")), "gamepk")
    x = x.selectExpr("* except (_o)", "inline(filter(_o, o -> o.o_orderkey = l_orderkey))")
    at = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
          "l_linestatus", "l_shipdate"]
    # line numbers and plays rise together, so one sort serves both
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy("gamepk", "l_orderkey").orderBy("play", *at)))
    x = x.withColumn("pitch_number", F.row_number().over(Window.partitionBy("gamepk", "l_orderkey", "play").orderBy(*at)))
    tax, disc = "round(l_tax * 100)", "round(l_discount * 100)"
    home = "concat('t', (o_orderkey div 4) % 25)"
    away = "concat('t', ((o_orderkey div 4) % 25 + 1 + (o_orderkey div 100) % 24) % 25)"
    in_play = f"cast({tax} as int) in (4, 5)"
    return x.selectExpr(
        "gamepk",
        "cast((o_orderkey % 4) * 4 + play as int) as play_id",
        "cast((o_orderkey % 4) * 1000 + _n as int) as event_index",
        "pitch_number",
        "concat('b', o_custkey * 2 + o_orderkey % 2) as batter_id",
        "concat('Batter ', o_custkey) as batter_name",
        f"case when o_orderkey % 2 = 1 then {home} else {away} end as batter_team_id",
        "concat('p', l_suppkey * 2 + o_orderkey % 2) as pitcher_id",
        "concat('Pitcher ', l_suppkey) as pitcher_name",
        f"case when o_orderkey % 2 = 1 then {away} else {home} end as pitcher_team_id",
        "cast(1 + (o_orderkey % 4) * 2 + l_linenumber div 4 as int) as inning",
        "case when o_orderkey % 2 = 1 then 'bottom' else 'top' end as half_inning",
        "cast(l_partkey % 4 as int) as count_balls",
        "cast(l_suppkey % 3 as int) as count_strikes",
        "cast(l_linenumber % 3 as int) as count_outs",
        _pick(RESULTS, "l_quantity % 16") + " as play_result",
        _pick(EVENTS, "l_quantity % 16") + " as event_type",
        _pick(CALLS, tax) + " as pitch_call",
        _pick(CODES, disc) + " as pitch_call_code",
        "not (l_returnflag = 'A' and l_linenumber = 7) as is_pitch",
        f"{in_play} as is_in_play",
        f"cast({tax} as int) in (0, 1, 3, 6, 7) as is_strike",
        f"cast({tax} as int) in (2, 8) as is_ball",
        "cast(nullif(l_partkey % 15, 0) as int) as zone",
        "80 + nullif(l_quantity, 50) * 0.4D as start_speed",
        "74 + nullif(l_quantity, 50) * 0.4D - l_tax * 25 as end_speed",
        "5 + l_discount * 20 as extension",
        "l_extendedprice / 40 as spin_rate",
        "cast(l_suppkey % 21 - 10 as double) as pfx_x",
        "cast(l_partkey % 23 - 11 as double) as pfx_z",
        "cast(l_partkey % 19 - 9 as double) as break_horizontal",
        "cast(l_suppkey % 17 - 8 as double) as break_vertical_induced",
        "50 + l_discount * 30 as release_pos_y",
        "(l_partkey % 41 - 20) / 10.0D as plate_x",
        "(l_partkey % 37) / 10.0D as plate_z",
        "1.5D as strike_zone_bottom",
        "3.5D as strike_zone_top",
        f"case when {in_play} and l_partkey % 11 <> 0 then 60 + l_quantity end as launch_speed",
        f"case when {in_play} then cast(l_partkey % 90 - 30 as double) end as launch_angle",
        f"case when {in_play} and l_partkey % 13 <> 0 then {_pick(TRAJECTORIES, 'l_partkey % 4')} end as trajectory",
        f"case when {in_play} then {_pick(HARDNESS, 'l_suppkey % 3')} end as hardness",
    )


def players(spark, d) -> DataFrame:
    """Reference rows of both sides' batters and pitchers."""
    side = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    c = read(spark, d, "customer").select("*", side).select(
        F.expr("concat('b', c_custkey * 2 + side)").alias("person_id"),
        F.concat(F.lit("Batter "), F.col("c_custkey")).alias("player_name"),
        F.expr("case c_mktsegment when 'AUTOMOBILE' then 'L' when 'MACHINERY' then 'L' "
               "when 'HOUSEHOLD' then 'S' else 'R' end").alias("batSide"),
        F.lit("R").alias("pitchHand"),
        F.expr("concat(5 + c_custkey % 2, '\\' ', c_custkey % 12, '\"')").alias("height"),
        F.expr("160 + c_custkey % 90").cast("double").alias("weight"))
    s = read(spark, d, "supplier").select("*", side).select(
        F.expr("concat('p', s_suppkey * 2 + side)").alias("person_id"),
        F.concat(F.lit("Pitcher "), F.col("s_suppkey")).alias("player_name"),
        F.lit("R").alias("batSide"),
        F.expr("case when s_nationkey % 5 in (0, 1) then 'L' when s_nationkey % 5 = 4 then 'S' "
               "else 'R' end").alias("pitchHand"),
        F.expr("concat(6, '\\' ', s_suppkey % 12, '\"')").alias("height"),
        F.expr("170 + s_suppkey % 80").cast("double").alias("weight"))
    return c.unionByName(s)


def game_info(spark, d) -> DataFrame:
    """Raw weather text, several rows per game; games still pending are absent."""
    return read(spark, d, "orders").filter("o_orderstatus <> 'P'").select(
        F.expr("cast(o_orderkey div 4 as string)").alias("gamepk"), F.col("o_orderkey").alias("info_row"),
        F.expr("year(o_orderdate)").alias("game_season"),
        F.expr("case o_custkey % 4 when 0 then 'Clear' when 1 then 'Cloudy' when 2 then 'Dome' end")
        .alias("weather_condition"),
        F.expr("case when o_custkey % 7 = 0 then 'n/a' else concat(40 + o_custkey % 60, ' F') end")
        .alias("weather_temp"),
        F.expr("case when o_custkey % 5 = 0 then 'Calm' else concat(o_custkey % 20, ' mph, Out To ', "
               "o_orderstatus, 'F') end").alias("weather_wind"))


def pitches(spark, d, by: str | None = None) -> DataFrame:
    """The derived pitch table every pitch-level operator starts from; with by, dealt by that column of a bounded number of pitches."""
    from lagwell.operators import clean, pitches as P
    sched = clean.earliest_schedule(schedule_raw(spark, d), tie="schedule_row")
    return P.build_pitch_table(pitches_raw(spark, d), sched, players(spark, d), dealt=dealt(spark, d), by=by)


def _games(spark, d) -> DataFrame:
    from lagwell.operators import clean
    return (clean.earliest_schedule(schedule_raw(spark, d), tie="schedule_row")
            .select("gamepk", "game_date", "game_type", F.year("game_date").alias("game_season")))


def batter_box(spark, d) -> DataFrame:
    p = pitches_raw(spark, d)
    n = lambda cond: F.expr(f"sum(case when {cond} then 1 else 0 end)")
    box = p.groupBy("gamepk", F.col("batter_id").alias("personId"), F.col("batter_team_id").alias("team_id"),
                    F.col("batter_name").alias("player_name")).agg(
        F.count(F.lit(1)).alias("plate_appearances"),
        n("play_result is null or play_result not in ('Walk','Hit By Pitch','Sac Fly')").alias("ab"),
        n("play_result in ('Single','Double','Triple','Home Run')").alias("h"),
        n("play_result = 'Single'").alias("singles"), n("play_result = 'Double'").alias("doubles"),
        n("play_result = 'Triple'").alias("triples"), n("play_result = 'Home Run'").alias("hr"),
        n("play_result = 'Walk'").alias("bb"),
        n("play_result in ('Strikeout','Strikeout Double Play')").alias("k"),
        n("play_result in ('Home Run','Sac Fly')").alias("rbi"),
        n("play_result in ('Home Run','Triple')").alias("r"),
        n("count_outs = 2 and play_result = 'Single'").alias("lob"),
        n("count_strikes = 2 and play_result = 'Walk'").alias("sb"),
        n("play_result = 'Hit By Pitch'").alias("hbp"),
        F.max(F.expr("play_id % 9 * 100 + play_id % 2")).alias("_slot"))
    box = box.withColumn("total_bases_from_h", F.expr("singles + 2*doubles + 3*triples + 4*hr"))
    box = box.withColumn("total_bases", F.expr("total_bases_from_h + bb + sb"))
    box = box.withColumn("fantasy_points", F.expr("cast(3*singles + 5*doubles + 8*triples + 10*hr + 2*bb as double)"))
    box = box.withColumn("batting_order", F.expr("case when _slot % 100 = 0 then null else cast(_slot as string) end"))
    return box.drop("_slot").join(_games(spark, d), "gamepk", "left")


def pitcher_box(spark, d) -> DataFrame:
    p = pitches_raw(spark, d)
    n = lambda cond: F.expr(f"sum(case when {cond} then 1 else 0 end)")
    outs = n("play_result in ('Strikeout','Groundout','Flyout','Lineout','Sac Fly','Pop Out','Strikeout Double Play')")
    box = p.groupBy("gamepk", F.col("pitcher_id").alias("personId"), F.col("pitcher_team_id").alias("team_id"),
                    F.col("pitcher_name").alias("player_name")).agg(
        outs.alias("_o"),
        n("play_result in ('Single','Double','Triple','Home Run')").alias("h"),
        n("play_result in ('Home Run','Triple')").alias("r"), n("play_result = 'Home Run'").alias("er"),
        n("play_result = 'Walk'").alias("bb"),
        n("play_result in ('Strikeout','Strikeout Double Play')").alias("k"),
        n("play_result = 'Home Run'").alias("hr"), F.count(F.lit(1)).alias("p"),
        n("is_strike").alias("s"))
    box = box.withColumn("ip", F.expr("(_o div 3) + (_o % 3) / 10.0D")).drop("_o")
    return box.join(_games(spark, d), "gamepk", "left")
