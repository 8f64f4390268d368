"""Sources and documents: seasons, snapshots, fallbacks, nested rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from harness import tables as t
from harness.registry import query
from lagwell.sources import tables as S
from lagwell.sources.schemas import conform


@query("scan_multi_season", ["status"], """
SELECT o_orderstatus AS status, o_orderkey, CAST(o_totalprice AS FLOAT) AS price, CAST(o_custkey AS DOUBLE) AS spin FROM orders""")
def scan_multi_season(spark, d):
    """Orders written season by season, one of which delivers a column as text, and read as one table."""
    from uuid import uuid4
    from lagwell.plans.scale import scratch
    o = t.read(spark, d, "orders").selectExpr("o_orderkey", "o_orderstatus AS status", "o_totalprice AS price", "o_custkey AS spin",
                                              "coalesce(year(o_orderdate), 0) AS game_season")
    at, cast = f"{scratch(spark)}/seasons-{uuid4().hex}", lambda df, ty: df.withColumn("spin", F.col("spin").cast(ty))
    S.write_season(cast(o.filter("game_season <> 1997"), "double"), f"{at}/orders")
    S.write_season(cast(o.filter("game_season = 1997"), "string"), f"{at}/orders")
    years = [r[0] for r in o.select("game_season").distinct().collect()]  # one row per season
    table = S.read_seasons(spark, at, "orders", [f"game_season={y}" for y in years], "o_orderkey bigint, status string, price float, spin double", {"spin": "double"})
    return table.select("status", "o_orderkey", "price", "spin")


@query("scan_latest_snapshot", ["event_type"], "SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY ALL")
def scan_latest_snapshot(spark, d):
    e = S.read_latest(spark, f"{d}/events.parquet")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))


@query("source_fallback", ["o_orderstatus"], """
SELECT o_custkey, o_orderstatus, count(*) AS n FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS r,
  min(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) OVER (PARTITION BY o_custkey, year(o_orderdate)) AS m FROM orders)
WHERE r = m GROUP BY ALL""")
def source_fallback(spark, d):
    o = t.read(spark, d, "orders").withColumn("season", F.year("o_orderdate"))
    picked = S.first_source([o.filter(F.col("o_orderstatus") == s) for s in ("F", "O", "P")], ["o_custkey", "season"])
    return picked.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("snapshot_slice", ["event_timestamp"], """
SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS event_timestamp FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1997-05-28'""")
def snapshot_slice(spark, d):
    s = S.snapshot(t.read(spark, d, "orders"), "1997-05-28", "o_orderdate")
    return s.select("o_orderkey", "o_totalprice", F.date_format("event_timestamp", "yyyy-MM-dd").alias("event_timestamp"))


@query("backfill_counts", ["date"], """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS "date", count(*) AS rows FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-04-01' AND TIMESTAMP '1997-09-30'
GROUP BY ALL""")
def backfill_counts(spark, d):
    return S.backfill(t.read(spark, d, "orders"), "1997-04-01", "1997-09-30", None, "o_orderdate")


@query("incremental_latest_ttl", ["event_type"], """
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events
WHERE ts <= TIMESTAMP '2024-01-20' AND ts > TIMESTAMP '2024-01-10' AND ts >= TIMESTAMP '2024-01-13') WHERE rn = 1""")
def incremental_latest_ttl(spark, d):
    e = t.read(spark, d, "events").withColumnRenamed("ts", "event_timestamp")
    return S.materialize(e, ["user_id"], "2024-01-10 00:00:00", "2024-01-20 00:00:00", 7, tie=["event_id"]).select(
        "user_id", "event_id", "event_type", "value")


@query("json_props", [], """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(json_extract(props, '$.k') AS INTEGER) * value AS kv FROM events""")
def json_props(spark, d):
    e = t.read(spark, d, "events").withColumn("p", F.from_json("props", "k int"))
    return e.select("event_id", F.col("p.k").alias("k"), (F.col("p.k") * F.col("value")).alias("kv"))


@query("json_round_trip", ["doc"], """
SELECT user_id, event_id, concat('{"k":', json_extract(props, '$.k'), ',"t":"', event_type, '"}') AS doc FROM events""")
def json_round_trip(spark, d):
    e = t.read(spark, d, "events").withColumn("p", F.from_json("props", "k int"))
    return e.select("user_id", "event_id", F.to_json(F.struct(F.col("p.k").alias("k"), F.col("event_type").alias("t"))).alias("doc"))


@query("nested_explode", ["id", "bookmaker", "market"], """
SELECT CAST(l_orderkey AS VARCHAR) AS id, concat('s', l_suppkey) AS bookmaker, l_linestatus AS market, l_extendedprice AS price, l_quantity AS point
FROM lineitem UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def nested_explode(spark, d):
    outcome = F.array(F.struct(F.lit("x").alias("name"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("point")))
    l = t.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(
        F.concat(F.lit("s"), "l_suppkey").alias("key"),
        F.array(F.struct(F.col("l_linestatus").alias("key"), outcome.alias("outcomes"))).alias("markets"))).alias("bookmakers"))
    o = t.read(spark, d, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").cast("string").alias("id"), F.lit("h").alias("home_team"), F.lit("a").alias("away_team"),
        F.lit("t").alias("commence_time"), "bookmakers")
    return S.odds_lines(o).select("id", "bookmaker", "market", "price", "point")


@query("nested_schedule", ["home_team_name", "game_time_utc", "status"], """
SELECT o_orderkey AS game_pk, o_custkey AS home_team_id, concat('team ', o_custkey) AS home_team_name,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS game_time_utc, o_orderstatus AS status FROM orders""")
def nested_schedule(spark, d):
    team = lambda k: F.struct(F.struct(F.col(k).alias("id"), F.concat(F.lit("team "), k).alias("name")).alias("team"))
    game = F.struct(F.col("o_orderkey").alias("gamePk"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("gameDate"),
                    F.struct(F.col("o_orderstatus").alias("detailedState")).alias("status"),
                    F.struct(team("o_custkey").alias("home"), team("o_custkey").alias("away")).alias("teams"),
                    F.struct(F.col("o_orderpriority").alias("name")).alias("venue"))
    api = t.read(spark, d, "orders").select(F.array(F.struct(F.lit("d").alias("date"), F.array(game).alias("games"))).alias("dates"))
    return S.schedule_rows(api).select("game_pk", "home_team_id", "home_team_name", "game_time_utc", "status")


@query("declared_fields", ["event_type"], "SELECT event_id, event_type FROM events")
def declared_fields(spark, d):
    return S.declared_fields(t.read(spark, d, "events"), "event_id bigint, event_type string, absent string")
