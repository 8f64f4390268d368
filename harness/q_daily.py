"""Daily views and incremental operators over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness import tables as t
from harness.oracle import cte
from harness.registry import query
from lagwell.functions.text import local_clock, numbered
from lagwell.plans import jobs as JB
from lagwell.sources import tables as S
from lagwell.streaming import lineups as L

# a user's day is a game; its start depends on the user, an event is a look at its lineup
cte("day_games", (), """
SELECT user_id AS game_pk, CAST(ts AS DATE) AS d, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 HOUR * (14 + user_id % 8) AS start
FROM events GROUP BY ALL""")
cte("day_cut", ("day_games",), "SELECT d, min(start) - INTERVAL 30 MINUTE AS cutoff FROM day_games GROUP BY d")


def _games(spark, d):
    e = t.read(spark, d, "events")
    return e.select(F.col("user_id").alias("game_pk"), F.to_date("ts").alias("d")).distinct().withColumn(
        "start", F.col("d").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (14 + F.col("game_pk") % 8).cast("int")))


def _looks(spark, d):
    e = t.read(spark, d, "events")
    return e.select(F.col("user_id").alias("game_pk"), F.to_date("ts").alias("d"), "ts",
                    (F.col("event_type").isin("click", "purchase") & (F.col("value") > 10)).alias("complete"))


@query("lineup_state_batch", ["d", "state", "decided_at"], """
SELECT g.game_pk, CAST(g.d AS VARCHAR) AS d, CASE WHEN f.at IS NOT NULL THEN 'CONFIRMED' WHEN c.cutoff <= TIMESTAMP '2024-01-20 12:00:00'
  THEN 'SKIPPED' ELSE 'PENDING' END AS state,
  strftime(CASE WHEN f.at IS NOT NULL THEN f.at WHEN c.cutoff <= TIMESTAMP '2024-01-20 12:00:00' THEN c.cutoff END, '%Y-%m-%d %H:%M:%S') AS decided_at
FROM day_games g JOIN day_cut c ON g.d = c.d LEFT JOIN (
  SELECT e.user_id, CAST(e.ts AS DATE) AS d, min(e.ts) AS at FROM events e JOIN day_cut c ON CAST(e.ts AS DATE) = c.d
  WHERE e.event_type IN ('click','purchase') AND e.value > 10 AND e.ts < c.cutoff AND e.ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY ALL) f
ON g.game_pk = f.user_id AND g.d = f.d""", ["day_games", "day_cut"])
def lineup_state_batch(spark, d):
    g = _games(spark, d)
    g = g.join(F.broadcast(L.cutoffs(g, "d", "start")), "d")  # one cutoff per day
    r = L.resolve(g.select("game_pk", "d", "cutoff"), _looks(spark, d), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"), ["game_pk", "d"])
    return r.select("game_pk", F.col("d").cast("string").alias("d"), "state", F.date_format("decided_at", "yyyy-MM-dd HH:mm:ss").alias("decided_at"))


@query("lineup_day_counts", ["d", "finished"], """
SELECT CAST(d AS VARCHAR) AS d, count(*) AS scheduled, count(*) FILTER (c) AS confirmed, count(*) FILTER (NOT c) AS skipped, true AS finished FROM (
  SELECT g.game_pk, g.d, coalesce(bool_or(e.ts < c.cutoff AND e.event_type IN ('click','purchase') AND e.value > 10), false) AS c
  FROM day_games g JOIN day_cut c ON g.d = c.d LEFT JOIN events e ON e.user_id = g.game_pk AND CAST(e.ts AS DATE) = g.d GROUP BY ALL)
GROUP BY d""", ["day_games", "day_cut"])
def lineup_day_counts(spark, d):
    g = _games(spark, d)
    g = g.join(F.broadcast(L.cutoffs(g, "d", "start")), "d")
    r = L.resolve(g.select("game_pk", "d", "cutoff"), _looks(spark, d), F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"), ["game_pk", "d"])
    return L.day_counts(r.withColumn("d", F.col("d").cast("string")), ["d"])


@query("lineup_array", ["role", "text_len"], """
SELECT conv_id, role, batting_order, CAST(length(text) AS VARCHAR) AS text_len FROM (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS batting_order FROM conversations)""")
def lineup_array(spark, d):
    c = t.read(spark, d, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("o"))
    return c.select("conv_id", F.explode(numbered(F.col("o"), "x")).alias("x")).select(
        "conv_id", "x.batting_order", F.col("x.x.role").alias("role"), F.col("x.x.n").cast("string").alias("text_len"))


@query("utc_to_local", ["local"], """
SELECT event_id, ltrim(strftime(ts - INTERVAL 6 HOUR, '%I:%M %p'), '0') AS local FROM events""")
def utc_to_local(spark, d):
    return t.read(spark, d, "events").select("event_id", local_clock("ts").alias("local"))


@query("slate_view", ["away_team", "home_team", "game_time_utc", "game_time_ct", "venue", "lineup_status", "has_odds"], """
SELECT o_orderkey AS game_pk, concat('A', o_custkey % 30) AS away_team, concat('H', o_custkey % 40) AS home_team,
  strftime(o_orderdate + INTERVAL 1 HOUR * (o_custkey % 24), '%Y-%m-%dT%H:%M:%SZ') AS game_time_utc,
  ltrim(strftime(o_orderdate + INTERVAL 1 HOUR * (o_custkey % 24) - INTERVAL 1 HOUR * CASE WHEN o_orderdate + INTERVAL 1 HOUR * (o_custkey % 24) >= spring AND o_orderdate + INTERVAL 1 HOUR * (o_custkey % 24) < autumn THEN 5 ELSE 6 END, '%I:%M %p'), '0') AS game_time_ct,
  o_orderpriority AS venue, CASE o_orderstatus WHEN 'F' THEN 'CONFIRMED' WHEN 'O' THEN 'SKIPPED' ELSE 'PENDING' END AS lineup_status,
  (concat('H', o_custkey % 40), concat('A', o_custkey % 30)) IN (SELECT (concat('H', c_custkey % 40), concat('A', c_custkey % 30)) FROM customer
     WHERE c_mktsegment = 'BUILDING') AS has_odds, CAST(NULL AS DOUBLE) AS prediction
FROM (SELECT *, make_timestamp(year(o_orderdate), 4, 1, 8, 0, 0) + INTERVAL 1 DAY * ((7 - dayofweek(make_date(year(o_orderdate), 4, 1))) % 7) AS spring,
  make_timestamp(year(o_orderdate), 10, 31, 7, 0, 0) - INTERVAL 1 DAY * dayofweek(make_date(year(o_orderdate), 10, 31)) AS autumn FROM orders)""")
def slate_view(spark, d):
    o = t.read(spark, d, "orders")
    s = o.selectExpr("o_orderkey as game_pk", "concat('A', o_custkey % 30) as away_team_name", "concat('H', o_custkey % 40) as home_team_name",
                     "date_format(o_orderdate + make_dt_interval(0, cast(o_custkey % 24 as int)), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") as game_time_utc",
                     "o_orderpriority as venue_name")
    states = o.filter("o_orderstatus <> 'P'").selectExpr(
        "o_orderkey as game_pk", "case o_orderstatus when 'F' then 'CONFIRMED' else 'SKIPPED' end as state")
    odds = t.read(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").selectExpr(
        "concat('H', c_custkey % 40) as home_team", "concat('A', c_custkey % 30) as away_team")
    return JB.slate(s, states, odds)


STATUSES = """(SELECT event_type AS function_name, strftime(ts, '%Y-%m-%d') AS run_date, strftime(ts, '%Y-%m-%d %H:%M:%S') AS completed_at,
  value AS duration_seconds, CASE WHEN value > 40 THEN 'failed' END AS error, event_id FROM events)"""
JOBS = [("click", "Clicks", "yesterday"), ("view", "Views", "today"), ("error", "Errors", "yesterday"), ("absent", "Absent", "today")]


def _cards(spark, d):
    e = t.read(spark, d, "events").select(
        F.col("event_type").alias("function_name"), F.date_format("ts", "yyyy-MM-dd").alias("run_date"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("completed_at"), F.col("value").alias("duration_seconds"),
        F.when(F.col("value") > 40, "failed").alias("error"))
    return JB.pipeline_cards(e, "2024-01-31", JOBS)


CARDS_SQL = f"""
SELECT j.function_name, j.title, s.run_date, s.completed_at, s.duration_seconds,
  coalesce(s.run_date <> CASE j.due WHEN 'yesterday' THEN '2024-01-30' ELSE '2024-01-31' END, true) AS is_stale,
  CASE WHEN s.run_date IS NULL THEN concat('no status for ', j.function_name) ELSE s.error END AS error
FROM (VALUES ('click', 'Clicks', 'yesterday'), ('view', 'Views', 'today'), ('error', 'Errors', 'yesterday'), ('absent', 'Absent', 'today'))
  j(function_name, title, due)
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY function_name ORDER BY run_date DESC, completed_at DESC) AS rn FROM {STATUSES})
  WHERE rn = 1) s ON j.function_name = s.function_name"""


@query("status_view", ["function_name", "title", "run_date", "completed_at", "is_stale", "error"], CARDS_SQL)
def status_view(spark, d):
    return _cards(spark, d)


@query("status_summary", [], f"""
SELECT count(*) FILTER (NOT is_stale AND coalesce(error, '') = '') AS ok_count, count(*) FILTER (is_stale) AS stale_count FROM ({CARDS_SQL})""")
def status_summary(spark, d):
    return JB.pipeline_summary(_cards(spark, d))


@query("staleness", ["run_date", "is_stale"], """
SELECT strftime(ts, '%Y-%m-%d') AS run_date, strftime(ts, '%Y-%m-%d') <> '2024-01-29' AS is_stale, count(*) AS n FROM events GROUP BY ALL""")
def staleness(spark, d):
    e = t.read(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("run_date"))
    due = F.date_sub(F.lit("2024-01-30").cast("date"), 1)
    return e.groupBy("run_date", (F.col("run_date").cast("date") != due).alias("is_stale")).agg(F.count(F.lit(1)).alias("n"))


@query("quota_month", ["month", "warn", "stop"], """
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS used, count(*) >= 0.9 * 180 AS warn, count(*) >= 180 AS stop FROM orders GROUP BY ALL""")
def quota_month(spark, d):
    return S.monthly_quota(t.read(spark, d, "orders"), "o_orderdate", 180)


@query("upsert_latest", ["event_type"], """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1""")
def upsert_latest(spark, d):
    e = t.read(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    early, late = e.filter("ts < '2024-01-15'"), e.filter("ts >= '2024-01-15'")
    return S.upsert(early, late, ["user_id"], "ts").select("user_id", "event_id", "event_type")


@query("upsert_new_only", ["c_name"], """
SELECT c_custkey, c_name FROM customer WHERE c_nationkey < 10 UNION ALL
SELECT DISTINCT o_custkey, 'new' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)""")
def upsert_new_only(spark, d):
    known = t.read(spark, d, "customer").filter("c_nationkey < 10").select("c_custkey", "c_name")
    seen = t.read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit("new").alias("c_name"))
    return S.upsert(known, seen, ["c_custkey"])


# ---- increments: arrivals written as files, run through the streams, read back ----------

def _arrivals(spark, batches):
    """A folder that batches are written to one after another, and a stand-in for the table and its checkpoint."""
    from uuid import uuid4
    from lagwell.plans.scale import scratch
    at = f"{scratch(spark)}/arrivals-{uuid4().hex}"
    for i, batch in enumerate(batches):
        batch.write.mode("append").parquet(f"{at}/in")
        yield i, f"{at}/in", f"{at}/out", f"{at}/checkpoint"


@query("increment_dates", ["day"], """
SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS day, count(*) AS n, sum(o_totalprice) AS total FROM orders
WHERE month(o_orderdate) <> 2 AND o_orderkey % 7 <> 0 GROUP BY ALL""")
def increment_dates(spark, d):
    """Orders of a month count on its first day; later some are cancelled, and all of each February, so that these days go."""
    from lagwell.streaming import increments as I
    o = t.read(spark, d, "orders").selectExpr("o_orderkey", "cast(date_trunc('month', o_orderdate) as timestamp_ntz) as game_date", "o_totalprice", "1 as version", "true as live")
    gone = o.filter("month(game_date) = 2 OR o_orderkey % 7 = 0").withColumns({"version": F.lit(2), "live": F.lit(False)})

    def days(rows):
        last = rows.groupBy("o_orderkey", "game_date").agg(F.max_by(F.struct("live", "o_totalprice"), "version").alias("x")).filter("x.live")
        return last.groupBy("game_date").agg(F.count(F.lit(1)).alias("n"), F.sum("x.o_totalprice").alias("total"))

    for _, src, out, checkpoint in _arrivals(spark, [o, gone]):
        I.daily_increment(I.new_files(spark, src, o.schema.simpleString()[7:-1].replace(":", " ")), days, out, checkpoint, source=lambda src=src: spark.read.parquet(src)).awaitTermination()
    table = I.dated(spark, out, "game_date timestamp_ntz, n bigint, total double")
    return table.groupBy(F.date_format("game_date", "yyyy-MM-dd").alias("day")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("increment_latest", ["event_type"], """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def increment_latest(spark, d):
    """Events arrive in five batches, mixed in time; the newest of each user is kept."""
    from lagwell.streaming import increments as I
    e = t.read(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    ddl = "user_id bigint, event_id bigint, event_type string, ts timestamp_ntz"
    for _, src, out, checkpoint in _arrivals(spark, [e.filter(F.pmod(F.xxhash64("event_id"), F.lit(5)) == i) for i in range(5)]):
        I.latest_rows(I.new_files(spark, src, ddl), ["user_id"], "ts", out, checkpoint, fan=3, tie=["event_id"]).awaitTermination()
    return I.current(spark, out, ["user_id"], "ts", ["event_id"]).select("user_id", "event_id", "event_type")


@query("snapshot_latest_file", ["o_orderstatus"], "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 2")
def snapshot_latest_file(spark, d):
    """Three files arrive; the newest is read."""
    o = t.read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    for _, src, _, _ in _arrivals(spark, [o.filter(F.col("o_orderkey") % 3 == i).coalesce(1) for i in range(3)]):
        pass
    return S.read_latest(spark, src)
