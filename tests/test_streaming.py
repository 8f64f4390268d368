"""Lineup confirmation: the stream and the batch form agree; increments are idempotent."""

import datetime as dt

from conftest import rows
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagwell.streaming import increments as I
from lagwell.streaming import lineups as L
from lagwell.streaming.versions import Versions

DAY = dt.datetime(2024, 5, 1)


def snap(game, minute, complete):
    return (game, DAY + dt.timedelta(minutes=minute), DAY + dt.timedelta(minutes=100), complete)


DDL = "game_pk string, ts timestamp, cutoff timestamp, complete boolean"
LOOKS = [
    [snap("1", 10, False), snap("2", 10, False), snap("3", 10, True)],
    [snap("1", 50, True), snap("2", 50, False), snap("3", 55, False)],
    [snap("1", 90, True), snap("2", 130, True), snap("4", 131, False)],
    [snap("5", 400, False)],
]


def test_stream_matches_batch(spark, tmp_path):
    L.use_rocksdb(spark)
    src = tmp_path / "in"
    for i, batch in enumerate(LOOKS):
        spark.createDataFrame(batch, DDL).coalesce(1).write.mode("append").parquet(str(src))
    s = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = (L.stream(s).writeStream.format("memory").queryName("decided").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "cp")).start())
    q.processAllAvailable()
    q.stop()
    got = {r["game_pk"]: (r["state"], r["decided_at"]) for r in spark.table("decided").collect()}
    every = spark.createDataFrame([r for b in LOOKS for r in b], DDL)
    games = every.groupBy("game_pk").agg(F.min("cutoff").alias("cutoff"))
    want = {r["game_pk"]: (r["state"], r["decided_at"])
            for r in L.resolve(games, every, F.lit(DAY + dt.timedelta(minutes=400))).collect()}
    assert want["1"] == ("CONFIRMED", DAY + dt.timedelta(minutes=50))
    assert want["2"] == ("SKIPPED", DAY + dt.timedelta(minutes=100))
    assert want["3"] == ("CONFIRMED", DAY + dt.timedelta(minutes=10))
    for g in ("1", "2", "3"):
        assert got[g] == want[g]


def test_stream_decides_silent_games_late_snapshots_and_goes_on_after_a_restart(spark, tmp_path):
    L.use_rocksdb(spark)
    at = lambda m: DAY + dt.timedelta(minutes=m)
    cut = {"1": 100, "2": 100, "3": 100, "silent": 100, "later": 300, "never": 900}
    games = spark.createDataFrame([(g, at(m)) for g, m in cut.items()], "game_pk string, cutoff timestamp")
    looks = [[("1", 10, False), ("3", 95, True)], [("2", 120, True), ("1", 112, False)],
             [("1", 99, True), ("unknown", 121, True)],  # late, within the delay
             [("x", 200, None)], [("later", 290, True), ("x", 600, False)]]
    src, cp, ddl = tmp_path / "in", str(tmp_path / "cp"), "game_pk string, ts timestamp, complete boolean"
    got = {}
    for i, batch in enumerate(looks):
        spark.createDataFrame([(g, at(m), c) for g, m, c in batch], ddl).coalesce(1).write.mode("append").parquet(str(src))
        s = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(src))
        name = f"silent{i}"  # a new query over the same checkpoint each time: a restart
        q = (L.stream(s, games, "30 minutes").writeStream.format("parquet").option("path", str(tmp_path / "decided"))
             .outputMode("append").queryName(name).option("checkpointLocation", cp).trigger(availableNow=True).start())
        q.awaitTermination()
    for r in spark.read.parquet(str(tmp_path / "decided")).collect():
        assert r["game_pk"] not in got
        got[r["game_pk"]] = (r["state"], r["decided_at"])
    every = spark.createDataFrame([(g, at(m), c) for b in looks for g, m, c in b], ddl)
    want = {r["game_pk"]: (r["state"], r["decided_at"]) for r in L.resolve(games, every, F.lit(at(570))).collect() if r["state"] != "PENDING"}
    assert want["silent"] == ("SKIPPED", at(100)) and want["1"] == ("CONFIRMED", at(99)) and "never" not in want
    assert got == want


def test_pending_before_cutoff_and_document(spark):
    games = spark.createDataFrame([("1", DAY), ("2", DAY)], "game_pk string, cutoff timestamp")
    none = spark.createDataFrame([], "game_pk string, ts timestamp, complete boolean")
    r = L.resolve(games, none, F.lit(DAY - dt.timedelta(minutes=1)))
    assert {x["state"] for x in r.collect()} == {"PENDING"}
    doc = L.states_document(r.select("game_pk", "state"), "2024-05-01").first()
    assert doc["games"] == {"1": "PENDING", "2": "PENDING"}
    assert L.day_counts(r).first()["finished"] is False
    assert L.initial_states(spark.createDataFrame([], "game_pk bigint")).count() == 0


def test_both_sides_and_payload(spark):
    d = spark.createDataFrame([(1, [7, 9], [3]), (2, [], [3]), (3, None, [3])], "game_pk bigint, h array<bigint>, a array<bigint>")
    assert [r["ok"] for r in rows(d.select("game_pk", L.both_sides("h", "a").alias("ok")), "game_pk")] == [True, False, False]
    p = L.payload(d.filter("game_pk = 1").selectExpr(
        "game_pk", "'d' as date", "'t' as confirmed_at", "10L as home_team_id", "20L as away_team_id", "h as home_order",
        "a as away_order", "1L as home_pitcher_id", "2L as away_pitcher_id")).first()
    assert [(x["batting_order"], x["player_id"]) for x in p["home_lineup"]] == [(1, 7), (2, 9)]


def test_latest_rows_increment(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    ddl = "k string, t timestamp, v int"
    for batch in ([("a", DAY, 1), ("b", DAY, 2)], [("a", DAY + dt.timedelta(days=1), 3)]):
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(src)
        I.latest_rows(I.new_files(spark, src, ddl), ["k"], "t", out, cp).awaitTermination()
    assert [(r["k"], r["v"]) for r in rows(I.current(spark, out, ["k"], "t"), "k")] == [("a", 3), ("b", 2)]


def test_latest_rows_follow_versions_of_a_new_checkpoint_and_skip_replays(spark, tmp_path):
    ddl, out = "k string, t timestamp, v int", str(tmp_path / "out")
    for i, batch in enumerate(([("a", DAY, 1)], [("a", DAY + dt.timedelta(days=1), 5)], [("b", DAY, 7), ("a", DAY, 0)])):
        src = str(tmp_path / f"src{i}")
        spark.createDataFrame(batch, ddl).coalesce(1).write.parquet(src)
        for _ in range(2):  # the second start finds nothing new
            I.latest_rows(I.new_files(spark, src, ddl), ["k"], "t", out, str(tmp_path / f"cp{i}")).awaitTermination()
    assert [(r["k"], r["v"]) for r in rows(I.current(spark, out, ["k"], "t"), "k")] == [("a", 5), ("b", 7)]


def test_latest_rows_merge_by_level_and_old_folders_go(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    ddl, want, sizes = "k string, t timestamp, v int", {}, []
    for i in range(13):
        batch = [(f"k{j}", DAY + dt.timedelta(minutes=i if j else 0), i) for j in (0, i % 5 + 1, 100 + i)]
        for k, t, v in batch:
            want[k] = max(want.get(k, (t, v)), (t, v))
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(src)
        I.latest_rows(I.new_files(spark, src, ddl), ["k"], "t", out, cp, fan=3, tie=["v"]).awaitTermination()
        _, entries, _ = Versions(spark, out).newest()
        sizes.append(sorted((e.level, e.rows) for e in entries))
        assert all(sum(e.level == n for e in entries) < 3 for n in range(5))
    assert {r["k"]: (r["t"], r["v"]) for r in I.current(spark, out, ["k"], "t", ["v"]).collect()} == want
    assert sizes[0] == [(0, 3)] and max(n for n, _ in sizes[-1]) == 2
    left = [n for n in Versions(spark, out).names() if n.startswith("rows-")]
    assert len(left) < 9 and len([n for n in Versions(spark, out).names() if n.startswith("manifest-")]) == 2


def test_daily_increment_keeps_rows_of_earlier_batches(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    ddl = "k string, game_date timestamp_ntz"
    seen = lambda d: d.withColumn("n", F.count("*").over(W.partitionBy("k").orderBy("game_date").rowsBetween(W.unboundedPreceding, 0)))
    for batch in ([("a", DAY)], [("b", DAY)], [("a", DAY + dt.timedelta(days=1))]):
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(src)
        I.daily_increment(I.new_files(spark, src, ddl), seen, out, cp).awaitTermination()
    got = sorted((r["k"], r["game_date"].day, r["n"]) for r in I.dated(spark, out).collect())
    assert got == [("a", 1, 1), ("a", 2, 2), ("b", 1, 1)]


def test_daily_increment_replaces_dates(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    ddl = "k string, game_date timestamp_ntz"
    spark.createDataFrame([("a", DAY), ("b", DAY + dt.timedelta(days=1))], ddl).write.parquet(src)
    for cp in ("one", "two"):  # a second full run must not double the rows
        I.daily_increment(I.new_files(spark, src, ddl), lambda d: d, out, str(tmp_path / cp)).awaitTermination()
    assert I.dated(spark, out).count() == 2


def test_daily_increment_drops_emptied_dates_and_skips_replays(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    ddl = "k string, game_date timestamp_ntz, version int, live boolean"
    calls = []

    def transform(d):
        calls.append(1)
        last = d.groupBy("k", "game_date").agg(F.max_by("live", "version").alias("live"))
        return last.filter("live").select("k", "game_date")

    day = lambda n: DAY + dt.timedelta(days=n)
    for batch in ([("a", day(0), 1, True), ("b", day(1), 1, True), ("c", day(1), 1, True)], [("b", day(1), 2, False), ("c", day(1), 2, False)],
                  [("a", day(0), 2, False)], [("d", day(1), 1, True)]):
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(src)
        I.daily_increment(I.new_files(spark, src, ddl), transform, out, cp).awaitTermination()
        I.daily_increment(I.new_files(spark, src, ddl), transform, out, cp).awaitTermination()  # nothing new
        got = I.dated(spark, out, "k string, game_date timestamp_ntz")
        seen = sorted(r["k"] for r in got.collect())
        assert seen == {1: ["a", "b", "c"], 2: ["a"], 3: [], 4: ["d"]}[len(calls)]
    # the same epoch again, as after a crash between the batch's commit and the checkpoint's
    at = Versions(spark, out)
    version, entries, done = at.newest()
    I.daily_increment(I.new_files(spark, src, ddl), transform, out, str(tmp_path / "cp2")).awaitTermination()
    assert sorted(r["k"] for r in I.dated(spark, out).collect()) == ["d"] and at.newest()[0] == version + 1


def test_a_large_day_is_written_by_several_tasks(spark, tmp_path):
    import os
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.range(200_000).selectExpr("sha2(cast(id as string), 512) as k", "timestamp_ntz '2024-05-01' as game_date").write.parquet(src)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(2 << 20))
    try:
        I.daily_increment(I.new_files(spark, src, "k string, game_date timestamp_ntz"), lambda d: d, out, str(tmp_path / "cp")).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert I.dated(spark, out).count() == 200_000
    files = [f for p, _, fs in os.walk(out) for f in fs if f.endswith(".parquet") and "_day=" in p]
    assert len(files) > 1
