"""Reading and writing dated tables, snapshots, summaries and documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwell.plans.scale import stage
from lagwell.sources.schemas import conform, struct


def root_of(base: str, env: str = "", table: str | None = None) -> str:
    """Storage root of an environment; player reference data is shared by all of them."""
    if not env or table == "player_info":
        return base
    return f"{base.rstrip('/')}/{env}"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, path: str, ddl: str | None = None, fmt: str = "parquet") -> DataFrame:
    """One stored object; a missing path names itself."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    if ddl and fmt != "parquet":
        return r.schema(ddl).load(path)
    df = r.load(path)
    return conform(df, ddl) if ddl else df


def read_or_empty(spark: SparkSession, path: str, ddl: str, fmt: str = "parquet") -> DataFrame:
    try:
        return read_table(spark, path, ddl, fmt)
    except FileNotFoundError:
        return spark.createDataFrame([], struct(ddl))


def read_season(spark: SparkSession, root: str, table: str, season, ddl: str | None = None) -> DataFrame:
    return read_table(spark, f"{root}/{table}/{season}", ddl)


def read_seasons(spark: SparkSession, root: str, table: str, seasons, ddl: str | None = None,
                 casts: dict[str, str] | None = None) -> DataFrame:
    """Several seasons as one table; seasons of one file schema are one scan, drifting columns are cast in each scan."""
    scans: dict[str, list[str]] = {}
    for s in seasons:
        path = f"{root}/{table}/{s}"
        if not exists(spark, path):
            raise FileNotFoundError(path)
        scans.setdefault(spark.read.parquet(path).schema.json(), []).append(path)  # from one footer
    parts = []
    for paths in scans.values():
        d = spark.read.parquet(*paths)
        d = d.withColumns({c: F.col(c).cast(ty) for c, ty in (casts or {}).items() if c in d.columns})
        parts.append(conform(d, ddl) if ddl else d)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_dates(df: DataFrame, path: str, date: str = "game_date") -> None:
    """Replace exactly the dates present in df, partitioned by year and date; a large date is spread over several tasks.

    A date that df no longer holds keeps its rows; `streaming.increments.daily_increment` replaces those as well.
    """
    d = df.withColumns({"year": F.year(date), "date_key": F.date_format(date, "yyyy-MM-dd")})
    (d.hint("rebalance", "year", "date_key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("year", "date_key").parquet(path))


def write_season(df: DataFrame, path: str, season: str = "game_season") -> None:
    """Replace the seasons present in df."""
    (df.withColumn(season, F.col(season).cast("int")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(season).parquet(path))


def snapshot(df: DataFrame, date: str, col: str = "game_date") -> DataFrame:
    """One date's rows, stamped with the time they become valid."""
    d = df.filter(F.col(col).cast("date") == F.lit(date).cast("date"))
    return d.withColumn("event_timestamp", F.col(col).cast("timestamp_ntz"))


def write_snapshot(df: DataFrame, path: str) -> str:
    """Write a snapshot; 'empty' writes nothing. Its rows are computed once and staged."""
    rows = stage(df)
    if rows.isEmpty():
        return "empty"
    write_dates(rows, path, "event_timestamp")
    return "ok"


def backfill(df: DataFrame, start: str, end: str, path: str | None = None, col: str = "game_date") -> DataFrame:
    """Write every date of a season window in one job; without a path only count them."""
    d = df.filter(F.col(col).cast("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    d = d.withColumn("event_timestamp", F.col(col).cast("timestamp_ntz"))
    if path:
        write_dates(d, path, "event_timestamp")
    return d.groupBy(F.date_format(col, "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("rows"))


def newest_file(spark: SparkSession, path: str) -> str:
    """The most recently modified file under a path, ties by name, from the file system's listing alone."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    files, best = fs.listFiles(at, True), None
    while files.hasNext():
        f = files.next()
        if f.getPath().getName()[0] not in "._":
            here = (f.getModificationTime(), f.getPath().toString())
            best = here if best is None or here > best else best
    if best is None:
        raise FileNotFoundError(f"no file under {path}")
    return best[1]


def read_latest(spark: SparkSession, path: str, ddl: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Rows of the most recently modified file under a path; only that file is opened."""
    r = spark.read.format(fmt)
    return (r.schema(ddl) if ddl else r).load(newest_file(spark, path))


def first_source(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the first source that has the key, in order of preference.

    The preferred rank per key is found by aggregation, so a key with many rows stays spread.
    """
    tagged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                    [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)])
    best = tagged.groupBy(*keys).agg(F.min("source_rank").alias("source_rank"))
    return tagged.join(best, [*keys, "source_rank"], "left_semi")


def latest_per_key(df: DataFrame, keys: list[str], time: str, tie: list[str] = ()) -> DataFrame:
    """The newest row per key."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(time, *tie)).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def materialize(features: DataFrame, keys: list[str], since: str | None, until: str, ttl_days: int = 7,
                time: str = "event_timestamp", tie: list[str] = ()) -> DataFrame:
    """Latest row per key that became valid in (since, until] and has not expired at until."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    d = features.filter(F.col(time) <= at(until))
    if since:
        d = d.filter(F.col(time) > at(since))
    d = d.filter(F.col(time) >= at(until) - F.expr(f"INTERVAL {int(ttl_days)} DAYS"))
    return latest_per_key(d, keys, time, tie)


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], time: str | None = None) -> DataFrame:
    """Keep known keys as they are and add new ones once; with a time the newest row wins."""
    if time is None:
        rest = [c for c in incoming.columns if c not in keys]
        once = incoming.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")
        return current.unionByName(once.join(current.select(*keys), keys, "left_anti"))
    return latest_per_key(current.unionByName(incoming), keys, time)


def monthly_quota(calls: DataFrame, time: str, limit: int, warn_at: float = 0.9) -> DataFrame:
    """Calls per month with warn and stop flags."""
    g = calls.groupBy(F.date_format(time, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("used"))
    return g.withColumns({"warn": F.col("used") >= warn_at * limit, "stop": F.col("used") >= limit})


def odds_lines(odds: DataFrame) -> DataFrame:
    """Nested bookmakers and markets to one row per outcome; games without any stay."""
    d = odds.select("id", "home_team", "away_team", "commence_time", F.explode_outer("bookmakers").alias("b"))
    d = d.select("id", "home_team", "away_team", "commence_time", F.col("b.key").alias("bookmaker"), F.explode_outer("b.markets").alias("m"))
    d = d.select("id", "home_team", "away_team", "commence_time", "bookmaker", F.col("m.key").alias("market"),
                 F.explode_outer("m.outcomes").alias("o"))
    return d.select("id", "home_team", "away_team", "commence_time", "bookmaker", "market", "o.*")


def schedule_rows(api: DataFrame) -> DataFrame:
    """Schedule documents (dates of games) to one row per game."""
    g = api.select(F.explode("dates").alias("d")).select(F.explode("d.games").alias("g"))
    return g.select(
        F.col("g.gamePk").alias("game_pk"), F.col("g.teams.home.team.id").alias("home_team_id"),
        F.col("g.teams.away.team.id").alias("away_team_id"), F.col("g.teams.home.team.name").alias("home_team_name"),
        F.col("g.teams.away.team.name").alias("away_team_name"), F.col("g.gameDate").alias("game_time_utc"),
        F.col("g.venue.name").alias("venue_name"), F.col("g.status.detailedState").alias("status"))


def legacy_schedule(df: DataFrame) -> DataFrame:
    """Older schedule files in the shape of the current rows."""
    return df.select(F.col("game_id").cast("bigint").alias("game_pk"), F.col("home_name").alias("home_team_name"),
                     F.col("away_name").alias("away_team_name"), F.col("game_datetime").alias("game_time_utc"),
                     "venue_name", "status")


def declared_fields(df: DataFrame, ddl: str) -> DataFrame:
    """Only the declared fields of a wider record."""
    return df.select(*[f.name for f in struct(ddl).fields if f.name in df.columns])


def status_row(spark: SparkSession, **fields) -> DataFrame:
    """One run-status record."""
    from lagwell.sources.schemas import RUN_STATUS

    s = struct(RUN_STATUS)
    return spark.createDataFrame([tuple(fields.get(f.name) for f in s.fields)], s)


def append_status(status: DataFrame, path: str) -> None:
    status.write.mode("append").partitionBy("function_name").json(path)


def write_report(bins: DataFrame, metrics: DataFrame, path: str) -> None:
    """Calibration table as CSV and metrics as Parquet."""
    bins.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/calibration")
    metrics.write.mode("append").parquet(f"{path}/metrics")


