"""Incremental file streams: new dates in, replaced dates or latest rows out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwell.sources.tables import latest_per_key
from lagwell.streaming.versions import Entry, Versions


def new_files(spark: SparkSession, path: str, ddl: str, fmt: str = "parquet") -> DataFrame:
    out = spark.readStream.format(fmt).schema(ddl).option("recursiveFileLookup", True).load(path)
    out.opened = (path, fmt)
    return out


def daily_increment(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
                    date: str = "game_date", source: Callable[[], DataFrame] | None = None, history: str | None = None):
    """Recompute and replace the dates of the rows that arrived; then stop.

    The batch only names the dates. Their rows, and those before them that the transform's frames need (since `history`, an
    interval such as "400 days"; all earlier rows by default), are read from `source`, the table at rest, which
    holds the arrived files as well. source defaults to the files the stream itself reads.

    The table is versioned (`dated` reads it): a batch writes the rows of its dates to a new folder and commits a manifest in which each
    of its dates points there. A date for which the transform yields no rows any more is left out of the manifest, so its old rows
    are gone; dates the batch doesn't name keep their folder. A repeated batch is not applied twice. A day's rows are spread
    over as many tasks as its size asks for.
    """
    at_rest = source or _files_of(stream)

    def replace(batch: DataFrame, epoch: int) -> None:
        at = Versions(batch.sparkSession, out)
        version, entries, done = at.newest()
        if done.get(checkpoint, -1) >= epoch:
            return
        days = [r[0] for r in batch.select(F.to_date(date)).distinct().collect() if r[0] is not None]  # the dates of one batch
        if days:
            day, first = F.to_date(F.col(date)), F.lit(min(days))
            rows = at_rest().filter(day <= F.lit(max(days)))
            if history is not None:
                rows = rows.filter(day >= (first.cast("timestamp_ntz") - F.expr(f"INTERVAL {history}")).cast("date"))
            rows = transform(rows).filter(F.to_date(date).isin(days)).withColumn("_day", F.date_format(date, "yyyy-MM-dd"))
            folder = f"rows-{version + 1}"
            rows.hint("rebalance", "_day").write.mode("overwrite").partitionBy("_day").parquet(f"{out}/{folder}")
            found = {n.removeprefix("_day=") for n in at.names(folder) if n.startswith("_day=")}
            touched = {d.isoformat() for d in days}
            entries = [e for e in entries if e.key not in touched]
            entries += [Entry(d, f"{folder}/_day={d}") for d in sorted(touched & found)]
        at.commit(version + 1, entries, {**done, checkpoint: epoch})

    return (stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
            .foreachBatch(replace).start())


def dated(spark: SparkSession, out: str, schema=None) -> DataFrame | None:
    """The newest complete version of a table kept by `daily_increment`."""
    return Versions(spark, out).table(schema)


def _files_of(stream: DataFrame) -> Callable[[], DataFrame]:
    """A batch reader of the folder and format that `new_files` opened."""
    spark, schema = stream.sparkSession, stream.schema
    opened = getattr(stream, "opened", None)
    if opened is None:
        raise ValueError("name the source table of a stream that new_files didn't open")
    path, fmt = opened
    return lambda: spark.read.format(fmt).schema(schema).option("recursiveFileLookup", True).load(path)


FAN = 8


def latest_rows(stream: DataFrame, keys: list[str], time: str, out: str, checkpoint: str, fan: int = FAN, tie: list[str] = ()):
    """Keep the newest row per key in a versioned table, batch by batch; `current` reads it.

    A batch writes its own newest rows, and nothing else, as a folder of level 0. When a level has `fan` folders they are merged
    into one of the next level, newest row per key. So a batch rewrites what it brings, and over time each row is
    rewritten once per level, whose number is the logarithm of the batches. Merged folders are removed once two newer versions
    don't list them. Equal times are decided by `tie`.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        at = Versions(spark, out)
        version, entries, done = at.newest()
        if done.get(checkpoint, -1) >= epoch:
            return
        new, part = [], 0

        def write(rows: DataFrame, level: int) -> None:
            nonlocal part
            folder = f"rows-{version + 1}-{part}"
            part += 1
            latest_per_key(rows, keys, time, tie).write.mode("overwrite").parquet(f"{out}/{folder}")
            count = spark.read.parquet(f"{out}/{folder}").count()  # from the footers
            if count:
                new.append(Entry("", folder, level, count))

        write(batch, 0)
        level, listed = 0, [*entries, *new]
        while sum(e.level == level for e in listed) >= fan:
            full = [e for e in listed if e.level == level]
            new = []
            write(spark.read.schema(batch.schema).parquet(*[f"{out}/{e.folder}" for e in full]), level + 1)
            listed = [e for e in listed if e.level != level] + new
            level += 1
        at.commit(version + 1, listed, {**done, checkpoint: epoch})

    return (stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
            .foreachBatch(merge).start())


def current(spark: SparkSession, out: str, keys: list[str], time: str, tie: list[str] = ()) -> DataFrame | None:
    """The newest row per key of a table kept by `latest_rows`."""
    rows = Versions(spark, out).table()
    return None if rows is None else latest_per_key(rows, keys, time, tie)


def stamp(df: DataFrame, time: str = "game_date") -> DataFrame:
    return df.withColumn("event_timestamp", F.col(time).cast("timestamp_ntz"))
