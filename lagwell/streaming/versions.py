"""Committed versions of a table: row folders and a manifest that lists them.

A batch writes its rows to a folder of its own and then a manifest; readers take the newest complete manifest, so a lost executor, a
half-written batch or a replay never shows. The manifest is a small Parquet table with one row per entry (key, folder, level, rows)
and the (run, epoch) pairs that are in it: a batch that is there already is not applied again. Versions follow the newest
manifest, whatever checkpoint the stream has. Folders that neither of the two newest manifests lists are removed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_DDL = "version bigint, key string, folder string, level int, rows bigint, run string, epoch bigint"


@dataclass(frozen=True)
class Entry:
    """One folder of rows. key: what part of the table it holds (a date); level: how often it was merged."""

    key: str
    folder: str
    level: int = 0
    rows: int = 0


class Versions:
    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str = "") -> list[str]:
        at = self._path(f"{self.out}/{folder}" if folder else self.out)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _numbers(self) -> list[int]:
        found = [n for n in self.names() if n.startswith("manifest-")]
        return sorted(int(n[9:]) for n in found if self._fs.exists(self._path(f"{self.out}/{n}/_SUCCESS")))

    def _read(self, number: int) -> tuple[list[Entry], dict[str, int]]:
        rows = self.spark.read.schema(_DDL).parquet(f"{self.out}/manifest-{number}").collect()
        entries = [Entry(r.key, r.folder, r.level, r.rows) for r in rows if r.folder is not None]
        return entries, {r.run: r.epoch for r in rows if r.run is not None}

    def newest(self) -> tuple[int, list[Entry], dict[str, int]]:
        """(version, entries, last epoch of each run); version -1 before the first commit."""
        numbers = self._numbers()
        return (numbers[-1], *self._read(numbers[-1])) if numbers else (-1, [], {})

    def commit(self, version: int, entries: list[Entry], done: dict[str, int]) -> None:
        rows = [(version, e.key, e.folder, e.level, e.rows, None, None) for e in entries]
        rows += [(version, None, None, None, None, run, epoch) for run, epoch in done.items()]
        self.spark.createDataFrame(rows, _DDL).coalesce(1).write.mode("overwrite").parquet(f"{self.out}/manifest-{version}")
        self.collect()

    def collect(self) -> None:
        """Remove what readers of the two newest versions don't need."""
        numbers = self._numbers()
        if not numbers:
            return
        used = {e.folder for n in numbers[-2:] for e in self._read(n)[0]}
        tops = {f.split("/")[0] for f in used}
        for n in self.names():
            if n.startswith("manifest-") and int(n[9:]) < numbers[max(0, len(numbers) - 2)]:
                self._fs.delete(self._path(f"{self.out}/{n}"), True)
            elif n.startswith("rows-") and int(n.split("-")[1]) <= numbers[-1]:
                if n not in tops:
                    self._fs.delete(self._path(f"{self.out}/{n}"), True)
                else:
                    for part in self.names(n):
                        if "=" in part and f"{n}/{part}" not in used and n not in used:
                            self._fs.delete(self._path(f"{self.out}/{n}/{part}"), True)

    def table(self, schema=None) -> DataFrame | None:
        """The rows of the newest version; an empty table once commits have removed all rows, None before the first."""
        version, entries, _ = self.newest()
        if not entries:
            return None if version < 0 or schema is None else self.spark.createDataFrame([], schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.out}/{e.folder}" for e in entries])
