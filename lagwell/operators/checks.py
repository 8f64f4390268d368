"""Data contracts as tables of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rows(spark, rows):
    return spark.createDataFrame(rows, "check string, subject string, ok boolean, detail string")


def contract(df: DataFrame, required: dict[str, str], key: list[str] = (), max_null_rate: dict[str, float] | None = None,
             date: tuple[str, str] | None = None) -> DataFrame:
    """One row per check: columns and types, row count, key nulls, null rates, single date.

    Columns and types come from the schema; everything else from one pass over the data.
    """
    types = dict(df.dtypes)
    out = []
    for c, ty in required.items():
        have = types.get(c)
        out.append(("column", c, have is not None, "" if have else "absent"))
        if have:
            out.append(("type", c, have == ty, have))
    static = _rows(df.sparkSession, out)
    nulls = {c: r for c, r in (max_null_rate or {}).items() if c in types}
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count(F.when(F.col(k).isNull(), 1)).alias(f"_key_{k}") for k in key if k in types]
    aggs += [F.avg(F.col(c).isNull().cast("int")).alias(f"_null_{c}") for c in nulls]
    if date:
        aggs.append(F.count(F.when(F.col(date[0]).isNull() | (F.col(date[0]).cast("date") != F.lit(date[1]).cast("date")), 1)).alias("_date"))
    a = df.agg(*aggs)
    row = lambda kind, subject, ok, detail: F.struct(F.lit(kind).alias("check"), F.lit(subject).alias("subject"),
                                                     ok.alias("ok"), detail.cast("string").alias("detail"))
    items = [row("row_count", "table", F.col("_rows") > 0, F.col("_rows"))]
    items += [row("key_not_null", k, F.col(f"_key_{k}") == 0, F.col(f"_key_{k}")) for k in key if k in types]
    items += [row("null_rate", c, F.coalesce(F.col(f"_null_{c}") <= r, F.lit(False)), F.round(f"_null_{c}", 6)) for c, r in nulls.items()]
    if date:
        items.append(row("date", date[0], F.col("_date") == 0, F.col("_date")))
    return static.unionByName(a.select(F.inline(F.array(*items))))


def violations(findings: DataFrame) -> DataFrame:
    return findings.filter(~F.col("ok"))


def completeness(schedule: DataFrame, tables: dict[str, DataFrame], game: str = "gamepk") -> DataFrame:
    """Scheduled games absent from each table: (table, game)."""
    want = schedule.select(F.col(game).cast("string").alias(game)).distinct()
    gaps = [want.join(t.select(F.col(game).cast("string").alias(game)).distinct(), game, "left_anti")
            .select(F.lit(n).alias("table_name"), game) for n, t in tables.items()]
    return reduce(DataFrame.unionByName, gaps)


def games_processed(tables: dict[str, DataFrame], game: str = "gamepk") -> DataFrame:
    parts = [t.agg(F.countDistinct(game).alias("games")).select(F.lit(n).alias("table_name"), "games")
             for n, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def distinct_ids(sources: list[tuple[DataFrame, str]], name: str) -> DataFrame:
    """Every id of the (table, column) sources once, as text; each source is made distinct before they meet."""
    parts = [d.select(F.col(c).cast("string").alias(name)).distinct() for d, c in sources]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()
