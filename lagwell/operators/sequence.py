"""Pitch sequences per appearance and transition counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwell.plans.ranks import previous


def sequences(df: DataFrame, keys: list[str], order, value: str) -> DataFrame:
    """The ordered list of values per group; the list itself is the result."""
    order = [order] if isinstance(order, str) else list(order)
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, value))).alias("_s"))
    return g.select(*keys, F.transform("_s", lambda s: s[value]).alias("sequence"))


def transitions(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Counts of adjacent pairs, with START before the first and END after the last value.

    Long form (from, to, n); no list is built and a group may span many tasks, so its length does not matter.
    """
    d = previous(df.select(*keys, *order, value), keys, order, {"_prev": value})
    steps = d.select(F.coalesce("_prev", F.lit("START")).alias("from"), F.col(value).alias("to"))
    ends = df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("from")).select("from", F.lit("END").alias("to"))
    count = lambda x: x.groupBy("from", "to").agg(F.count(F.lit(1)).alias("n"))
    return count(steps).unionByName(count(ends))
