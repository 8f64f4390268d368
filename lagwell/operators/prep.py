"""Model-frame preparation: indicators, imputation, encoding, scaling, time splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagwell.plans.ranks import exact_quantiles, numbered
from lagwell.plans.scale import one_row, small_side

MISSING = "missing"


def null_flags(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row saying which columns hold a NULL."""
    return df.agg(*[F.coalesce(F.max(F.col(c).isNull()), F.lit(False)).alias(c) for c in cols])


def columns_with_nulls(df: DataFrame, cols: list[str]) -> list[str]:
    """Names of the columns holding a NULL, from one aggregated row."""
    row = null_flags(df, cols).first()
    return [c for c in cols if row[c]]


def add_missing_indicators(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select("*", *[F.col(c).isNull().alias(f"{c}_isnull") for c in cols])


def medians(train: DataFrame, cols: list[str]) -> DataFrame:
    """One row of exact medians; a column without values gets 0."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])
    q = exact_quantiles(train.select(F.inline(items)), "v", [0.5], ["column"])
    return q.agg(*[F.coalesce(F.max(F.when(F.col("column") == c, F.col("value"))), F.lit(0.0)).alias(f"_m_{c}") for c in cols])


def impute_median(train: DataFrame, others: list[DataFrame], cols: list[str]) -> list[DataFrame]:
    """Fill train and the other frames with the training medians."""
    m = medians(train, cols)
    fill = lambda d: d.crossJoin(one_row(m)).select(
        *[F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")).alias(c) if c in cols else F.col(c) for c in d.columns])
    return [fill(d) for d in [train, *others]]


def impute_mode(train: DataFrame, others: list[DataFrame], cols: list[str]) -> list[DataFrame]:
    """Fill with the most frequent training value, the smallest on a tie."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols])
    n = train.select(F.inline(items)).filter("v is not null").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("column").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))
    m = best.agg(*[F.max(F.when(F.col("column") == c, F.col("v"))).alias(f"_m_{c}") for c in cols])
    fill = lambda d: d.crossJoin(one_row(m)).select(
        *[F.coalesce(F.col(c).cast("string"), F.col(f"_m_{c}")).alias(c) if c in cols else F.col(c) for c in d.columns])
    return [fill(d) for d in [train, *others]]


def category_codes(train: DataFrame, cols: list[str]) -> DataFrame:
    """(column, category, code): 0-based place in the sorted training categories."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("category"))
                      for c in cols])
    d = numbered(train.select(F.inline(items)).distinct(), ["column", "category"])
    first = d.groupBy("column").agg(F.min("number").alias("_first"))  # one row per column
    return d.join(F.broadcast(first), "column").select("column", "category", (F.col("number") - F.col("_first")).alias("code"))


def encode(train: DataFrame, others: list[DataFrame], cols: list[str]) -> list[DataFrame]:
    """Ordinal codes fitted on train; categories it never saw become -1."""
    codes = category_codes(train, cols)

    def apply(d):
        for c in cols:
            m = codes.filter(F.col("column") == c).select(F.col("category").alias("_c"), F.col("code").cast("double").alias("_v"))
            d = d.join(small_side(m), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) == F.col("_c"), "left")
            d = d.withColumn(c, F.coalesce("_v", F.lit(-1.0))).drop("_c", "_v")
        return d

    return [apply(d) for d in [train, *others]]


def impute_and_encode(train: DataFrame, val: DataFrame, num: list[str], cat: list[str]) -> tuple[DataFrame, DataFrame]:
    frames = [train, val]
    if num:
        frames = impute_median(frames[0], frames[1:], num)
    if cat:
        frames = encode(frames[0], frames[1:], cat)
    return frames[0], frames[1]


def standardize(train: DataFrame, others: list[DataFrame], cols: list[str]) -> list[DataFrame]:
    """(x - mean) / population deviation of train; constant columns keep their distance."""
    s = train.agg(*[F.avg(c).alias(f"_a_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])

    def apply(d):
        z = {c: (F.col(c) - F.col(f"_a_{c}")) / F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}")) for c in cols}
        return d.crossJoin(one_row(s)).select(*[z[c].alias(c) if c in cols else F.col(c) for c in d.columns])

    return [apply(d) for d in [train, *others]]


def split_seasons(df: DataFrame, fit, val, season: str = "game_season") -> tuple[DataFrame, DataFrame]:
    """Fit and validation rows; seasons named in neither stay locked away."""
    if set(fit) & set(val):
        raise ValueError("a season cannot be both fitted and validated on")
    return df.filter(F.col(season).isin(*fit)), df.filter(F.col(season).isin(*val))


def numeric_features(df: DataFrame, exclude=(), prefixes=None) -> list[str]:
    """Names of numeric columns, by prefix if given, without the excluded ones."""
    pick = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    return [c for c in pick if c not in set(exclude) and (prefixes is None or c.startswith(tuple(prefixes)))]


def drop_incomplete(df: DataFrame, required: list[str]) -> DataFrame:
    return df.na.drop(subset=required)


def incomplete_report(df: DataFrame, required: list[str], by) -> DataFrame:
    """Rows a drop would lose, per group, most first."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])
    by = [by] if isinstance(by, str) else list(by)
    return df.filter(bad).groupBy(*by).agg(F.count(F.lit(1)).alias("dropped")).orderBy(F.desc("dropped"), *by)
