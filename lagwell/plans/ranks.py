"""Exact quantiles, running totals, row numbers and previous rows without gathering values or keys in one task.

Both start from a mergeable quantile sketch, whose error is one of ranks, not of values: outliers and concentrated values
don't matter. For quantiles the sketch brackets each wanted rank; the exact counts below the bracket and the values
inside it settle the answer. For running totals it gives the bounds of buckets of nearly equal row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lagwell.plans.scale import one_row, stage

BUCKETS, ACCURACY = 1024, 20_000


def running_totals(df: DataFrame, value: str, measures: list[str], prefix: str = "before_",
                   descending: bool = False) -> DataFrame:
    """Exclusive running sums of measures over rows ordered by a distinct value column.

    df holds one row per value (ties already folded). Bucket totals are at most BUCKETS rows.
    """
    v = F.col(value).cast("double")
    sign = -v if descending else v
    d = df.withColumn("_v", sign)
    bounds = F.percentile_approx("_v", F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)]), F.lit(ACCURACY))
    steps = ", ".join(str(1 << k) for k in reversed(range(BUCKETS.bit_length() - 1)))
    # binary search: how many of the bounds are at most the value
    bucket = f"aggregate(array({steps}), 0, (a, s) -> a + if(_v >= _e[a + s - 1], s, 0))"
    d = d.crossJoin(one_row(d.agg(bounds.alias("_e")))).withColumn("_b", F.expr(bucket)).drop("_e")
    per = d.groupBy("_b").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    # at most BUCKETS rows: one array, folded in order, broadcast back
    up = Window.partitionBy(F.lit(1)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = per.select("_b", *[F.coalesce(F.sum(f"_t_{m}").over(up), F.lit(0)).alias(f"_o_{m}")
                              for m in measures])
    d = d.join(F.broadcast(offs), "_b")
    w = Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    out = [(F.col(f"_o_{m}") + F.coalesce(F.sum(m).over(w), F.lit(0))).alias(prefix + m) for m in measures]
    return d.select(*df.columns, *out)


def exact_quantiles(df: DataFrame, value: str, qs: list[float], by=(), name: str = "value") -> DataFrame:
    """One row per group and q: (by..., q, name), linear interpolation, NULLs ignored."""
    by = list(by)
    src = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    off = 3 / ACCURACY
    near = [p for q in qs for p in (max(0.0, q - off), min(1.0, q + off))]
    ends = src.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", F.array(*map(F.lit, near)), F.lit(ACCURACY)).alias("_p"))
    wanted = ", ".join(
        f"named_struct('q', {q!r}D, 'lo', {'_min' if q <= off else f'_p[{2 * i}]'}, 'hi', {'_max' if q >= 1 - off else f'_p[{2 * i + 1}]'})"
        for i, q in enumerate(qs))
    ends = ends.filter("_n > 0").select(*by, "_n", F.expr(f"array({wanted})").alias("_w"))
    counted = src.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    d = counted.join(ends, by) if by else counted.crossJoin(one_row(ends))
    # the bracket is widened by the next value on both sides, as a sketch of few values may miss a rank by one
    parts = []
    for i in range(len(qs)):
        lo, hi, pair = F.col("_w")[i]["lo"], F.col("_w")[i]["hi"], F.struct(F.col("_v").alias("v"), F.col("_c").alias("c"))
        parts += [F.sum(F.when(F.col("_v") < lo, F.col("_c"))).alias(f"_b{i}"), F.max(F.when(F.col("_v") < lo, pair)).alias(f"_l{i}"), F.min(F.when(F.col("_v") > hi, F.col("_v"))).alias(f"_h{i}")]
    wide = d.groupBy(*by).agg(F.first("_w").alias("_w"), F.first("_n").alias("_n"), *parts)
    wide = wide.select(*by, "_n", F.array(*[F.struct(
        F.lit(float(q)).alias("q"), (F.coalesce(f"_b{i}", F.lit(0)) - F.coalesce(F.col(f"_l{i}.c"), F.lit(0))).alias("b"),
        F.coalesce(F.col(f"_l{i}.v"), F.col("_w")[i]["lo"]).alias("lo"), F.coalesce(f"_h{i}", F.col("_w")[i]["hi"]).alias("hi")) for i, q in enumerate(qs)]).alias("_w"))
    d = counted.join(wide, by) if by else counted.crossJoin(one_row(wide))
    inside = d.select(*by, "_v", "_c", "_n", F.explode(F.expr("filter(_w, z -> _v >= z.lo AND _v <= z.hi)")).alias("_z")).select(*by, "_v", "_c", "_n", "_z.q", "_z.b")
    up = Window.partitionBy(*by, "q").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_o", F.coalesce(F.sum("_c").over(up), F.lit(0)))
    pos = F.col("q") * (F.col("_n") - 1)
    first = F.col("_o") + F.col("b")
    covers = lambda r: (r >= first) & (r < first + F.col("_c"))
    lo, hi = F.max(F.when(covers(F.floor(pos)), F.col("_v"))), F.max(F.when(covers(F.ceil(pos)), F.col("_v")))
    return inside.groupBy(*by, "q").agg((lo + (hi - lo) * F.max(pos - F.floor(pos))).alias(name))


def sorted_parts(df: DataFrame, order: list[str]) -> DataFrame:
    """df in the order of a total order, cut into ranges of nearly equal size whatever keys it holds: _part, and _at in the part.

    Staged, so that parts and places stay what they are.
    """
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    return stage(d).selectExpr("* EXCEPT (_m)", "CAST(shiftright(_m, 33) AS INT) AS _part", "_m & 8589934591 AS _at")


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Dense numbers from 0 in the order of a total order; they don't depend on how df is partitioned."""
    d = sorted_parts(df, order)
    # one row per part: their number is that of the shuffle's partitions
    up = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    off = sizes.select("_part", F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_off"))
    return d.join(F.broadcast(off), "_part").select(*df.columns, (F.col("_off") + F.col("_at")).alias(name))


def previous(df: DataFrame, keys: list[str], order: list[str], cols: dict[str, str]) -> DataFrame:
    """Add columns {new: old} of the row before in the group of keys, NULL in its first row; a group may span many tasks."""
    d = sorted_parts(df, [*keys, *order])
    row = F.struct(F.struct(*keys).alias("k"), F.struct(*[F.col(c) for c in dict.fromkeys(cols.values())]).alias("v"))
    d = d.withColumn("_p", F.lag(row).over(Window.partitionBy("_part").orderBy("_at")))
    ends = d.groupBy("_part").agg(F.max_by(row, "_at").alias("_e"))  # one row per part
    before = ends.select("_part", F.lag("_e").over(Window.partitionBy(F.lit(1)).orderBy("_part")).alias("_q"))
    d = d.join(F.broadcast(before), "_part").withColumn("_p", F.when(F.col("_at") == 0, F.col("_q")).otherwise(F.col("_p")))
    same = F.col("_p.k").eqNullSafe(F.struct(*keys))
    return d.select(*df.columns, *[F.when(same, F.col(f"_p.v.{old}")).alias(new) for new, old in cols.items()])
