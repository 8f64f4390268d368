"""Ordered-frame features: lagged sums, means, medians and running numbers.

Every feature is declared as data (`Feature`) and computed by `lagged`. Which plan is used depends on what the operator
is, never on the size of its input: keys whose groups are bounded by nature (the games of a player, the rows of an
appearance) go through one window per partitioning. Operators over raw events, where one key may hold most rows, pass
`Split`: every group then gets exact row numbers from per-bucket counts, blocks of consecutive rows, a
halo of the preceding rows for bounded frames and carried partial aggregates for expanding ones. Both plans give
the same column types.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Split:
    """Groups may be of any size: rows are worked on in blocks of block_rows."""

    block_rows: int = 1_000_000


AGGS = ("sum", "avg", "std", "median", "max", "min", "count", "rows", "value", "moments")


@dataclass(frozen=True)
class Frame:
    """Rows `lo`..`hi` back from the current one; lo None means from the start."""

    lo: int | None
    hi: int = 1
    within: tuple[str, ...] = ()


def last(n: int, *within: str) -> Frame:
    if n < 1:
        raise ValueError("a frame needs at least one row")
    return Frame(n, 1, within)


def prior(*within: str) -> Frame:
    return Frame(None, 1, within)


def through(*within: str) -> Frame:
    return Frame(None, 0, within)


def back(n: int, *within: str) -> Frame:
    return Frame(n, n, within)


@dataclass(frozen=True)
class Feature:
    """One output column. need_prev blanks it when the previous row's value is NULL.

    'moments' merges a column of states (see `moments_sql`) over the frame.
    """

    name: str
    agg: str
    col: str | None = None
    frame: Frame = field(default_factory=prior)
    need_prev: bool = False

    def __post_init__(self):
        if self.agg not in AGGS:
            raise ValueError(f"unknown aggregate {self.agg!r}")
        if self.agg == "value" and self.frame.lo != self.frame.hi:
            raise ValueError("'value' takes a single-row frame")


def spread(cols, aggs, frame: Frame, pattern: str, need_prev: bool = False) -> list[Feature]:
    """Features for every (column, aggregate) pair named by pattern.format(col, agg)."""
    return [Feature(pattern.format(col=c, agg=a), a, src, frame, need_prev)
            for c, src in (cols.items() if isinstance(cols, dict) else [(c, c) for c in cols])
            for a in aggs]


def lagged(df: DataFrame, entity, order, features: list[Feature],
           split: Split | None = None, bucket: Column | None = None) -> DataFrame:
    """Add the features to df, partitioned by entity (+ frame.within), ordered by order.

    order must be unique within a partition. With split, bucket is a coarse, monotone form of the first order
    column that numbers the rows of a group; dates, timestamps and integers have a default.
    """
    entity = [entity] if isinstance(entity, str) else list(entity)
    order = [order] if isinstance(order, str) else list(order)
    groups: dict[tuple, list[Feature]] = {}
    for f in features:
        groups.setdefault(f.frame.within, []).append(f)
    for within in sorted(groups, key=len):
        keys = entity + [w for w in within if w not in entity]
        if split is None:
            df = _plain(df, keys, order, groups[within])
        else:
            df = _blocked(df, keys, order, groups[within], split.block_rows, bucket)
    return df


def _agg(agg: str, c: Column) -> Column:
    return {
        "sum": lambda: F.sum(c), "avg": lambda: F.avg(c), "std": lambda: F.stddev_samp(c),
        "median": lambda: F.percentile(c, F.lit(0.5)), "max": lambda: F.max(c),
        "min": lambda: F.min(c), "count": lambda: F.count(c),
        "rows": lambda: F.count(F.lit(1)),
    }[agg]()


def _over(f: Feature, w) -> Column:
    if f.agg == "value":
        return F.lag(f.col, f.frame.lo).over(w)
    lo = Window.unboundedPreceding if f.frame.lo is None else -f.frame.lo
    return _agg(f.agg, F.col(f.col) if f.col else F.lit(1)).over(w.rowsBetween(lo, -f.frame.hi))


def _plain(df, keys, order, feats):
    """All windows of one partitioning in one projection, as SQL text."""
    over = f"PARTITION BY {', '.join(map(_q, keys))} ORDER BY {', '.join(map(_q, order))}"
    grown = [f for f in feats if f.agg == "moments" and f.frame.lo is None]
    if not grown:
        return df.selectExpr("*", *[f"{_window_sql(f, over)} AS {_q(f.name)}" for f in feats])
    kept = df.columns
    before = f"OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    cols = list(dict.fromkeys(f.col for f in grown))
    at = {c: i for i, c in enumerate(cols)}
    # what a state adds to those before it: its own squares, and the distance of its mean from theirs. Nothing is subtracted.
    d = df.selectExpr("*", *[e for c, i in at.items() for e in (
        f"sum({_q(c)}.n) {before} AS _mn{i}", f"sum({_q(c)}.n * {_q(c)}.mean) {before} AS _ms{i}")])
    d = d.selectExpr("*", *[
        f"CASE WHEN {_q(c)}.n > 0 THEN {_q(c)}.m2 + CASE WHEN _mn{i} > 0 THEN pow({_q(c)}.mean - _ms{i} / _mn{i}, 2) * {_q(c)}.n / (_mn{i} + {_q(c)}.n) * _mn{i} "
        f"ELSE 0D END END AS _mi{i}" for c, i in at.items()])
    out = []
    for f in feats:
        if f not in grown:
            out.append(f"{_window_sql(f, over)} AS {_q(f.name)}")
            continue
        c, i = _q(f.col), at[f.col]
        w = f"OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND {'CURRENT ROW' if f.frame.hi == 0 else f'{f.frame.hi} PRECEDING'})"
        n, s = (f"_mn{i}", f"_ms{i}") if f.frame.hi == 1 else (f"sum({c}.n) {w}", f"sum({c}.n * {c}.mean) {w}")
        e = f"named_struct('n', coalesce({n}, 0L), 'mean', try_divide({s}, {n}), 'm2', coalesce(sum(_mi{i}) {w}, 0D))"
        if f.need_prev:
            e = f"CASE WHEN lag({c}, 1) OVER ({over}) IS NOT NULL THEN {e} END"
        out.append(f"{e} AS {_q(f.name)}")
    return d.selectExpr(*map(_q, kept), *out)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _window_sql(f: Feature, over: str) -> str:
    x = _q(f.col) if f.col else "1"
    if f.agg == "value":
        e = f"lag({x}, {f.frame.lo}) OVER ({over})"
    else:
        call = {"sum": "sum({})", "avg": "avg({})", "std": "stddev_samp({})", "median": "percentile({}, 0.5D)",
                "max": "max({})", "min": "min({})", "count": "count({})", "rows": "count({})", "moments": "collect_list({})"}[f.agg].format(x)
        lo = "UNBOUNDED" if f.frame.lo is None else str(f.frame.lo)
        hi = "CURRENT ROW" if f.frame.hi == 0 else f"{f.frame.hi} PRECEDING"
        e = f"{call} OVER ({over} ROWS BETWEEN {lo} PRECEDING AND {hi})"
        if f.agg == "moments":  # a bounded frame: its few states are folded
            e = folded_sql(e)
    if f.need_prev:
        e = f"CASE WHEN lag({x}, 1) OVER ({over}) IS NOT NULL THEN {e} END"
    return e


def _default_bucket(df, col):
    t = df.schema[col].dataType
    if isinstance(t, T.DateType):
        return F.col(col)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc("hour", F.col(col).cast("timestamp"))
    if isinstance(t, T.IntegralType):
        return F.floor(F.col(col) / 65536)
    raise ValueError(f"name a bucket expression for order column {col!r} of type {t}")


def _numbered(df, keys, order, bucket):
    """Add _rn, the row number in the group, from bucket counts plus in-bucket numbers."""
    d = df.withColumn("_bkt", bucket if bucket is not None else _default_bucket(df, order[0]))
    counts = d.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    up = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bkt", F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_off"))
    d = attach(d, offsets, keys + ["_bkt"])
    inside = Window.partitionBy(*keys, "_bkt").orderBy(*order)
    return d.withColumn("_rn", F.col("_off") + F.row_number().over(inside)).drop("_off", "_bkt")


def attach(df, side, keys):
    """Left join on null-safe keys."""
    r = side
    for i, k in enumerate(keys):
        r = r.withColumnRenamed(k, f"_k_{i}")
    cond = reduce(lambda a, b: a & b,
                  [F.col(k).eqNullSafe(F.col(f"_k_{i}")) for i, k in enumerate(keys)])
    return df.join(r, cond, "left").drop(*[f"_k_{i}" for i in range(len(keys))])


def _blocked(df, keys, order, feats, block_rows, bucket):
    look = max([1] + [f.frame.lo for f in feats if f.frame.lo is not None])
    size = max(block_rows, look)
    keep = df.columns
    d = _numbered(df, keys, order, bucket)
    d = d.withColumn("_blk", F.floor((F.col("_rn") - 1) / size))

    kinds = {f.name: f.dataType for f in _plain(df, keys, order, feats).schema}
    expanding = [f for f in feats if f.frame.lo is None]
    if any(f.agg == "moments" for f in feats):
        raise ValueError("states are merged per game; a player's games take no split groups")
    if any(f.agg == "median" for f in expanding):
        raise ValueError("an expanding median needs all earlier values, so it takes no split groups")
    uses: dict[str, set] = {}
    for f in expanding:
        if f.col:
            uses.setdefault(f.col, set()).add(f.agg)
    centred = sorted(c for c, a in uses.items() if "std" in a)
    if centred:
        # deviations are summed around the group's mean, so that equal or far-off values lose no digits
        means = df.groupBy(*keys).agg(*[F.avg(F.col(c).cast("double")).alias(f"_m_{c}") for c in centred])
        d = attach(d, means, keys)
    carry = None
    if expanding:
        parts = [F.count(F.lit(1)).alias("_p_rows")]
        for c, aggs in sorted(uses.items()):
            x = F.col(c)
            parts.append(F.count(x).alias(f"_n_{c}"))
            if aggs & {"sum", "avg"}:
                parts.append(F.sum(x).alias(f"_s_{c}"))
            if "std" in aggs:
                off = x.cast("double") - F.col(f"_m_{c}")
                parts += [F.sum(off).alias(f"_d_{c}"), F.sum(off * off).alias(f"_q_{c}")]
            if "max" in aggs:
                parts.append(F.max(x).alias(f"_x_{c}"))
            if "min" in aggs:
                parts.append(F.min(x).alias(f"_i_{c}"))
        per = d.groupBy(*keys, "_blk").agg(*parts)
        up = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
        how = {"_p": F.sum, "_s": F.sum, "_n": F.sum, "_d": F.sum, "_q": F.sum, "_x": F.max, "_i": F.min}
        carry = per.select(*keys, "_blk", *[
            how[c[:2]](c).over(up).alias("c" + c) for c in per.columns if c not in keys + ["_blk"]])

    halo = F.when(F.col("_rn") > (F.col("_blk") + 1) * size - look,
                  F.array(F.col("_blk"), F.col("_blk") + 1)).otherwise(F.array(F.col("_blk")))
    d = d.withColumn("_in", F.explode(halo))
    if carry is not None:
        d = attach(d, carry.withColumnRenamed("_blk", "_in"), keys + ["_in"])
    own = F.col("_in") == F.col("_blk")
    w = Window.partitionBy(*keys, "_in").orderBy("_rn")
    out = []
    for f in feats:
        if f.frame.lo is not None:
            c = _over(f, w)
        else:
            c = _carried(f, w.rowsBetween(Window.unboundedPreceding, -f.frame.hi), own, kinds[f.name])
        if f.need_prev:
            c = F.when(F.lag(f.col, 1).over(w).isNotNull(), c)
        out.append(c.cast(kinds[f.name]).alias(f.name))
    return d.select("*", *out).filter(own).select(*keep, *[f.name for f in feats])


def _carried(f: Feature, w, own, kind) -> Column:
    """In-block aggregate merged with what the earlier blocks carried in."""
    def mine(x):
        return F.when(own, x)

    zero = F.lit(0)
    if f.agg == "rows":
        return F.count(mine(F.lit(1))).over(w) + F.coalesce(F.col("c_p_rows"), zero)
    x = F.col(f.col)
    n = F.count(mine(x)).over(w) + F.coalesce(F.col(f"c_n_{f.col}"), zero)
    if f.agg == "count":
        return n
    if f.agg in ("max", "min"):
        fn, pick, tag = (F.max, F.greatest, "x") if f.agg == "max" else (F.min, F.least, "i")
        return pick(fn(mine(x)).over(w), F.col(f"c_{tag}_{f.col}"))
    if f.agg == "std":
        off = x.cast("double") - F.col(f"_m_{f.col}")
        s, q = (F.coalesce(F.sum(mine(v)).over(w), F.lit(0.0)) + F.coalesce(F.col(f"c_{t}_{f.col}"), F.lit(0.0))
                for v, t in ((off, "d"), (off * off, "q")))
        n = n.cast("double")
        return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), q - F.try_divide(s * s, n)) / (n - 1)))
    s = F.coalesce(F.sum(mine(x)).over(w), zero) + F.coalesce(F.col(f"c_s_{f.col}"), zero)
    if f.agg == "sum":
        return F.when(n > 0, s)
    if isinstance(kind, T.DecimalType):  # a bounded divisor leaves the quotient its decimal places
        s, n = s.cast(T.DecimalType(min(38, kind.precision + 6), max(0, kind.scale - 4))), n.cast("decimal(12,0)")
    return F.try_divide(s, n)


# ---- central moments ---------------------------------------------------------------------
# A state is (n, mean, m2): how many values, their mean, the sum of squared distances from it. Two states merge by Chan's rule, which
# adds non-negative terms only, so deviations of far-off or equal values lose no digits.

_ZERO = "named_struct('n', 0L, 'mean', CAST(NULL AS DOUBLE), 'm2', 0D)"
_CHAN = ("(a, b) -> CASE WHEN b.n = 0 THEN a WHEN a.n = 0 THEN b ELSE named_struct('n', a.n + b.n, "
         "'mean', a.mean + (b.mean - a.mean) * b.n / (a.n + b.n), "
         "'m2', a.m2 + b.m2 + (b.mean - a.mean) * (b.mean - a.mean) * a.n / (a.n + b.n) * b.n) END")


def moments_sql(x: str, cond: str | None = None) -> str:
    """State of the values x (where cond holds) of a group, as an aggregate; partial aggregation merges it map-side."""
    v = f"CAST({x} AS DOUBLE)" if cond is None else f"CASE WHEN {cond} THEN CAST({x} AS DOUBLE) END"
    return f"named_struct('n', count({v}), 'mean', avg({v}), 'm2', coalesce(var_pop({v}) * count({v}), 0D))"


def one_sql(x: str) -> str:
    """State of one value; without values where x is NULL."""
    return f"CASE WHEN {x} IS NULL THEN {_ZERO} ELSE named_struct('n', 1L, 'mean', CAST({x} AS DOUBLE), 'm2', 0D) END"


def folded_sql(states: str) -> str:
    """Merged state of an array of states."""
    return f"aggregate({states}, {_ZERO}, {_CHAN})"


def merged_sql(state: str) -> str:
    """Merged state of a group, as an aggregate over a bounded number of states (the games of a season)."""
    return folded_sql(f"collect_list({state})")


def squares_sql(state: str) -> str:
    """Plain sum of squares of a state's values, as published per-game tables carry it."""
    return f"({state}.m2 + {state}.n * coalesce({state}.mean, 0) * coalesce({state}.mean, 0))"


def deviation_sql(state: str) -> str:
    """Sample deviation of a state; NULL below two values."""
    return f"CASE WHEN {state}.n > 1 THEN sqrt({state}.m2 / ({state}.n - 1)) END"


def integer_deviation_sql(n: str, total: str, squares: str) -> str:
    """Sample deviation from sums of integers, which are exact, for formulas that divide by another count than they sum over.

    NULL below a count of two and where such a count makes the variance negative.
    """
    top = f"(CAST({squares} AS DECIMAL(38, 0)) * {n} - CAST({total} AS DECIMAL(38, 0)) * {total})"
    return f"CASE WHEN {n} > 1 AND {top} >= 0 THEN sqrt(CAST({top} AS DOUBLE) / (CAST({n} AS DOUBLE) * ({n} - 1))) END"


def totals(df: DataFrame, keys, aggs: dict[str, Column]) -> DataFrame:
    """Whole-group aggregates on every row, pre-aggregated map-side and joined back, so no group is gathered in one task."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return attach(df, df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()]), keys)


def seven_day_sum(df: DataFrame, entity: str, date: str, order, col: str, name: str,
                  days: int = 7, split: Split | None = None) -> DataFrame:
    """Sum of the previous row's value over dates in (date - days, date], rows so far.

    Values are shifted by one row first, so the previous start always counts; an empty
    frame gives 0. Rows later on the same date are left out.
    """
    order = [order] if isinstance(order, str) else list(order)
    d = lagged(df, entity, [date] + order, [Feature("_prev", "value", col, back(1))], split)
    d = d.withColumn("_day", F.datediff(F.col(date), F.lit("1970-01-01").cast("date")))
    span = Window.partitionBy(entity).orderBy("_day").rangeBetween(-(days - 1), -1)
    same = Window.partitionBy(entity, "_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if split is None:  # all frames of an entity in one place
        d = d.withColumn("_earlier", F.sum("_prev").over(span))
    else:
        per_day = d.groupBy(entity, "_day").agg(F.sum("_prev").alias("_d"))
        d = attach(d, per_day.select(entity, "_day", F.sum("_d").over(span).alias("_earlier")), [entity, "_day"])
    today = F.sum("_prev").over(same)
    return (d.withColumn(name, F.coalesce(F.col("_earlier"), F.lit(0.0)) + F.coalesce(today, F.lit(0.0)))
            .drop("_prev", "_day", "_earlier"))
