"""Model diagnostics as tables: losses, slices, calibration, ranking, intervals, reports.

Predictions are a DataFrame with a 0/1 target and a probability. Every result is a
DataFrame; nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwell.functions.rates import half_even, row_log_loss, safe_div
from lagwell.plans.frames import attach
from lagwell.plans.ranks import exact_quantiles, running_totals
from lagwell.plans.scale import one_row, stage

CROSS = "×"


def with_loss(df: DataFrame, y: str, p: str, name: str = "loss") -> DataFrame:
    return df.withColumn(name, row_log_loss(y, p))


def confidently_wrong(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.filter(((F.col(p) > 0.6) & (F.col(y) == 0)) | ((F.col(p) < 0.4) & (F.col(y) == 1)))


def top_losses(df: DataFrame, y: str, p: str, key: list[str], n: int = 20) -> DataFrame:
    """The n worst rows; losses equal to nine places are ties, ordered by key."""
    return with_loss(df, y, p).orderBy(F.desc(F.round("loss", 9)), *key).limit(n)


# ---- slices -----------------------------------------------------------------------------

def slice_rows(df: DataFrame, keep: list[str], cols: list[str], pairs=()) -> DataFrame:
    """One row per input row and slice it belongs to: (keep..., feature, value).

    A row belongs to one value of each column and of each pair, never to pairs of rows.
    """
    text = lambda c: F.col(c).cast("string")
    items = [F.struct(F.lit(c).alias("feature"), text(c).alias("value")) for c in cols if c in df.columns]
    for a, b in pairs:
        if a in df.columns and b in df.columns:
            both = F.concat(text(a), F.lit(CROSS), text(b))
            items.append(F.struct(F.lit(a + CROSS + b).alias("feature"), both.alias("value")))
    return (df.select(*keep, F.explode(F.array(*items)).alias("_s"))
            .select(*keep, "_s.feature", "_s.value").filter(F.col("value").isNotNull()))


def slices(df: DataFrame, cols: list[str], pairs=()) -> DataFrame:
    """Distinct (feature, value) pairs that occur."""
    return slice_rows(df, [], cols, pairs).distinct()


def slice_contribution(df: DataFrame, y: str, p: str, cols: list[str], pairs=(), min_n: int = 50) -> DataFrame:
    """Share of rows times excess loss per slice, largest first; slices under min_n are left out."""
    d = df.select(*dict.fromkeys([*cols, *[c for ab in pairs for c in ab]]), row_log_loss(y, p).alias("_l"))
    whole = d.agg(F.avg("_l").alias("_overall"), F.count(F.lit(1)).alias("_total"))
    s = slice_rows(d, ["_l"], cols, pairs).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_l").alias("slice_loss"))
    s = s.filter(F.col("n") >= min_n).crossJoin(one_row(whole))
    s = s.withColumns({"pct": F.col("n") / F.col("_total"), "delta": F.col("slice_loss") - F.col("_overall")})
    s = s.withColumn("contribution", F.col("pct") * F.col("delta")).drop("_overall", "_total")
    return s.orderBy(F.desc("contribution"), "feature", "value")


def top_slices(contribution: DataFrame, n: int = 15) -> DataFrame:
    return contribution.orderBy(F.desc("contribution"), "feature", "value").limit(n)


def slice_filter(df: DataFrame, feature: str, value: str) -> DataFrame:
    """Rows of one slice; a combined feature compares each part as text."""
    for c, v in zip(feature.split(CROSS), str(value).split(CROSS)):
        df = df.filter(F.col(c).cast("string") == v)
    return df


def header(df: DataFrame, y: str, p: str, contribution: DataFrame) -> DataFrame:
    """One row: rows, positive rate, overall loss, worst slice."""
    a = df.agg(F.count(F.lit(1)).alias("total_pa"), F.avg(y).alias("positive_rate"),
               F.avg(row_log_loss(y, p)).alias("overall_loss"))
    top = top_slices(contribution, 1).select(F.concat("feature", F.lit("="), "value").alias("top_slice"))
    return a.join(one_row(top), how="left")


# ---- bootstrap --------------------------------------------------------------------------

#: Distinct losses that one matrix of draws holds.
DRAWN = 2000


def bootstrap_ci(df: DataFrame, y: str, p: str, by: list[str] = (), n_iter: int = 1000, seed: int = 42,
                 alpha: float = 0.05, min_n: int = 1) -> DataFrame:
    """Percentile interval of the mean log loss, per group.

    Rows of equal loss are folded into a count first; replicate r then draws Poisson(count)
    copies. Rows without a loss are left out. The losses of a group are dealt by hash to buckets of about `DRAWN`; a bucket draws one matrix (losses x
    replicates) and multiplies it with its losses. The draws depend only on the seed, the group and its losses, so the result does
    not change with partitioning or a re-run task. Partial sums leave each task, never rows.
    """
    by = list(by)
    folded = stage(df.select(*by, row_log_loss(y, p).alias("_l")).filter("_l IS NOT NULL").groupBy(*by, "_l").agg(F.count(F.lit(1)).alias("_c")))
    key = F.xxhash64(F.lit(seed), *by) if by else F.xxhash64(F.lit(seed))
    sizes = folded.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    src = attach(folded, sizes, by) if by else folded.crossJoin(one_row(sizes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "_l"), F.ceil(F.col("_n") / F.lit(DRAWN)))
    src = src.select(*by, "_l", "_c", key.alias("_g"), bucket.alias("_b"))

    def draw(pdf):
        pdf = pdf.sort_values("_l")
        rng = np.random.Generator(np.random.Philox(key=np.array([pdf["_g"].iloc[0], pdf["_b"].iloc[0]], np.int64).view(np.uint64)))
        counts, copies = pdf["_c"].to_numpy(), np.empty((len(pdf), n_iter))
        for c in np.unique(counts):  # one rate at a time draws several times faster
            copies[counts == c] = rng.poisson(c, (int((counts == c).sum()), n_iter))
        w, x = np.stack([np.ones(len(pdf)), pdf["_l"].to_numpy()]) @ copies
        out = pd.DataFrame({"_r": np.arange(n_iter, dtype="int32"), "_w": w, "_x": x})
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out[[*by, "_r", "_w", "_x"]]

    schema = folded.select(*by).schema.add("_r", "integer").add("_w", "double").add("_x", "double")
    # few rows, but much work in each bucket: a named number of tasks isn't merged into one
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    means = src.repartition(tasks, *by, "_g", "_b").groupBy(*by, "_g", "_b").applyInPandas(draw, schema).groupBy(*by, "_r").agg(
        safe_div(F.sum("_x"), F.sum("_w")).alias("_m"))
    lo, hi = alpha / 2, 1 - alpha / 2
    ends = means.groupBy(*by).agg(F.percentile("_m", F.lit(lo)).alias("lo"), F.percentile("_m", F.lit(hi)).alias("hi"))
    point = folded.groupBy(*by).agg((F.sum(F.col("_l") * F.col("_c")) / F.sum("_c")).alias("point"),
                                    F.sum("_c").alias("n")).filter(F.col("n") >= min_n)
    out = point.join(ends, by) if by else point.crossJoin(one_row(ends))
    return out.select(*by, "point", "lo", "hi", "n")


def slice_intervals(df: DataFrame, y: str, p: str, cols, pairs=(), top: int = 15, min_n: int = 10,
                    **kw) -> DataFrame:
    """Intervals of the slices that contribute most."""
    best = top_slices(slice_contribution(df, y, p, cols, pairs), top).select("feature", "value")
    rows = slice_rows(df, [y, p], cols, pairs).join(F.broadcast(best), ["feature", "value"], "left_semi")
    return bootstrap_ci(rows, y, p, ["feature", "value"], min_n=min_n, **kw)


# ---- calibration ------------------------------------------------------------------------

def reliability_bins(df: DataFrame, y: str, p: str, n_bins: int = 10) -> DataFrame:
    """Equal-width bins on [0, 1]; empty bins are left out."""
    edges = [float(e) for e in np.linspace(0.0, 1.0, n_bins + 1)]
    idx = " + ".join(f"CAST({p} >= {e!r}D AS INT)" for e in edges[1:-1]) or "0"
    mids = [round((a + b) / 2, 4) for a, b in zip(edges, edges[1:])]
    d = df.selectExpr(f"{idx} AS _i", f"{p} AS _p", f"{y} AS _y")
    g = d.groupBy("_i").agg(F.avg("_p").alias("pred_mean"), F.avg("_y").alias("actual_rate"), F.count(F.lit(1)).alias("n"))
    return g.select(F.element_at(F.array(*[F.lit(m) for m in mids]), F.col("_i") + 1).alias("bin_mid"),
                    "pred_mean", "actual_rate", "n")


def _edges(df: DataFrame, x: str, n_bins: int) -> DataFrame:
    """One row with the ascending array of the n_bins + 1 quantile edges."""
    q = exact_quantiles(df, x, [i / n_bins for i in range(n_bins + 1)])
    return q.agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "value"))), lambda s: s["value"]).alias("_e"))


def quantile_calibration(df: DataFrame, y: str, p: str, n_bins: int = 10, min_n: int = 0,
                         closed_last: bool = False) -> DataFrame:
    """Quantile bins [lo, hi) with predicted mean and observed rate; empty bins stay, with n 0.

    Rows at the maximum fall outside every bin unless closed_last.
    """
    e = one_row(_edges(df, p, n_bins))
    at = F.size(F.filter("_e", lambda v: v <= F.col("_p"))) - 1
    if closed_last:
        at = F.least(at, F.lit(n_bins - 1))
    d = df.select(F.col(p).cast("double").alias("_p"), F.col(y).alias("_y")).crossJoin(e).select("_p", "_y", at.alias("bin"))
    g = d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), half_even(F.avg("_p"), 3).alias("mean_pred"),
                             half_even(F.avg("_y"), 3).alias("obs_hit_rate"))
    bins = e.select(F.posexplode(F.slice("_e", 1, n_bins)).alias("bin", "lo"), "_e")
    bins = bins.withColumn("hi", F.element_at("_e", F.col("bin") + 2)).drop("_e")
    text = lambda c: F.format_string("%.3f", c)
    out = bins.join(g, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("bin", F.concat(text("lo"), F.lit("–"), text("hi")).alias("bucket"), "lo", "hi", "n",
                      (F.col("n") >= min_n).alias("reliable"), "mean_pred", "obs_hit_rate")


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    gap = F.abs(F.col("mean_pred") - F.col("obs_hit_rate"))
    return bins.agg(safe_div(F.sum(F.col("n") * gap), F.sum("n")).alias("ece"))


def murphy(df: DataFrame, y: str, bins: DataFrame) -> DataFrame:
    """Reliability, resolution, uncertainty and the Brier score they rebuild."""
    base = df.agg(F.avg(F.col(y).cast("double")).alias("_b"))
    d = bins.crossJoin(one_row(base))
    sq = lambda a, b: F.pow(F.col(a) - F.col(b), F.lit(2.0))
    r = d.agg(safe_div(F.sum(F.col("n") * sq("mean_pred", "obs_hit_rate")), F.sum("n")).alias("reliability"),
              safe_div(F.sum(F.col("n") * sq("obs_hit_rate", "_b")), F.sum("n")).alias("resolution"),
              F.max(F.col("_b") * (1 - F.col("_b"))).alias("uncertainty"))
    return r.withColumn("brier_reconstructed", F.col("reliability") - F.col("resolution") + F.col("uncertainty"))


# ---- scores and ranking -----------------------------------------------------------------

def probability_scores(df: DataFrame, y: str, p: str, baseline: str | None = None) -> DataFrame:
    """Brier score and log loss, with deltas against a baseline prediction."""
    sq = lambda c: F.avg(F.pow(F.col(c) - F.col(y), F.lit(2.0)))
    a = [sq(p).alias("brier"), F.avg(row_log_loss(y, p)).alias("log_loss")]
    if baseline:
        a += [sq(baseline).alias("baseline_brier"), F.avg(row_log_loss(y, baseline)).alias("baseline_log_loss")]
    d = df.agg(*a)
    if baseline:
        d = d.withColumns({
            "brier_delta": F.col("baseline_brier") - F.col("brier"),
            "log_loss_delta": F.col("baseline_log_loss") - F.col("log_loss"),
            "brier_improvement_pct": safe_div(F.col("baseline_brier") - F.col("brier"), "baseline_brier") * 100,
            "log_loss_improvement_pct": safe_div(F.col("baseline_log_loss") - F.col("log_loss"), "baseline_log_loss") * 100})
    return d


def decile_spread(df: DataFrame, y: str, p: str) -> DataFrame:
    """Observed rate at or under the 10th and at or over the 90th percentile of p."""
    q = exact_quantiles(df, p, [0.1, 0.9]).agg(F.min("value").alias("p10"), F.max("value").alias("p90"))
    d = df.select(F.col(p).alias("_p"), F.col(y).alias("_y")).crossJoin(one_row(q))
    low, high = F.col("_p") <= F.col("p10"), F.col("_p") >= F.col("p90")
    r = d.agg(F.max("p10").alias("p10"), F.max("p90").alias("p90"),
              F.count(F.when(low, 1)).alias("bottom_n"), F.count(F.when(high, 1)).alias("top_n"),
              F.avg(F.when(low, F.col("_y"))).alias("bottom_decile_rate"),
              F.avg(F.when(high, F.col("_y"))).alias("top_decile_rate"))
    return r.withColumn("decile_spread", F.col("top_decile_rate") - F.col("bottom_decile_rate"))


def _by_score(df: DataFrame, y: str, p: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    pos = F.col(y) == 1
    return df.groupBy(F.col(p).cast("double").alias("_p")).agg(F.count(F.when(pos, 1)).alias("pos"),
                                                              F.count(F.when(~pos, 1)).alias("neg"))


def roc_auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """Exact area under the ROC curve; tied scores count half."""
    r = running_totals(_by_score(df, y, p), "_p", ["neg"])
    pairs = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    return r.agg(safe_div(pairs, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def average_precision(df: DataFrame, y: str, p: str) -> DataFrame:
    """Step-wise area under the precision-recall curve."""
    r = running_totals(_by_score(df, y, p), "_p", ["pos", "neg"], descending=True)
    tp = F.col("before_pos") + F.col("pos")
    fp = F.col("before_neg") + F.col("neg")
    return r.agg(safe_div(F.sum(F.col("pos") * safe_div(tp, tp + fp)), F.sum("pos")).alias("pr_auc"))


def metrics_report(df: DataFrame, y: str, p: str, baseline: str | None = None, n_bins: int = 10,
                   min_n: int = 500) -> DataFrame:
    """Every single-number metric in one row; the predictions are read once and kept as the few columns that all parts need."""
    df = stage(df.select(*dict.fromkeys([y, p, *([baseline] if baseline else [])])))
    bins = stage(quantile_calibration(df, y, p, n_bins, min_n))  # a row per bin
    parts = [expected_calibration_error(bins), murphy(df, y, bins), probability_scores(df, y, p, baseline),
             roc_auc(df, y, p), average_precision(df, y, p), decile_spread(df, y, p).drop("p10", "p90")]
    out = parts[0]
    for x in parts[1:]:
        out = out.crossJoin(one_row(x))
    return out


def fixed_buckets(df: DataFrame, y: str, p: str, edges=(0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 1.01), eps: float = 1e-6) -> DataFrame:
    """Rows, mean prediction, rate and log loss per fixed bucket; empty buckets are left out."""
    pairs = list(zip(edges, edges[1:]))
    c = None
    for i, (lo, hi) in enumerate(pairs):
        hit = (F.col(p) >= lo) & (F.col(p) < hi)
        c = F.when(hit, i) if c is None else c.when(hit, i)
    d = df.select(c.alias("bucket"), F.col(p).alias("_p"), F.col(y).alias("_y")).filter(F.col("bucket").isNotNull())
    return d.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("_p").alias("mean_pred"),
                                   F.avg("_y").alias("hit_rate"), F.avg(row_log_loss("_y", "_p", eps)).alias("log_loss"))


def confusion(df: DataFrame, y: str, p: str, threshold: float = 0.5) -> DataFrame:
    return df.groupBy(F.col(y).alias("actual"), (F.col(p) >= threshold).cast("int").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def mae_lift(df: DataFrame, y: str, pred: str, baseline: str) -> DataFrame:
    """Mean absolute error against a baseline whose gaps take the mean of the target."""
    mean = df.agg(F.avg(F.col(y).cast("double")).alias("_m"))
    d = df.select(F.col(y).cast("double").alias("_y"), F.col(pred).alias("_p"), F.col(baseline).alias("_b")).crossJoin(one_row(mean))
    r = d.agg(F.avg(F.abs(F.col("_y") - F.col("_p"))).alias("mae"),
              F.avg(F.abs(F.col("_y") - F.coalesce("_b", "_m"))).alias("mae_baseline"))
    return r.withColumn("lift", F.col("mae_baseline") - F.col("mae"))


def component_scores(df: DataFrame, y: str, components: list[str], eps: float = 1e-6) -> DataFrame:
    """Brier and log loss of each component of a blend; gaps take the overall rate."""
    base = df.agg(F.avg(F.col(y).cast("double")).alias("_m"))
    items = [F.struct(F.lit(c).alias("component"), F.col(c).cast("double").alias("p")) for c in components]
    d = df.select(F.col(y).alias("_y"), F.explode(F.array(*items)).alias("_c")).crossJoin(one_row(base))
    d = d.select("_y", "_c.component", F.coalesce("_c.p", "_m").alias("_p"))
    q = F.when(F.col("_p") < eps, eps).when(F.col("_p") > 1 - eps, 1 - eps).otherwise(F.col("_p"))
    return d.withColumn("_p", q).groupBy("component").agg(
        F.avg(row_log_loss("_y", "_p", eps)).alias("log_loss"),
        F.avg(F.pow(F.col("_p") - F.col("_y"), F.lit(2.0))).alias("brier"))


# ---- exploration ------------------------------------------------------------------------

def _round_label(x: Column, digits: int = 3) -> Column:
    lead = F.floor(F.log10(F.abs(x)))
    small = digits - 1 - lead
    places = F.when(F.abs(x) >= 1, F.lit(digits)).otherwise(small)
    scale = F.pow(F.lit(10.0), places)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * scale) / scale)


def outcome_by_bin(df: DataFrame, feature: str, outcome: str, n_bins: int = 10) -> DataFrame:
    """Mean outcome per quantile bin: (lo, hi], the lowest value included, equal edges merged."""
    e = one_row(_edges(df, feature, n_bins).select(F.array_distinct("_e").alias("_e")))
    d = df.select(F.col(feature).cast("double").alias("_x"), F.col(outcome).alias("_y")).filter(F.col("_x").isNotNull())
    at = F.greatest(F.size(F.filter("_e", lambda v: v < F.col("_x"))), F.lit(1))
    d = d.crossJoin(e).select("_y", at.alias("bin"), F.element_at("_e", at).alias("bin_lo"),
                              F.try_element_at(F.col("_e"), at + 1).alias("bin_hi"))
    g = d.groupBy("bin", "bin_lo", "bin_hi").agg(F.avg("_y").alias("mean_outcome"), F.count("_y").alias("n"))
    lo = _round_label(F.col("bin_lo")) - F.when(F.col("bin") == 1, F.lit(0.001)).otherwise(0.0)
    return g.withColumn("bin_label", F.concat(F.lit("("), lo.cast("string"), F.lit(", "),
                                              _round_label(F.col("bin_hi")).cast("string"), F.lit("]")))


def outcome_by_category(df: DataFrame, feature: str, outcome: str) -> DataFrame:
    return df.groupBy(F.col(feature).cast("string").alias("bin_label")).agg(
        F.avg(outcome).alias("mean_outcome"), F.count(outcome).alias("n"))


def missing_report(df: DataFrame) -> DataFrame:
    """Share of NULLs per column, in one pass, largest first."""
    a = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns])
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("pct_missing")) for c in df.columns])
    return a.select(F.inline(items)).orderBy(F.desc("pct_missing"), "feature")


def histogram(df: DataFrame, x: str, n_bins: int = 50, by: list[str] = (), density: bool = False) -> DataFrame:
    """Equal-width counts between the overall minimum and maximum, optionally per class."""
    by = list(by)
    d = df.select(*by, F.col(x).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    ends = d.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / n_bins
    d = d.crossJoin(one_row(ends))
    at = F.least(F.coalesce(F.floor(F.try_divide(F.col("_x") - F.col("_lo"), width)), F.lit(0)), F.lit(n_bins - 1))
    g = d.groupBy(*by, at.alias("bin"), (F.col("_lo") + at * width).alias("bin_lo"), width.alias("_w")).agg(
        F.count(F.lit(1)).alias("n"))
    if density:
        whole = g.groupBy(*by).agg(F.sum("n").alias("_t"))
        g = g.join(F.broadcast(whole), by) if by else g.crossJoin(one_row(whole))
        g = g.withColumn("density", safe_div("n", F.col("_t") * F.col("_w"))).drop("_t")
    return g.drop("_w")


def entity_series(df: DataFrame, entity: str, value, date: str, metric: str, season: int | None = None,
                  slice_by: str | None = None) -> DataFrame:
    """One entity's metric over time."""
    d = df.filter(F.col(entity) == value)
    if season is not None:
        d = d.filter(F.col("game_season") == season)
    return d.select(entity, date, metric, *([slice_by] if slice_by else [])).orderBy(date)


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per column."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])
    d = df.select(F.inline(items)).filter(F.col("v").isNotNull())
    a = d.groupBy("column").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
                                F.min("v").alias("min"), F.max("v").alias("max"))
    q = exact_quantiles(d, "v", [0.25, 0.5, 0.75], ["column"])
    pick = lambda x: F.max(F.when(F.col("q") == x, F.col("value")))
    q = q.groupBy("column").agg(pick(0.25).alias("p25"), pick(0.5).alias("p50"), pick(0.75).alias("p75"))
    return a.join(q, "column", "left")


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair of the named columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    items = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"`{a}|{b}`").alias("corr"))
                      for a, b in pairs])
    return one.select(F.inline(items))
