"""Diagnostics over one prediction per line item."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness import tables as t
from harness.registry import query
from lagwell.operators import evaluate as E


def preds(spark, d):
    return t.read(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", "l_shipdate",
        "case when l_returnflag = 'R' then 1 else 0 end as y",
        "least(greatest(round(l_discount * 8 + 0.1D + (l_partkey % 7) * 0.01D, 4), 0.01D), 0.99D) as p",
        "l_quantity", "l_extendedprice")


LOSS = "-(y * ln(p) + (1 - y) * ln(1 - p))"
SLICES = ["l_linestatus", "l_linenumber", "supp"]
PAIRS = [("l_linestatus", "l_linenumber")]
SL_SQL = f"""
FROM (SELECT *, l_suppkey % 10 AS supp, {LOSS} AS l FROM preds) d,
LATERAL (VALUES ('l_linestatus', l_linestatus), ('l_linenumber', CAST(l_linenumber AS VARCHAR)), ('supp', CAST(supp AS VARCHAR)),
  ('l_linestatus×l_linenumber', concat(l_linestatus, '×', l_linenumber))) s(feature, value)"""
CONTRIB = f"""
SELECT feature, value, n, slice_loss, n::DOUBLE / total AS pct, slice_loss - overall AS delta,
  n::DOUBLE / total * (slice_loss - overall) AS contribution
FROM (SELECT feature, value, count(*) AS n, avg(l) AS slice_loss {SL_SQL} GROUP BY ALL HAVING count(*) >= 50),
  (SELECT avg({LOSS}) AS overall, count(*) AS total FROM preds)"""


def sliced(spark, d):
    return preds(spark, d).withColumn("supp", F.col("l_suppkey") % 10)


@query("row_log_loss", ["l_returnflag", "l_linestatus"], f"""
SELECT l_returnflag, l_linestatus, avg({LOSS}) AS mean_loss, max({LOSS}) AS max_loss, count(*) AS n FROM preds GROUP BY ALL""",
       ["preds"])
def row_log_loss(spark, d):
    return E.with_loss(preds(spark, d), "y", "p").groupBy("l_returnflag", "l_linestatus").agg(
        F.avg("loss").alias("mean_loss"), F.max("loss").alias("max_loss"), F.count(F.lit(1)).alias("n"))


@query("slice_contribution", ["feature", "value"], CONTRIB, ["preds"])
def slice_contribution(spark, d):
    return E.slice_contribution(sliced(spark, d), "y", "p", SLICES, PAIRS)


@query("slice_list", ["feature", "value"], f"SELECT DISTINCT feature, value {SL_SQL}", ["preds"], exact=True)
def slice_list(spark, d):
    return E.slices(sliced(spark, d), SLICES, PAIRS)


@query("top_slices", ["feature", "value"], f"SELECT * FROM ({CONTRIB}) ORDER BY round(contribution, 9) DESC, feature, value LIMIT 15", ["preds"])
def top_slices(spark, d):
    c = E.slice_contribution(sliced(spark, d), "y", "p", SLICES, PAIRS)
    return c.orderBy(F.desc(F.round("contribution", 9)), "feature", "value").limit(15)


@query("top_losses", [], f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p, l AS loss FROM (
  SELECT *, {LOSS} AS l FROM preds) ORDER BY round(l, 9) DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20""",
       ["preds"])
def top_losses(spark, d):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return E.top_losses(preds(spark, d), "y", "p", key).select(*key, "p", "loss")


@query("confidently_wrong", ["l_linestatus"], """
SELECT l_linestatus, count(*) AS n, avg(p) AS mean_p FROM preds
WHERE (p > 0.6 AND y = 0) OR (p < 0.4 AND y = 1) GROUP BY ALL""", ["preds"])
def confidently_wrong(spark, d):
    return E.confidently_wrong(preds(spark, d), "y", "p").groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"))


@query("slice_filter", [], """
SELECT l_orderkey, l_linenumber, p, y FROM preds WHERE l_linestatus = 'F' AND l_linenumber = 3""", ["preds"])
def slice_filter(spark, d):
    return E.slice_filter(preds(spark, d), "l_linestatus×l_linenumber", "F×3").select("l_orderkey", "l_linenumber", "p", "y")


@query("header_summary", ["top_slice"], f"""
SELECT count(*) AS total_pa, avg(y) AS positive_rate, avg({LOSS}) AS overall_loss,
  (SELECT concat(feature, '=', value) FROM ({CONTRIB}) ORDER BY contribution DESC, feature, value LIMIT 1) AS top_slice
FROM preds""", ["preds"])
def header_summary(spark, d):
    s = sliced(spark, d)
    return E.header(s, "y", "p", E.slice_contribution(s, "y", "p", SLICES, PAIRS))


EDGES = [i / 10 for i in range(11)]


@query("reliability_bins", [], """
SELECT list_extract([0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95], i + 1) AS bin_mid, avg(p) AS pred_mean,
  avg(y) AS actual_rate, count(*) AS n
FROM (SELECT *, (p >= 0.1::DOUBLE)::INT + (p >= 0.2::DOUBLE)::INT + (p >= 0.30000000000000004::DOUBLE)::INT + (p >= 0.4::DOUBLE)::INT
  + (p >= 0.5::DOUBLE)::INT + (p >= 0.6000000000000001::DOUBLE)::INT + (p >= 0.7000000000000001::DOUBLE)::INT
  + (p >= 0.8::DOUBLE)::INT + (p >= 0.9::DOUBLE)::INT AS i FROM preds) GROUP BY i""".replace("GROUP BY i", "GROUP BY i"), ["preds"])
def reliability_bins(spark, d):
    return E.reliability_bins(preds(spark, d), "y", "p")


QC = """(SELECT b.bin, b.lo, b.hi, count(p) AS n, round_even(avg(p) * 1000, 0) / 1000 AS mean_pred,
  round_even(avg(y) * 1000, 0) / 1000 AS obs_hit_rate
FROM (SELECT i AS bin, e[i + 1] AS lo, e[i + 2] AS hi FROM
  (SELECT quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM preds), range(10) r(i)) b
LEFT JOIN preds ON p >= b.lo AND p < b.hi GROUP BY ALL)"""


@query("quantile_calibration", ["bucket", "reliable"], f"""
SELECT concat(format('{{:.3f}}', lo), '–', format('{{:.3f}}', hi)) AS bucket, n >= 500 AS reliable, * FROM {QC}""", ["preds"])
def quantile_calibration(spark, d):
    return E.quantile_calibration(preds(spark, d), "y", "p", 10, 500)


ECE_MURPHY = f"""
SELECT sum(n * abs(mean_pred - obs_hit_rate)) / sum(n) AS ece, sum(n * (mean_pred - obs_hit_rate) ** 2) / sum(n) AS reliability,
  sum(n * (obs_hit_rate - b) ** 2) / sum(n) AS resolution, max(b * (1 - b)) AS uncertainty,
  sum(n * (mean_pred - obs_hit_rate) ** 2) / sum(n) - sum(n * (obs_hit_rate - b) ** 2) / sum(n) + max(b * (1 - b))
    AS brier_reconstructed
FROM {QC}, (SELECT avg(y) AS b FROM preds)"""


@query("ece_murphy", [], ECE_MURPHY, ["preds"])
def ece_murphy(spark, d):
    p = preds(spark, d)
    b = E.quantile_calibration(p, "y", "p")
    return E.expected_calibration_error(b).crossJoin(E.murphy(p, "y", b))


DEC = """
SELECT p10, p90, count(*) FILTER (p <= p10) AS bottom_n, count(*) FILTER (p >= p90) AS top_n,
  avg(y) FILTER (p <= p10) AS bottom_decile_rate, avg(y) FILTER (p >= p90) AS top_decile_rate,
  avg(y) FILTER (p >= p90) - avg(y) FILTER (p <= p10) AS decile_spread
FROM preds, (SELECT quantile_cont(p, 0.1) AS p10, quantile_cont(p, 0.9) AS p90 FROM preds) GROUP BY p10, p90"""


@query("decile_spread", [], DEC, ["preds"])
def decile_spread(spark, d):
    return E.decile_spread(preds(spark, d), "y", "p")


BYP = "(SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM preds GROUP BY p)"
AUC = f"""SELECT sum(pos * (b + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)) AS roc_auc FROM (
  SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {BYP})"""
AP = f"""SELECT sum(pos * tp::DOUBLE / (tp + fp)) / sum(pos) AS pr_auc FROM (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM {BYP} WINDOW w AS (ORDER BY p DESC))"""


@query("roc_auc", [], AUC, ["preds"])
def roc_auc(spark, d):
    return E.roc_auc(preds(spark, d), "y", "p")


@query("average_precision", [], AP, ["preds"])
def average_precision(spark, d):
    return E.average_precision(preds(spark, d), "y", "p")


SCORES = f"""SELECT *, baseline_brier - brier AS brier_delta, baseline_log_loss - log_loss AS log_loss_delta,
  (baseline_brier - brier) / baseline_brier * 100 AS brier_improvement_pct,
  (baseline_log_loss - log_loss) / baseline_log_loss * 100 AS log_loss_improvement_pct
FROM (SELECT avg((p - y) ** 2) AS brier, avg({LOSS}) AS log_loss, avg((0.3 - y) ** 2) AS baseline_brier,
  avg(-(y * ln(0.3) + (1 - y) * ln(0.7))) AS baseline_log_loss FROM preds)"""


@query("probability_scores", [], SCORES, ["preds"])
def probability_scores(spark, d):
    return E.probability_scores(preds(spark, d).withColumn("base", F.lit(0.3)), "y", "p", "base")


@query("metrics_report", [], f"""
SELECT * FROM ({ECE_MURPHY}), ({SCORES}), ({AUC}), ({AP}), (SELECT * EXCLUDE (p10, p90) FROM ({DEC}))""", ["preds"])
def metrics_report(spark, d):
    return E.metrics_report(preds(spark, d).withColumn("base", F.lit(0.3)), "y", "p", "base")


@query("fixed_bucket_report", [], f"""
SELECT CASE WHEN p < 0.1 THEN 0 WHEN p < 0.2 THEN 1 WHEN p < 0.3 THEN 2 WHEN p < 0.4 THEN 3 WHEN p < 0.5 THEN 4 ELSE 5 END
  AS bucket, count(*) AS n, avg(p) AS mean_pred, avg(y) AS hit_rate, avg({LOSS}) AS log_loss FROM preds GROUP BY ALL""", ["preds"])
def fixed_bucket_report(spark, d):
    return E.fixed_buckets(preds(spark, d), "y", "p")


@query("confusion_matrix", [], "SELECT y AS actual, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS predicted, count(*) AS n FROM preds GROUP BY ALL", ["preds"])
def confusion_matrix(spark, d):
    return E.confusion(preds(spark, d), "y", "p")


@query("feature_vs_outcome", [], """
SELECT bin, e[bin] AS bin_lo, e[bin + 1] AS bin_hi, avg(y) AS mean_outcome, count(*) AS n FROM (
  SELECT y, e, greatest(len(list_filter(e, lambda v: v < x)), 1) AS bin
  FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_extendedprice AS x FROM lineitem), (SELECT list_sort(list_distinct(quantile_cont(l_extendedprice,
    [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM lineitem)) GROUP BY bin, e""")
def feature_vs_outcome(spark, d):
    return E.outcome_by_bin(preds(spark, d), "l_extendedprice", "y").drop("bin_label")


@query("feature_vs_outcome_category", ["bin_label"], """
SELECT CAST(l_linenumber AS VARCHAR) AS bin_label, avg(y) AS mean_outcome, count(*) AS n FROM preds GROUP BY ALL""", ["preds"])
def feature_vs_outcome_category(spark, d):
    return E.outcome_by_category(preds(spark, d), "l_linenumber", "y")


@query("missing_report", ["feature"], """
SELECT feature, pct_missing FROM (SELECT avg((zone IS NULL)::INT) AS zone, avg((play_result IS NULL)::INT) AS play_result,
  avg((launch_speed IS NULL)::INT) AS launch_speed, avg((start_speed IS NULL)::INT) AS start_speed FROM raw)
UNPIVOT INCLUDE NULLS (pct_missing FOR feature IN (zone, play_result, launch_speed, start_speed))""", ["raw"])
def missing_report(spark, d):
    return E.missing_report(t.pitches_raw(spark, d).select("zone", "play_result", "launch_speed", "start_speed"))


@query("histogram", ["y"], """
SELECT y, bin, lo + bin * w AS bin_lo, n, n::DOUBLE / (sum(n) OVER (PARTITION BY y) * w) AS density FROM (
  SELECT CAST(y AS VARCHAR) AS y, least(floor((p - lo) / w), 49) AS bin, lo, w, count(*) AS n
  FROM preds, (SELECT min(p) AS lo, (max(p) - min(p)) / 50 AS w FROM preds) GROUP BY ALL)""", ["preds"])
def histogram(spark, d):
    return E.histogram(preds(spark, d).withColumn("y", F.col("y").cast("string")), "p", 50, ["y"], density=True)


@query("entity_series", ["day", "l_linestatus"], """
SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, l_linestatus, p FROM preds WHERE l_suppkey = 7 AND year(l_shipdate) = 1998""", ["preds"])
def entity_series(spark, d):
    x = preds(spark, d).withColumn("game_season", F.year("l_shipdate"))
    s = E.entity_series(x, "l_suppkey", 7, "l_shipdate", "p", 1998, "l_linestatus")
    return s.select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_linestatus", "p")


@query("mae_lift", [], f"""
SELECT mae, mae_baseline, mae_baseline - mae AS lift FROM (
  SELECT avg(abs(x - pred)) AS mae, avg(abs(x - coalesce(b, m))) AS mae_baseline FROM (
    SELECT o_totalprice AS x, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS pred,
      avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS b
    FROM orders), (SELECT avg(o_totalprice) AS m FROM orders))""")
def mae_lift(spark, d):
    from lagwell.plans.frames import Feature, lagged, last
    o = t.read(spark, d, "orders")
    means = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("pred"))
    x = lagged(o, "o_custkey", ["o_orderdate", "o_orderkey"], [Feature("b", "avg", "o_totalprice", last(30))])
    return E.mae_lift(x.join(F.broadcast(means), "o_orderpriority"), "o_totalprice", "pred", "b")


@query("describe_corr", ["column"], """
SELECT 'l_quantity' AS "column", count(l_quantity) AS "count", avg(l_quantity) AS mean, stddev(l_quantity) AS std,
  min(l_quantity) AS "min", max(l_quantity) AS "max", quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_quantity, 0.5) AS p50,
  quantile_cont(l_quantity, 0.75) AS p75, corr(l_quantity, l_extendedprice) AS r FROM lineitem
UNION ALL SELECT 'l_extendedprice', count(l_extendedprice), avg(l_extendedprice), stddev(l_extendedprice), min(l_extendedprice),
  max(l_extendedprice), quantile_cont(l_extendedprice, 0.25), quantile_cont(l_extendedprice, 0.5),
  quantile_cont(l_extendedprice, 0.75), corr(l_quantity, l_extendedprice) FROM lineitem""")
def describe_corr(spark, d):
    l = t.read(spark, d, "lineitem")
    cols = ["l_quantity", "l_extendedprice"]
    r = E.correlations(l, cols).select(F.col("corr").alias("r"))
    return E.describe(l, cols).crossJoin(F.broadcast(r))


@query("bootstrap_ci", [])
def bootstrap_ci(spark, d):
    return E.bootstrap_ci(preds(spark, d), "y", "p")


@query("slice_cis", ["feature", "value"])
def slice_cis(spark, d):
    return E.slice_intervals(sliced(spark, d), "y", "p", SLICES, PAIRS)
