"""Diagnostics against numpy and hand-computed values."""

import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lagwell.operators import evaluate as E

TOY = [(1, 0.8, "L", "R"), (0, 0.3, "R", "R"), (1, 0.6, "L", "L"), (0, 0.4, "R", "L"), (1, 0.9, "L", "R"), (0, 0.1, "R", "L"),
       (1, 0.35, "L", "R"), (0, 0.7, "R", "R")]


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame(TOY, "is_hit int, pred_prob double, batSide string, pitcher_hand string")


@pytest.fixture(scope="module")
def biased(spark):
    rng = np.random.default_rng(42)
    data = []
    for i in range(1000):
        side = "L" if i % 2 else "R"
        y = int(rng.random() < 0.25)
        data.append((y, 0.9 if side == "L" and y == 0 else 0.25, side))
    return spark.createDataFrame(data, "is_hit int, pred_prob double, batSide string").cache()


def loss(y, p):
    return -(y * math.log(p) + (1 - y) * math.log(1 - p))


def test_row_loss(toy):
    for r in E.with_loss(toy, "is_hit", "pred_prob").collect():
        assert r["loss"] == pytest.approx(loss(r["is_hit"], r["pred_prob"]))


def test_extreme_probability_is_clipped(spark):
    d = spark.createDataFrame([(1, 0.0)], "y int, p double")
    assert E.with_loss(d, "y", "p").first()["loss"] == pytest.approx(-math.log(1e-15))


def test_contribution(biased):
    r = E.slice_contribution(biased, "is_hit", "pred_prob", ["batSide"]).collect()
    assert r[0]["value"] == "L" and r[0]["contribution"] > 0 > r[1]["contribution"]
    assert sum(x["contribution"] for x in r) == pytest.approx(0.0, abs=1e-9)
    assert E.slice_contribution(biased, "is_hit", "pred_prob", ["batSide"], min_n=501).count() == 0


def test_interactions_are_real_columns(toy):
    got = {(r["feature"], r["value"]) for r in E.slices(toy, ["batSide"], [("batSide", "pitcher_hand")]).collect()}
    assert ("batSide×pitcher_hand", "L×R") in got and ("batSide", "R") in got and len(got) == 6
    assert E.slice_filter(toy, "batSide×pitcher_hand", "L×R").count() == 3


def test_bootstrap_is_reproducible_and_brackets_the_point(biased):
    a = E.bootstrap_ci(biased, "is_hit", "pred_prob", n_iter=300).first()
    b = E.bootstrap_ci(biased.repartition(7), "is_hit", "pred_prob", n_iter=300).first()
    c = E.bootstrap_ci(biased, "is_hit", "pred_prob", n_iter=300, seed=7).first()
    assert a["lo"] == pytest.approx(b["lo"], rel=1e-12) and a["hi"] == pytest.approx(b["hi"], rel=1e-12)
    assert a["lo"] < a["point"] < a["hi"] and a["lo"] != c["lo"]
    x = np.array([loss(r["is_hit"], r["pred_prob"]) for r in biased.collect()])
    boot = np.random.default_rng(1).choice(x, (2000, len(x))).mean(axis=1)
    assert a["lo"] == pytest.approx(np.percentile(boot, 2.5), abs=0.02)
    assert a["hi"] == pytest.approx(np.percentile(boot, 97.5), abs=0.02)


def test_bootstrap_widens_with_fewer_rows(biased):
    small = biased.limit(60)
    width = lambda d: (lambda r: r["hi"] - r["lo"])(E.bootstrap_ci(d, "is_hit", "pred_prob", n_iter=300).first())
    assert width(small) > width(biased)


def test_calibration_edges(spark):
    d = spark.range(100).selectExpr("cast(id % 2 as int) as y", "id / 100.0D as p")
    b = rows(E.quantile_calibration(d, "y", "p", 10), "bin")
    assert sum(r["n"] for r in b) == 99  # the maximum falls outside the half-open bins
    assert sum(r["n"] for r in E.quantile_calibration(d, "y", "p", 10, closed_last=True).collect()) == 100
    flat = E.quantile_calibration(d.withColumn("p", F.lit(0.5)), "y", "p", 10).collect()
    assert [r["n"] for r in flat] == [0] * 10 and flat[0]["mean_pred"] is None


def test_ranking_with_ties(spark):
    data = [(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1), (0, 0.9)]
    d = spark.createDataFrame(data, "y int, p double")
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for y, a in data if y for z, b in data if not z]
    assert E.roc_auc(d, "y", "p").first()["roc_auc"] == pytest.approx(sum(pairs) / len(pairs))
    # recall steps: 0.9 takes one of two positives at precision 1/2, 0.5 the other at 2/4
    assert E.average_precision(d, "y", "p").first()["pr_auc"] == pytest.approx(0.5 * 0.5 + 0.5 * 0.5)


def test_quantile_bins_merge_equal_edges(spark):
    d = spark.createDataFrame([(v, i % 2) for i, v in enumerate([1.0, 1.0, 1.0, 1.0, 2.0, 3.0, 4.0, 5.0])], "x double, y int")
    r = rows(E.outcome_by_bin(d, "x", "y", 4), "bin")
    assert [x["n"] for x in r] == [4, 2, 2] and r[0]["bin_label"].startswith("(0.999, ")


def test_missing_and_histogram(spark):
    d = spark.createDataFrame([(1.0, None), (2.0, "a"), (None, "b"), (4.0, None)], "x double, s string")
    assert [(r["feature"], r["pct_missing"]) for r in E.missing_report(d).collect()] == [("s", 0.5), ("x", 0.25)]
    assert sorted((r["bin"], r["n"]) for r in E.histogram(d, "x", 3).collect()) == [(0, 1), (1, 1), (2, 1)]
