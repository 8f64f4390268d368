"""Exact quantiles and running totals against numpy."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lagwell.plans.ranks import exact_quantiles, running_totals

QS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def test_quantiles_match_numpy(spark):
    d = spark.range(997).selectExpr(
        "id", "case when id % 3 = 0 then 'a' else 'b' end as g",
        "case when id % 11 = 0 then null when id % 2 = 0 then 5.0D else exp(pmod(hash(id), 1000) / 100.0D) end as v")
    got = {(r["g"], r["q"]): r["value"] for r in exact_quantiles(d, "v", QS, ["g"]).collect()}
    vals = {}
    for r in d.collect():
        if r["v"] is not None:
            vals.setdefault(r["g"], []).append(r["v"])
    for g, v in vals.items():
        for q in QS:
            assert got[g, q] == pytest.approx(np.percentile(v, q * 100), rel=1e-12)


def test_constant_column(spark):
    d = spark.range(5).select(F.lit(0.25).alias("v"))
    assert {r["value"] for r in exact_quantiles(d, "v", QS).collect()} == {0.25}


def test_running_totals_descending(spark):
    d = spark.createDataFrame([(0.1, 1), (0.7, 2), (0.3, 4)], "p double, n long")
    r = rows(running_totals(d, "p", ["n"], descending=True), "p")
    assert [x["before_n"] for x in r] == [6, 2, 0]


def test_concentrated_and_outlying_values(spark):
    d = spark.range(3000).selectExpr("id", "case when id = 7 then 1e12D when id % 3 = 0 then 0.2D + id * 1e-9D else id % 40 * 1.0D end as v", "1L as n")
    v = np.array([r["v"] for r in d.collect()])
    got = {r["q"]: r["value"] for r in exact_quantiles(d, "v", QS).collect()}
    assert all(got[q] == pytest.approx(np.percentile(v, q * 100), rel=1e-12) for q in QS)
    folded = d.groupBy("v").agg(F.sum("n").alias("n"))
    r = rows(running_totals(folded, "v", ["n"]).withColumn("k", F.col("v")), "v")
    below = {x["v"]: x["before_n"] for x in r}
    assert all(below[x] == (v < x).sum() for x in set(v.tolist()))
