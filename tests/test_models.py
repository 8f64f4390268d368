"""Boosted counts, permutations, codes, transitions and the bootstrap: brute force, large or hot keys, no dependence on partitioning."""

import math
import time

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lagwell.operators import evaluate as E
from lagwell.operators import ml, prep
from lagwell.operators import sequence as Q
from lagwell.plans import ranks


@pytest.fixture
def small_parts(spark):
    """Small tables keep their partitions, as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers_are_dense_and_don_t_depend_on_partitions(spark):
    d = spark.range(5000).selectExpr("id", "id * 7919 % 5003 AS k")
    for n in (1, 7):
        got = sorted((r.k, r.number) for r in ranks.numbered(d.repartition(n), ["k"]).collect())
        assert [x[1] for x in got] == list(range(5000))
    assert ranks.numbered(d.limit(0), ["k"]).count() == 0


def test_codes_of_a_large_column_are_spread_over_tasks(spark, small_parts):
    d = spark.range(30_000).selectExpr("concat('c', lpad(cast(id % 20000 AS string), 6, '0')) AS a", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN NULL ELSE 'x' END AS b")
    codes = prep.category_codes(d, ["a", "b"])
    got = {(r["column"], r["category"]): r["code"] for r in codes.collect()}
    assert [got["b", c] for c in ("hot", "missing", "x")] == [0, 1, 2]
    assert all(got["a", f"c{i:06d}"] == i for i in (0, 1, 777, 19_999)) and len(got) == 20_003
    parts = ranks.sorted_parts(d.select("a").distinct(), ["a"]).groupBy("_part").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 20_000


def test_transitions_with_a_user_who_holds_most_rows(spark, small_parts):
    d = spark.range(6000).selectExpr("CASE WHEN id % 3 <> 0 THEN 'hot' ELSE concat('u', id % 50) END AS k", "id AS i", "concat('v', id * id % 5) AS v")
    want, last = {}, {}
    for r in sorted(d.collect(), key=lambda r: (r.k, r.i)):
        pair = (last.get(r.k, "START"), r.v)
        want[pair] = want.get(pair, 0) + 1
        last[r.k] = r.v
    for v in last.values():
        want[v, "END"] = want.get((v, "END"), 0) + 1
    assert {(r["from"], r["to"]): r["n"] for r in Q.transitions(d, ["k"], ["i"], "v").collect()} == want
    hot = ranks.sorted_parts(d, ["k", "i"]).filter("k = 'hot'").select("_part").distinct().count()
    assert hot > 1


@pytest.mark.parametrize("count", [1, 2, 3, 5, 64, 65, 1000])
def test_every_draw_is_a_bijection(spark, count):
    d = spark.range(count).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("r")).select("id", "r", ml.dealt_out("id", count, 42, "r").alias("to"))
    got = {r: [x.to for x in sorted(d.filter(F.col("r") == r).collect(), key=lambda x: x.id)] for r in (0, 1)}
    assert all(sorted(x) == list(range(count)) for x in got.values())
    if count >= 64:
        assert got[0] != got[1] and sum(i == t for i, t in enumerate(got[0])) < count / 8
        assert abs(np.corrcoef(np.arange(count), got[0])[0, 1]) < 0.4


@pytest.mark.parametrize("count", [1, 5, 64, 1000])
def test_compiled_draws_are_the_same_draws(spark, count):
    d = spark.range(count).select("id", F.explode(F.array(F.lit(0), F.lit(7))).alias("r"), F.col("id").alias("was"))
    to = {(x.was, x.r): x.id for x in ml.deal_out(d, "id", count, 43, "r").collect()}
    assert to == {(x.was, x.r): x.to for x in d.select("was", "r", ml.dealt_out("id", count, 43, "r").alias("to")).collect()}


class _Plans:
    """A model of one column that keeps the plans of what it is given."""

    def __init__(self):
        self.plans = []

    def transform(self, d):
        self.plans.append(d._jdf.queryExecution().executedPlan().toString())
        return d.withColumn("prediction", F.col("a"))


def test_shuffled_values_are_merged_and_never_broadcast_or_gathered(spark):
    m = _Plans()
    ml.permutation_importance(m, spark.range(50).selectExpr("id", "cast(id AS double) AS a", "cast(id AS double) AS y"), "y", ["a"], ["id"], repeats=3)
    assert "SortMergeJoin" in m.plans[1] and "Broadcast" not in m.plans[1].split("SortMergeJoin")[0] and "collect_list" not in m.plans[1]


def test_fits_read_staged_rows(spark):
    d = spark.range(40).selectExpr("cast(id % 2 AS int) AS y", "cast(id AS double) AS a")
    assert [f for f in ml._rows(d, "y", ["a"]).inputFiles() if "lagwell-" in f]


class _Sum:
    """A model whose prediction is 3 a + b."""

    def transform(self, d):
        return d.withColumn("prediction", 3 * F.col("a") + F.col("b"))


def test_permutation_importance_ranks_and_is_reproducible(spark):
    d = spark.range(800).selectExpr("id", "cast(id * 37 % 101 AS double) AS a", "cast(id * 53 % 97 AS double) AS b", "cast(id % 7 AS double) AS c").withColumn("y", F.expr("3 * a + b"))
    one = ml.permutation_importance(_Sum(), d, "y", ["a", "b", "c"], ["id"], repeats=6)
    two = ml.permutation_importance(_Sum(), d.repartition(11), "y", ["a", "b", "c"], ["id"], repeats=6)
    got = {r["feature"]: (r["importance"], r["std"]) for r in one.collect()}
    assert got["c"] == (0.0, 0.0) and got["a"][0] > 2 * got["b"][0] > 10
    again = {r["feature"]: (r["importance"], r["std"]) for r in two.collect()}
    assert all(again[k] == pytest.approx(v) for k, v in got.items())
    # shuffled against itself, |3 (a - a')| has the mean of independent pairs
    a = np.array([i * 37 % 101 for i in range(800)])
    assert got["a"][0] == pytest.approx(3 * np.abs(a[:, None] - a[None]).mean(), rel=0.1)


def counts(spark, n=3000):
    rng = np.random.default_rng(5)
    x, z = rng.uniform(-2, 2, n), rng.uniform(-2, 2, n)
    y = rng.poisson(np.exp(0.4 + np.where(np.abs(x) > 1, 1.0, 0.0) - 0.8 * (x * z > 0)))
    return spark.createDataFrame([(i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(x, z, y, strict=True))], "id bigint, x double, z double, y int")


def test_boosted_counts_beat_the_linear_model_where_the_target_is_not_linear(spark):
    d = counts(spark)
    train, val = d.filter("id % 4 <> 0"), d.filter("id % 4 = 0")
    model, scored = ml.boosted_counts(train, val, "y", ["x", "z"], rounds=25, rate=0.3, patience=4)
    _, linear = ml.poisson(train, val, "y", ["x", "z"])
    dev = lambda s: ml.poisson_deviance(s, "y", "prediction").first()["deviance"]
    assert dev(scored) < 0.9 * dev(linear) and 2 <= len(model.steps) <= 25
    assert scored.filter("prediction > 0").count() == val.count()


def test_one_round_of_boosted_counts_equals_a_hand_made_stump(spark):
    data = [(float(x), y) for x, y in zip([1, 2, 3, 4, 10, 11, 12, 13], [1, 0, 2, 1, 5, 6, 4, 9], strict=True)]
    d = spark.createDataFrame(data, "x double, y int")
    model, scored = ml.boosted_counts(d, d, "y", ["x"], rounds=2, depth=1, rate=0.5, leaf_rows=1)
    x, y = (np.array(c, float) for c in zip(*data, strict=True))
    mean = np.full(8, y.mean())
    for _ in range(2):
        g = y - mean  # the tree parts the gradients where their squares around both means are least
        low = min((x < cut for cut in (x[1:] + x[:-1]) / 2), key=lambda s: g[s].var() * s.sum() + g[~s].var() * (~s).sum())
        for side in (low, ~low):
            mean[side] = mean[side] * math.exp(0.5 * g[side].sum() / mean[side].sum())
    assert [r["prediction"] for r in rows(scored.orderBy("x"))] == pytest.approx(list(mean)) and len(model.steps) == 2


def test_bootstrap_of_many_distinct_losses_is_fast_and_near_the_normal_interval(spark):
    d = spark.range(50_000).selectExpr("cast(pmod(xxhash64(id), 3) = 0 AS int) AS y", "0.05 + 0.9 * (id + 1) / 50001 AS p").repartition(8).cache()
    d.count()
    E.bootstrap_ci(d, "y", "p", n_iter=2).collect()  # a worker per core is up
    t = time.time()
    r = E.bootstrap_ci(d, "y", "p").first()
    took = time.time() - t
    loss = np.array([-math.log(x.p if x.y else 1 - x.p) for x in d.collect()])
    half = 1.96 * loss.std() / math.sqrt(len(loss))
    assert r["n"] == 50_000 and r["point"] == pytest.approx(loss.mean())
    assert (r["hi"] - r["lo"]) / 2 == pytest.approx(half, rel=0.1) and took < 5


def test_forest_rows_are_ordered_by_the_fewest_values_and_all_kept(spark):
    d = spark.range(4000).selectExpr("id", "CAST((id * 7919) % 1009 AS DOUBLE) AS many", "CAST((id * 31) % 5 AS DOUBLE) AS few").repartition(3, "id")
    d = d.withColumn("y", F.expr("CAST(few + many / 500 + (id % 3) > 4 AS INT)"))
    out = ml._alike(d, ["many", "few"])
    got = [[(r.few, r.many) for r in p] for p in out.rdd.glom().collect()]
    assert all(p == sorted(p) for p in got) and sum(map(len, got)) == 4000
    assert sorted(r.id for r in out.collect()) == list(range(4000))
    # a forest of other draws, as any other order of rows gives, that tells the rows apart as well
    scored = ml.forest(d, d, "y", ["many", "few"], trees=20, depth=5)[1]
    p = F.greatest(F.least("probability", F.lit(1 - 1e-9)), F.lit(1e-9))
    loss = scored.agg(F.avg(-F.log(F.when(F.col("y") == 1, p).otherwise(1 - p)))).first()[0]
    assert scored.count() == 4000 and loss < 0.45
