"""Baseline models on Spark ML, with their scored validation rows and importances."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwell.plans.ranks import numbered
from lagwell.plans.scale import one_row, stage


def prior_model(train: DataFrame, val: DataFrame, target: str) -> DataFrame:
    """The training rate as every row's probability."""
    m = train.agg(F.avg(F.col(target).cast("double")).alias("probability"))
    return val.crossJoin(one_row(m))


def _vector(cols):
    return VectorAssembler(inputCols=cols, outputCol="_features", handleInvalid="keep")


def _scored(model, val):
    return model.transform(val).withColumn("probability", vector_to_array("probability")[1]).drop(
        "_features", "_scaled", "rawPrediction", "prediction")


def _rows(train: DataFrame, target: str, cols: list[str]) -> DataFrame:
    """What a fit reads, staged: fits go over their rows many times, and each pass would derive them anew."""
    return stage(train.select(*dict.fromkeys([target, *cols])))


def _alike(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Rows ordered inside their partitions, by the columns with the fewest values first.

    A forest sends every row through all its trees at each level; rows alike that follow one another take the same nodes and bins,
    which then stay in the processor's cache.
    """
    n = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    return rows.sortWithinPartitions(*sorted(cols, key=lambda c: (n[c], c)))


def logistic(train: DataFrame, val: DataFrame, target: str, cols: list[str], max_iter: int = 100):
    scale = StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True, withStd=True)
    lr = LogisticRegression(featuresCol="_scaled", labelCol=target, maxIter=max_iter, standardization=False)
    model = Pipeline(stages=[_vector(cols), scale, lr]).fit(_rows(train, target, cols))
    return model, _scored(model, val)


def forest(train: DataFrame, val: DataFrame, target: str, cols: list[str], trees: int = 100, depth: int = 10, seed: int = 42):
    """Random forest with leaves of five rows and square-root feature sampling."""
    rf = RandomForestClassifier(featuresCol="_features", labelCol=target, numTrees=trees, maxDepth=depth,
                                minInstancesPerNode=5, featureSubsetStrategy="sqrt", seed=seed)
    model = Pipeline(stages=[_vector(cols), rf]).fit(_alike(_rows(train, target, cols), cols))
    return model, _scored(model, val)


def boosted(train: DataFrame, val: DataFrame, target: str, cols: list[str], rounds: int = 100, depth: int = 4,
            rate: float = 0.1, seed: int = 42):
    """Boosted trees that stop early on the validation rows."""
    both = train.withColumn("_val", F.lit(False)).unionByName(val.withColumn("_val", F.lit(True)))
    gbt = GBTClassifier(featuresCol="_features", labelCol=target, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed,
                        validationIndicatorCol="_val")
    model = Pipeline(stages=[_vector(cols), gbt]).fit(_rows(both, target, [*cols, "_val"]))
    return model, _scored(model, val)


def poisson(train: DataFrame, val: DataFrame, target: str, cols: list[str]):
    """Log-linear Poisson regression, to compare boosted counts with."""
    glm = GeneralizedLinearRegression(featuresCol="_features", labelCol=target, family="poisson", link="log",
                                      predictionCol="prediction", regParam=1e-6)
    model = Pipeline(stages=[_vector(cols), glm]).fit(_rows(train, target, cols))
    return model, model.transform(val).drop("_features")


def importances(model, cols: list[str], spark) -> DataFrame:
    """Feature importances of a fitted tree model, largest first; one row per feature."""
    v = model.stages[-1].featureImportances
    rows = [(c, float(v[i])) for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


# ---- boosted counts ----------------------------------------------------------------------

class CountTrees:
    """Boosted trees under the Poisson deviance: log mean = start + rate * (sum of the values of the leaves a row falls in)."""

    def __init__(self, cols: list[str], start: float, rate: float):
        self.cols, self.start, self.rate, self.steps = cols, start, rate, []

    def _step(self, df: DataFrame, tree, values: dict[int, float]) -> DataFrame:
        d = tree.transform(df)
        steps = F.create_map(*[F.lit(x) for leaf, v in values.items() for x in (float(leaf), self.rate * v)])
        # a leaf that no fitted row reached adds nothing
        return d.withColumn("_m", F.col("_m") + F.coalesce(F.element_at(steps, F.col("_leaf")), F.lit(0.0))).drop("_leaf", "_tree")

    def transform(self, df: DataFrame) -> DataFrame:
        d = _vector(self.cols).transform(df).withColumn("_m", F.lit(self.start))
        for i, (tree, values) in enumerate(self.steps):
            d = self._step(d, tree, values)
            if i % 25 == 24:
                d = stage(d)  # the plan stays short however many trees there are
        return d.withColumn("prediction", F.exp("_m")).drop("_features", "_m")


def boosted_counts(train: DataFrame, val: DataFrame, target: str, cols: list[str], rounds: int = 300, depth: int = 4,
                   rate: float = 0.05, leaf_rows: int = 5, patience: int = 10, seed: int = 42):
    """Gradient boosting of counts under the Poisson deviance; stops when `patience` rounds bring the validation rows nothing.

    A round fits one Spark tree to the gradients (count less mean) and then sets each leaf by a Newton step, gradients over means,
    from one grouped sum; the same sums of the validation rows give their deviance after the step, without another pass. Trees
    after the best round are dropped. Rows with a NULL or negative target are left out. Returns the model and the scored
    validation rows.
    """
    known = lambda d, held: d.filter(F.col(target) >= 0).withColumn("_val", F.lit(held))
    both = _vector(cols).transform(known(train, False).unionByName(known(val, True)))
    y = F.col(target).cast("double")
    mean = train.filter(F.col(target) >= 0).agg(F.avg(y)).first()[0]
    if not mean:
        raise ValueError("boosted counts need a training row with a count above 0")
    model = CountTrees(cols, math.log(mean), rate)
    now = stage(both.select(y.alias("_y"), "_features", "_val", F.lit(model.start).alias("_m")))
    best, best_at = None, 0
    for i in range(rounds):
        grown = now.withColumn("_g", F.col("_y") - F.exp("_m"))
        fit = DecisionTreeRegressor(featuresCol="_features", labelCol="_g", predictionCol="_tree", leafCol="_leaf", maxDepth=depth,
                                    minInstancesPerNode=leaf_rows, seed=seed + i)
        tree = fit.fit(grown.filter("NOT _val"))
        sums = tree.transform(grown).groupBy("_val", "_leaf").agg(
            F.sum("_g").alias("g"), F.sum(F.exp("_m")).alias("u"), F.sum("_y").alias("y"), F.sum(F.col("_y") * F.col("_m")).alias("ym"),
            F.count(F.lit(1)).alias("n")).collect()  # at most two rows a leaf
        values = {int(r["_leaf"]): r["g"] / r["u"] for r in sums if not r["_val"]}
        model.steps.append((tree, values))
        now = model._step(now, tree, values)
        held = [r for r in sums if r["_val"]]
        if held:
            step = lambda r: rate * values.get(int(r["_leaf"]), 0.0)
            loss = sum(r["u"] * math.exp(step(r)) - r["ym"] - r["y"] * step(r) for r in held) / sum(r["n"] for r in held)
            if best is None or loss < best:
                best, best_at = loss, i + 1
            elif i + 1 - best_at >= patience:
                break
        else:
            best_at = i + 1
        if i % 5 == 4:
            now = stage(now)
    model.steps = model.steps[:best_at]
    return model, model.transform(val)


def poisson_deviance(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """One row: mean Poisson deviance of predicted means."""
    y, u = F.col(target).cast("double"), F.col(prediction).cast("double")
    return df.agg(F.avg(2 * (F.when(y > 0, y * F.log(y / u)).otherwise(0.0) - (y - u))).alias("deviance"))


# ---- permutation importance --------------------------------------------------------------

def _rounds(count: int, seed: int, draw: str):
    """Feistel rounds over the next power of two as an expression of a place, and the width and masks of its halves."""
    bits = max(2, (count - 1).bit_length())
    low = bits // 2
    mask_low, mask_high = (1 << low) - 1, (1 << bits - low) - 1
    # each round changes one half by what the other holds, which the same round would undo: no two numbers meet
    rounds = lambda x: f"""aggregate(array(0, 1, 2, 3, 4, 5), named_struct('h', shiftright({x}, {low}), 'l', {x} & {mask_low}L), (s, k) ->
        CASE WHEN k % 2 = 0 THEN named_struct('h', s.h ^ (xxhash64({seed}L, {draw}, k, s.l) & {mask_high}L), 'l', s.l)
        ELSE named_struct('h', s.h, 'l', s.l ^ (xxhash64({seed}L, {draw}, k, s.h) & {mask_low}L)) END, s -> shiftleft(s.h, {low}) | s.l)"""
    return rounds, low, mask_low, mask_high


def dealt_out(number: str, count: int, seed: int, draw: str) -> Column:
    """A keyed bijection of 0..count-1: alternating Feistel rounds over the next power of two, walked until the place is in range.

    Which place a number goes to depends on count, seed and draw alone.
    """
    rounds = _rounds(count, seed, draw)[0]
    return F.expr(f"get(transform(array({rounds(f'CAST({number} AS BIGINT)')}), a -> {_walk(count, rounds)}), 0)")


def deal_out(df: DataFrame, number: str, count: int, seed: int, draw: str) -> DataFrame:
    """df with each number in its place of `dealt_out`. The first rounds, which are all for most rows, are plain columns that Spark compiles."""
    rounds, low, mask_low, mask_high = _rounds(count, seed, draw)
    kept = [c for c in df.columns if c != number]
    d = df.selectExpr(*kept, f"shiftright(CAST({number} AS BIGINT), {low}) AS _h", f"CAST({number} AS BIGINT) & {mask_low}L AS _l")
    for k in range(6):
        to, by, mask = ("_h", "_l", mask_high) if k % 2 == 0 else ("_l", "_h", mask_low)
        d = d.selectExpr(*kept, by, f"{to} ^ (xxhash64({seed}L, {draw}, {k}, {by}) & {mask}L) AS {to}")
    d = d.selectExpr(*kept, f"shiftleft(_h, {low}) | _l AS _a")
    return d.selectExpr(*kept, f"CASE WHEN _a < {count} THEN _a ELSE get(transform(array(_a), a -> {_walk(count, rounds)}), 0) END AS {number}")


def _walk(count: int, rounds) -> str:
    """Rounds until place a is in range; it stays out with a chance under a half each time, so 128 are never all needed, and 8 seldom."""
    walk = lambda steps, then: f"CASE WHEN a < {count} THEN a ELSE {then(f'aggregate(sequence(1, {steps}), a, (a, i) -> CASE WHEN a < {count} THEN a ELSE {rounds("a")} END)')} END"
    return walk(8, lambda x: f"get(transform(array({x}), a -> {walk(120, lambda y: y)}), 0)")


def permutation_importance(model, val: DataFrame, target: str, cols: list[str], key: list[str], repeats: int = 20,
                           seed: int = 42) -> DataFrame:
    """Mean and deviation of the rise in absolute error when a column is shuffled.

    Rows are numbered once, in the order of their key, which must be unique. A repeat sends the value of each row to the row that a
    keyed bijection names, so a column's repeats are one join on numbers and one job, and no draw depends on partitioning. The
    values travel alone and meet their row in a sorted merge, whose size in memory doesn't grow with the rows: Spark's estimate
    doesn't know how many rows the repeats make and would broadcast them.
    """
    rows = stage(numbered(val, key, "_n"))
    count = rows.count()
    mae = lambda d: F.avg(F.abs(F.col(target) - F.col("prediction"))).alias("mae")
    base = model.transform(rows).agg(mae(rows)).first()[0]
    runs = []
    for i, c in enumerate(cols):  # one job per column
        draws = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_r")
        sent = deal_out(rows.select("_n", c, draws), "_n", count, seed + i, "_r")
        mixed = rows.drop(c).join(sent.hint("merge"), "_n")
        runs += [(c, r["_r"], r["mae"]) for r in model.transform(mixed).groupBy("_r").agg(mae(mixed)).collect()]
    d = val.sparkSession.createDataFrame(runs, "feature string, draw int, mae double").withColumn("rise", F.col("mae") - F.lit(base))
    return d.groupBy("feature").agg(F.avg("rise").alias("importance"), F.stddev_pop("rise").alias("std")).orderBy(
        F.desc("importance"), "feature")


def residuals(df: DataFrame, target: str, prediction: str) -> DataFrame:
    r = F.col(target) - F.col(prediction)
    return df.withColumns({"residual": r, "abs_residual": F.abs(r)})


def log_run(metrics: DataFrame, params: dict, tags: dict, path: str) -> None:
    """Append one run's metrics with its parameters and tags to a Parquet run log."""
    text = lambda m: F.create_map(*[F.lit(str(x)) for kv in m.items() for x in kv]) if m else F.create_map().cast("map<string,string>")
    metrics.select(F.current_timestamp().alias("logged_at"), text(params).alias("params"), text(tags).alias("tags"),
                   F.struct(*metrics.columns).alias("metrics")).write.mode("append").parquet(path)
