"""Intermediate tables in the shared folder that the cluster names, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder, which only a local master may use."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Spark's own setting: shuffle files of a statement go when it ends, not when its plan happens to be collected as garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, **options) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: lineage ends here, whatever executors are lost later.

    The shuffles of the write are freed when it ends; nothing reads them again, as the rows stand in the folder.
    """
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/{uuid.uuid4().hex}", spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_FREED, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """(v, c): for each end of an edge (a, b of bigint) the smallest vertex that is reachable.

    Alternating large-star and small-star steps: each replaces edges by edges to smaller neighbours, so a star around the
    smallest vertex remains. Neighbour minima are partial aggregates, and the joins back on a hot vertex are ones that
    adaptive execution can split. Each round is staged; the former round's table is deleted. Rounds go on until nothing
    changes; their number grows with the logarithm of the longest path.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    last = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if seen[0] == 0 or seen == last:
            break
        last = seen
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = staged(small.filter("a <> b").distinct())
        discard(now)
        now = new
    labels = now.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("c"))
    return labels.unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("c")).distinct())
