"""Size checks and session settings shared by the plans.

Intermediates are staged in the shared checkpoint folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "lagwell", cores: str = "*", shuffle_partitions: int | None = None,
            **conf) -> SparkSession:
    """A local session for tests and benchmarks; a cluster supplies its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), str(v))
    return short_methods(b.getOrCreate())


#: Spark's own setting. The JVM never compiles a method of more than 8,000 bytes, so a wide projection fused into one runs interpreted.
_LONGEST = "spark.sql.codegen.hugeMethodLimit"


def short_methods(spark: SparkSession) -> SparkSession:
    """Have Spark split generated code that the JVM would not compile; a limit that the session already sets lower stays."""
    if int(spark.conf.get(_LONGEST)) > 8000:
        spark.conf.set(_LONGEST, "8000")
    return spark


def scratch(spark: SparkSession) -> str:
    """The shared folder the session names; a temporary one only for local sessions."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.sparkContext.getCheckpointDir() is not None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Spark's own setting: shuffle files of a statement go when it ends, not when its plan happens to be collected as garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate once, as Parquet in the shared folder, and read it from there.

    Cuts lineage, survives lost executors, keeps column pruning and gives exact sizes. The shuffles of the write are freed when
    it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path, before = f"{scratch(spark)}/lagwell-{uuid.uuid4().hex}", spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """Broadcast hint only where the optimizer's own size estimate is under the limit."""
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:
        return df
    return F.broadcast(df) if size <= limit else df


def parts(df: DataFrame, limit: int = 2 << 20) -> int:
    """Number of shuffle partitions for rows of df: at most `limit` estimated bytes of its input each, never fewer than the session's."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // limit), 20_000))


def one_row(df: DataFrame) -> DataFrame:
    """Broadcast of a global aggregate, which is one row by construction."""
    return F.broadcast(df)
