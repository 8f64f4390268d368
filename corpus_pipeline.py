"""Corpus pipeline: toxicity, near duplicates, benchmark contamination, mixing to target weights, token ids.

Each stage is a function (spark, docs, sf_dir) of the documents that the stage before kept; its decisions take effect, and all but
the last return the columns they were given. `run` writes each stage's rows as Parquet in the shared folder and reads them again.

Inside a stage the rows travel as one struct beside the columns it needs, so columns of any name pass through. An empty table gives
an empty table. Rows with a null doc_id are never near duplicates of others and stay; of several rows of one doc_id in one group one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lagwell.llm import decontaminate, jaccard, kneser, mixing, tokens
from lagwell.llm.queries import tokenizer_path
from lagwell.llm.stage import staged


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and the whole row as the struct `row__`."""
    return docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row__"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the cut; models learn from the labelled documents among those given."""
    scored = kneser.scored(_packed(docs, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter(F.col("toxic_score") < kneser.CUT).select("row__.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of similar ones."""
    rows = jaccard.grouped(docs.select("doc_id", "text")).filter("doc_id = component_id")
    # of a component's rows of its smallest doc_id, those with the smallest text hash; ids may repeat in other components
    first = staged(rows.groupBy("doc_id", "c").agg(F.min("text_hash").alias("__x")).select(F.col("doc_id").alias("__d"), "__x").distinct())
    rows = _packed(docs, "doc_id", "text")
    kept = rows.join(first, (F.col("doc_id") == F.col("__d")) & (F.xxhash64("text") == F.col("__x")), "left_semi")
    once = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
    kept = kept.withColumn("__n", F.row_number().over(once)).filter("__n = 1").select("row__.*")
    return kept.unionByName(docs.filter("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth repeats windows of the benchmark."""
    found = decontaminate.contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated")
    bad = found.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__x")).distinct()
    hit = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__x"))
    return _packed(docs, "doc_id", "text").join(bad, hit, "left_anti").select("row__.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample that calibrated probabilities draw; sources, languages and topics approach their target shares."""
    return mixing.mixed(_packed(docs, "doc_id", "text", "source", "lang")).filter("mix_kept").select("row__.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document, read back from the token files: doc_id, start, n_tokens, ids_crc32."""
    return tokens.token_table(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("mixing", mix),
    ("token_output", token_ids),
]

#: The learned toxicity scores can't be said in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
