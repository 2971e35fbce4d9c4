"""From raw documents to a training mix: each stage reads the whole table that the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.decontaminate import decontaminated
from hushframe.llm.line_dedup import without_duplicate_lines
from hushframe.llm.mixing import by_length, mixed
from hushframe.llm.quality import of_quality
from hushframe.llm.shared import staged
from hushframe.llm.simhash import without_near_duplicates

#: No SQL: the classifier, the fingerprints and the sample can't be expressed in it.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they now are."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def _begin(spark: SparkSession) -> None:
    """Frees the broadcasts and plans of earlier stages on the driver: Spark's cleaner waits for a full collection."""
    spark._jvm.System.gc()


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return of_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return _counted(without_duplicate_lines(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return without_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return _counted(decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return mixed(docs, importance=by_length())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
