"""From raw documents to a mixed training corpus, stage by stage.

Every stage keeps rows of its input (``documents`` with all their columns) but the last,
which deals them to shards, some more than once.  Each stage's rows are written as
Parquet and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprof.llm import decontaminate, language, mixing, quality, simhash
from sparkprof.llm.queries import GOOD, remainder
from sparkprof.scratch import write_once

# A document stays if its language is this likely.
SURE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as good; all if there is no label to learn from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(remainder("doc_id", 4) != 2)
    model = quality.fit(docs, labels)
    return docs.filter(model.score(F.col("text")) >= GOOD) if model.trained else docs


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known for sure; all if there is none to learn from."""
    model = language.fit(docs.filter(remainder("doc_id", 3) != 1))
    name = simhash.fresh(docs, "language")
    found = docs.withColumn(name, model.predict(F.col("text")))
    sure = (F.col(name)["lang_pred"] != language.UNKNOWN) & (F.col(name)["score"] >= SURE)
    return found.filter(sure).drop(name) if model.languages else docs


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on shingles of five words."""
    return simhash.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources, a row for each time a document is taken."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
]

# Trained models, fingerprints and seeded draws cannot be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
