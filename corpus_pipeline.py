"""A corpus made ready for training, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept and
returns the columns of ``documents``; the last returns packed pieces.  ``run`` writes
each stage's result as Parquet in the shared checkpoint folder, reads it again, and
removes it once the next stage is written.

Stages decide by row, not by id: rows without an id, and rows of one id with different
texts, are kept or dropped each for its own text, and of rows equal in id and text one
stays.  Null and blank texts are one text, scored like any other.  Other columns of the
documents go through all stages but the last; empty tables give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import common, mil, packing, qgram, secrets, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    common.small_batches(spark)
    return mil.keep_good(docs, common.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies: five-word shingles, similarity 0.8 or more."""
    common.small_batches(spark)
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    common.small_batches(spark)
    return qgram.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return secrets.redact(docs, secrets.train(secrets.default_findings(spark)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents at their places in sequences of 2048 tokens."""
    common.small_batches(spark)
    return packing.pack(docs, packing.vocabulary())


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Models, components and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole ``documents`` table."""
    folder = f"{common.shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, last = common.table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            old = spark._jvm.org.apache.hadoop.fs.Path(last)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        last = path
    return docs
