"""Tables as corpora: one row a file, ``(rel_path, content)`` and what listing adds."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; only a session of one process may do without."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="shared-")


def checkpointed(rows: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/doc_id.lang``."""
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("rel_path"), F.col("text").alias("content"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as files named by their url."""
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("rel_path"), F.col("html").alias("content"))


def with_markers(files: DataFrame, every: int = 7) -> DataFrame:
    """The same files with a work marker or comment sign before some of their lines.

    Invented prose has neither; line k (from 0) gets ``# TODO`` where k is divisible by
    ``every`` and ``// `` where the rest is 3.
    """
    lines = F.split("content", "\n", -1)
    marked = F.transform(lines, lambda x, i: F.when(i % every == 0, F.concat(F.lit("# TODO "), x)).when(i % every == 3, F.concat(F.lit("// "), x)).otherwise(x))
    return files.withColumn("content", F.array_join(marked, "\n"))
