"""Transfer chunks as files of one folder, and such a folder as messages again."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(chunks: DataFrame, folder: str) -> int:
    """One file for each of ``chunks(rel_path, block, chunk_index, message)``, exactly its bytes; how many there are.

    Tasks write below ``folder``, which all machines must mount.  A file is complete
    before it has its name, so a task that runs again only replaces it.
    """

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for name, message in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                path = os.path.join(folder, name)
                with open(f"{path}.{os.getpid()}.new", "wb") as f:
                    f.write(message.encode("utf-8", "replace"))
                os.replace(f"{path}.{os.getpid()}.new", path)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    name = F.format_string("%s-block-%05d-chunk-%05d.txt", F.left(F.sha2("rel_path", 256), F.lit(8)), "block", "chunk_index")
    return chunks.select(name.alias("name"), "message").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, message)`` of a folder of chunk files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*block-*-chunk-*.txt").load(folder)
    return found.select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), F.col("content").cast("string").alias("message"))
