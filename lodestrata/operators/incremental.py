"""Incremental analysis: findings of unchanged files are taken from a cache table."""

from __future__ import annotations

import hashlib
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules

CACHE = (
    "rel_path string, hash string, todos array<struct<line_number:long,kind:string,content:string>>, secrets array<struct<line_number:long,pattern_name:string,is_test_fixture:boolean>>, fingerprint string"
)


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table; a missing one, or other rules, leave it empty."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(CACHE).parquet(path).where(F.col("fingerprint") == rules.fingerprint())
    except AnalysisException:
        return spark.createDataFrame([], CACHE)


def cache_path(folder: str, root: str) -> str:
    """Where the cache of a project is kept: a name of its own for each root folder."""
    name = re.sub("[^A-Za-z0-9._-]+", "-", os.path.basename(os.path.abspath(root))).strip("-.").lower() or "project"
    return f"{folder.rstrip('/')}/{name}-{hashlib.sha256(os.path.abspath(root).encode()).hexdigest()[:10]}"


def save_cache(entries: DataFrame, path: str) -> None:
    """Replace the cache at ``path``, which ``entries`` may have been read from."""
    new = f"{path}.new"
    entries.write.mode("overwrite").parquet(new)
    spark = entries.sparkSession
    to, of = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, new))
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(to, True)
    fs.rename(of, to)


def partition(records: DataFrame, cache: DataFrame) -> DataFrame:
    """``records`` with ``is_hit``: the cache has the same hash; a null hash is never a hit."""
    known = cache.select("rel_path", F.col("hash").alias("_hash"))
    return records.join(known, "rel_path", "left").withColumn("is_hit", F.coalesce(F.col("content_hash") == F.col("_hash"), F.lit(False))).drop("_hash")


def hits(records: DataFrame, cache: DataFrame) -> DataFrame:
    return partition(records, cache).where("is_hit").drop("is_hit")


def changed(records: DataFrame, cache: DataFrame) -> DataFrame:
    return partition(records, cache).where("not is_hit").drop("is_hit")


def build_cache(records: DataFrame, todos: DataFrame, secrets: DataFrame, unhashed: bool = False) -> DataFrame:
    """One entry a record that has a hash, with its findings; with ``unhashed`` one for each other record too, without a hash."""

    def grouped(found, name, *fields):
        return found.groupBy("rel_path").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    own = (records if unhashed else records.where("content_hash is not null")).select("rel_path", F.col("content_hash").alias("hash"))
    own = own.join(grouped(todos, "todos", "line_number", "kind", "content"), "rel_path", "left").join(grouped(secrets, "secrets", "line_number", "pattern_name", "is_test_fixture"), "rel_path", "left")
    return own.withColumns({"todos": F.coalesce("todos", F.array()), "secrets": F.coalesce("secrets", F.array()), "fingerprint": F.lit(rules.fingerprint())})


def cached_findings(hit: DataFrame, cache: DataFrame, kind: str) -> DataFrame:
    """``todos`` or ``secrets`` of the hit files, as rows again."""
    return cache.join(hit.select("rel_path"), "rel_path", "left_semi").select("rel_path", F.inline(kind))


def combined(scanned: DataFrame, cached: DataFrame) -> DataFrame:
    return scanned.unionByName(cached)
