"""Line findings kept up to date as files arrive, and transfers checked as chunks do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import rules
from ..operators import findings, incremental, records, transfer


def maintain_cache(files: DataFrame, cache_path: str, checkpoint: str, version: str | None = None, compact_every: int = 16, **trigger) -> StreamingQuery:
    """Keep a cache table current from a stream of ``files(rel_path, content)``.

    Each batch scans only files whose hash isn't cached and writes entries to
    ``cache_path/batch=N``; a batch run again overwrites its own folder, so a retry
    changes nothing.  Of several versions of a file in a batch the one with the greatest
    ``version`` counts, or without that column the greatest content.  A file that can't be
    hashed any more (empty, binary, too large) leaves an entry without a hash, which ends
    its earlier one.  Every ``compact_every`` batches all entries are merged into
    ``cache_path/base=N``, so a batch reads a bounded number of folders.
    """

    def one(batch: DataFrame, number: int):
        spark = batch.sparkSession
        own = batch.groupBy("rel_path").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "rel_path"]), version or "content").alias("_v")).select("rel_path", "_v.*")
        new = incremental.changed(records.records(own), latest(spark, cache_path, before=number))
        text = own.join(new.select("rel_path"), "rel_path", "left_semi")
        entries = incremental.build_cache(new, findings.scan_todos(text), findings.scan_secrets(text), unhashed=True)
        entries.write.mode("overwrite").parquet(f"{cache_path}/batch={number}")
        if (number + 1) % compact_every == 0:
            compact(spark, cache_path, number)

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _folders(spark, cache_path: str) -> dict[str, list[int]]:
    """Numbers of the complete ``batch`` and ``base`` folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"batch": [], "base": []}
    for f in fs.listStatus(path) if fs.exists(path) else []:
        kind, _, n = f.getPath().getName().partition("=")
        if kind in found and n.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")):
            found[kind].append(int(n))
    return found


def _newest(spark, cache_path: str, before: int) -> DataFrame:
    """The newest entry of each file, those without a hash included."""
    found = _folders(spark, cache_path)
    base = max((n for n in found["base"] if n < before), default=-1)
    parts = [(f"base={base}", base)] * (base >= 0) + [(f"batch={n}", n) for n in found["batch"] if base < n < before]
    if not parts:
        return spark.createDataFrame([], incremental.CACHE)
    every = reduce(DataFrame.unionByName, [spark.read.schema(incremental.CACHE).parquet(f"{cache_path}/{name}").withColumn("_n", F.lit(n).cast("long")) for name, n in parts])
    fields = [x for x in every.columns if x not in ("_n", "rel_path")]
    return every.groupBy("rel_path").agg(F.max_by(F.struct(*fields), "_n").alias("e")).select("rel_path", "e.*")


def latest(spark, cache_path: str, before: int = 1 << 62) -> DataFrame:
    """The newest entry of each file that has one under today's rules, of batches before ``before``."""
    return _newest(spark, cache_path, before).where((F.col("fingerprint") == rules.fingerprint()) & F.col("hash").isNotNull())


def compact(spark, cache_path: str, number: int) -> None:
    """Merge all entries up to batch ``number`` into one folder, then remove what it replaces."""
    _newest(spark, cache_path, number + 1).write.mode("overwrite").parquet(f"{cache_path}/base={number}")
    for kind, numbers in _folders(spark, cache_path).items():
        for n in numbers:
            if n < number or (kind == "batch" and n == number):
                old = spark._jvm.org.apache.hadoop.fs.Path(f"{cache_path}/{kind}={n}")
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def arrivals(messages: DataFrame) -> DataFrame:
    """Progress of transfers from a stream of ``messages(message)``: chunks may come in any order and again.

    One row a session: how many different sound chunks came, how many it has, and whether its end was seen.
    """
    parsed = transfer.parse_chunks(messages).where("error is null")
    return parsed.groupBy("session_id").agg(F.size(F.collect_set("chunk_index")).alias("received"), F.max("total_chunks").alias("total"), F.bool_or("has_end").alias("ended"))
