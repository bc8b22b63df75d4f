"""A cache table of versions: immutable files in buckets, and a manifest that says which make a version.

Entries are dealt over buckets by a hash of their path.  A merge reads and writes only the
buckets that its entries fall into, into a folder of its own, and then writes a manifest
under another name and renames it: a version is there wholly or not at all, and what was
there before stays readable.  The newest two versions are kept; files that neither names
are removed afterwards.  Manifests and folders live on any file system that Hadoop knows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from . import findings, incremental, records

BUCKETS = 64


class Store:
    """Hadoop's file system below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, rel: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{rel}".rstrip("/"))

    def names(self, rel: str) -> list[str]:
        path = self._path(rel)
        return [f.getPath().getName() for f in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def read(self, rel: str) -> str:
        stream = self.fs.open(self._path(rel))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, rel: str, text: str) -> None:
        """``text`` under ``rel``, wholly or not at all; an error if that name is taken."""
        new = f"{rel.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(new), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.fs.exists(self._path(rel)) or not self.fs.rename(self._path(new), self._path(rel)):
            self.fs.delete(self._path(new), False)
            raise FileExistsError(rel)

    def remove(self, rel: str) -> None:
        self.fs.delete(self._path(rel), True)


def manifests(store: Store) -> list[int]:
    """Numbers of the versions that are there, in order."""
    return sorted(int(n.removesuffix(".json")) for n in store.names("manifest") if n.endswith(".json") and not n.startswith("."))


def manifest(store: Store, version: int | None = None) -> dict:
    """``{"version", "batch", "rules", "buckets": {bucket: folder}}`` of a version, the newest unless given."""
    there = manifests(store)
    if not there:
        return {"version": 0, "batch": -1, "rules": rules.fingerprint(), "buckets": {}}
    return json.loads(store.read(f"manifest/{version or there[-1]:010}.json"))


def _read(store: Store, buckets: dict[str, str]) -> DataFrame:
    if not buckets:
        return store.spark.createDataFrame([], incremental.CACHE)
    return store.spark.read.schema(incremental.CACHE).parquet(*[f"{store.root}/data/{folder}/bucket={b}" for b, folder in buckets.items()])


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Entries of a version under today's rules, the newest unless given; none where there is no version."""
    store = Store(spark, path)
    return _read(store, manifest(store, version)["buckets"]).where(F.col("fingerprint") == rules.fingerprint())


def bucket(path, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def touched(store: Store, paths: DataFrame, buckets: int = BUCKETS) -> list[str]:
    """The buckets that ``paths(rel_path)`` fall into, at most as many as there are."""
    return [str(r.b) for r in paths.select(bucket("rel_path", buckets).alias("b")).distinct().collect()]


def known(spark: SparkSession, path: str, paths: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Entries of the newest version in the buckets of ``paths`` alone."""
    store = Store(spark, path)
    own = manifest(store)["buckets"]
    return _read(store, {b: own[b] for b in touched(store, paths, buckets) if b in own}).where(F.col("fingerprint") == rules.fingerprint())


def merge(entries: DataFrame, path: str, batch: int | None = None, buckets: int = BUCKETS, keep: int = 2) -> int:
    """A new version with ``entries`` in place of those of the same paths; one without a hash ends its path's.

    ``batch`` makes a merge happen once: one whose number the newest version has seen
    changes nothing.  Returns the newest version's number.
    """
    spark = entries.sparkSession
    store = Store(spark, path)
    last = manifest(store)
    if batch is not None and batch <= last["batch"]:
        return last["version"]
    folder = uuid.uuid4().hex
    names = touched(store, entries, buckets)
    old = _read(store, {b: last["buckets"][b] for b in names if b in last["buckets"]}).where(F.col("fingerprint") == rules.fingerprint())
    fresh = old.join(entries.select("rel_path"), "rel_path", "left_anti").unionByName(entries.where("hash is not null"))
    placed = fresh.withColumn("bucket", bucket("rel_path", buckets))
    # One file a bucket and task is enough: a bucket is what one merge rewrites.
    placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{store.root}/data/{folder}")
    written = {n.partition("=")[2] for n in store.names(f"data/{folder}") if n.startswith("bucket=")}
    new = {b: f for b, f in last["buckets"].items() if b not in names} | {b: folder for b in names if b in written}
    number = last["version"] + 1
    store.publish(f"manifest/{number:010}.json", json.dumps({"version": number, "batch": last["batch"] if batch is None else batch, "rules": rules.fingerprint(), "buckets": new}))
    tidy(store, keep)
    return number


def tidy(store: Store, keep: int = 2) -> None:
    """Remove versions but the newest ``keep``, and folders that none of these names."""
    there = manifests(store)
    used = {f for v in there[-keep:] for f in manifest(store, v)["buckets"].values()}
    for v in there[:-keep]:
        store.remove(f"manifest/{v:010}.json")
    for f in store.names("data"):
        if f not in used:
            store.remove(f"data/{f}")


def apply_changes(changes: DataFrame, path: str, batch: int | None = None, buckets: int = BUCKETS) -> int:
    """Bring a cache up to date with ``changes(change, rel_path, content)``, one row a path.

    Files whose hash the cache has aren't scanned; removed files, and those that can't be
    hashed any more, lose their entry.  Only the buckets of these paths are read.
    """
    spark = changes.sparkSession
    own = changes.where("change != 'removed' and content is not null")
    new = incremental.changed(records.records(own.select("rel_path", "content")), known(spark, path, changes, buckets))
    text = own.select("rel_path", F.make_valid_utf8(F.col("content").cast("string")).alias("content")).join(new.select("rel_path"), "rel_path", "left_semi")
    found = incremental.build_cache(new, findings.scan_todos(text), findings.scan_secrets(text), unhashed=True)
    gone = changes.where("change = 'removed' or content is null").select("rel_path", F.lit(None).cast("string").alias("hash"), F.array().cast("array<struct<line_number:long,kind:string,content:string>>").alias("todos"), F.array().cast("array<struct<line_number:long,pattern_name:string,is_test_fixture:boolean>>").alias("secrets"), F.lit(rules.fingerprint()).alias("fingerprint"))
    entries = found.unionByName(gone).persist()
    try:
        return merge(entries, path, batch, buckets)
    finally:
        entries.unpersist()
