"""Changes of a file tree as a stream: files added, changed and removed since the last listing.

An offset is a listing: path, size and time of change of every file, kept in ``state``, a
folder that driver and executors share, and named by a digest of what it says.  A tree
that hasn't changed has the same offset, so there is no batch.  A listing is dealt over
shards by path; a batch compares two listings shard by shard in tasks and reads the files
that are new or other.  The tree is walked on the driver, as metadata only, written out
shard by shard.

Listings are written under another name and renamed, and stay until a batch that ends
later is committed.  So a query that starts again from its checkpoint has both listings of
its last batch, and gives the same changes.  A file that changes while a batch runs is
read as it then is, and again with the next listing.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..operators import snapshots
from ..sources import files

SCHEMA = "change string, rel_path string, size long, mtime_ns long, content binary"
EMPTY = "0"


class Shard(InputPartition):
    def __init__(self, start: str, end: str, k: int):
        super().__init__(k)
        self.start, self.end, self.k = start, end, k


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options):
        self.tree = files.TreeReader(options)
        self.state = options["state"].removeprefix("file://")
        self.shards = int(options.get("shards", 16))

    def _walk(self) -> Iterator[tuple[str, int, int]]:
        start = [("", files.outer_ignores(self.tree.root, self.tree.user) if self.tree.use_ignores else [])]
        for rel in files.listing(self.tree.root, self.tree.ignore_dirs, self.tree.use_ignores, start):
            try:
                s = os.lstat(os.path.join(self.tree.root, rel))
            except OSError:
                continue
            yield rel, s.st_size, s.st_mtime_ns

    def _listed(self, snapshot: str, k: int) -> dict[str, tuple[int, int]]:
        if snapshot == EMPTY:
            return {}
        with open(os.path.join(self.state, snapshot, str(k)), encoding="utf-8", errors="surrogateescape") as f:
            return {rel: (size, mtime) for rel, size, mtime in map(json.loads, f)}

    def initialOffset(self) -> dict:
        return {"listing": EMPTY}

    def latestOffset(self) -> dict:
        """The tree's listing as it is now, written out unless it is there already."""
        new = os.path.join(self.state, f".new-{uuid.uuid4().hex}")
        os.makedirs(new)
        out = [open(os.path.join(new, str(k)), "w", encoding="utf-8", errors="surrogateescape") for k in range(self.shards)]
        total = 0  # sums of digests don't depend on the order of the walk
        for row in self._walk():
            line = json.dumps(row)
            total += int.from_bytes(hashlib.sha256(line.encode()).digest(), "little")
            out[zlib.crc32(row[0].encode("utf-8", "surrogateescape")) % self.shards].write(line + "\n")
        for f in out:
            f.close()
        name = hashlib.sha256(f"{self.shards}:{total}".encode()).hexdigest()[:32]
        to = os.path.join(self.state, name)
        try:
            os.rename(new, to)
        except OSError:  # the same listing again
            shutil.rmtree(new)
            os.utime(to)
        return {"listing": name}

    def partitions(self, start: dict, end: dict):
        return [Shard(start["listing"], end["listing"], k) for k in range(self.shards)]

    def read(self, partition: Shard):
        old, new = (self._listed(x, partition.k) for x in (partition.start, partition.end))
        for rel in old.keys() - new.keys():
            yield "removed", rel, None, None, None
        for rel, (size, mtime) in new.items():
            if old.get(rel) == (size, mtime):
                continue
            try:
                path = os.path.join(self.tree.root, rel)
                content = None
                if not os.path.islink(path) and size <= self.tree.most:
                    with open(path, "rb") as f:
                        content = f.read()
            except OSError:  # gone since; the next listing says so
                content = None
            yield "changed" if rel in old else "added", rel, size, mtime, content

    def commit(self, end: dict) -> None:
        """Listings older than the one that ends a finished batch aren't asked for again."""
        kept = os.path.join(self.state, end["listing"])
        if not os.path.exists(kept):
            return
        since = os.stat(kept).st_mtime_ns
        for name in os.listdir(self.state):
            path = os.path.join(self.state, name)
            if name != end["listing"] and not name.startswith(".") and os.stat(path).st_mtime_ns < since:
                shutil.rmtree(path, ignore_errors=True)


class TreeChanges(DataSource):
    """``spark.readStream.format("treechanges")``; options ``state``, ``shards`` and those of ``filetree``."""

    @classmethod
    def name(cls):
        return "treechanges"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return ChangeReader(self.options)


def changes(spark: SparkSession, path: str, state: str, **options) -> DataFrame:
    """``(change, rel_path, size, mtime_ns, content)`` of the tree at ``path`` as a stream.

    ``change`` is ``added``, ``changed`` or ``removed``; a link, and a file of more than
    ``maxContentBytes``, has no content.
    """
    spark.dataSource.register(TreeChanges)
    os.makedirs(state.removeprefix("file://"), exist_ok=True)
    return spark.readStream.format("treechanges").options(**{k: str(v) for k, v in ({"path": path, "state": state, "userIgnores": files.user_ignores()} | options).items()}).load()


def follow(spark: SparkSession, path: str, cache: str, checkpoint: str, buckets: int = snapshots.BUCKETS, trigger: dict | None = None, **options) -> StreamingQuery:
    """Keep the cache at ``cache`` current with the tree at ``path``; a batch run again changes nothing."""

    def one(batch: DataFrame, number: int):
        snapshots.apply_changes(batch, cache, number, buckets)

    stream = changes(spark, path, f"{checkpoint.rstrip('/')}-listings", **options)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
