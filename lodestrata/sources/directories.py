"""The directory tree as it is on disk, listed level by level in tasks.

A table of paths knows neither empty directories nor what ignore files leave out; this
listing has both, and follows links to directories.  Every round lists the directories of
one level, dealt over tasks, and gives the next level's; the driver sees a count a round.
The tree must be on a file system that all executors mount at the same path.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from . import corpus

SCHEMA = "path string, name string, depth int, is_dir boolean, rank int, siblings long, line string, key array<int>, indent string, above array<string>, enter boolean"


def _identity(path: str) -> str | None:
    try:
        s = os.stat(path)
    except OSError:
        return None
    return f"{s.st_dev}:{s.st_ino}"


def _entries(folder: str, ignore_dirs: frozenset[str]) -> Iterator[tuple[bool, str, str, bool]]:
    """``(is file, lower-cased name, name, is directory)`` of what a directory holds, links followed."""
    try:
        with os.scandir(folder) as found:
            for e in found:
                if e.name not in ignore_dirs:
                    yield os.path.isfile(e.path), e.name.lower(), e.name, os.path.isdir(e.path)
    except OSError:
        return


def _listed(root: str, parent: tuple, ignore_dirs: frozenset[str], most: int) -> Iterator[tuple]:
    """Rows of one directory: the first ``most`` entries in order, then how many more there are.

    No more than ``most`` entries are held, however many there are.
    """
    path, depth, key, indent, above = parent
    siblings = 0

    def counted():
        nonlocal siblings
        for e in _entries(os.path.join(root, path), ignore_dirs):
            siblings += 1
            yield e

    first = heapq.nsmallest(most, counted())
    for rank, (_, _, name, is_dir) in enumerate(first, 1):
        last = rank == siblings
        own = _identity(os.path.join(root, path, name)) if is_dir else None
        shown = os.fsencode(name).decode("utf-8", "replace")
        yield (
            f"{path}{shown}", shown, depth + 1, is_dir, rank, siblings, f"{indent}{'└── ' if last else '├── '}{shown}{'/' if is_dir else ''}",
            [*key, rank], indent + ("    " if last else "│   "), [*above, own or ""], is_dir and own is not None and own not in above and shown == name,
        )
    if siblings > most:
        yield f"{path}...", "...", depth + 1, False, most + 1, siblings, f"{indent}└── ... ({siblings - most} more entries hidden)", [*key, most + 1], "", [], False


def folder_tree(spark: SparkSession, root: str, ignore_dirs: tuple[str, ...] = rules.IGNORE_DIRS, max_depth: int = rules.TREE_DEPTH, max_entries: int = rules.TREE_ENTRIES) -> DataFrame:
    """``(path, name, depth, is_dir, rank, siblings, line, key)``: a row a line of the drawn tree; ``key`` orders them.

    In a directory, what isn't a file comes first, then by lower-cased name and name.
    Entries beyond ``max_entries`` are one row that counts them, and aren't entered.  Ignore
    files have no say; names in ``ignore_dirs`` are left out.  A link to a directory is
    entered like one, but for a link to a directory it is itself in.  A name that isn't UTF-8 is shown with replacement signs, and
    not entered.  A directory that can't be read, or isn't there, has no rows below it.
    """
    root = str(root).removeprefix("file://")
    names = frozenset(ignore_dirs)
    schema = spark.createDataFrame([], SCHEMA).schema
    arrow = pa.schema([("path", pa.string()), ("name", pa.string()), ("depth", pa.int32()), ("is_dir", pa.bool_()), ("rank", pa.int32()), ("siblings", pa.int64()), ("line", pa.string()), ("key", pa.list_(pa.int32())), ("indent", pa.string()), ("above", pa.list_(pa.string())), ("enter", pa.bool_())])

    def listed(batches):
        for b in batches:
            for r in b.to_pylist():
                rows = _listed(root, (r["path"], r["depth"], r["key"], r["indent"], r["above"]), names, max_entries)
                while held := [x for _, x in zip(range(10_000), rows)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), arrow.types)], schema=arrow)

    level = spark.createDataFrame([("", 0, [], "", [_identity(root) or ""])], "path string, depth int, key array<int>, indent string, above array<string>")
    levels = []
    for depth in range(max_depth):
        found = corpus.checkpointed(level.mapInArrow(listed, schema))
        levels.append(found)
        below = found.where("enter")
        n = below.count()
        if not n:
            break
        level = below.select(F.concat("path", F.lit("/")).alias("path"), "depth", "key", "indent", "above").repartition(min(n, 10_000), "path")
    every = reduce(DataFrame.unionByName, levels) if levels else spark.createDataFrame([], SCHEMA)
    return every.select("path", "name", "depth", "is_dir", "rank", "siblings", "line", "key")
