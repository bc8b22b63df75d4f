"""Large texts written by tasks as pieces, and joined in order.

Each task writes its rows of a sorted table into a file with a name of its own and tells
its length and digest.  Only when all tasks are done does the commit write a manifest, under another
name and renamed; a task that was lost or ran twice leaves a file that no manifest names.
The folder must be one that all executors mount at the same path.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MANIFEST = "manifest.json"
BLOCK = 1 << 20


@dataclass
class Piece(WriterCommitMessage):
    """A task's file: its place in the order, name, rows, bytes and their SHA-256."""

    place: int
    name: str
    rows: int
    size: int
    digest: str


class PieceWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.folder = options["path"].removeprefix("file://")
        self.between = options.get("between", "\n").encode()

    def write(self, iterator):
        place, running, rows, size = TaskContext.get().partitionId(), hashlib.sha256(), 0, 0
        name = f"{place:06}-{uuid.uuid4().hex}"
        os.makedirs(self.folder, exist_ok=True)
        with open(os.path.join(self.folder, name), "wb") as f:
            for batch in iterator:
                for value in batch.column(0):
                    data = self.between * (rows > 0) + (value.as_py() or "").encode("utf-8", "replace")
                    running.update(data)
                    f.write(data)
                    rows, size = rows + 1, size + len(data)
        return Piece(place, name, rows, size, running.hexdigest())

    def commit(self, messages):
        os.makedirs(self.folder, exist_ok=True)
        new = os.path.join(self.folder, f".{uuid.uuid4().hex}")
        with open(new, "w", encoding="utf-8") as f:
            json.dump([asdict(m) for m in sorted((m for m in messages if m), key=lambda m: m.place)], f)
        os.replace(new, os.path.join(self.folder, MANIFEST))

    def abort(self, messages):
        for m in messages:
            if m:
                try:
                    os.remove(os.path.join(self.folder, m.name))
                except OSError:
                    pass


class Pieces(DataSource):
    """``df.write.format("textpieces")``; options ``path`` and ``between``, what goes between two rows."""

    @classmethod
    def name(cls):
        return "textpieces"

    def writer(self, schema, overwrite):
        return PieceWriter(self.options)


def write(rows: DataFrame, folder: str, between: str = "\n") -> None:
    """The first column of ``rows``, in their order, as pieces in a new folder; null is empty."""
    rows.sparkSession.dataSource.register(Pieces)
    rows.write.format("textpieces").mode("append").option("between", between).save(folder)


def manifest(folder: str) -> list[Piece]:
    """The pieces of a complete folder, in order; an error if it isn't complete."""
    with open(os.path.join(folder, MANIFEST), encoding="utf-8") as f:
        return [Piece(**p) for p in json.load(f)]


def joined(folder: str, between: str = "\n") -> Iterator[bytes]:
    """The bytes of all pieces, a block at a time; raises ``OSError`` where one isn't what its task wrote."""
    started = False
    for piece in manifest(folder):
        if not piece.rows:
            continue
        if started:
            yield between.encode()
        started, running = True, hashlib.sha256()
        with open(os.path.join(folder, piece.name), "rb") as f:
            while block := f.read(BLOCK):
                running.update(block)
                yield block
        if running.hexdigest() != piece.digest:
            raise OSError(f"{piece.name} isn't what was written")
