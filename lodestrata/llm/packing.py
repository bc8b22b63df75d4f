"""Best-fit packing of token sequences by hierarchical residual packing.

Each task tokenizes its documents, cuts those longer than a sequence, and packs its
pieces best-fit in decreasing length.  Bins that are nearly full are final.  Of the
rest a task hands its emptiest bins to a tree: groups of tasks pack them as items,
best-fit again, and hand their own emptiest ones up until one group is left.

After best-fit at most one bin of a group is half empty or more, so only one bin per
child can still move; ``carry`` hosts per child are therefore as good as all of them,
and what a node of the tree reads is bounded by ``fan_in * carry`` rows however large
the input is.  Texts are read once and never shuffled; only piece rows of a few numbers
are, and of these only the ones in handed-up bins are joined to their final place.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, base long, open boolean"


class WordIds(dict):
    """Token ids, as little-endian 32-bit words, of white-space separated words.

    The vocabulary's normaliser and splitter never look across white space, so a text's
    ids are those of its words in order.  A word of Latin-1 letters with ASCII
    punctuation behind is two such parts again; the tokenizer's model gets its
    lower-cased letters as the byte-level alphabet writes them.  Any other word, and a
    text with characters that Python and the tokenizer may take differently, goes to
    the tokenizer as it is.  At most ``most`` words and three times as many parts are remembered.
    """

    ODD = re.compile("[\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]")
    PARTS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.parts = Tokenizer.from_file(path), most, {}
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        moved = iter(range(256, 512))
        self.alphabet = {b: b if b in plain else next(moved) for b in range(256)}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def letters(self, word: str) -> bytes:
        ids = self.parts.get(word)
        if ids is None:
            mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
            ids = array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()
            if len(self.parts) >= 3 * self.most:
                self.parts.clear()
            self.parts[word] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        m = self.PARTS.match(word)
        if m is None:
            ids = self.whole(word)
        else:
            ids = self.letters(m[1].lower())
            if end := m[2]:
                if (mark := self.parts.get(end)) is None:
                    mark = self.parts[end] = self.whole(end)
                ids += mark
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        return self.whole(text) if self.ODD.search(text) else b"".join(map(self.__getitem__, text.split()))


@cache
def word_ids(path: str) -> WordIds:
    """One memory of words for all tasks of a Python worker."""
    return WordIds(path)


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit in decreasing length: each item's bin and place in it, and each bin's fill.

    Gaps are few different numbers, so bins are kept by gap; ties go to the latest bin.
    """
    where, base, fill = [0] * len(lengths), [0] * len(lengths), []
    gaps: list[int] = []
    bins: dict[int, list[int]] = {}
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        n = lengths[i]
        k = bisect_left(gaps, n)
        if k < len(gaps):
            gap = gaps[k]
            b = bins[gap].pop()
            if not bins[gap]:
                del bins[gap], gaps[k]
        else:
            b, gap = len(fill), size
            fill.append(0)
        where[i], base[i] = b, fill[b]
        fill[b] += n
        if gap := gap - n:
            if gap not in bins:
                bins[gap] = []
                insort(gaps, gap)
            bins[gap].append(b)
    return where, base, fill


def carried(fill: list[int], size: int, carry: int, full: float) -> set[int]:
    """The bins that go up: the ``carry`` emptiest of those that aren't nearly full."""
    low = [b for b, n in enumerate(fill) if n < full * size]
    return set(sorted(low, key=lambda b: (fill[b], b))[:carry])


def local_pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int, carry: int, full: float) -> DataFrame:
    """Tokenize, cut and pack within each partition of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, text in zip(part.column(0).to_pylist(), texts):
                    ids = words.ids(text) + end
                    for piece, start in enumerate(range(0, len(ids), 4 * size)):
                        cut_ids = ids[start : start + 4 * size]
                        rows.append((doc, piece, start // 4, len(cut_ids) // 4, zlib.crc32(cut_ids)))
        if not rows:
            return
        where, base, fill = best_fit([r[3] for r in rows], size)
        first = TaskContext.get().partitionId() << 32
        up = carried(fill, size, carry, full)
        columns = [*zip(*rows), [first + b for b in where], base, [b in up for b in where]]
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.mapInArrow(run, PIECES)


def merge_bins(bins: DataFrame, size: int, carry: int, full: float, fan_in: int, rounds: int) -> DataFrame:
    """``(bin, sequence_id, shift)``: where the tree puts each of ``bins(bin, fill)``.

    Round k groups by the task number divided by ``fan_in ** k``; the last round has one group.
    """
    schema = "task long, sequence_id long, fill long, members array<struct<bin:long,shift:long>>, open boolean"

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("sequence_id")
        where, base, fill = best_fit(group["fill"].tolist(), size)
        up = carried(fill, size, carry, full)
        ids, members = group["sequence_id"].tolist(), group["members"].tolist()
        made = [{"task": int(group["task"].iloc[0]), "sequence_id": None, "fill": n, "members": [], "open": b in up} for b, n in enumerate(fill)]
        for i, b in enumerate(where):
            made[b]["sequence_id"] = ids[i] if made[b]["sequence_id"] is None else min(ids[i], made[b]["sequence_id"])
            made[b]["members"] += [{"bin": m["bin"], "shift": m["shift"] + base[i]} for m in members[i]]
        return pd.DataFrame(made, columns=["task", "sequence_id", "fill", "members", "open"])

    level = bins.select(
        F.shiftright("bin", 32).alias("task"), F.col("bin").alias("sequence_id"), "fill", F.array(F.struct("bin", F.lit(0).cast("long").alias("shift"))).alias("members"), F.lit(True).alias("open")
    )
    done = None
    for _ in range(rounds):
        up = level.where("open").withColumn("task", F.expr(f"task div {fan_in}"))
        level = cut(up.groupBy("task").applyInPandas(merge, schema))
        closed = level.where("not open")
        done = closed if done is None else done.unionByName(closed)
    done = level.where("open") if done is None else done.unionByName(level.where("open"))
    return done.select("sequence_id", F.inline("members"))


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", carry: int = 64, full: float = 0.999, fan_in: int = 16) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document's ids are its tokens and then ``end_id``; only documents longer than
    ``size`` are cut.  Null and empty texts are one piece that holds ``end_id`` alone.
    Repeated rows are packed each by itself, so their pieces repeat too; a null id is kept.  An empty table gives an empty
    result, and other columns are ignored.
    """
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = cut(local_pieces(read, tokenizer, size, end_id, carry, full))
    moved = pieces.where("open")
    bins = cut(moved.groupBy("bin").agg(F.sum("length").alias("fill")))
    top = bins.agg(F.max(F.shiftright("bin", 32))).first()[0] or 0
    rounds = 0
    while top:
        top, rounds = top // fan_in, rounds + 1
    places = merge_bins(bins, size, carry, full, fan_in, rounds)
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id"]
    still = pieces.where("not open").select(*out[:-1], F.col("bin").alias("sequence_id"), F.col("base").alias("offset"))
    return still.unionByName(moved.join(places, "bin").select(*out, (F.col("base") + F.col("shift")).alias("offset")))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op8_packing(spark, sf_dir):
    """Contract: all documents, at most 2048 tokens a sequence."""
    small_batches(spark)
    return pack(table(spark, sf_dir, "documents"), vocabulary())


QUERIES = {"op8_packing": op8_packing}
ORACLE_SQL = {}
