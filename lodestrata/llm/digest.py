"""Document fingerprints by quartile bucket digests.

Byte triplets of every window of five bytes are hashed into buckets and counted.  A
digest writes, for each bucket, which quartile of all counts its count lies in, and
before that the length of the text on a logarithmic scale and two ratios of the
quartiles.  Two digests are compared by a difference score, bounded and turned into a
likeness between 0 and 1.  Digests need no other document: fingerprinting is one scan.

A text of fewer than five bytes, but one at least, counts as if zero bytes followed it, so
it has the triplets of one window.  Digests of short texts leave most buckets at zero; the
difference that makes likeness 0 is therefore never more than what two texts without a
common bucket would reach.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, table, utf8

BUCKETS = 256
#: Places in a window of five bytes; the outer two are always there, as wide triplets tell texts of one language apart best.
TRIPLETS = ((0, 1, 4), (0, 2, 4), (0, 3, 4))
BLOCK = 1 << 18
WINDOW = 5
#: A bucket whose quartiles differ by 1, 2 or 3 adds so much to the difference.
STEP = np.array([0, 1, 3, 6])
SHIFTS = np.array([0, 2, 4, 6], np.uint8)
#: The difference at which likeness is 0: what independent digests reach on average.
WORST = BUCKETS * float(np.mean([STEP[abs(a - b)] for a in range(4) for b in range(4)]))


def _tables() -> np.ndarray:
    """Byte permutations, one for each triplet and place: tabulation hashing by xor."""
    rng = np.random.default_rng(20)
    return np.stack([[rng.permutation(256) for _ in range(3)] for _ in TRIPLETS]).astype(np.uint8)


TABLES = _tables()


def bucket_counts(data: bytes) -> np.ndarray:
    """How many hashed triplets of ``data`` fall into each bucket."""
    raw = np.frombuffer(data.ljust(WINDOW, b"\0") if data else data, np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(0, len(raw) - 4), BLOCK):
        part = raw[at : at + BLOCK + 4]
        n = len(part) - 4
        for t, places in zip(TABLES, TRIPLETS):
            h = t[0][part[places[0] :][:n]]
            h ^= t[1][part[places[1] :][:n]]
            h ^= t[2][part[places[2] :][:n]]
            counts += np.bincount(h, minlength=BUCKETS)
    return counts


def digest(data: bytes) -> str:
    """Length, quartile ratios and a two-bit code for each bucket, as hex digits."""
    counts = bucket_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    length = min(255, round(8 * math.log2(1 + len(data))))
    ratios = [int(15 * a / b) if b else 0 for a, b in ((q1, q3), (q2, q3))]
    return bytes([length, ratios[0] << 4 | ratios[1]]).hex() + packed.tobytes().hex()


def _codes(a: str) -> tuple[bytes, np.ndarray]:
    """Length and ratios, and the code of each bucket."""
    raw = bytes.fromhex(a)
    return raw, (np.frombuffer(raw, np.uint8)[2:, None] >> SHIFTS & 3).view(np.int8)


def _difference(x: bytes, p: np.ndarray, y: bytes, q: np.ndarray) -> int:
    d = int(STEP[np.abs(p - q)].sum()) + max(0, abs(x[0] - y[0]) - 2)
    return d + abs((x[1] >> 4) - (y[1] >> 4)) + abs((x[1] & 15) - (y[1] & 15))


def difference(a: str, b: str) -> int:
    """Bucket steps, plus what length and ratios differ by beyond small change."""
    return _difference(*_codes(a), *_codes(b))


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 from the bound on."""
    if a == b:
        return 1.0
    (x, p), (y, q) = _codes(a), _codes(b)
    return max(0.0, 1.0 - _difference(x, p, y, q) / min(WORST, max(1, int(STEP[p].sum() + STEP[q].sum()))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)`` for every row; a null text counts as empty, null ids stay."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest(utf8(t.as_py())) for t in b.column(1)], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def spliced(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as much of the text that follows it."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(doc_id, text: str, own: str, following: str, other: str) -> tuple:
    edited = utf8(spliced(text, following))
    mark = digest(edited)
    return doc_id, len(text), hashlib.sha256(edited).hexdigest(), own, mark, likeness(own, mark), likeness(own, other)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its digest, that of its edited text, and likenesses.

    Rows are ordered by id, null ids first, ties by a hash of the text; the row after the
    last is the first.  Rows are dealt out by ranges of that order, so a row's successor
    is in its own task but for the last of each task; those few rows, two texts a task,
    meet in a join of their own.  Repeated rows return repeated rows; null texts are
    empty; a single row is its own successor; a very long text is digested by blocks; columns
    of other names are ignored; an empty table gives an empty result.
    """
    kinds = RESULT + ", part long, edge string, text string"
    names = [x.split()[0] for x in kinds.split(", ")]

    def run(batches):
        part, held, first, out = TaskContext.get().partitionId(), None, True, []

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), ARROW)], names)
            out.clear()
            return made

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                doc_id, text = doc_id.as_py(), text.as_py() or ""
                mark = digest(utf8(text))
                if first:
                    out.append((doc_id, None, None, mark, None, None, None, part, "first", text))
                    first = False
                if held:
                    out.append((*_compare(*held, text, mark), part, None, None))
                held = doc_id, text, mark
            if out:
                yield batch()
        if held:
            out.append((held[0], None, None, held[2], None, None, None, part, "last", held[1]))
            yield batch()

    ARROW = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64(), pa.string(), pa.string()]
    order = ["doc_id", "tie"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    spark = docs.sparkSession
    ranges = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).select("doc_id", "text")
    made = cut(ranges.mapInArrow(run, kinds))
    parts = sorted(r.part for r in made.where("edge = 'first'").select("part").collect())  # one number a task
    if not parts:
        return made.select(*RESULT_NAMES)
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part long, after long")
    last = made.where("edge = 'last'").select("part", "doc_id", "text", "fingerprint").join(F.broadcast(after), "part")
    first = made.where("edge = 'first'").select(F.col("part").alias("after"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_mark"))

    def finish(batches):
        for b in batches:
            out = [_compare(*r.values()) for r in b.to_pylist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), ARROW)], names[:7])

    ends = last.join(first, "after").select("doc_id", "text", "fingerprint", "next_text", "next_mark").mapInArrow(finish, RESULT)
    return made.where("edge is null").select(*RESULT_NAMES).unionByName(ends)


RESULT_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def op10_digest(spark, sf_dir):
    """Contract: every document, its edited text and the next document."""
    small_batches(spark)
    return compare_with_next(table(spark, sf_dir, "documents"))


QUERIES = {"op10_digest": op10_digest}
ORACLE_SQL = {}
