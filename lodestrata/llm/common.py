"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder takes its place in a session of one process;
    a cluster's executors wouldn't see that, so there it is an error.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="shared-")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Queries call this: whole texts are long, so fewer rows make an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def held_out(doc_id="doc_id"):
    """crc32 of the id as text leaves remainder 0 modulo 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def blocks(values, size: int):
    """Slices of a list, so that a batch is worked on piece by piece."""
    for i in range(0, len(values), size):
        yield i, values[i : i + size]


def by_bytes(texts: list, most: int = 1 << 20, rows: int = 256):
    """``(first, slice)`` of texts that together have about ``most`` characters, one text at least."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and (size + len(t or "") > most or i - first >= rows):
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t or "")
    if first < len(texts):
        yield first, texts[first:]


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes; null counts as empty and a lone surrogate cannot raise."""
    return text.encode("utf-8", "replace") if text else b""


def few(df: DataFrame, rows: int, part: int = 50_000) -> DataFrame:
    """``df``, known to have at most ``rows`` short rows, in a task for each ``part`` of them, but one a core at least.

    The driver keeps a record of every task, so a loop over a few thousand links must not
    run each of its steps in as many tasks as the shuffles of whole texts.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // part)))


def checked(small: DataFrame, row_bytes: int = 16, most: int = BROADCAST_BYTES) -> DataFrame:
    """``small`` marked for broadcast if its counted rows stay below ``most`` bytes, else as it is."""
    n = small.count()
    return F.broadcast(few(small, n)) if n * row_bytes < most else small


def join_one(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", row_bytes: int = 32, most: int = BROADCAST_BYTES, part: int = 50_000, counted: DataFrame | None = None) -> DataFrame:
    """``many`` joined to ``one``, which has one row for each key; a key may hold most rows of ``many``.

    Below ``most`` bytes ``one`` is broadcast and nothing is shuffled.  Beyond that, keys
    with more than ``part`` rows (or a hundred-thousandth of all, so that they are few)
    are dealt over several tasks, and their row of ``one`` goes to each of these.  Where
    the caller knows how many rows of ``many`` a key has, ``counted(*keys, _n)`` says so
    and ``many`` is read once.
    """
    one = cut(one)
    n = one.count()
    if n * row_bytes < most:
        return many.join(F.broadcast(few(one, n)), keys, how)
    if counted is None:
        many = cut(many)
        counted = many.groupBy(*keys).agg(F.count("*").alias("_n"))
    limit = max(part, (counted.agg(F.sum("_n")).first()[0] or 0) // 100_000)
    heavy = cut(counted.where(F.col("_n") > limit).select(*[F.col(k).alias(f"_{k}") for k in keys], F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))
    same = lambda side: [side[k].eqNullSafe(heavy[f"_{k}"]) for k in keys]
    names = [f"_{k}" for k in keys]
    left = many.join(F.broadcast(heavy), same(many), "left").withColumn("_part", F.coalesce(F.floor(F.rand(1) * F.col("_parts")).cast("int"), F.lit(0))).drop(*names, "_parts")
    right = one.join(F.broadcast(heavy), same(one), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop(*names, "_parts")
    return left.join(right, [*keys, "_part"], how).drop("_part")


def numbered(rows: DataFrame, group: list[str], order: list[str], size: str) -> DataFrame:
    """``rows`` with ``nth``, a row's number from 0 in its group, and ``before``, the sum of ``size`` ahead of it.

    A window would hold a whole group in one task.  Here rows are dealt by ranges of
    (group, order), every task counts its own, and what a group has in earlier tasks is
    added afterwards: one small row a task comes to the driver for that.  Nulls come
    first; rows equal in ``order`` are numbered in any order.
    """
    keys, names = [*group, *order], rows.columns
    spark = rows.sparkSession
    # Ends a tie, so that equal rows are dealt over tasks too.
    tied = rows.withColumn("_tie", F.rand(7))
    ranges = tied.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    kept = T.StructType([*rows.schema, T.StructField("nth", T.LongType()), T.StructField("before", T.LongType()), T.StructField("_task", T.IntegerType()), T.StructField("_row", T.LongType()), T.StructField("_first", T.BooleanType())])

    def run(batches):
        task, last, n, total, row, first = TaskContext.get().partitionId(), None, 0, 0, 0, True
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for k in group:
                c = b.column(names.index(k))
                a, z = c.slice(1), c.slice(0, len(c) - 1)
                equal = pc.or_(pc.fill_null(pc.equal(a, z), False), pc.and_(pc.is_null(a), pc.is_null(z)))
                new[1:] |= ~equal.to_numpy(zero_copy_only=False)
            key = tuple(b.column(names.index(k))[0].as_py() for k in group)
            new[0] = last is not None and key != last
            sizes = b.column(names.index(size)).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.arange(b.num_rows)
            start = np.maximum.accumulate(np.where(new, at, -1))
            ahead = np.cumsum(sizes) - sizes
            old = start < 0
            begin = np.maximum(start, 0)
            nth = np.where(old, n + at, at - begin)
            before = np.where(old, total + ahead, ahead - ahead[begin])
            leads = old & first
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nth), pa.array(before), pa.array(np.full(len(at), task, np.int32)), pa.array(row + at), pa.array(leads)], [*b.schema.names, "nth", "before", "_task", "_row", "_first"])
            first = bool(leads[-1])
            last = tuple(b.column(names.index(k))[b.num_rows - 1].as_py() for k in group)
            n, total, row = int(nth[-1]) + 1, int(before[-1] + sizes[-1]), row + b.num_rows

    made = cut(ranges.mapInArrow(run, kept))
    own = F.struct(*group)
    ends = made.groupBy("_task").agg(
        F.min_by(own, "_row").alias("first"), F.max_by(F.struct(own.alias("own"), (F.col("nth") + 1).alias("n"), (F.col("before") + F.col(size)).alias("total")), "_row").alias("last")
    ).orderBy("_task").collect()  # one row a task
    carry, key, n, total = [], None, 0, 0
    for e in ends:
        if key is not None and e.first == key:
            carry.append((e._task, n, total))
        else:
            n, total = 0, 0
        whole = e.first == e.last.own
        key, n, total = e.last.own, e.last.n + (n if whole else 0), e.last.total + (total if whole else 0)
    out = made.drop("_row")
    if carry:
        more = spark.createDataFrame(carry, "_task int, _n long, _total long")  # at most one row a task
        add = lambda c: F.when(F.col("_first"), F.coalesce(c, F.lit(0))).otherwise(0)
        out = out.join(F.broadcast(more), "_task", "left").withColumns({"nth": F.col("nth") + add(F.col("_n")), "before": F.col("before") + add(F.col("_total"))})
    return out.select(*names, "nth", "before")


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def sums_ahead(lengths: Column, block: int = 128) -> Column:
    """For each element the sum of those ahead of it.  A fold copies what it has made so far, so it runs by blocks."""
    none = F.array().cast("array<long>")
    blocks = lambda x: F.sequence(F.lit(0), F.ceil(F.size(x) / block).cast("int") - 1)
    part = lambda x, b: F.slice(x, b * block + 1, F.lit(block))

    def running(x, start):
        step = lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["done"], F.array(s["at"])).alias("done"))
        return F.aggregate(x, F.struct(start.alias("at"), none.alias("done")), step, lambda s: s["done"])

    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, n: a + n)
    sums = lambda x: F.transform(blocks(x), lambda b: total(part(x, b)))
    return let(lengths, lambda x: let(running(sums(x), F.lit(0).cast("long")), lambda base: F.flatten(F.transform(blocks(x), lambda b: running(part(x, b), F.get(base, b))))))
