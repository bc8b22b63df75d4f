"""Places of rows in a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import corpus

IN_PARTITION = (1 << 33) - 1


def numbered(rows: DataFrame, *keys: Column | str, name: str = "position") -> DataFrame:
    """The rows with their place in order of ``keys``, from 0.

    Rows are sorted by ranges and written to the shared folder, so that ranges stay as they
    are; a row's place is its own in its range and the sum of the ranges ahead.  The only
    window is over one row a range.
    """
    held = corpus.checkpointed(rows.orderBy(*keys).select(F.struct("*").alias("row")))
    placed = held.select("row", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND(F.lit(IN_PARTITION)).alias("at"))
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    # As many rows as ranges are broadcast.
    return placed.join(F.broadcast(sizes), "range").select("row.*", (F.col("ahead") + F.col("at")).alias(name))
