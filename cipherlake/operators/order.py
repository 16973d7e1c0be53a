"""Numbers of rows in a total order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cipherlake.sources.staging import discard, staged


def placed(rows: DataFrame, *keys: str, name: str = "place") -> DataFrame:
    """rows with their place from 1 by the keys (nulls first); rows equal in all keys take their places in any order.

    Rows are written once, so that the ranges are drawn from what was written, then sorted in ranges of the keys and
    written with their number in the range, which is shifted by the sizes of those before it. Of each range
    one number is broadcast; what one task orders without a split is the list of ranges.
    """
    given = staged(rows, "unplaced")
    # An identifier holds the range above bit 33 and the row's number in it below.
    ranges = staged(given.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "placed")
    discard(given)
    of = F.shiftright("_at", 33)
    sizes = ranges.groupBy(of.alias("_range")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifted = ranges.withColumn("_range", of).join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")
    return shifted.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_range", "_at", "_before")
