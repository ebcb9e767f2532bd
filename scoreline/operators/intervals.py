"""Interval merge and as-of joins by windows; each needs one exchange on the keys, and no pairs are made."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(rows: DataFrame, keys: list[str], gap: float, start: str = "start_seconds", end: str = "end_seconds", position: str = "input_pos") -> DataFrame:
    """Add island (from 0 in each key), anchor_end, frontier and merge_reason to intervals with start <= end and gap >= 0.

    In order of (start, end, position), an interval joins the island whose furthest end so far, the frontier, is at
    most gap before its start. The reason is OVERLAP or GAP_THRESHOLD if it reaches back to the island's first
    interval, else CHAIN_MERGE; the first has none. Rows of a key are one match's intervals, which are few.
    """
    order = Window.partitionBy(*keys).orderBy(start, end, position)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("frontier", F.max(end).over(before))
    new = F.col("frontier").isNull() | (F.col(start) - F.col("frontier") > gap)
    rows = rows.withColumn("island", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    inside = Window.partitionBy(*keys, "island").orderBy(start, end, position)
    anchor, first = F.first(end).over(inside), F.row_number().over(inside) == 1
    reason = F.when(first, F.lit(None)).when(F.col(start) <= anchor, "OVERLAP").when(F.col(start) - anchor <= gap, "GAP_THRESHOLD").otherwise("CHAIN_MERGE")
    return rows.withColumn("merge_reason", reason).withColumn("anchor_end", anchor)


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, columns: list[str], tolerance: float | None = None) -> DataFrame:
    """left with columns of the latest row of right at or before left_on, null if none (within tolerance, both ends included).

    Both sides go through one window over their union; rows of right come first at equal times.
    """
    one = left.withColumns({"__t": F.col(left_on), "__side": F.lit(1), "__r": F.lit(None)})
    held = F.struct(F.col(right_on).alias("__at"), *columns)
    other = right.select(*keys, F.col(right_on).alias("__t"), F.lit(0).alias("__side"), held.alias("__r"))
    one = one.withColumn("__r", F.lit(None).cast(other.schema["__r"].dataType))
    both = one.unionByName(other, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__r", F.last("__r", ignorenulls=True).over(order)).filter("__side = 1")
    if tolerance is not None:
        found = found.withColumn("__r", F.when(F.col("__t") - F.col("__r.__at") <= tolerance, F.col("__r")))
    return found.select(*left.columns, *[F.col(f"__r.{c}").alias(c) for c in columns])
