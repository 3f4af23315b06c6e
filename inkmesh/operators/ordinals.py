"""Dense numbers in order, over many partitions, in two passes.

The same serves running totals.  The rows are dealt into sorted ranges and written with the number of their
range.  Rows are counted by range, and a range's first number is the sum of the
counts before it: a list as long as there are ranges.  A row's number is that
plus its rank in its range.  No task sees more than a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkmesh.sources.scratch import scratch, written


def _dealt(rows: DataFrame, order: list[str], ranges: int | None, folder: str | None) -> DataFrame:
    # without a number, small ranges are joined as the rows' size asks, neighbours only, so they stay in order
    ranged = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    return written(ranged.withColumn("__range", F.spark_partition_id()), folder or scratch(rows.sparkSession), "ranges")


def _firsts(dealt: DataFrame, total, start, kind: str) -> DataFrame:
    """(__range, __first): what comes before each range."""
    firsts, at = [], start
    for r in dealt.groupBy("__range").agg(total.alias("n")).orderBy("__range").collect():  # one row for a range
        firsts.append((r["__range"], at))
        at += r["n"]
    return F.broadcast(dealt.sparkSession.createDataFrame(firsts, f"__range int, __first {kind}"))


def numbered(rows: DataFrame, order: list[str], into: str, start: int = 0, ranges: int | None = None, folder: str | None = None) -> DataFrame:
    """``rows`` with the column ``into``: ``start``, ``start`` + 1, ... in the order of the columns ``order``.

    Rows that agree in all of ``order`` lie in one range and get numbers in no
    particular order among them, so the columns should tell all rows apart.
    """
    dealt = _dealt(rows, order, ranges, folder)
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.join(_firsts(dealt, F.count("*"), start, "long"), "__range").withColumn(into, F.col("__first") + rank - 1).select(*[c for c in rows.columns if c != into], into)


def running(rows: DataFrame, order: list[str], value: str, into: str, ranges: int | None = None, folder: str | None = None) -> DataFrame:
    """``rows`` with the column ``into``: the sum of the numbers ``value`` up to and with the row, in the order of ``order``."""
    dealt = _dealt(rows.withColumn(value, F.col(value).cast("double")), order, ranges, folder)
    own = F.sum(value).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.join(_firsts(dealt, F.sum(value), 0.0, "double"), "__range").withColumn(into, F.col("__first") + own).select(*[c for c in rows.columns if c != into], into)
