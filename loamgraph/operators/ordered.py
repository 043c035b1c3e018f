"""Places, differences and running sums in an order, without a task that holds a whole group.

A window over a group puts all its rows into one task.  Here a group is cut into blocks
of its order (between quantiles of the ordering number over all rows, so clustered and
outlying numbers make no large block; only equal numbers stay together); inside the blocks plain windows run, and what a
block hands to the next (its number of rows, its last value, its sum) comes from a window
over one row per block.  A group that holds a third of all rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.session import shuffle_parts, stored

#: Blocks the rows are cut into by the ordering number, at least and at most (both powers of two, the cuts are part of the plan), and rows a block is meant for.
BLOCKS, MOST, ROWS = 1024, 16_384, 1_000_000


def blocks_for(rows: int) -> int:
    """Number of blocks for so many rows."""
    return min(MOST, max(BLOCKS, 1 << (-(-rows // ROWS)).bit_length()))


def _blocked(df: DataFrame, order: str) -> DataFrame:
    """With _b: the block of the ordering number, null numbers in the first."""
    x, n = F.col(order).cast("double"), BLOCKS
    quantiles = lambda n: F.percentile_approx(x, [i / n for i in range(1, n)], 16 * n)
    rows, cuts = df.agg(F.count("*"), quantiles(n)).first()  # one row, of n - 1 numbers, null without numbers
    if blocks_for(rows) > n:
        n = blocks_for(rows)
        cuts = df.agg(quantiles(n)).first()[0]
    cuts = sorted({c for c in cuts or () if c == c})
    if not cuts:
        return df.withColumn("_b", F.lit(-1).cast("bigint"))
    known = F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>")
    # The number of cuts below the value, by halving.
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(n.bit_length()))))
    below = F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(F.coalesce(F.get(known, n + step - 1) < x, F.lit(False)), step).otherwise(0))
    return df.withColumn("_b", F.when(x.isNull(), -1).otherwise(below).cast("bigint"))


def _carried(df: DataFrame, by: Sequence[str], per_block: Column, over_blocks) -> DataFrame:
    """df joined with _c: what each block of a group gets from the blocks before it."""
    each = df.groupBy(*by, "_b").agg(per_block.alias("_s"))
    w = Window.partitionBy(*by).orderBy("_b")
    keys = (*by, "_b")
    each = each.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), over_blocks(w).alias("_c"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    return df.join(each, same, "left").select(*df.columns, "_c")


def ranked(df: DataFrame, by: Sequence[str], order: str, name: str, *ties: Column, descending: bool = False) -> DataFrame:
    """With the row's number from 1 within its group, in the order of a number and, for equal numbers, of ``ties``."""
    rows = _blocked(df, order)
    if descending:
        rows = rows.withColumn("_b", -F.col("_b"))
    before = lambda w: F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = _carried(rows, by, F.count("*"), before)
    first = F.desc_nulls_last(order) if descending else F.asc_nulls_first(order)
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(first, *ties))
    return rows.withColumn(name, (place + F.col("_c")).cast("bigint")).drop("_b", "_c")


def differences(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """With the difference to the next smaller value of the group; the smallest is its own difference."""
    rows = _carried(_blocked(df, value), by, F.max(value), lambda w: F.last("_s", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.lag(value).over(Window.partitionBy(*by, "_b").orderBy(value))
    return rows.withColumn(name, F.col(value) - F.coalesce(inside, F.col("_c"), F.lit(0))).drop("_b", "_c")


def running(df: DataFrame, by: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """With the sum of ``value`` over the rows of the group up to this one; the order is to be unique in its group."""
    rows = _carried(_blocked(df, order), by, F.sum(value), lambda w: F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum(value).over(Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, inside + F.col("_c")).drop("_b", "_c")


def numbered(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """With the row's number from 1 in the order of all rows, for any orderable columns.

    Rows are range partitioned and sorted and written down; a row's number is that within its
    partition plus the sizes of the partitions before, which are few numbers.  Equal rows may be
    numbered in any order among themselves.
    """
    spark = df.sparkSession
    rows = df.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order)
    rows = stored(rows.withColumn("_p", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    start, offsets = 1, []
    for r in rows.groupBy("_p").count().orderBy("_p").collect():  # one row per partition
        offsets.append((r["_p"], start))
        start += r["count"]
    shift = spark.createDataFrame(offsets, "_p int, _o bigint")
    return rows.join(F.broadcast(shift), "_p").withColumn(name, F.col("_n") + F.col("_o")).drop("_p", "_n", "_o")
