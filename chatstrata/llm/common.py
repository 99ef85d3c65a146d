"""What the operators share: tables, global positions and prefix sums."""

from __future__ import annotations

import ctypes

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatstrata.session import configure, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# monotonically_increasing_id() holds the partition above this bit and the row within it below.
PARTITION_BIT = 33


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def give_back() -> None:
    """Hands the freed memory of a Python worker back to the system, where the C library (glibc) can.

    Workers serve one job after another; without it each keeps as much as its largest task ever took.
    """
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def unused(rows: DataFrame, stem: str) -> str:
    """A column name that the table does not have."""
    taken = {name.lower() for name in rows.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def partition_of(row: Column) -> Column:
    return F.shiftright(row, PARTITION_BIT)


def row_within(row: Column) -> Column:
    return row.bitwiseAND(F.lit((1 << PARTITION_BIT) - 1))


def prefix_sums(counts: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """`counts` with the sum of `value` over all rows before, in `order`.

    For tables with one row per partition: their length is the number of tasks of
    a stage, whatever the data, so one window holds them.
    """
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))


def ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`rows` with `position`, their place (from 0) in the order of `keys`.

    A range exchange splits the rows evenly even where a leading key is hot, if a
    later key tells its rows apart. Rows are numbered within their partition; the
    partitions' bases are prefix sums of their counts.
    """
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = staged(ordered.withColumn("_row", F.monotonically_increasing_id()), name)
    counts = ordered.groupBy(partition_of(F.col("_row")).alias("_part")).agg(F.count("*").alias("_rows"))
    bases = prefix_sums(counts, "_part", "_rows", "_base").select("_part", "_base")
    placed = ordered.withColumn("_part", partition_of(F.col("_row"))).join(bases, "_part")
    return placed.withColumn("position", F.col("_base") + row_within(F.col("_row"))).drop("_part", "_base", "_row")
