"""Prefix scans over a table in one total order, without a task that holds it.

Rows are dealt by range of the order, so that partitions follow each other, and written once with their partition. What a
partition hands to those after it (its rows, its greatest or last value) is one row a partition; a window over these few rows gives
what comes before each, and a window within each partition does the rest. Rows with equal order columns lie in one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.shared import kept_table

PART, CARRY = "scan_part_", "scan_carry_"


def _dealt(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with the number of their partition, in ranges of the order."""
    return kept_table(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()), "scan")


def _carried(dealt: DataFrame, handed: Column, before: Column) -> DataFrame:
    """``dealt`` with ``CARRY``: ``before`` (a window function over ``handed``) of the partitions before."""
    parts = dealt.groupBy(F.col(PART).alias("p_")).agg(handed.alias("handed_"))
    carry = parts.select("p_", before.alias(CARRY))  # a row a partition
    return dealt.join(F.broadcast(carry), F.col(PART) == F.col("p_")).drop("p_")


def _over(c: Column) -> Column:
    """An aggregate of what the partitions before hand on."""
    return c.over(Window.partitionBy().orderBy("p_").rowsBetween(Window.unboundedPreceding, -1))


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Adds the place of each row, from 1."""
    rows = _carried(_dealt(df, order), F.count("*"), F.coalesce(_over(F.sum("handed_")), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(PART).orderBy(*order)) + F.col(CARRY)
    return rows.withColumn(out, place.cast("int")).drop(PART, CARRY)


def max_before(df: DataFrame, at: Column, value: Column, out: str) -> DataFrame:
    """Adds the greatest ``value`` of the rows at a smaller ``at`` (a whole number); null if there is none."""
    df = df.withColumns({"at_": at.cast("long"), "value_": value})
    rows = _carried(_dealt(df, [F.col("at_")]), F.max("value_"), _over(F.max("handed_")))
    own = F.max("value_").over(Window.partitionBy(PART).orderBy("at_").rangeBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(out, F.greatest(own, CARRY)).drop(PART, CARRY, "at_", "value_")


def last_before(df: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds the last ``value`` that is not null of the rows before; null if there is none. The order must be total."""
    names = [f"order_{i}_" for i in range(len(order))]
    df = df.withColumn("value_", value).withColumns(dict(zip(names, order, strict=True)))
    keys = [F.col(n) for n in names]
    rows = _carried(_dealt(df, keys), F.max_by("value_", F.when(F.col("value_").isNotNull(), F.struct(*keys))), _over(F.last("handed_", ignorenulls=True)))
    own = F.last("value_", ignorenulls=True).over(Window.partitionBy(PART).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(out, F.coalesce(own, CARRY)).drop(PART, CARRY, "value_", *names)
