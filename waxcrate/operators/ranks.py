"""Places in an order within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import kept


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """df with name: each row's place (from 1) in its group by the order, in two phases, so that no task holds a group.

    Rows are dealt to ranges of (by, order) and kept with their range's number; a range's rows are placed among themselves, and the
    counts of the ranges before it within the group are added. The order must tell a group's rows apart, as a range holds all rows that are equal in it.
    """
    ranges = kept(df.repartitionByRange(*by, *order).withColumn("w_range", F.spark_partition_id()), "ranges")
    group = [F.col(f"`{c}`") for c in by]
    sizes = ranges.groupBy(*group, "w_range").agg(F.count("*").alias("w_rows"))
    before = F.sum("w_rows").over(Window.partitionBy(*group).orderBy("w_range").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select(*[c.alias(f"w_by{i}") for i, c in enumerate(group)], F.col("w_range").alias("w_at"), F.coalesce(before, F.lit(0)).alias("w_base"))
    same = F.col("w_range") == F.col("w_at")
    for i, c in enumerate(group):
        same = same & c.eqNullSafe(F.col(f"w_by{i}"))
    inside = F.row_number().over(Window.partitionBy(*group, "w_range").orderBy(*order))
    return ranges.withColumn("w_inside", inside).join(bases, same).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("w_base") + F.col("w_inside")).cast("long").alias(name))
