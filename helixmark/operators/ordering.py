"""Running sums and numbers over a global order, without a window that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise


def placed(rows: DataFrame, order: list[str], name: str = "ordered") -> DataFrame:
    """rows in a global order, range-sorted and written, with __part: the number of their range."""
    return materialise(rows.orderBy(*order).withColumn("__part", F.spark_partition_id()), name)


def running(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with, under each name of sums, the sum of that column over all rows before in the order, which must be total.

    Rows are range-sorted, sums of whole ranges are added up first (a row per range), and windows run within a range.
    """
    df = placed(rows, order)
    per = df.groupBy("__part").agg(*[F.sum(v).alias(f"__all_{k}") for k, v in sums.items()])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = per.select("__part", *[F.coalesce(F.sum(f"__all_{k}").over(earlier), F.lit(0)).alias(f"__from_{k}") for k in sums])
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(F.broadcast(offsets), "__part")  # a row per range
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[(F.col(f"__from_{k}") + F.coalesce(F.sum(v).over(own), F.lit(0))).alias(k) for k, v in sums.items()])


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their number, from 1, in the order."""
    return running(rows, order, {"__n": F.lit(1).cast("long")}).withColumn(name, F.col("__n") + 1).drop("__n")
