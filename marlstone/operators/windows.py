"""Ordered operators whose groups may hold a third of all rows.

A plain window puts one key into one task. The operators here cut each key's order into buckets, work inside
buckets, and carry only one row a bucket between them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_ordinal(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], out: str) -> DataFrame:
    """Position of each row (from 0) within ``keys``; ``bucket`` must rise with ``order``.

    Null keys are keys of their own. Rows that tie in ``order`` get any of their positions. An empty input gives an empty output.
    """
    b = df.withColumn("_b", bucket)
    k = [F.col(c) for c in keys]
    sizes = b.groupBy(*k, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*k).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(*k, "_b").orderBy(*order)
    left = b.withColumn("_r", F.row_number().over(inner) - 1)
    on = [left[c].eqNullSafe(sizes[c]) for c in [*keys, "_b"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(sizes, cond).select(*[left[c] for c in df.columns], (left["_r"] + sizes["_off"]).cast("bigint").alias(out))


def prefix_sum(df: DataFrame, bucket: Column, order: Sequence[Column], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over all rows before each row in the order; only one row a bucket meets in one task."""
    b = df.withColumn("_b", bucket)
    sums = b.groupBy("_b").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("_s"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_b").alias("_b2"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    inner = Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = b.withColumn("_in", F.coalesce(F.sum(F.coalesce(F.col(value), F.lit(0))).over(inner), F.lit(0)))
    return left.join(sums, left["_b"].eqNullSafe(sums["_b2"])).select(*[left[c] for c in df.columns], (F.col("_in") + F.col("_off")).cast("bigint").alias(out))
