"""Ordered scans over keys of any size.

A window over one key runs in one task. These helpers cut each key's order into buckets, run the
window inside a bucket, and carry only one summary row per bucket across. A key that holds a third of
all rows is thus spread over as many tasks as it has buckets. The carried row joins its bucket by a
union, as its first (or last) row, so the data is exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "__bucket"
_OWN = ("__v", "__place", "__far", BUCKET)


def _scan(d: DataFrame, carried: DataFrame, keys: list[str], order: list, result: Column, out: str, place: int, frame: tuple[int, int] | None) -> DataFrame:
    """``result`` over each bucket of ``d`` with the carried row put before (place 0) or after (2) all others."""
    both = d.withColumn("__place", F.lit(1)).unionByName(carried.withColumn("__place", F.lit(place)), allowMissingColumns=True)
    window = Window.partitionBy(*keys, BUCKET).orderBy("__place", *order)
    if frame:
        window = window.rowsBetween(*frame)
    return both.withColumn(out, result.over(window)).where(F.col("__place") == 1)


def neighbour(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: Column, out: str, *, following: bool = False) -> DataFrame:
    """Add ``out``: ``value`` of the previous (or following) row of the same keys.

    ``bucket`` must not decrease along ``order``. Ties in ``order`` are the caller's to break. Null
    keys form a group of their own; the first (last) row gets null. Names that start with ``__`` are
    the helper's own.
    """
    d = df.withColumn(BUCKET, bucket).withColumn("__v", F.struct(value.alias("v")))
    at = F.struct(*order)
    edge = F.min_by("__v", at) if following else F.max_by("__v", at)
    across = Window.partitionBy(*keys).orderBy(BUCKET)
    edges = d.groupBy(*keys, BUCKET).agg(edge.alias("__edge"))
    step = F.lead if following else F.lag
    carried = edges.select(*keys, BUCKET, step("__edge").over(across).alias("__v"))
    return _scan(d, carried, keys, order, step("__v"), "__far", 2 if following else 0, None).withColumn(out, F.col("__far")["v"]).drop(*_OWN)


def _running(df: DataFrame, keys: list[str], bucket: Column, order: list, value: Column, out: str, fold) -> DataFrame:
    d = df.withColumn(BUCKET, bucket).withColumn("__v", value)
    wide = d.agg(fold("__v")).schema[0].dataType  # a sum of ints is a bigint
    d = d.withColumn("__v", F.col("__v").cast(wide))
    across = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    folded = d.groupBy(*keys, BUCKET).agg(fold("__v").alias("__part"))
    carried = folded.select(*keys, BUCKET, fold("__part").over(across).cast(wide).alias("__v"))
    return _scan(d, carried, keys, order, fold("__v"), out, 0, (Window.unboundedPreceding, 0)).drop(*_OWN)


def running_max(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """Add ``out``: the greatest ``value`` so far, the row itself included (nulls do not count)."""
    return _running(df, keys, bucket, order, value, out, F.max)


def running_sum(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` so far, the row itself included (nulls count as 0)."""
    return _running(df, keys, bucket, order, F.coalesce(value, F.lit(0)), out, F.sum)
