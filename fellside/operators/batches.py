"""Which rows a loader takes, and in which batch: within groups that are windows of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(key: Column, seed: int) -> Column:
    """A key for an order that depends on the seed alone."""
    return F.xxhash64(F.lit(seed), key)


def batched(rows: DataFrame, size: int, by: str, *order: Column, drop_last: bool = False) -> DataFrame:
    """``rows`` with batch, from 0 within each ``by``, in ``order``; with ``drop_last``, without a last one that isn't full."""
    own = Window.partitionBy(by)
    out = rows.withColumn("batch", F.floor((F.row_number().over(own.orderBy(*order)) - 1) / size))
    if drop_last:
        out = out.withColumn("_n", F.count("*").over(own)).where(F.col("batch") < F.floor(F.col("_n") / size)).drop("_n")
    return out


def drawn(weights: DataFrame, by: str, key: str, place: Column) -> DataFrame:
    """``weights``: ``by``, ``key``, weight (whole numbers above 0). As many draws with replacement as ``by`` has rows: by, draw (from 0), key. ``place``, a whole number from the column draw, is taken modulo the sum of
    weights; whose share of the sum it falls into is drawn. Places and shares are merged by one window, so draws meet no product of rows."""
    own = Window.partitionBy(by).orderBy(key)
    starts = weights.select(by, key, "weight", (F.sum("weight").over(own) - F.col("weight")).alias("_at"))
    sums = weights.groupBy(by).agg(F.sum("weight").alias("_sum"), F.count("*").alias("_n"))
    draws = sums.select(by, "_sum", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("draw")).select(by, "draw", F.pmod(place, F.col("_sum")).alias("_at"))
    both = starts.select(by, "_at", F.col(key).alias("_key"), F.lit(None).cast("long").alias("draw")).unionByName(draws.select(by, "_at", F.lit(None).cast(starts.schema[key].dataType).alias("_key"), "draw"))
    merged = both.withColumn(key, F.last("_key", True).over(Window.partitionBy(by).orderBy("_at", F.col("draw").isNotNull(), "draw").rowsBetween(Window.unboundedPreceding, 0)))
    return merged.where(F.col("draw").isNotNull()).select(by, "draw", key)
