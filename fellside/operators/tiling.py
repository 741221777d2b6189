"""Windows over images, and what blends their predictions. Positions are computed from sizes, rows come from sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def starts(size: Column, window: int, step: int) -> Column:
    """Positions along one side: every ``step``, and one flush with the end."""
    last = F.greatest(size - window, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))


def windows(images: DataFrame, window: int, step: int) -> DataFrame:
    """``images``: image, height, width. image, y, x."""
    return images.select("image", F.explode(starts(F.col("height"), window, step)).alias("y"), "width").select("image", "y", F.explode(starts(F.col("width"), window, step)).alias("x"))


def weights(window: int, mode: str, spark) -> DataFrame:
    """i, j, weight of each pixel of a window."""
    at = lambda n: F.when(F.lit(window) == 1, F.lit(-1.0)).otherwise(-1 + 2 * F.col(n) / (window - 1))
    one = {"average": lambda n: F.lit(1.0), "cosine": lambda n: 0.5 * (1 + F.cos(at(n) * 3.141592653589793)), "gaussian": lambda n: F.exp(-(at(n) * at(n)) / (2 * 0.35 * 0.35))}[mode]
    side = spark.range(window)
    return side.select(F.col("id").alias("i")).crossJoin(side.select(F.col("id").alias("j"))).select("i", "j", (one("i") * one("j")).alias("weight"))


def reflected(index: Column, size: Column) -> Column:
    """The source of a padded position: mirrored at the edges, which aren't repeated."""
    period = F.greatest(2 * (size - 1), F.lit(1))
    m = F.pmod(index, period)
    return F.when(m < size, m).otherwise(period - m)


def variants(pixels: DataFrame, size: int) -> DataFrame:
    """The seven test-time variants' source positions (vr, vc) of each pixel (r, c) of square images; other columns stay."""
    r, c, n = F.col("r"), F.col("c"), size - 1
    kinds = [("identity", r, c), ("h", r, n - c), ("v", n - r, c), ("hv", n - r, n - c), ("rot90", c, n - r), ("rot180", n - r, n - c), ("rot270", n - c, r)]
    moves = F.array(*[F.struct(F.lit(k).alias("variant"), a.cast("int").alias("vr"), b.cast("int").alias("vc")) for k, a, b in kinds])
    return pixels.select("*", F.explode(moves).alias("v")).select(*pixels.columns, "v.variant", "v.vr", "v.vc")


def undone(predicted: DataFrame) -> DataFrame:
    """What was predicted at (r, c) of a variant belongs to its source pixel (vr, vc): rows at these, ready to be averaged."""
    rest = [c for c in predicted.columns if c not in ("r", "c", "vr", "vc", "variant")]
    return predicted.select(*rest, F.col("vr").alias("r"), F.col("vc").alias("c"))
