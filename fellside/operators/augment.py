"""Augmentation of images and their labels: affine maps, blur, brightness and colours. Images are tables of pixels (map_id, r, c, then channels from 0 to 255); ``images`` has map_id, height and width."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .masks import byte_hsv, byte_rgb
from .raster import KEY

#: What lies outside an image, and outside a label.
PAPER, NOTHING = 255, 0


def drawn(images: DataFrame, seed: int, shift: float = 0.06, scale: float = 0.1, rotate: float = 15.0, share: float = 0.4) -> DataFrame:
    """map_id, tx, ty, scale, angle for each image: what an affine map with these limits takes, by ``seed`` and map alone, so a lost task draws the same again. A ``share`` of the images is moved, the others stay."""
    unit = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("map_id")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    side = lambda k, limit: F.when(unit(0) < share, (2 * unit(k) - 1) * limit).otherwise(0.0)
    return images.select("map_id", side(1, shift).alias("tx"), side(2, shift).alias("ty"), (1 + side(3, scale)).alias("scale"), side(4, rotate).alias("angle"))


def _sources(images: DataFrame, moves: DataFrame) -> DataFrame:
    """map_id, r, c of every pixel of the moved images, with sy, sx: where it comes from. Rows are dealt out before they're filled with columns, so a large image isn't one task's."""
    lines = images.select("map_id", "height", "width").join(moves, "map_id").select("*", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("r")).repartition("map_id", "r")
    px = lines.select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("c"))
    cx, cy, turn = (F.col("width") - 1) / 2, (F.col("height") - 1) / 2, F.radians("angle")
    u, v = F.col("c") - cx - F.col("tx") * F.col("width"), F.col("r") - cy - F.col("ty") * F.col("height")
    at = lambda a, b, middle: F.round((a * u + b * v) / F.col("scale") + middle, 6)
    return px.select(*[F.col(k).cast("int").alias(k) for k in KEY], at(-F.sin(turn), F.cos(turn), cy).alias("sy"), at(F.cos(turn), F.sin(turn), cx).alias("sx"))


def affine(image: DataFrame, images: DataFrame, moves: DataFrame, outside: int = PAPER) -> DataFrame:
    """``image`` turned by ``angle`` degrees and scaled about its middle, then shifted by shares ``tx`` and ``ty`` of its sides (``moves``: map_id, tx, ty, scale, angle). Each pixel looks back to its source and meets the four around it, an
    equi-join on pixels; a missing one counts as ``outside``."""
    names = [c for c in image.columns if c not in KEY]
    s = _sources(images, moves)
    y, x = F.floor("sy"), F.floor("sx")
    fy, fx = F.col("sy") - y, F.col("sx") - x
    corner = lambda a, b: F.struct((y + a).cast("int").alias("r"), (x + b).cast("int").alias("c"), ((fy if a else 1 - fy) * (fx if b else 1 - fx)).alias("w"))
    asked = s.select("map_id", F.col("r").alias("_r"), F.col("c").alias("_c"), F.inline(F.filter(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)]), lambda k: k.w > 0)))
    met = asked.join(image, KEY, "left").groupBy("map_id", F.col("_r").alias("r"), F.col("_c").alias("c"))
    return met.agg(*[F.floor(F.round(F.sum(F.col("w") * F.coalesce(F.col(n), F.lit(outside))), 6) + 0.5).cast("int").alias(n) for n in names])


def affine_label(label: DataFrame, images: DataFrame, moves: DataFrame, outside: int = NOTHING) -> DataFrame:
    """``label`` (map_id, r, c, class_id) moved as ``affine`` moves its image; classes don't mix, so each pixel takes its nearest one's."""
    s = _sources(images, moves).select("map_id", F.col("r").alias("_r"), F.col("c").alias("_c"), F.floor(F.col("sy") + 0.5).cast("int").alias("r"), F.floor(F.col("sx") + 0.5).cast("int").alias("c"))
    return s.join(label.select(*KEY, "class_id"), KEY, "left").select("map_id", F.col("_r").alias("r"), F.col("_c").alias("c"), F.coalesce("class_id", F.lit(outside)).cast("int").alias("class_id"))


def bell(size: int) -> list[float]:
    """The weights of a blur of odd ``size``, their width by the usual rule."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((k - size // 2) ** 2) / (2 * sigma * sigma)) for k in range(size)]
    return [w / sum(raw) for w in raw]


def _along(image: DataFrame, names: list[str], line: str, size: str, weights: list[float]) -> DataFrame:
    """Weighted sums along one side. A pixel is told to all places that see it, straight or mirrored at an edge (which isn't repeated); sums are combined before the exchange."""
    half, n = len(weights) // 2, F.col(size)
    period = F.greatest(2 * (n - 1), F.lit(1))
    waves = F.sequence(-F.ceil(F.lit(half) / period).cast("int"), F.ceil((n + half) / period).cast("int"))
    shown = F.array_distinct(F.flatten(F.transform(waves, lambda k: F.array(k * period + F.col(line), k * period - F.col(line)))))
    taps = F.array(*[F.struct(F.lit(k - half).alias("d"), F.lit(w).alias("w")) for k, w in enumerate(weights)])
    told = image.select("*", F.explode(F.filter(shown, lambda q: (q >= -half) & (q < n + half))).alias("_q")).select("*", F.inline(taps)).withColumn("_p", (F.col("_q") - F.col("d")).cast("int")).where((F.col("_p") >= 0) & (F.col("_p") < n))
    keys = [F.col("_p").alias(k) if k == line else F.col(k) for k in (*KEY, "height", "width")]
    return told.groupBy(*keys).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in names], F.sum("w").alias("_w")).select(*KEY, "height", "width", *[(F.col(c) / F.col("_w")).alias(c) for c in names])


def blurred(image: DataFrame, images: DataFrame, weights: list[float]) -> DataFrame:
    """``image`` blurred by ``weights`` (an odd number of them) along rows and then columns; sums are rounded at the end. Where pixels are missing those there count alone; what is missing from ``image`` is missing from the result."""
    names = [c for c in image.columns if c not in KEY]
    wide = image.join(images.select("map_id", "height", "width"), "map_id")
    soft = _along(_along(wide, names, "c", "width", weights), names, "r", "height", weights)
    return soft.join(image.select(*KEY), KEY, "left_semi").select(*KEY, *[F.floor(F.round(c, 6) + 0.5).cast("int").alias(c) for c in names])


def _byte(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), value)).cast("int")


def lit(image: DataFrame, contrast: float, brightness: float) -> DataFrame:
    """Channels times ``1 + contrast`` plus ``brightness`` of the full range, held within it, fractions cut off."""
    names = [c for c in image.columns if c not in KEY]
    return image.select(*KEY, *[_byte(F.floor(F.round(F.col(c) * (1 + contrast) + 255 * brightness, 6))).alias(c) for c in names])


def tinted(image: DataFrame, hue: int, saturation: int, value: int) -> DataFrame:
    """``image`` (red, green, blue) with its hue turned (of 180), saturation and value shifted, both held within the range."""
    seen = image.select(*KEY, F.inline(F.array(F.struct(*[c.alias(n) for c, n in zip(byte_hsv(*[F.col(n) for n in ("red", "green", "blue")]), "hsv", strict=True)]))))
    moved = (F.pmod(F.col("h") + hue, F.lit(180)), _byte(F.col("s") + saturation), _byte(F.col("v") + value))
    return seen.select(*KEY, *[c.alias(n) for c, n in zip(byte_rgb(*moved), ("red", "green", "blue"), strict=True)])
