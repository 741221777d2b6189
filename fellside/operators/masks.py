"""Masks of course colours: morphology with any kernel, equalised brightness, and the whole rule that makes a mask of an image.

Masks are tables of pixels (map_id, r, c); ``images`` has map_id, height and width. Kernels are lists of offsets and meet pixels by equi-joins; what lies outside an image is neutral, for
growing as for shrinking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .raster import KEY, PLUS, _shifted, pink

Kernel = list[tuple[int, int]]


def _inside(r: Column, c: Column) -> Column:
    return (r >= 0) & (c >= 0) & (r < F.col("height")) & (c < F.col("width"))


def grown(mask: DataFrame, images: DataFrame, kernel: Kernel = PLUS) -> DataFrame:
    """Every pixel of the images that some offset leads to from the mask. A map without an image has no pixels."""
    return _shifted(mask, kernel).distinct().join(images, "map_id").where(_inside(F.col("r"), F.col("c"))).select(*KEY)


def shrunk(mask: DataFrame, images: DataFrame, kernel: Kernel = PLUS) -> DataFrame:
    """The pixels of ``mask`` and of their surroundings from which all offsets that stay inside the image lead to the mask. Pixels of the mask are counted at the places that see them, so that a place is known by its count; it sees
    as many as the size of the image says. The mask holds no pixel twice."""
    seen = _shifted(mask, [(-a, -b) for a, b in kernel]).groupBy(*KEY).agg(F.count("*").alias("_n")).join(images, "map_id").where(_inside(F.col("r"), F.col("c")))
    room = sum((_inside(F.col("r") + a, F.col("c") + b).cast("int") for a, b in kernel), F.lit(0))
    return seen.where(F.col("_n") == room).select(*KEY)


def opened(mask: DataFrame, images: DataFrame, kernel: Kernel = PLUS) -> DataFrame:
    """What a kernel can reach without leaving the mask: thin strokes go."""
    return grown(shrunk(mask, images, kernel), images, kernel)


def closed(mask: DataFrame, images: DataFrame, kernel: Kernel = PLUS, times: int = 1) -> DataFrame:
    """The mask with gaps filled: grown ``times``, then shrunk as often."""
    for _ in range(times):
        mask = grown(mask, images, kernel)
    for _ in range(times):
        mask = shrunk(mask, images, kernel)
    return mask


#: Fixed values of equalising: tiles a side, grey levels, how far above an even histogram a level may stand.
TILES, LEVELS, CLIP = 8, 256, 2.0


def _padded(size: Column, other: Column) -> Column:
    """A side with what is reflected at its end. Sides are padded if one of both doesn't divide, then by a whole tile row at most."""
    return F.when((size % TILES == 0) & (other % TILES == 0), size).otherwise(size + TILES - size % TILES)


def _mirrored(at: Column, size: Column, padded: Column) -> Column:
    """All places below ``padded`` that show the pixel at ``at`` if the image is reflected at its edge (the edge itself once)."""
    period = F.greatest(2 * (size - 1), F.lit(1))
    waves = F.sequence(F.lit(0), F.ceil(padded / period).cast("int"))
    both = F.flatten(F.transform(waves, lambda k: F.array(k * period + at, k * period - at)))
    return F.array_distinct(F.filter(both, lambda p: (p >= 0) & (p < padded)))


def tile_levels(values: DataFrame, images: DataFrame, clip: float = CLIP) -> DataFrame:
    """``values``: map_id, r, c, v (0..255). map_id, ty, tx, v, level: for each tile (``TILES`` a side) the level that replaces each of the 256, by the tile's cumulative histogram; what stands above the limit is dealt out
    evenly, what's left of that to levels at even distances. A histogram is counted before the exchange: 256 rows a tile at most."""
    wide = images.select("map_id", "height", "width", _padded(F.col("height"), F.col("width")).alias("_h"), _padded(F.col("width"), F.col("height")).alias("_w"))
    px = values.join(wide, "map_id")
    px = px.select("*", F.explode(_mirrored(F.col("r"), F.col("height"), F.col("_h"))).alias("_r")).select("*", F.explode(_mirrored(F.col("c"), F.col("width"), F.col("_w"))).alias("_c"))
    tile = ["map_id", "ty", "tx"]
    size = (F.col("_h") / TILES).cast("int") * (F.col("_w") / TILES).cast("int")
    n = px.groupBy("map_id", F.floor(F.col("_r") / (F.col("_h") / TILES)).cast("int").alias("ty"), F.floor(F.col("_c") / (F.col("_w") / TILES)).cast("int").alias("tx"), F.col("v").cast("int").alias("v"), size.alias("_size")).agg(F.count("*").alias("_n"))
    limit = F.greatest(F.floor(F.lit(clip) * F.col("_size") / LEVELS), F.lit(1))
    held = n.groupBy(*tile, "_size").agg(F.map_from_entries(F.collect_list(F.struct("v", F.least("_n", limit)))).alias("_kept"), F.sum(F.greatest(F.col("_n") - limit, F.lit(0))).alias("_over"))
    rest = F.col("_over") % LEVELS
    step = F.greatest(F.floor(LEVELS / F.greatest(rest, F.lit(1))), F.lit(1))
    every = held.select("*", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("v"))
    upto = F.sum(F.coalesce(F.try_element_at("_kept", F.col("v")), F.lit(0))).over(Window.partitionBy(*tile).orderBy("v"))
    dealt = F.floor(F.col("_over") / LEVELS) * (F.col("v") + 1) + F.least(rest, F.floor(F.col("v") / step) + 1)
    return every.select(*tile, "v", F.bround(F.least((upto + dealt) * F.lit(255.0) / F.col("_size"), F.lit(255.0))).cast("int").alias("level"))


def equalised(values: DataFrame, images: DataFrame, clip: float = CLIP) -> DataFrame:
    """``values`` (map_id, r, c, v) with level: v as the four nearest tiles replace it, weighted by nearness to their middles. The four levels of every v between four middles are put side by side first (at most 81 x 256 rows a map),
    so pixels meet them in one join."""
    tiles = tile_levels(values, images, clip)
    wide = images.select("map_id", (_padded(F.col("height"), F.col("width")) / TILES).alias("_th"), (_padded(F.col("width"), F.col("height")) / TILES).alias("_tw"))
    # a place between middles gy and gy + 1 (from -1 on) sees tiles gy and gy + 1, held within the image
    sees = lambda t: F.array_distinct(F.flatten(F.array(
        F.array(F.struct(t.alias("g"), F.lit(0).alias("s")), F.struct((t - 1).alias("g"), F.lit(1).alias("s"))),
        F.when(t == 0, F.array(F.struct(F.lit(-1).alias("g"), F.lit(0).alias("s")))).otherwise(F.array()),
        F.when(t == TILES - 1, F.array(F.struct(t.alias("g"), F.lit(1).alias("s")))).otherwise(F.array()))))
    four = tiles.select("map_id", "v", "level", F.explode(sees(F.col("ty"))).alias("_y"), "tx").select("*", F.explode(sees(F.col("tx"))).alias("_x"))
    pick = lambda a, b: F.max(F.when((F.col("_y.s") == a) & (F.col("_x.s") == b), F.col("level"))).alias(f"_l{a}{b}")
    four = four.groupBy("map_id", "v", F.col("_y.g").alias("_gy"), F.col("_x.g").alias("_gx")).agg(*[pick(a, b) for a in (0, 1) for b in (0, 1)])
    px = values.join(wide, "map_id").withColumn("_fy", F.col("r") / F.col("_th") - 0.5).withColumn("_fx", F.col("c") / F.col("_tw") - 0.5)
    px = px.withColumn("_gy", F.floor("_fy").cast("int")).withColumn("_gx", F.floor("_fx").cast("int")).withColumn("v", F.col("v").cast("int"))
    y, x = F.col("_fy") - F.col("_gy"), F.col("_fx") - F.col("_gx")
    mixed = (F.col("_l00") * (1 - x) + F.col("_l01") * x) * (1 - y) + (F.col("_l10") * (1 - x) + F.col("_l11") * x) * y
    return px.join(four, ["map_id", "_gy", "_gx", "v"]).select(*values.columns, F.bround(F.round(mixed, 6)).cast("int").alias("level"))


def byte_hsv(red: Column, green: Column, blue: Column) -> tuple[Column, Column, Column]:
    """Hue 0..179, saturation and value 0..255, in whole numbers."""
    top, low = F.greatest(red, green, blue), F.least(red, green, blue)
    span = top - low
    per = F.greatest(span, F.lit(1))
    sixth = F.when(top == red, (green - blue) / per).when(top == green, 2 + (blue - red) / per).otherwise(4 + (red - green) / per)
    hue = F.floor(F.round(30 * sixth, 6) + 0.5)
    return F.when(hue < 0, hue + 180).otherwise(hue).cast("int") % 180, F.floor(F.round(255 * span / F.greatest(top, F.lit(1)), 6) + 0.5).cast("int"), top.cast("int")


def byte_rgb(hue: Column, saturation: Column, value: Column) -> tuple[Column, Column, Column]:
    """Colours 0..255 of hue 0..179, saturation and value 0..255."""
    sixth, s = hue / 30, saturation / 255
    part = lambda n: F.pmod(F.lit(n) + sixth, F.lit(6.0))
    # each colour falls from the value by the saturation where its hue is far: 5, 3 and 1 sixths off
    channel = lambda n: F.bround(F.round(value - value * s * F.greatest(F.lit(0.0), F.least(part(n), 4 - part(n), F.lit(1.0))), 6)).cast("int")
    return channel(5.0), channel(3.0), channel(1.0)


#: Fixed values of the mask: least saturation and value; hues of magenta (from here up), of red (up to here) and of faded strokes; how much lower they are for thin strokes.
SATURATION, VALUE, MAGENTA, RED, FADED, FADED_SATURATION = 40, 40, 135, 15, (140, 175), 20
THIN_MAGENTA, THIN_SATURATION, LEAST_SATURATION = 130, 10, 15


def course_colour(hue: Column, saturation: Column, value: Column, thin: bool = False, least_saturation: int = SATURATION, least_value: int = VALUE) -> Column:
    """Whether a pixel has the colour of a course: magenta, red or faded."""
    magenta = (hue >= (THIN_MAGENTA if thin else MAGENTA)) & (saturation >= max(LEAST_SATURATION, least_saturation - (THIN_SATURATION if thin else 0)))
    red = (hue <= RED) & (saturation >= least_saturation)
    faded = hue.between(*FADED) & (saturation >= max(FADED_SATURATION, least_saturation // 2))
    return (magenta | red | faded) & (value >= least_value)


def course_mask(image: DataFrame, images: DataFrame, thin: bool = False, equalise: bool = True, least_saturation: int = SATURATION, least_value: int = VALUE) -> DataFrame:
    """``image``: map_id, r, c, red, green, blue (bytes). The pixels of a course: by hue, saturation and value, the latter equalised first; then opened and closed. ``thin`` keeps thin strokes: lower limits, the rule for magenta
    in plain colours besides, no opening, and gaps of two closed."""
    # a generator of one row keeps the optimizer from writing each of these steps out inside the next one
    step = lambda df, names, values: df.select(*KEY, *colours, F.inline(F.array(F.struct(*[c.alias(n) for c, n in zip(values, names, strict=True)]))))
    colours = [F.col(n) for n in ("red", "green", "blue")]
    seen, mixed = ("_hue", "_sat", "v"), ("_red", "_green", "_blue")
    px = step(image, seen, byte_hsv(*colours))
    if equalise:
        made = step(equalised(px, images), mixed, byte_rgb(F.col("_hue"), F.col("_sat"), F.col("level")))
        px = step(made, seen, byte_hsv(*[F.col(n) for n in mixed]))
    found = course_colour(F.col("_hue"), F.col("_sat"), F.col("v"), thin, least_saturation, least_value)
    mask = px.where(found | pink(*colours) if thin else found).select(*KEY)
    return closed(mask, images, times=2) if thin else closed(opened(mask, images), images)


def united(mask: DataFrame, *others: DataFrame) -> DataFrame:
    """The pixels of any of the masks, each once."""
    for o in others:
        mask = mask.union(o.select(*KEY))
    return mask.distinct()
