"""Label rasters as tables of pixels (map_id, r, c, class_id), and what is computed from them pixel by pixel or block by block.

Every operator is keyed by map_id and partitions by pixel or block, so a map of any size spreads over the cluster. Neighbourhoods
are equi-joins on shifted coordinates, never range joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims

KEY = ["map_id", "r", "c"]


def dim(df: DataFrame) -> DataFrame:
    return F.broadcast(dims.dim_class(df.sparkSession))


def channels_to_index(channels: DataFrame, domain: DataFrame) -> DataFrame:
    """The topmost channel with a value above 0 of each pixel of ``domain``; background (0) never paints."""
    top = channels.where((F.col("value") > 0) & (F.col("channel") != 0)).join(dim(channels), F.col("channel") == F.col("class_id")).groupBy(*KEY).agg(F.min_by("channel", "priority").alias("top"))
    return domain.select(*KEY).join(top, KEY, "left").select(*KEY, F.coalesce("top", F.lit(0)).cast("int").alias("class_id"))


def colorize(label: DataFrame) -> DataFrame:
    """Colours; a class without one is black."""
    d = dim(label).select("class_id", "red", "green", "blue")
    return label.join(d, "class_id", "left").select(*KEY, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("red", "green", "blue")])


def overlay_blend(image: DataFrame, label: DataFrame, alpha: float) -> DataFrame:
    """``image`` (map_id, r, c, red, green, blue) with the class's colour over it where the class isn't background."""
    names = ("red", "green", "blue")
    tint = colorize(label.where(F.col("class_id") > 0)).select(*KEY, *[F.col(n).alias(f"t_{n}") for n in names])
    mixed = [F.when(F.col(f"t_{n}").isNull(), F.col(n)).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col(n) * (1 - alpha) + F.col(f"t_{n}") * alpha)))).cast("int").alias(n) for n in names]
    return image.join(tint, KEY, "left").select(*KEY, *mixed)


def cost_export(label: DataFrame) -> DataFrame:
    return label.join(dim(label).select("class_id", "cost"), "class_id", "left").select(*KEY, F.coalesce("cost", F.lit(dims.UNKNOWN_COST)).alias("cost"))


def cost_image(costs: DataFrame) -> DataFrame:
    """Costs as grey levels: 255 for walls, else in proportion to the largest passable cost of the map (1 at least)."""
    top = costs.where(F.col("cost") < dims.WALL_TIME).groupBy("map_id").agg(F.greatest(F.max("cost"), F.lit(1.0)).alias("top"))
    grey = F.when(F.col("cost") >= dims.WALL_TIME, 255).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("cost") / F.coalesce("top", F.lit(1.0)) * 255)))).cast("int")
    return costs.join(top, "map_id", "left").select(*KEY, grey.alias("grey"))


def _shifted(df: DataFrame, offsets: list[tuple[int, int]], *keep: str) -> DataFrame:
    """Each row at each offset from its place."""
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets]))
    return df.select("*", moves.alias("_m")).select("map_id", (F.col("r") + F.col("_m.dr")).alias("r"), (F.col("c") + F.col("_m.dc")).alias("c"), *keep)


PLUS = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]


def close_linear(label: DataFrame) -> DataFrame:
    """Morphological closing (plus-shaped) of each linear class of the input; a closed pixel is filled only where the
    input is background, by the first linear class in order. Outside the image is neutral."""
    order = F.array_position(F.array(*[F.lit(x) for x in dims.LINEAR]), F.col("class_id"))
    domain = label.select(*KEY)
    lines = label.where(F.col("class_id").isin(*dims.LINEAR)).select(*KEY, "class_id")
    grown = _shifted(lines, PLUS, "class_id").distinct().join(domain, KEY, "left_semi")
    support = _shifted(grown, PLUS, "class_id").groupBy(*KEY, "class_id").agg(F.count("*").alias("n"))
    room = _shifted(domain, PLUS).groupBy(*KEY).agg(F.count("*").alias("room"))
    closed = support.join(room, KEY).where(F.col("n") == F.col("room")).groupBy(*KEY).agg(F.min_by("class_id", order).alias("fill"))
    return label.join(closed, KEY, "left").select(*KEY, F.when((F.col("class_id") == 0) & F.col("fill").isNotNull(), F.col("fill")).otherwise(F.col("class_id")).alias("class_id"))


def _beside(pixels: DataFrame, line: str, along: str) -> DataFrame:
    """``pixels`` (map_id, r, c, class_id; null where nothing is known) with before and after: place (``along``) and class of the nearest pixels of a class that
    isn't an overlay, at or before and at or after each one, in its own ``line``."""
    own = Window.partitionBy("map_id", line)
    upto = lambda order: own.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)  # noqa: E731 a frame that grows; one that shrinks is summed up anew for every row
    real = F.when(~F.col("class_id").isin(*dims.OVERLAY), F.struct(F.col(along).alias("at"), "class_id"))
    return pixels.withColumn("before", F.last(real, True).over(upto(F.asc(along)))).withColumn("after", F.last(real, True).over(upto(F.desc(along))))


def resolve_overlays(label: DataFrame) -> DataFrame:
    """Overlay classes take the class of the nearest other pixel; ties go to the smaller row, then column; a map without one is open land.

    Windows along rows and columns give each overlay pixel the nearest pixel of its own row and column, so a bound on the distance. Only rows within that
    bound can hold a nearer one: it is looked for in each by one more window along rows, over the pixels and the places asked for. So work grows with
    the distance, not with its square, and no distance is too large. A pixel whose row and column hold overlays only asks all rows of its map."""
    real = label.where(~F.col("class_id").isin(*dims.OVERLAY))
    gap = lambda side, at: F.abs(F.col(f"{side}.at") - F.col(at))
    wide = _beside(label.select(*KEY, "class_id"), "r", "c").withColumn("_x", F.least(gap("before", "c"), gap("after", "c"))).drop("before", "after")
    both = _beside(wide, "c", "r").withColumn("_y", F.least(gap("before", "r"), gap("after", "r"))).where(F.col("class_id").isin(*dims.OVERLAY))
    todo = both.select(*KEY, F.least("_x", "_y").alias("_bound"))
    extent = real.groupBy("map_id").agg(F.min("r").alias("_low"), F.max("r").alias("_high"))
    todo = todo.join(extent, "map_id", "left")
    first = F.when(F.col("_bound").isNull(), F.col("_low")).otherwise(F.greatest(F.col("r") - F.col("_bound"), F.col("_low")))
    last = F.when(F.col("_bound").isNull(), F.col("_high")).otherwise(F.least(F.col("r") + F.col("_bound"), F.col("_high")))
    asked = todo.where(F.col("_low").isNotNull() & (first <= last)).select("map_id", F.col("r").alias("_r"), "c", F.explode(F.sequence(first, last)).alias("r"))
    mixed = real.select(*KEY, "class_id", F.lit(None).cast("int").alias("_r")).unionByName(asked.select(*KEY, F.lit(dims.OVERLAY[0]).alias("class_id"), "_r"))
    near = _beside(mixed, "r", "c").where(F.col("_r").isNotNull())
    found = near.select("map_id", F.col("_r").alias("r"), "c", F.col("r").alias("_row"), F.explode(F.array("before", "after")).alias("_n")).where(F.col("_n").isNotNull())
    d2 = (F.col("r") - F.col("_row")) * (F.col("r") - F.col("_row")) + (F.col("c") - F.col("_n.at")) * (F.col("c") - F.col("_n.at"))
    best = found.groupBy(*KEY).agg(F.min_by("_n.class_id", F.struct(d2, F.col("_row"), F.col("_n.at"))).alias("class_id"))
    lost = label.where(F.col("class_id").isin(*dims.OVERLAY)).select(*KEY).join(best, KEY, "left")
    return real.select(*KEY, "class_id").unionByName(lost.select(*KEY, F.coalesce("class_id", F.lit(dims.OPEN_LAND)).alias("class_id")))


def _cells(label: DataFrame, size: int) -> DataFrame:
    """Pixels with their cell (cr, cc); what doesn't fill a whole cell at the right and lower edge is left out."""
    edge = label.groupBy("map_id").agg((F.floor((F.max("r") + 1) / size)).cast("int").alias("_h"), (F.floor((F.max("c") + 1) / size)).cast("int").alias("_w"))
    cells = label.select("*", F.floor(F.col("r") / size).cast("int").alias("cr"), F.floor(F.col("c") / size).cast("int").alias("cc"))
    return cells.join(edge, "map_id").where((F.col("cr") < F.col("_h")) & (F.col("cc") < F.col("_w"))).drop("_h", "_w")


def downsample(label: DataFrame, size: int) -> DataFrame:
    """A class for each cell: a fast linear class if there is one, in order; else the most frequent passable class, the
    smaller of equals; a cell of walls only takes its first pixel's class."""
    fast = F.array_position(F.array(*[F.lit(x) for x in dims.FAST]), F.col("class_id"))
    counts = _cells(label, size).groupBy("map_id", "cr", "cc", "class_id").agg(F.count("*").alias("n"), F.min(F.struct("r", "c")).alias("at"))
    wall = F.col("class_id").isin(*dims.IMPASSABLE)
    best = F.struct(
        F.when(fast > 0, 0).when(~wall, 1).otherwise(2),
        F.when(fast > 0, fast).otherwise(F.lit(0)),
        F.when(wall, F.lit(0)).otherwise(-F.col("n")),
        F.when(wall, F.col("at.r")).otherwise(F.lit(0)),
        F.when(wall, F.col("at.c")).otherwise(F.lit(0)),
        F.col("class_id"),
    )
    return counts.groupBy("map_id", "cr", "cc").agg(F.min_by("class_id", best).alias("class_id"))


def contour_density(label: DataFrame, size: int) -> DataFrame:
    return _cells(label, size).groupBy("map_id", "cr", "cc").agg(F.avg((F.col("class_id") == dims.CONTOURS).cast("double")).alias("density"))


def cost_grid(label: DataFrame, size: int = dims.CELL_SIZE, m_per_px: float = 1.0, penalty: float = dims.CONTOUR_PENALTY) -> DataFrame:
    """map_id, cr, cc, class_id, density, time_s (null: wall), passable."""
    cells = downsample(resolve_overlays(label), size)
    d = dim(label).select("class_id", "speed")
    speed = F.coalesce("speed", F.lit(dims.UNKNOWN_SPEED))
    time = F.when(speed > 0, size * m_per_px / speed)
    out = cells.join(d, "class_id", "left")
    if penalty > 0:
        out = out.join(contour_density(label, size), ["map_id", "cr", "cc"])
        time = time * (1 + penalty * F.col("density"))
    else:
        out = out.withColumn("density", F.lit(None).cast("double"))
    return out.select("map_id", "cr", "cc", "class_id", "density", time.alias("time_s")).withColumn("passable", F.col("time_s").isNotNull() & (F.col("time_s") < dims.WALL_TIME))


def speed_field(label: DataFrame) -> DataFrame:
    """Speed of each pixel, overlays resolved, an unknown class 0, over the map's largest positive speed (else 1), within 0 and 1."""
    speeds = resolve_overlays(label).join(dim(label).select("class_id", "speed"), "class_id", "left").select(*KEY, F.coalesce("speed", F.lit(0.0)).alias("speed"))
    top = speeds.groupBy("map_id").agg(F.coalesce(F.max(F.when(F.col("speed") > 0, F.col("speed"))), F.lit(1.0)).alias("top"))
    return speeds.join(top, "map_id").select(*KEY, "speed", F.least(F.greatest(F.col("speed") / F.col("top"), F.lit(0.0)), F.lit(1.0)).alias("level"))


def class_share(label: DataFrame) -> DataFrame:
    """Pixels and share of each class in its map."""
    counts = label.groupBy("map_id", "class_id").agg(F.count("*").alias("n"))
    return counts.join(dim(label).select("class_id", "name", "speed"), "class_id", "left").select("map_id", "class_id", F.coalesce("name", F.concat(F.lit("class_"), F.col("class_id").cast("string"))).alias("name"), F.coalesce("speed", F.lit(0.0)).alias("speed"), "n", (F.col("n") * 100 / F.sum("n").over(Window.partitionBy("map_id"))).alias("share"))


def pink(red: Column, green: Column, blue: Column) -> Column:
    """The colour rule for thin magenta strokes."""
    low = F.least(red, blue)
    return (red > 90) & (blue > 70) & (green < 0.85 * low) & ((red + blue) / 2 - green > 25)


def hsv(red: Column, green: Column, blue: Column) -> tuple[Column, Column, Column]:
    """Hue 0..180, saturation and value 0..255, not rounded."""
    top, low = F.greatest(red, green, blue), F.least(red, green, blue)
    span = F.when(top > low, top - low)
    hue = F.when(top == red, 60 * (green - blue) / span).when(top == green, 120 + 60 * (blue - red) / span).otherwise(240 + 60 * (red - green) / span)
    hue = F.coalesce(F.when(hue < 0, hue + 360).otherwise(hue), F.lit(0.0)) / 2
    return hue, F.when(top > 0, 255 * (top - low) / top).otherwise(F.lit(0.0)), top.cast("double")
