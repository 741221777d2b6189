"""Scalar rules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims


def speed_from_cost(cost: Column, base: float) -> Column:
    return F.when(cost >= 1e7, F.lit(0.0)).otherwise(F.lit(base) / F.greatest(cost, F.lit(1e-6)))


def scaled_speeds(classes: DataFrame, open_land: float) -> DataFrame:
    """All speeds by the factor that brings open land to ``open_land``; what can't be crossed stays so."""
    if open_land <= 0:
        raise ValueError("the speed on open land must be positive")
    factor = open_land / dims.SPEEDS[dims.OPEN_LAND]
    return classes.withColumn("speed", F.when(F.col("speed") <= 0, F.lit(0.0)).otherwise(F.col("speed") * factor))


def resolution(explicit: Column, scale: Column, dpi: Column) -> Column:
    """Metres a pixel: given, else from the map's scale and dots an inch (300 if unknown), else 1."""
    return F.coalesce(explicit, scale * dims.INCH_M / F.coalesce(dpi, F.lit(dims.DPI)), F.lit(1.0))


def cell_of(pixel: Column, size: int, cells: int) -> Column:
    """Cut to a whole number first, then to cells, then into the grid."""
    whole = F.when(pixel < 0, F.ceil(pixel)).otherwise(F.floor(pixel))
    return F.least(F.greatest(F.floor(whole / size), F.lit(0)), F.lit(cells - 1)).cast("int")


def pixel_of(cell: Column, size: int) -> Column:
    return (cell + 0.5) * size


def points(number: Column) -> Column:
    """The first decimal digit."""
    return F.substring(F.abs(number).cast("string"), 1, 1).cast("int")


def parse_number(text: Column, low: int = 0, high: int = 999) -> Column:
    """One to three digits, after trimming; null else."""
    n = F.when(F.trim(text).rlike(r"^\d{1,3}$"), F.trim(text).cast("int"))
    return F.when(n.between(low, high), n)


def distance_text(metres: Column) -> Column:
    """Whole metres, or kilometres with two decimals from 1,000 on; halves go to the even neighbour."""
    whole = F.rint(metres).cast("long").cast("string")
    cents = F.rint(metres / 1000 * 100).cast("long")
    km = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.when(metres >= 1000, F.concat(km, F.lit(" km"))).otherwise(F.concat(whole, F.lit(" m")))


def learning_rate(step: Column, total: int, warm: int, base: float, power: float | None) -> Column:
    """Linear warm-up, then polynomial decay, or cosine if ``power`` is None."""
    part = F.least((step - warm) / max(1, total - warm), F.lit(1.0))
    fall = F.pow(1 - part, F.lit(power)) if power is not None else (1 + F.cos(part * 3.141592653589793)) / 2
    return F.when(step < warm, base * (step + 1) / max(1, warm)).otherwise(base * fall)
