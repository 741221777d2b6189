"""Land classes and the engine's default numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Id, name, speed (m/s), export cost, drawing priority (0 on top).
CLASSES = (
    (0, "background", 0.20, 5.0, 15),
    (1, "forest_run", 0.83, 1.2, 14),
    (2, "open_land", 1.00, 1.0, 13),
    (3, "semi_open", 0.77, 1.3, 12),
    (4, "green_slow", 0.40, 2.5, 9),
    (5, "green_hard", 0.125, 8.0, 8),
    (6, "water", 0.0, 1e9, 2),
    (7, "marsh", 0.17, 6.0, 10),
    (8, "road", 1.67, 0.6, 3),
    (9, "track_path", 1.43, 0.7, 4),
    (10, "paved_settlement", 1.25, 0.8, 11),
    (11, "contours", 0.91, 1.1, 7),
    (12, "impassable", 0.0, 1e9, 1),
    (13, "footpath", 1.33, 0.75, 5),
    (14, "cycle_path", 1.43, 0.7, 6),
    (15, "control_point", 1.00, 1.0, 0),
)
EMPTY = (1, 7, 14)
CRITICAL = (2, 4, 5, 6, 8, 9, 11, 12, 13, 15)
LINEAR = (8, 9, 11, 12, 13, 14)
OVERLAY = (11, 15)
FAST = (8, 9, 13, 14)  # in this order they win a block
IMPASSABLE = (6, 12)
OPEN_LAND, CONTOURS = 2, 11
UNKNOWN_SPEED, UNKNOWN_COST = 0.2, 5.0
WALL_TIME = 1e8
DIAGONAL = 1.41421356237
CELL_SIZE, CONTOUR_PENALTY = 4, 2.0
ROUTES, PENALTY_FACTOR, PENALTY_WIDTH, SIMILARITY, MIN_SEGMENT_M = 3, 3.0, 2, 0.55, 8.0
EXACT_LIMIT, BUDGET_SLACK = 18, 1e-6
INCH_M, DPI = 0.0254, 300

NAMES = {i: n for i, n, *_ in CLASSES}
SPEEDS = {i: s for i, _, s, *_ in CLASSES}
COSTS = {i: c for i, _, _, c, _ in CLASSES}


def palette(class_id: int) -> tuple[int, int, int]:
    """A class's colour. Ours, by a rule: any distinct colours serve."""
    return (class_id * 53 % 256, class_id * 97 % 256, class_id * 193 % 256)


def dim_class(spark: SparkSession) -> DataFrame:
    """One row for each class; sixteen rows, so it may be broadcast."""
    rows = [
        (i, n, s, c, p, i in EMPTY, i in CRITICAL, i in LINEAR, i in OVERLAY, FAST.index(i) if i in FAST else None, i in IMPASSABLE, *palette(i))
        for i, n, s, c, p in CLASSES
    ]
    kinds = "class_id int, name string, speed double, cost double, priority int, is_empty boolean, is_critical boolean, is_linear boolean, is_overlay boolean, fast_rank int, is_impassable boolean, red int, green int, blue int"
    return spark.createDataFrame(rows, kinds)


def values_sql() -> str:
    """The same as a VALUES list named dim, for SQL."""
    null = lambda v: "NULL" if v is None else v
    rows = ", ".join(f"({i}, '{n}', CAST({s} AS DOUBLE), CAST({c} AS DOUBLE), {p}, {i in EMPTY}, {i in CRITICAL}, {i in LINEAR}, {i in OVERLAY}, {null(FAST.index(i) if i in FAST else None)}, {i in IMPASSABLE}, {', '.join(map(str, palette(i)))})" for i, n, s, c, p in CLASSES)
    return f"dim(class_id, name, speed, cost, priority, is_empty, is_critical, is_linear, is_overlay, fast_rank, is_impassable, red, green, blue) AS (VALUES {rows})"
