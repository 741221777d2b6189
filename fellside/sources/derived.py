"""Rasters, predictions, detections and problems derived from the star-schema tables by whole-number arithmetic, for
the queries: the same rows come out of the SQL beside each function."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CLASSES = (1, 2, 3, 4, 5, 7, 1, 2, 10, 6, 12, 4, 0)
WIDTH, MAP_PIXELS = 100, 1_000_000


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label(spark, sf_dir: str) -> DataFrame:
    """map_id, r, c, class_id: a label raster, one pixel for each order."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    base = table(spark, sf_dir, "orders").select(
        F.floor(key / MAP_PIXELS).cast("int").alias("map_id"), F.floor(key % MAP_PIXELS / WIDTH).cast("int").alias("r"), (key % WIDTH).cast("int").alias("c"), cust.alias("k")
    )
    block = (F.floor(F.col("r") / 8) * 7 + F.floor(F.col("c") / 8) * 5) % 13
    value = (
        F.when(F.col("k") % 16 == 0, 11)
        .when(F.col("k") % 97 == 3, 15)
        .when(F.col("r") % 23 == 11, 8)
        .when(F.col("c") % 29 == 7, 13)
        .when((F.col("r") + F.col("c")) % 41 == 0, 9)
        .otherwise(F.element_at(F.array(*[F.lit(x) for x in BLOCK_CLASSES]), (block + 1).cast("int")))
    )
    return base.select("map_id", "r", "c", value.cast("int").alias("class_id"))


LABEL = f"""label AS (SELECT map_id, r, c, CAST(CASE WHEN k % 16 = 0 THEN 11 WHEN k % 97 = 3 THEN 15 WHEN r % 23 = 11 THEN 8 WHEN c % 29 = 7 THEN 13
  WHEN (r + c) % 41 = 0 THEN 9 ELSE {list(BLOCK_CLASSES)}[CAST((floor(r / 8) * 7 + floor(c / 8) * 5) % 13 + 1 AS INT)] END AS INT) AS class_id
  FROM (SELECT CAST(floor(o_orderkey / {MAP_PIXELS}) AS INT) AS map_id, CAST(floor(o_orderkey % {MAP_PIXELS} / {WIDTH}) AS INT) AS r, CAST(o_orderkey % {WIDTH} AS INT) AS c, o_custkey AS k FROM orders))"""


def channels(spark, sf_dir: str) -> DataFrame:
    """map_id, r, c, channel, value: overlapping channels, one for each line item."""
    key = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        F.floor(key / MAP_PIXELS).cast("int").alias("map_id"), F.floor(key % MAP_PIXELS / WIDTH).cast("int").alias("r"), (key % WIDTH).cast("int").alias("c"), (F.col("l_partkey") % 16).cast("int").alias("channel"), (F.col("l_suppkey") % 3).cast("int").alias("value")
    )


CHANNELS = f"""channels AS (SELECT CAST(floor(l_orderkey / {MAP_PIXELS}) AS INT) AS map_id, CAST(floor(l_orderkey % {MAP_PIXELS} / {WIDTH}) AS INT) AS r, CAST(l_orderkey % {WIDTH} AS INT) AS c,
  CAST(l_partkey % 16 AS INT) AS channel, CAST(l_suppkey % 3 AS INT) AS value FROM lineitem)"""


def predictions(spark, sf_dir: str) -> DataFrame:
    """map_id (string), gt, pred, p (probability of gt): one pixel for each line item."""
    gt = (F.col("l_partkey") % 16).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("map_id"), F.col("l_orderkey").alias("pixel"), F.col("l_linenumber").alias("line"), gt.alias("gt"), F.when(F.col("l_linenumber") % 3 == 0, (F.col("l_suppkey") % 16).cast("int")).otherwise(gt).alias("pred"), ((F.col("l_quantity") + 1) / 60).alias("p")
    )


PREDICTIONS = """pred AS (SELECT l_returnflag AS map_id, l_orderkey AS pixel, l_linenumber AS line, CAST(l_partkey % 16 AS INT) AS gt,
  CAST(CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey % 16 ELSE l_partkey % 16 END AS INT) AS pred, (l_quantity + 1) / 60 AS p FROM lineitem)"""


def detections(spark, sf_dir: str) -> DataFrame:
    """course, seq, number, x, y, score: one detection for each event."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("course"), e.alias("seq"), (10 + e % 190).cast("int").alias("number"), (e * 37 % 1000).cast("double").alias("x"), (e * 91 % 700).cast("double").alias("y"), (e * 17 % 100 / 100).alias("score"))


DETECTIONS = """det AS (SELECT user_id % 50 AS course, event_id AS seq, CAST(10 + event_id % 190 AS INT) AS number, CAST(event_id * 37 % 1000 AS DOUBLE) AS x, CAST(event_id * 91 % 700 AS DOUBLE) AS y, (event_id * 17 % 100) / 100 AS score FROM events)"""


COURSE = 7
#: Courses of ten rows each that a map has room for.
COURSES_A_MAP = MAP_PIXELS // WIDTH // 10 - 1


def controls(spark, sf_dir: str) -> DataFrame:
    """course, map_id, i (1..7 in a course), point (no two alike), number, x, y: control points in pixels, one for each supplier, a course for every seven."""
    k, course = F.col("s_suppkey"), F.floor(F.col("s_suppkey") / COURSE)
    return table(spark, sf_dir, "supplier").select(
        course.cast("int").alias("course"), F.floor(course / COURSES_A_MAP).cast("int").alias("map_id"), (k % COURSE + 1).cast("int").alias("i"), (course * 8 + k % COURSE + 1).cast("int").alias("point"), (31 + 7 * (k % 24)).cast("int").alias("number"),
        (k * 13 % 29 * 3 + 2).cast("double").alias("x"), (course % COURSES_A_MAP * 10 + k * 5 % 7 * 2 + 1).cast("double").alias("y"))


CONTROLS = f"""controls AS (SELECT CAST(k // {COURSE} AS INT) AS course, CAST(k // {COURSE} // {COURSES_A_MAP} AS INT) AS map_id, CAST(k % {COURSE} + 1 AS INT) AS i, CAST(k // {COURSE} * 8 + k % {COURSE} + 1 AS INT) AS point, CAST(31 + 7 * (k % 24) AS INT) AS number,
  CAST(k * 13 % 29 * 3 + 2 AS DOUBLE) AS x, CAST(k // {COURSE} % {COURSES_A_MAP} * 10 + k * 5 % 7 * 2 + 1 AS DOUBLE) AS y FROM (SELECT s_suppkey AS k FROM supplier))"""

STRIDE = 12
CELL_ROWS = MAP_PIXELS // WIDTH // 4


def walks(spark, sf_dir: str) -> DataFrame:
    """route, map_id, seq (0..11), cr, cc: a walk of twelve cells for each customer, on a diagonal, along a row, or down and then along a row; forty start in each row of cells.
    Joins sort and merge it: it has twelve rows for each of a small file, so an estimate by the file's size would have it broadcast."""
    n = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(STRIDE - 1))).alias("seq"))
    k, s, kind, row = F.col("k"), F.col("seq"), F.col("k") % 3, F.floor(F.col("k") / 40)
    down, along = F.when(kind == 0, s).when(kind == 1, 0).otherwise(F.least(s, F.lit(6))), F.when(kind < 2, s).otherwise(F.greatest(s - 6, F.lit(0)))
    return n.select(k.cast("int").alias("route"), F.floor(row / CELL_ROWS).cast("int").alias("map_id"), s.cast("int").alias("seq"), (row % CELL_ROWS + down).cast("int").alias("cr"), (k % 13 + along).cast("int").alias("cc")).hint("merge")


WALKS = f"""steps AS (SELECT CAST(k AS INT) AS route, CAST(k // 40 // {CELL_ROWS} AS INT) AS map_id, CAST(seq AS INT) AS seq, CAST(k // 40 % {CELL_ROWS} + CASE k % 3 WHEN 0 THEN seq WHEN 1 THEN 0 ELSE least(seq, 6) END AS INT) AS cr,
  CAST(k % 13 + CASE WHEN k % 3 < 2 THEN seq ELSE greatest(seq - 6, 0) END AS INT) AS cc FROM (SELECT c_custkey AS k FROM customer), (SELECT unnest(range({STRIDE})) AS seq))"""


def images(spark, sf_dir: str) -> DataFrame:
    """map_id, height, width of the label maps."""
    return label(spark, sf_dir).groupBy("map_id").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))


def _marks(spark, sf_dir: str) -> DataFrame:
    """course, map_id, x, y: a place for each course, three side by side."""
    course = F.floor(F.col("s_suppkey") / COURSE)
    j = course % COURSES_A_MAP
    return table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % COURSE == 0).select(course.cast("int").alias("course"), F.floor(course / COURSES_A_MAP).cast("int").alias("map_id"), (18 + j % 3 * 32).cast("int").alias("x"), (16 + F.floor(j / 3) * 30).cast("int").alias("y"))


def _drawn(spark, sf_dir: str, classes: str, inside) -> DataFrame:
    """map_id, r, c: pixels of some classes, and a mark around the place of each course, inside the maps."""
    span = F.explode(F.sequence(F.lit(-16), F.lit(16)))
    # places meet the maps' sizes before they become a thousand pixels each
    at = _marks(spark, sf_dir).join(images(spark, sf_dir), "map_id")
    px = at.select("*", span.alias("a")).select("*", span.alias("b")).where(inside).withColumn("r", F.col("y") + F.col("a")).withColumn("c", F.col("x") + F.col("b"))
    px = px.where("r >= 0 AND c >= 0 AND r < height AND c < width").select("map_id", "r", "c")
    return label(spark, sf_dir).where(classes).select("map_id", "r", "c").union(px).distinct()


def ring_mask(spark, sf_dir: str) -> DataFrame:
    """Rings of radius 11 to 14 with a rim of three pixels, crossed by lines, among specks."""
    radius, d2 = 11 + F.col("course") % 4, F.col("a") * F.col("a") + F.col("b") * F.col("b")
    return _drawn(spark, sf_dir, "class_id IN (13, 15)", d2.between((radius - 1) * (radius - 1), (radius + 1) * (radius + 1)))


def start_mask(spark, sf_dir: str) -> DataFrame:
    """Triangles that stand on a side of 20 to 26 pixels, among specks."""
    half = 10 + F.col("course") % 4
    return _drawn(spark, sf_dir, "class_id = 15", (F.col("a") <= half) & (F.col("a") >= -10) & (26 * F.abs("b") <= 15 * (F.col("a") + 10)))


MARKS = f"""im AS (SELECT map_id, max(r) + 1 AS height, max(c) + 1 AS width FROM label GROUP BY map_id), mp AS (SELECT course, map_id, CAST(18 + j % 3 * 32 AS INT) AS x, CAST(16 + j // 3 * 30 AS INT) AS y FROM (SELECT CAST(s_suppkey // {COURSE} AS INT) AS course, CAST(s_suppkey // {COURSE} // {COURSES_A_MAP} AS INT) AS map_id, s_suppkey // {COURSE} % {COURSES_A_MAP} AS j FROM supplier WHERE s_suppkey % {COURSE} = 0)),
sp AS (SELECT CAST(unnest(range(-16, 17)) AS INT) AS a), sq AS (SELECT p.a AS a, q.a AS b FROM sp p, sp q)"""
RING_MASK = f"""{MARKS}, mk AS (SELECT map_id, r, c FROM label WHERE class_id IN (13, 15) UNION SELECT map_id, r, c FROM (SELECT map_id, y + a AS r, x + b AS c FROM mp, sq WHERE a * a + b * b BETWEEN (10 + course % 4) * (10 + course % 4) AND (12 + course % 4) * (12 + course % 4)) JOIN im USING (map_id) WHERE r >= 0 AND c >= 0 AND r < height AND c < width)"""


def given_rings(spark, sf_dir: str) -> DataFrame:
    """map_id, ring, x, y, radius: the drawn rings of ``ring_mask``, some pixels off their centres."""
    k = F.col("course")
    return _marks(spark, sf_dir).select("map_id", k.alias("ring"), (F.col("x") + k % 5 - 2 + k % 2 / 2).alias("x"), (F.col("y") + k % 7 - 3).cast("double").alias("y"), (11 + k % 4).cast("double").alias("radius"))


GIVEN_RINGS = "gv AS (SELECT map_id, course AS ring, CAST(x + course % 5 - 2 + (course % 2) / 2 AS DOUBLE) AS x, CAST(y + course % 7 - 3 AS DOUBLE) AS y, CAST(11 + course % 4 AS DOUBLE) AS radius FROM mp)"
