"""Queries over augmented images, with fixed parameters so that SQL gives the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import augment as A
from ..sources import derived as D
from .mask_queries import IM, hsv_sql
from .raster_queries import IMAGE, image
from .registry import query

NAMES = ("red", "green", "blue")


def moves(spark, sf_dir):
    """A move for each map: up to twelve degrees, some per cent larger or smaller, a few to the side."""
    k = F.col("map_id")
    return D.images(spark, sf_dir).select("map_id", (k % 3 * 0.02 + 0.03).alias("tx"), (k % 2 * 0.03 - 0.02).alias("ty"), (1.05 - k % 4 * 0.05).alias("scale"), (k % 5 * 6 - 12).cast("double").alias("angle"))


MOVED = f"""{IM}, mo AS (SELECT *, map_id % 3 * CAST(0.02 AS DOUBLE) + CAST(0.03 AS DOUBLE) AS tx, map_id % 2 * CAST(0.03 AS DOUBLE) - CAST(0.02 AS DOUBLE) AS ty, CAST(1.05 AS DOUBLE) - map_id % 4 * CAST(0.05 AS DOUBLE) AS sc, radians(map_id % 5 * 6 - 12) AS an FROM im),
og AS (SELECT map_id, r, c, c - (width - 1) / 2 - tx * width AS u, r - (height - 1) / 2 - ty * height AS v, sc, an, (width - 1) / 2 AS cx, (height - 1) / 2 AS cy FROM (SELECT *, unnest(range(height)) AS r FROM mo), LATERAL (SELECT unnest(range(width)) AS c)),
so AS MATERIALIZED (SELECT map_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, round((v * cos(an) - u * sin(an)) / sc + cy, 6) AS sy, round((u * cos(an) + v * sin(an)) / sc + cx, 6) AS sx FROM og)"""


@query("affine_image", f"""WITH {D.LABEL}, {IMAGE}, {MOVED}, nb AS (SELECT so.map_id, so.r AS o_r, so.c AS o_c, CAST(floor(sy) AS BIGINT) + a AS r, CAST(floor(sx) AS BIGINT) + b AS c, CASE a WHEN 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END * CASE b WHEN 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END AS w FROM so, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(a, b))
SELECT map_id, o_r AS r, o_c AS c, {', '.join(f"CAST(floor(round(sum(w * coalesce({n}, 255)), 6) + 0.5) AS INT) AS {n}" for n in NAMES)} FROM nb LEFT JOIN image USING (map_id, r, c) GROUP BY ALL""")
def affine_image(spark, sf_dir):
    return A.affine(image(spark, sf_dir), D.images(spark, sf_dir), moves(spark, sf_dir))


@query("affine_label", f"WITH {D.LABEL}, {MOVED} SELECT so.map_id, so.r, so.c, coalesce(class_id, 0) AS class_id FROM so LEFT JOIN label l ON l.map_id = so.map_id AND l.r = CAST(floor(sy + 0.5) AS BIGINT) AND l.c = CAST(floor(sx + 0.5) AS BIGINT)")
def affine_label(spark, sf_dir):
    return A.affine_label(D.label(spark, sf_dir), D.images(spark, sf_dir), moves(spark, sf_dir))


def along_sql(src: str, out: str, line: str, other: str, size: str) -> str:
    """``out``: five weights along a side of ``src``, places beyond it mirrored."""
    taps = ", ".join(f"({k - 2}, {w!r}::DOUBLE)" for k, w in enumerate(A.bell(5)))
    return f"""{out}_p AS (SELECT map_id, p, w, CASE WHEN m < {size} THEN m ELSE g - m END AS {line} FROM (SELECT map_id, {size}, p, w, greatest(2 * ({size} - 1), 1) AS g, ((p + d) % greatest(2 * ({size} - 1), 1) + greatest(2 * ({size} - 1), 1)) % greatest(2 * ({size} - 1), 1) AS m FROM (SELECT map_id, {size}, unnest(range({size})) AS p FROM im), (VALUES {taps}) t(d, w))),
{out} AS MATERIALIZED (SELECT map_id, p AS {line}, {other}, {', '.join(f'sum(w * {n}) / sum(w) AS {n}' for n in NAMES)} FROM {out}_p JOIN {src} USING (map_id, {line}) GROUP BY ALL)"""


@query("gaussian_blur", f"WITH {D.LABEL}, {IMAGE}, {IM}, {along_sql('image', 'b1', 'c', 'r', 'width')}, {along_sql('b1', 'b2', 'r', 'c', 'height')} SELECT map_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, {', '.join(f'CAST(floor(round(b2.{n}, 6) + 0.5) AS INT) AS {n}' for n in NAMES)} FROM b2 SEMI JOIN image USING (map_id, r, c)")
def gaussian_blur(spark, sf_dir):
    return A.blurred(image(spark, sf_dir), D.images(spark, sf_dir), A.bell(5))


@query("colour_shift", f"""WITH {D.LABEL}, {IMAGE}, li AS (SELECT map_id, r, c, {', '.join(f'CAST(greatest(0, least(255, floor(round({n} * CAST(1.1 AS DOUBLE) - 255 * CAST(0.05 AS DOUBLE), 6)))) AS INT) AS {n}' for n in NAMES)} FROM image), {hsv_sql("li", "hv")},
sh AS (SELECT map_id, r, c, CAST((h + 5) % 180 AS INT) AS h, greatest(0, least(255, s - 10)) / 255 AS s, least(255, v + 10) AS w FROM hv), pq AS (SELECT map_id, r, c, h // 30 AS k, CAST(w AS INT) AS w, CAST(round_even(round(w * (1 - s), 6), 0) AS INT) AS p, CAST(round_even(round(w * (1 - s * (h % 30 / 30)), 6), 0) AS INT) AS q, CAST(round_even(round(w * (1 - s * (1 - h % 30 / 30)), 6), 0) AS INT) AS t FROM sh)
SELECT map_id, r, c, [w, q, p, p, t, w][k + 1] AS red, [t, w, w, q, p, p][k + 1] AS green, [p, p, t, w, w, q][k + 1] AS blue FROM pq""")
def colour_shift(spark, sf_dir):
    """A tenth more contrast, a little darker, then another hue, paler and brighter."""
    return A.tinted(A.lit(image(spark, sf_dir), 0.1, -0.05), 5, -10, 10)
