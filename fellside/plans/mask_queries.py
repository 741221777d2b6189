"""Queries over masks: equalised brightness, masks of course colours, refined rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import masks as M
from ..operators.refine import refined_rings as refine
from ..sources import derived as D
from .raster_queries import IMAGE, image
from .registry import query

IM = "im AS (SELECT map_id, max(r) + 1 AS height, max(c) + 1 AS width FROM label GROUP BY map_id)"
#: Levels of eight by eight tiles of an image padded by reflection: ev (map_id, r, c, v, level) of iv (map_id, r, c, v).
EQUALISED = """pd AS (SELECT map_id, height, width, CASE WHEN height % 8 = 0 AND width % 8 = 0 THEN height ELSE height + 8 - height % 8 END AS ph, CASE WHEN height % 8 = 0 AND width % 8 = 0 THEN width ELSE width + 8 - width % 8 END AS pw FROM im),
yr AS (SELECT map_id, p, least(p % g, g - p % g) AS r FROM (SELECT map_id, unnest(range(ph)) AS p, greatest(2 * (height - 1), 1) AS g FROM pd)), xr AS (SELECT map_id, p, least(p % g, g - p % g) AS c FROM (SELECT map_id, unnest(range(pw)) AS p, greatest(2 * (width - 1), 1) AS g FROM pd)),
th AS (SELECT map_id, yr.p * 8 // ph AS ty, xr.p * 8 // pw AS tx, v, count(*) AS n, any_value((ph // 8) * (pw // 8)) AS size FROM pd JOIN yr USING (map_id) JOIN xr USING (map_id) JOIN iv USING (map_id, r, c) GROUP BY ALL),
ts AS (SELECT map_id, ty, tx, any_value(size) AS size, sum(greatest(n - greatest(floor(2.0 * size / 256), 1), 0))::BIGINT AS over FROM th GROUP BY ALL),
tb AS (SELECT ts.*, b.v, least(coalesce(n, 0), greatest(floor(2.0 * ts.size / 256), 1))::BIGINT + over // 256 + CASE WHEN over % 256 > 0 AND b.v % greatest(256 // greatest(over % 256, 1), 1) = 0 AND b.v // greatest(256 // greatest(over % 256, 1), 1) < over % 256 THEN 1 ELSE 0 END AS bin
  FROM ts CROSS JOIN (SELECT unnest(range(256)) AS v) b LEFT JOIN th ON th.map_id = ts.map_id AND th.ty = ts.ty AND th.tx = ts.tx AND th.v = b.v),
lu AS MATERIALIZED (SELECT map_id, ty, tx, v, round_even(least(CAST(sum(bin) OVER (PARTITION BY map_id, ty, tx ORDER BY v) AS DOUBLE) * 255 / size, 255), 0) AS level FROM tb),
wv AS (SELECT iv.*, CAST(r AS DOUBLE) / (ph / 8) - 0.5 AS fy, CAST(c AS DOUBLE) / (pw / 8) - 0.5 AS fx FROM iv JOIN pd USING (map_id)),
ev AS MATERIALIZED (SELECT w.map_id, w.r, w.c, w.v, CAST(round_even(round((a.level * (1 - (fx - floor(fx))) + b.level * (fx - floor(fx))) * (1 - (fy - floor(fy))) + (d.level * (1 - (fx - floor(fx))) + e.level * (fx - floor(fx))) * (fy - floor(fy)), 6), 0) AS INT) AS level FROM wv w
  JOIN lu a ON a.map_id = w.map_id AND a.v = w.v AND a.ty = greatest(floor(fy), 0) AND a.tx = greatest(floor(fx), 0) JOIN lu b ON b.map_id = w.map_id AND b.v = w.v AND b.ty = greatest(floor(fy), 0) AND b.tx = least(floor(fx) + 1, 7)
  JOIN lu d ON d.map_id = w.map_id AND d.v = w.v AND d.ty = least(floor(fy) + 1, 7) AND d.tx = greatest(floor(fx), 0) JOIN lu e ON e.map_id = w.map_id AND e.v = w.v AND e.ty = least(floor(fy) + 1, 7) AND e.tx = least(floor(fx) + 1, 7))"""


def hsv_sql(src: str, out: str) -> str:
    """``out`` (all of ``src``, h, s, v) of whole colours red, green, blue."""
    return f"""{out}_t AS (SELECT *, greatest(red, green, blue) AS v, greatest(red, green, blue) - least(red, green, blue) AS d FROM {src}),
{out} AS (SELECT * REPLACE (CASE WHEN h < 0 THEN h + 180 WHEN h = 180 THEN 0 ELSE h END AS h) FROM (SELECT *, CASE WHEN d = 0 THEN 0 WHEN v = red THEN floor(round(30 * CAST(green - blue AS DOUBLE) / d, 6) + 0.5) WHEN v = green THEN floor(round(60 + 30 * CAST(blue - red AS DOUBLE) / d, 6) + 0.5) ELSE floor(round(120 + 30 * CAST(red - green AS DOUBLE) / d, 6) + 0.5) END AS h, CASE WHEN v = 0 THEN 0 ELSE floor(round(255 * CAST(d AS DOUBLE) / v, 6) + 0.5) END AS s FROM {out}_t))"""


def moved_sql(mask: str, out: str, grow: bool) -> str:
    """``out``: ``mask`` grown, or what has no neighbour inside the image that isn't in it."""
    if grow:
        return f"{out} AS MATERIALIZED (SELECT DISTINCT map_id, r + a AS r, c + b AS c FROM {mask} JOIN im USING (map_id), mv WHERE r + a BETWEEN 0 AND height - 1 AND c + b BETWEEN 0 AND width - 1)"
    return f"{out} AS MATERIALIZED (SELECT m.map_id, m.r, m.c FROM {mask} m JOIN im USING (map_id) WHERE NOT EXISTS (SELECT 1 FROM (SELECT u.map_id, u.r - a AS r, u.c - b AS c FROM (SELECT map_id, r, c FROM (SELECT map_id, unnest(range(height)) AS r, width FROM im), LATERAL (SELECT unnest(range(width)) AS c) EXCEPT SELECT map_id, r, c FROM {mask}) u, mv) o WHERE o.map_id = m.map_id AND o.r = m.r AND o.c = m.c))"


#: The image with equalised brightness, as hue, saturation and value: hz. A sector of hues is made of value, p, q and t.
MADE = f"""{hsv_sql("image", "hv")}, iv AS (SELECT map_id, r, c, v FROM hv), {EQUALISED}, sc AS (SELECT hv.map_id, hv.r, hv.c, hv.red AS red0, hv.green AS green0, hv.blue AS blue0, level AS w, CAST(floor(h / 30.0) AS INT) AS k, h / 30.0 - floor(h / 30.0) AS f, s / 255.0 AS s FROM hv JOIN ev USING (map_id, r, c)),
pq AS (SELECT map_id, r, c, red0, green0, blue0, k, CAST(w AS INT) AS w, CAST(round_even(round(w * (1 - CAST(s AS DOUBLE)), 6), 0) AS INT) AS p, CAST(round_even(round(w * (1 - CAST(s AS DOUBLE) * f), 6), 0) AS INT) AS q, CAST(round_even(round(w * (1 - CAST(s AS DOUBLE) * (1 - f)), 6), 0) AS INT) AS t FROM sc),
rg AS (SELECT map_id, r, c, red0, green0, blue0, [w, q, p, p, t, w][k + 1] AS red, [t, w, w, q, p, p][k + 1] AS green, [p, p, t, w, w, q][k + 1] AS blue FROM pq), {hsv_sql("rg", "hz")}"""
CROSS = "mv(a, b) AS (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))"


@query("equalised_value", f"WITH {D.LABEL}, {IMAGE}, {IM}, iv AS (SELECT map_id, r, c, greatest(red, green, blue) AS v FROM image), {EQUALISED} SELECT map_id, r, c, CAST(v AS INT) AS v, level FROM ev")
def equalised_value(spark, sf_dir):
    values = image(spark, sf_dir).select("map_id", "r", "c", F.greatest("red", "green", "blue").cast("int").alias("v"))
    return M.equalised(values, D.images(spark, sf_dir))


@query("course_mask", f"""WITH {D.LABEL}, {IMAGE}, {IM}, {MADE}, {CROSS}, k0 AS MATERIALIZED (SELECT map_id, r, c FROM hz WHERE v >= 40 AND (((h >= 135 OR h <= 15) AND s >= 40) OR (h BETWEEN 140 AND 175 AND s >= 20))),
{moved_sql("k0", "k1", False)}, {moved_sql("k1", "k2", True)}, {moved_sql("k2", "k3", True)}, {moved_sql("k3", "k4", False)} SELECT map_id, r, c FROM k4""")
def course_mask(spark, sf_dir):
    """Course colours after equalising, opened and closed."""
    return M.course_mask(image(spark, sf_dir), D.images(spark, sf_dir))


@query("course_mask_thin", f"""WITH {D.LABEL}, {IMAGE}, {IM}, {MADE}, {CROSS}, k0 AS MATERIALIZED (SELECT map_id, r, c FROM hz WHERE (v >= 40 AND ((h >= 130 AND s >= 30) OR (h <= 15 AND s >= 40) OR (h BETWEEN 140 AND 175 AND s >= 20))) OR (red0 > 90 AND blue0 > 70 AND green0 < 0.85 * least(red0, blue0) AND (red0 + blue0) / 2 - green0 > 25)),
{moved_sql("k0", "k1", True)}, {moved_sql("k1", "k2", True)}, {moved_sql("k2", "k3", False)}, {moved_sql("k3", "k4", False)} SELECT map_id, r, c FROM k4""")
def course_mask_thin(spark, sf_dir):
    """The mask that keeps thin strokes: no opening, gaps of two closed."""
    return M.course_mask(image(spark, sf_dir), D.images(spark, sf_dir), thin=True)


def quality_sql(src: str, out: str) -> str:
    """``out``: rows of ``src`` (ring, n, map_id, x, y, radius) with rim and hollow there."""
    return f"""{out}_s AS MATERIALIZED (SELECT ring, n, map_id, k, CAST(round_even(y + round(greatest(radius, 1) * s * sin(k * 6.283185307179586 / 48), 6), 0) AS BIGINT) AS r, CAST(round_even(x + round(greatest(radius, 1) * s * cos(k * 6.283185307179586 / 48), 6), 0) AS BIGINT) AS c FROM {src} CROSS JOIN an),
{out}_d AS (SELECT DISTINCT ring, n, k FROM {out}_s JOIN mk USING (map_id, r, c)),
{out}_r AS (SELECT ring, n, count(*) / 48 AS rim FROM {out}_d GROUP BY ALL), {out}_p AS MATERIALIZED (SELECT q.ring, q.n, q.map_id, CAST(trunc(q.y) AS BIGINT) + i.a AS r, CAST(trunc(q.x) AS BIGINT) + j.a AS c FROM {src} q JOIN im USING (map_id), sp i, sp j WHERE (trunc(q.y) + i.a - q.y) ** 2 + (trunc(q.x) + j.a - q.x) ** 2 <= greatest(round_even(0.5 * radius, 0), 1) ** 2
  AND abs(i.a) <= greatest(round_even(0.5 * radius, 0), 1) AND abs(j.a) <= greatest(round_even(0.5 * radius, 0), 1) AND trunc(q.y) + i.a BETWEEN 0 AND height - 1 AND trunc(q.x) + j.a BETWEEN 0 AND width - 1),
{out}_f AS (SELECT p.ring, p.n, count(mk.r) / count(*) AS fill FROM {out}_p p LEFT JOIN mk ON mk.map_id = p.map_id AND mk.r = p.r AND mk.c = p.c GROUP BY ALL),
{out} AS MATERIALIZED (SELECT q.*, coalesce(rim, 0) AS rim, round(coalesce(rim, 0) - coalesce(fill, 1), 9) AS hollow FROM {src} q LEFT JOIN {out}_r USING (ring, n) LEFT JOIN {out}_f USING (ring, n))"""


def half_steps_sql(src: str) -> str:
    """Nine half-pixel steps one after another from ``src`` (ring, map_id, x, y, radius, hollow); the last one is h9."""
    parts = []
    for k in range(9):
        dy, dx = k // 3 / 2 - 0.5, k % 3 / 2 - 0.5
        parts.append(f"s{k} AS (SELECT ring, 0 AS n, map_id, x + {dx} AS x, y + {dy} AS y, radius, hollow AS h FROM {src}), {quality_sql(f's{k}', f'q{k}')}, h{k + 1} AS MATERIALIZED (SELECT ring, map_id, radius, CASE WHEN hollow > h THEN x ELSE x - ({dx}) END AS x, CASE WHEN hollow > h THEN y ELSE y - ({dy}) END AS y, greatest(hollow, h) AS hollow FROM q{k})")
        src = f"h{k + 1}"
    return ", ".join(parts)


REFINED = f"""WITH {D.LABEL}, {D.RING_MASK}, {D.GIVEN_RINGS}, an AS (SELECT k, s FROM (SELECT unnest(range(48)) AS k), (VALUES (0.85::DOUBLE), (1.0), (1.15)) v(s)), of AS (SELECT a, b, (a + 8) * 17 + b + 9 AS n FROM sq WHERE abs(a) <= 8 AND abs(b) <= 8),
gr AS (SELECT ring, of.n, map_id, x + b AS x, y + a AS y, radius FROM gv, of UNION ALL SELECT ring, 0, map_id, x, y, radius FROM gv), {quality_sql("gr", "gq")},
b1 AS MATERIALIZED (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY ring ORDER BY hollow DESC, n) AS k FROM gq WHERE n = 0 OR rim >= 0.25) WHERE k = 1),
ce AS (SELECT ring, 0 AS n, b1.map_id, sum(mk.c) / count(*) AS x, sum(mk.r) / count(*) AS y, radius FROM b1 JOIN mk ON mk.map_id = b1.map_id AND abs(mk.c - trunc(x)) <= ceil(radius + 4) AND abs(mk.r - trunc(y)) <= ceil(radius + 4) AND sqrt((mk.c - x) ** 2 + (mk.r - y) ** 2) BETWEEN 0.7::DOUBLE * radius AND 1.3::DOUBLE * radius GROUP BY ALL HAVING count(*) >= 12),
{quality_sql("ce", "cq")}, b2 AS MATERIALIZED (SELECT b1.ring, b1.map_id, b1.radius, CASE WHEN t THEN cq.x ELSE b1.x END AS x, CASE WHEN t THEN cq.y ELSE b1.y END AS y, CASE WHEN t THEN cq.hollow ELSE b1.hollow END AS hollow FROM b1 LEFT JOIN cq USING (ring), LATERAL (SELECT coalesce(round(cq.hollow + 0.02, 9) >= b1.hollow, false) AS t)),
{half_steps_sql("b2")} SELECT ring, round(x, 6) AS x, round(y, 6) AS y, round(hollow, 6) AS hollow FROM h9"""


@query("refined_rings", REFINED)
def refined_rings(spark, sf_dir):
    """The drawn rings of all maps from places some pixels off."""
    q = refine(D.given_rings(spark, sf_dir), D.ring_mask(spark, sf_dir), D.images(spark, sf_dir))
    return q.select("ring", *[F.round(n, 6).alias(n) for n in ("x", "y", "hollow")])
