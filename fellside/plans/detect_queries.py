"""Queries over derived detections, windows and replies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import distance_text, parse_number
from ..operators import batches as B
from ..operators import detect as X
from ..operators import raster as R
from ..operators import tiling as W
from ..sources import derived as D
from .raster_queries import IMAGE, image
from .registry import checkpoints as _checkpoints
from .registry import query


@query("best_per_number", f"WITH {D.DETECTIONS} SELECT course, number, seq, x, y, score FROM (SELECT *, row_number() OVER (PARTITION BY course, number ORDER BY score DESC, seq) AS k FROM det) WHERE k = 1")
def best_per_number(spark, sf_dir):
    return X.best_per_number(D.detections(spark, sf_dir))


READINGS = f"{D.DETECTIONS}, hit AS (SELECT seq % 40 AS ring, CAST(500 AS DOUBLE) AS rx, CAST(350 AS DOUBLE) AS ry, CAST(12 + seq % 40 AS DOUBLE) AS radius, seq, CAST(seq * 7 % 230 AS INT) AS number, seq * 17 % 101 / 100 AS conf, 500 + (seq * 13 % 121 - 60) - (4 + seq % 37) AS x0, 350 + (seq * 29 % 81 - 40) - (4 + seq % 19) AS y0, 500 + (seq * 13 % 121 - 60) + (4 + seq % 37) AS x1, 350 + (seq * 29 % 81 - 40) + (4 + seq % 19) AS y1 FROM det), hc AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, len(CAST(number AS VARCHAR)) AS nd FROM hit), ca AS (SELECT *, conf + 0.15 * (nd - 1) + CASE WHEN cx > rx THEN 0.05 ELSE 0.0 END AS score FROM hc WHERE nd >= 2 AND (nd = 2 OR number <= 199) AND conf >= CASE WHEN nd >= 3 THEN 0.85 ELSE 0.25 END AND sqrt((cx - rx) ** 2 + (cy - ry) ** 2) BETWEEN 0.75 * radius AND 3.5 * radius AND NOT (rx BETWEEN x0 - 3 AND x1 + 3 AND ry BETWEEN y0 - 3 AND y1 + 3) AND y1 - y0 BETWEEN 0.45 * radius AND 2.2 * radius AND x1 - x0 <= 4.5 * radius AND (x1 - x0) / (y1 - y0) <= 2.8)"


def readings(spark, sf_dir):
    """A number read near a ring for each event; rings of many sizes, boxes of many shapes."""
    s = F.col("seq")
    x, y, w, h = 500 + (s * 13 % 121 - 60), 350 + (s * 29 % 81 - 40), 4 + s % 37, 4 + s % 19
    base = D.detections(spark, sf_dir).select((s % 40).alias("ring"), F.lit(500.0).alias("rx"), F.lit(350.0).alias("ry"), (12 + s % 40).cast("double").alias("radius"), "seq", (s * 7 % 230).cast("int").alias("number"), (s * 17 % 101 / 100).alias("conf"), (x - w).alias("x0"), (y - h).alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))
    return base.withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("cy", (F.col("y0") + F.col("y1")) / 2)


@query("digit_vote", f"WITH {READINGS}, s AS (SELECT ring, number, round(sum(score), 9) AS total, max(score) AS top, arg_max(seq, {{'s': score, 'q': -seq}}) AS seq FROM ca GROUP BY ALL) SELECT ring, number, total, round(top, 9) AS top, seq FROM (SELECT *, row_number() OVER (PARTITION BY ring ORDER BY total DESC, top DESC, number) AS k FROM s) WHERE k = 1")
def digit_vote(spark, sf_dir):
    return X.vote(X.digit_candidates(readings(spark, sf_dir))).withColumn("top", F.round("top", 9))


BOXES = f"{D.DETECTIONS}, bx AS (SELECT course, seq AS id, x AS x0, y AS y0, x + 10 + seq % 30 AS x1, y + 8 + seq % 20 AS y1 FROM det)"


def boxes(spark, sf_dir):
    s = F.col("seq")
    return D.detections(spark, sf_dir).select("course", s.alias("id"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 10 + s % 30).alias("x1"), (F.col("y") + 8 + s % 20).alias("y1"))


@query("bbox_iou", f"WITH {BOXES}, p AS (SELECT a.course, a.id AS a_id, b.id AS b_id, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s FROM bx a JOIN bx b ON a.course = b.course AND a.id < b.id) SELECT course, a_id, b_id, round(i / (s - i), 6) AS iou FROM p WHERE i > 0")
def bbox_iou(spark, sf_dir):
    """Every pair of overlapping boxes of a course, copies too."""
    return X.paired(X.overlapping_lists(boxes(spark, sf_dir), 50.0).withColumn("iou", F.round("iou", 6)))


@query("expand_bbox", f"WITH {BOXES} SELECT id, greatest(x0 - ((x1 - x0) * 0.25 + 2), 0.0) AS x0, least(x1 + ((x1 - x0) * 0.25 + 2), 1000.0) AS x1 FROM bx")
def expand_bbox(spark, sf_dir):
    pad = (F.col("x1") - F.col("x0")) * 0.25 + 2
    return boxes(spark, sf_dir).select("id", F.greatest(F.col("x0") - pad, F.lit(0.0)).alias("x0"), F.least(F.col("x1") + pad, F.lit(1000.0)).alias("x1"))


@query("plausible_digit_size", f"WITH {BOXES} SELECT id FROM bx WHERE y1 - y0 BETWEEN 10 AND 25 AND (x1 - x0) / (y1 - y0) <= 1.6")
def plausible_digit_size(spark, sf_dir):
    h, w = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    return boxes(spark, sf_dir).where(h.between(10, 25) & (w / h <= 1.6)).select("id")


@query("ocr_windows", f"WITH {D.CONTROLS} SELECT course, i, kind, CAST(trunc(x + dx * 12) AS INT) AS x0, CAST(trunc(y + dy * 12) AS INT) AS y0 FROM controls, (VALUES ('right', 1.0, -0.5), ('left', -3.0, -0.5), ('up', -1.0, -2.5), ('down', -1.0, 1.0), ('around', -2.5, -2.5)) v(kind, dx, dy)")
def ocr_windows(spark, sf_dir):
    kinds = [("right", 1.0, -0.5), ("left", -3.0, -0.5), ("up", -1.0, -2.5), ("down", -1.0, 1.0), ("around", -2.5, -2.5)]
    w = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.col("x") + a * 12).cast("int").alias("x0"), (F.col("y") + b * 12).cast("int").alias("y0")) for k, a, b in kinds]))
    return D.controls(spark, sf_dir).select("course", "i", w.alias("w")).select("course", "i", "w.kind", "w.x0", "w.y0")


@query("ring_bounds", "SELECT p_partkey, greatest(6, round_even(CAST(0.7 AS DOUBLE) * p_size, 0)) AS low, greatest(greatest(6, round_even(CAST(0.7 AS DOUBLE) * p_size, 0)) + 2, round_even(CAST(1.35 AS DOUBLE) * p_size, 0)) AS high FROM part")
def ring_bounds(spark, sf_dir):
    low = F.greatest(F.lit(6.0), F.bround(F.lit(0.7) * F.col("p_size").cast("double"), 0))
    return D.table(spark, sf_dir, "part").select("p_partkey", low.alias("low"), F.greatest(low + 2, F.bround(F.lit(1.35) * F.col("p_size").cast("double"), 0)).alias("high"))


@query("iqr_median_radius", f"WITH {D.DETECTIONS}, v AS (SELECT course, CAST(seq * 7 % 61 AS DOUBLE) AS radius FROM det), q AS (SELECT course, quantile_cont(radius, 0.25) AS a, quantile_cont(radius, 0.75) AS b FROM v GROUP BY course) SELECT course, quantile_cont(radius, 0.5) AS median, count(*) AS kept FROM v JOIN q USING (course) WHERE radius BETWEEN a - 1.5 * greatest(b - a, 1) AND b + 1.5 * greatest(b - a, 1) GROUP BY course")
def iqr_median_radius(spark, sf_dir):
    v = D.detections(spark, sf_dir).select("course", (F.col("seq") * 7 % 61).cast("double").alias("radius"))
    return X.trimmed_median(v, "course", "radius")


@query("ring_radius", f"WITH {D.DETECTIONS}, im AS (SELECT p_partkey AS image, 300 + p_size * 17 AS height, 200 + p_size * 23 AS width FROM part), v AS (SELECT course, CAST(seq * 7 % 61 AS DOUBLE) AS radius FROM det), q AS (SELECT course, quantile_cont(radius, 0.25) AS a, quantile_cont(radius, 0.75) AS b FROM v GROUP BY course), m AS (SELECT course, quantile_cont(radius, 0.5) AS median FROM v JOIN q USING (course) WHERE radius BETWEEN a - 1.5 * greatest(b - a, 1) AND b + 1.5 * greatest(b - a, 1) GROUP BY course) SELECT image, coalesce(median, least(greatest(greatest(height, width) * CAST(0.018 AS DOUBLE), 12.0), 40.0)) AS radius FROM im LEFT JOIN m ON course = image")
def ring_radius(spark, sf_dir):
    """An image for each part; those numbered as courses have rings."""
    im = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"), (300 + F.col("p_size") * 17).alias("height"), (200 + F.col("p_size") * 23).alias("width"))
    return X.ring_radius(im, D.detections(spark, sf_dir).select(F.col("course").alias("image"), (F.col("seq") * 7 % 61).cast("double").alias("radius")))


@query("pink_overlap", f"WITH {D.LABEL}, {IMAGE}, bx AS (SELECT event_id AS id, CAST(event_id * 3 // 2 // 10000 AS INT) AS map_id, CAST(event_id * 37 % 88 AS INT) AS x0, CAST(event_id * 3 // 2 % 10000 AS INT) AS y0, CAST(6 + event_id % 7 AS INT) AS w, CAST(8 + event_id % 5 AS INT) AS h FROM events), pk AS (SELECT map_id, r, c FROM image WHERE red > 90 AND blue > 70 AND green < 0.85 * least(red, blue) AND (red + blue) / 2 - green > 25) SELECT id, round(count(r) / any_value(w * h), 6) AS share FROM bx LEFT JOIN pk ON pk.map_id = bx.map_id AND r >= y0 AND r < y0 + h AND c >= x0 AND c < x0 + w GROUP BY id")
def pink_overlap(spark, sf_dir):
    """Share of a box's pixels that are mask, a box for each event over all maps: mask pixels as bits of squares, which boxes meet."""
    e = F.col("event_id")
    down = F.floor(e * 3 / 2)
    b = D.table(spark, sf_dir, "events").select(e.alias("id"), F.floor(down / 10000).cast("int").alias("map_id"), (e * 37 % 88).cast("int").alias("x0"), (down % 10000).cast("int").alias("y0"), (6 + e % 7).cast("int").alias("w"), (8 + e % 5).cast("int").alias("h"))
    pk = image(spark, sf_dir).where(R.pink(F.col("red"), F.col("green"), F.col("blue"))).select("map_id", "r", "c")
    return X.mask_share(b, pk).withColumn("share", F.round("share", 6))


#: From rings rq (map_id, ring, x, y, radius) and a mask pk (map_id, r, c): qu (ring, rim, fill).
QUALITY = """an AS (SELECT map_id, ring, k, CAST(round_even(y + round(greatest(radius, 1.0) * s * sin(k * (6.283185307179586 / 48)), 6), 0) AS INT) AS r, CAST(round_even(x + round(greatest(radius, 1.0) * s * cos(k * (6.283185307179586 / 48)), 6), 0) AS INT) AS c FROM rq, (SELECT unnest(range(48)) AS k), (SELECT CAST(unnest([0.85, 1.0, 1.15]) AS DOUBLE) AS s)),
oq AS (SELECT map_id, ring, k, max(CASE WHEN pk.r IS NULL THEN 0.0 ELSE 1.0 END) AS one FROM an LEFT JOIN pk USING (map_id, r, c) GROUP BY ALL), rm AS (SELECT map_id, ring, avg(one) AS rim FROM oq GROUP BY ALL),
hf AS (SELECT *, CAST(greatest(round_even(CAST(0.5 AS DOUBLE) * radius, 0), 1) AS INT) AS h FROM rq), dk AS (SELECT map_id, ring, CAST(trunc(y) AS INT) + a AS r, CAST(trunc(x) AS INT) + b AS c FROM hf, (SELECT unnest(range(-20, 21)) AS a), (SELECT unnest(range(-20, 21)) AS b) WHERE abs(a) <= h AND abs(b) <= h AND (trunc(y) + a - y) ** 2 + (trunc(x) + b - x) ** 2 <= h * h),
di AS (SELECT dk.* FROM dk JOIN im USING (map_id) WHERE r >= 0 AND c >= 0 AND r < height AND c < width), fl AS (SELECT map_id, ring, avg(CASE WHEN pk.r IS NULL THEN 0.0 ELSE 1.0 END) AS fill FROM di LEFT JOIN pk USING (map_id, r, c) GROUP BY ALL),
qu AS (SELECT map_id, ring, rim, coalesce(fill, 1.0) AS fill, rim - coalesce(fill, 1.0) AS hollow FROM rm LEFT JOIN fl USING (map_id, ring))"""
IM = "im AS (SELECT map_id, max(r) + 1 AS height, max(c) + 1 AS width FROM label GROUP BY map_id)"


@query("ring_quality", f"WITH {D.LABEL}, {IMAGE}, {IM}, {D.CONTROLS}, pk AS (SELECT map_id, r, c FROM image WHERE red > 90 AND blue > 70 AND green < 0.85 * least(red, blue) AND (red + blue) / 2 - green > 25), rq AS (SELECT map_id, point AS ring, x + point % 3 / 4 AS x, y - 1 + point % 5 / 2 AS y, CAST(5 + point % 13 AS DOUBLE) AS radius FROM controls), {QUALITY} SELECT ring, round(rim, 6) AS rim, round(fill, 6) AS fill, round(hollow, 6) AS hollow FROM qu")
def ring_quality(spark, sf_dir):
    """Rings of many sizes around all controls, between pixels and over the edge too."""
    mask = image(spark, sf_dir).where(R.pink(F.col("red"), F.col("green"), F.col("blue"))).select("map_id", "r", "c")
    p = F.col("point")
    rings = D.controls(spark, sf_dir).select("map_id", p.alias("ring"), (F.col("x") + p % 3 / 4).alias("x"), (F.col("y") - 1 + p % 5 / 2).alias("y"), (5 + p % 13).cast("double").alias("radius"))
    q = X.ring_quality(rings, mask, D.images(spark, sf_dir))
    return q.select("ring", *[F.round(n, 6).alias(n) for n in ("rim", "fill", "hollow")])


def greedy_sql(order: str, least: float, once: str = "n") -> str:
    """Kept rows of cd (g, x, y, ...) by a pass in ``order``: kp (g, n), n the place in it. No two have the same ``once``."""
    return f"""rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {order}) AS n FROM cd), gr(g, n, kept) AS (SELECT g, CAST(0 AS BIGINT), CAST([] AS STRUCT(x DOUBLE, y DOUBLE, n BIGINT, o BIGINT)[]) FROM rk GROUP BY g UNION ALL
SELECT gr.g, gr.n + 1, CASE WHEN len(list_filter(kept, LAMBDA k: (k.x - c.x) * (k.x - c.x) + (k.y - c.y) * (k.y - c.y) < {least * least} OR k.o = c.{once})) > 0 THEN kept ELSE list_append(kept, {{'x': c.x, 'y': c.y, 'n': c.n, 'o': c.{once}}}) END FROM gr JOIN rk c ON c.g = gr.g AND c.n = gr.n + 1),
kp AS (SELECT g, unnest(kept).n AS n FROM (SELECT g, arg_max(kept, n) AS kept FROM gr GROUP BY g))"""


@query("nms_rings", f"WITH RECURSIVE {D.DETECTIONS}, cd AS (SELECT course AS g, seq, x, y, score FROM det), {greedy_sql('score DESC, seq', 60.0)} SELECT rk.g AS course, seq, x, y, score FROM rk JOIN kp USING (g, n)")
def nms_rings(spark, sf_dir):
    _checkpoints(spark)
    return X.suppress(D.detections(spark, sf_dir).select("course", "seq", "x", "y", "score"), 60.0)


HOUGH = """mm AS MATERIALIZED (SELECT * FROM mk), fu AS (SELECT map_id, r + a AS r, c + b AS c FROM mm, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) v(a, b) GROUP BY ALL HAVING count(*) = 4), ed AS MATERIALIZED (SELECT * FROM mm ANTI JOIN fu USING (map_id, r, c)), ox AS MATERIALIZED (SELECT a, b, CAST(floor(sqrt(a * a + b * b) + 0.5) AS INT) AS radius FROM (SELECT CAST(unnest(range(-18, 19)) AS INT) AS a), (SELECT CAST(unnest(range(-18, 19)) AS INT) AS b)),
vt AS (SELECT map_id, r + a AS r, c + b AS c, radius, count(*) AS votes FROM ed, ox WHERE radius BETWEEN 11 AND 18 GROUP BY ALL), vi AS MATERIALIZED (SELECT vt.* FROM vt JOIN im USING (map_id) WHERE r >= 0 AND c >= 0 AND r < height AND c < width AND votes >= 8),
tl AS (SELECT map_id, r + i AS r, c + j AS c, radius + k AS radius, max({'v': votes, 'r': -r, 'c': -c, 'd': -radius}) AS w FROM vi, (SELECT unnest(range(-1, 2)) AS i), (SELECT unnest(range(-1, 2)) AS j), (SELECT unnest(range(-1, 2)) AS k) GROUP BY ALL),
hc AS MATERIALIZED (SELECT map_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, CAST(radius AS INT) AS radius, w.v AS votes FROM tl WHERE w.r = -r AND w.c = -c AND w.d = -radius)"""


@query("hough_circles", f"WITH {D.LABEL}, {D.RING_MASK}, {HOUGH} SELECT map_id, r, c, radius, votes FROM hc")
def hough_circles(spark, sf_dir):
    """Where edges of the drawn rings, lines and specks of all maps vote for a circle."""
    h = X.hough_circles(D.ring_mask(spark, sf_dir), D.images(spark, sf_dir))
    return h.select("map_id", "ring.r", "ring.c", "ring.radius", "votes")


@query("control_rings", f"WITH RECURSIVE {D.LABEL}, {D.RING_MASK}, {HOUGH}, pk AS (SELECT * FROM mk), rq AS (SELECT map_id, {{'r': r, 'c': c, 'd': radius}} AS ring, CAST(c AS DOUBLE) AS x, CAST(r AS DOUBLE) AS y, CAST(radius AS DOUBLE) AS radius FROM hc), {QUALITY}, cd AS (SELECT map_id AS g, x, y, radius, rim, fill, hollow, round(hollow * rim, 9) AS score FROM rq JOIN qu USING (map_id, ring) WHERE rim >= 0.45 AND fill <= 0.35 AND hollow >= 0.40), {greedy_sql('score DESC, y, x, radius', 16.0)} SELECT rk.g AS map_id, x, y, radius, round(rim, 6) AS rim, round(fill, 6) AS fill, round(score, 6) AS score FROM rk JOIN kp USING (g, n)")
def control_rings(spark, sf_dir):
    """The rings of all maps: votes, quality, suppression."""
    _checkpoints(spark)
    got = X.control_rings(D.ring_mask(spark, sf_dir), D.images(spark, sf_dir))
    return got.select("map_id", "x", "y", "radius", *[F.round(n, 6).alias(n) for n in ("rim", "fill", "score")])


@query("merge_hits")
def merge_hits(spark, sf_dir):
    b = boxes(spark, sf_dir)
    h = b.select(F.col("course").alias("image"), F.col("id").alias("seq"), (1 + F.col("id") * 7 % 199).cast("int").alias("number"), (F.col("id") % 97 / 97).alias("conf"), "x0", "y0", "x1", "y1", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    return X.merge_hits(h)


RINGS = "rg AS (SELECT course AS image, seq AS ring, x, y, CAST(8 + seq % 19 AS DOUBLE) AS radius, seq * 31 % 101 / 100 AS hollow FROM det WHERE seq % 2 = 1), dg AS (SELECT course AS image, seq AS digit, x + 5 + seq % 9 AS cx, y + 8 + seq % 7 AS cy, x AS x0, y AS y0, x + 10 + 2 * (seq % 9) AS x1, y + 16 + 2 * (seq % 7) AS y1 FROM det WHERE seq % 2 = 0)"


def rings(spark, sf_dir):
    """Odd events as ring candidates."""
    s = F.col("seq")
    return D.detections(spark, sf_dir).where("seq % 2 = 1").select(F.col("course").alias("image"), s.alias("ring"), "x", "y", (8 + s % 19).cast("double").alias("radius"), (s * 31 % 101 / 100).alias("hollow"))


@query("ring_near_digit", f"WITH {D.DETECTIONS}, {RINGS}, j AS (SELECT image, digit, ring, radius, hollow, y1 - y0 AS h, x, y, x0, y0, x1, y1, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS away, floor(least(greatest(60.0, 2.2 * (y1 - y0)), 3.5 * (y1 - y0), 90.0)) AS reach, greatest(2.0, floor(0.15 * (y1 - y0))) AS pad FROM dg JOIN rg USING (image)), k AS (SELECT image, digit, ring, round(hollow - 1.25 * away / greatest(reach, 1.0), 9) AS score FROM j WHERE radius BETWEEN 0.45 * h AND 0.95 * h AND away <= reach AND NOT (x BETWEEN x0 - pad AND x1 + pad AND y BETWEEN y0 - pad AND y1 + pad)) SELECT image, digit, ring, score FROM (SELECT *, row_number() OVER (PARTITION BY image, digit ORDER BY score DESC, ring) AS n FROM k) WHERE n = 1")
def ring_near_digit(spark, sf_dir):
    s = F.col("seq")
    digits = D.detections(spark, sf_dir).where("seq % 2 = 0").select(F.col("course").alias("image"), s.alias("digit"), (F.col("x") + 5 + s % 9).alias("cx"), (F.col("y") + 8 + s % 7).alias("cy"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 10 + 2 * (s % 9)).alias("x1"), (F.col("y") + 16 + 2 * (s % 7)).alias("y1"))
    return X.ring_near_digit(digits, rings(spark, sf_dir), 60.0)


ASSIST = """pl AS (SELECT course AS image, CAST(10 + seq * 3 % 60 AS INT) AS number, x, y FROM det WHERE seq % 11 = 1), hh AS (SELECT dg.*, CAST(10 + digit * 7 % 120 AS INT) AS number, digit * 13 % 101 / 100 AS conf, digit % 5 / 100 AS overlap, y1 - y0 AS h FROM dg),
op AS (SELECT * FROM hh WHERE (overlap >= 0.02 OR conf >= 0.7) AND NOT EXISTS (SELECT 1 FROM pl WHERE pl.image = hh.image AND pl.number = hh.number)),
nj AS (SELECT op.image, digit, number, conf, ring, rg.x, rg.y, hollow, radius, h, sqrt((rg.x - cx) ** 2 + (rg.y - cy) ** 2) AS away, floor(least(greatest(3.2 * h, 36.0, 2.2 * CAST(14.5 AS DOUBLE), 2.2 * h), 3.5 * h, 90.0)) AS reach, greatest(2.0, floor(0.15 * h)) AS pad, x0, y0, x1, y1 FROM op JOIN rg USING (image)),
nk AS (SELECT *, round(hollow - 1.25 * away / greatest(reach, 1.0), 9) AS worth FROM nj WHERE radius BETWEEN 0.45 * h AND 0.95 * h AND away <= reach AND NOT (x BETWEEN x0 - pad AND x1 + pad AND y BETWEEN y0 - pad AND y1 + pad)),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, digit ORDER BY worth DESC, ring) AS k FROM nk) WHERE k = 1 AND hollow >= 0.35),
cd AS (SELECT image AS g, digit, number, conf, hollow, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM nb WHERE NOT EXISTS (SELECT 1 FROM pl WHERE pl.image = nb.image AND sqrt((pl.x - nb.x) ** 2 + (pl.y - nb.y) ** 2) < 14))"""


@query("digit_assist", f"WITH RECURSIVE {D.DETECTIONS}, {RINGS}, {ASSIST}, {greedy_sql('conf DESC, digit', 14.0, 'number')} SELECT rk.g AS image, number, x, y, round(conf * (0.55 + 0.45 * hollow) * 0.95, 9) AS score FROM rk JOIN kp USING (g, n)")
def digit_assist(spark, sf_dir):
    """Even events as readings, odd ones as rings, one in eleven as a control that is there already."""
    _checkpoints(spark)
    s = F.col("seq")
    d = D.detections(spark, sf_dir)
    h = d.where("seq % 2 = 0").select(F.col("course").alias("image"), s.alias("digit"), (F.col("x") + 5 + s % 9).alias("cx"), (F.col("y") + 8 + s % 7).alias("cy"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 10 + 2 * (s % 9)).alias("x1"), (F.col("y") + 16 + 2 * (s % 7)).alias("y1"), (10 + s * 7 % 120).cast("int").alias("number"), (s * 13 % 101 / 100).alias("conf"), (s % 5 / 100).alias("overlap"))
    placed = d.where("seq % 11 = 1").select(F.col("course").alias("image"), (10 + s * 3 % 60).cast("int").alias("number"), "x", "y")
    return X.digit_assist(h, rings(spark, sf_dir), placed).withColumn("score", F.round("score", 9))


@query("ring_arbitration", f"WITH {D.DETECTIONS}, {RINGS}, b AS (SELECT course AS image, seq AS ring, CAST(10 + seq * 7 % 50 AS INT) AS bn, seq * 13 % 101 / 100 AS bc FROM det WHERE seq % 3 <> 0), a AS (SELECT course AS image, seq AS ring, CAST(10 + seq * CASE WHEN seq % 4 = 1 THEN 7 ELSE 11 END % 50 AS INT) AS an, seq * 29 % 101 / 100 AS ac FROM det WHERE seq % 5 <> 0), j AS (SELECT rg.*, bn, bc, an, ac, CASE WHEN bn IS NULL THEN false WHEN an IS NULL OR bc >= 0.9 THEN true WHEN bn = an THEN bc >= ac WHEN ac >= 0.95 AND ac >= bc + 0.15 THEN false ELSE bc >= ac END AS first FROM rg LEFT JOIN b USING (image, ring) LEFT JOIN a USING (image, ring) WHERE bn IS NOT NULL OR an IS NOT NULL), h AS (SELECT image, ring, x, y, radius, hollow, CASE WHEN first THEN bn ELSE an END AS number, CASE WHEN first THEN bc ELSE ac END AS conf FROM j) SELECT image, ring, number, x, y, round(conf * (0.55 + 0.45 * least(hollow, 1.0)), 6) AS score FROM h WHERE NOT ((hollow < 0.55 AND conf < 0.9) OR (radius > 17.5 AND hollow < 0.7) OR conf * (0.55 + 0.45 * least(hollow, 1.0)) < 0.45)")
def ring_arbitration(spark, sf_dir):
    return _arbitrated(spark, sf_dir).withColumn("score", F.round("score", 6))


def _arbitrated(spark, sf_dir):
    s = F.col("seq")
    d = D.detections(spark, sf_dir)
    beside = d.where("seq % 3 <> 0").select(F.col("course").alias("image"), s.alias("ring"), (10 + s * 7 % 50).cast("int").alias("number"), (s * 13 % 101 / 100).alias("conf"))
    around = d.where("seq % 5 <> 0").select(F.col("course").alias("image"), s.alias("ring"), (10 + s * F.when(s % 4 == 1, 7).otherwise(11) % 50).cast("int").alias("number"), (s * 29 % 101 / 100).alias("conf"))
    return X.arbitrated(rings(spark, sf_dir), beside, around)


@query("placed_controls")
def placed_controls(spark, sf_dir):
    return X.placed_controls(_arbitrated(spark, sf_dir)).withColumn("score", F.round("score", 6))


TILES = "tl AS (SELECT course AS image, CAST(seq % 6 AS INT) AS tile, seq, CAST(10 + seq * 3 % 60 AS INT) AS number, 300 * (seq % 6 % 3) + x / 1000 * 400 AS px, 300 * floor(seq % 6 / 3) + y / 700 * 400 AS py, score FROM det WHERE seq % 2 = 0 AND score >= 0.35 AND NOT (seq % 6 = 5 AND course % 4 = 0))"


@query("vlm_merge", f"WITH {D.DETECTIONS}, {RINGS}, {TILES}, j AS (SELECT t.image, tile, t.seq, t.number, score, px, py, ring, x, y, hollow, round(2 * hollow - 0.35 * sqrt((x - px) ** 2 + (y - py) ** 2) / 36.0 - 0.35 * abs(radius - 15) / 15.0, 9) AS worth FROM tl t JOIN rg USING (image) WHERE radius BETWEEN 10 AND 20 AND sqrt((x - px) ** 2 + (y - py) ** 2) <= 33.0), b AS (SELECT image, tile, seq, x, y, hollow FROM (SELECT *, row_number() OVER (PARTITION BY image, tile, seq ORDER BY worth DESC, ring) AS n FROM j) WHERE n = 1), s AS (SELECT image, tile, seq, number, coalesce(b.x, px) AS x, coalesce(b.y, py) AS y, CASE WHEN b.x IS NULL THEN score ELSE score * (0.55 + 0.45 * least(hollow, 1.0)) END AS score, CASE WHEN b.x IS NULL THEN 'vlm' ELSE 'circle' END AS source FROM tl LEFT JOIN b USING (image, tile, seq)) SELECT image, number, round(x, 6) AS x, round(y, 6) AS y, round(score, 6) AS score, source FROM (SELECT *, row_number() OVER (PARTITION BY image, number ORDER BY score DESC, tile, seq) AS n FROM s) WHERE n = 1".replace("/ 36.0", "/ 33.0"))
def vlm_merge(spark, sf_dir):
    """Even events as hits in six tiles an image, the last too narrow in every fourth."""
    s, t = F.col("seq"), (F.col("seq") % 6).cast("int")
    hits = D.detections(spark, sf_dir).where("seq % 2 = 0").select(F.col("course").alias("image"), t.alias("tile"), (300 * (t % 3)).alias("x0"), (300 * F.floor(t / 3)).alias("y0"), F.when((t == 5) & (F.col("course") % 4 == 0), 31).otherwise(400).alias("width"), F.lit(400).alias("height"), "seq", (10 + s * 3 % 60).cast("int").alias("number"), (F.col("x") / 1000).alias("x"), (F.col("y") / 700).alias("y"), "score")
    r = rings(spark, sf_dir).withColumnRenamed("x", "rx").withColumnRenamed("y", "ry")
    return X.merged_tiles(hits, r, 15.0).select("image", "number", *[F.round(n, 6).alias(n) for n in ("x", "y", "score")], "source")


@query("glyph_clusters", f"WITH RECURSIVE {BOXES}, gb AS (SELECT *, (y0 + y1) / 2 AS cy, (x0 + x1) / 2 AS cx, greatest(y1 - y0, 1.0) AS h FROM bx), go AS (SELECT *, row_number() OVER (ORDER BY course, cy, cx, id) AS n FROM gb), gp AS MATERIALIZED (SELECT a.n, b.n AS other FROM go a JOIN go b ON a.course = b.course AND abs(a.cy - b.cy) <= 0.45 * (a.h + b.h) / 2 AND greatest(0, b.x0 - a.x1, a.x0 - b.x1) <= 0.55 * (a.h + b.h) / 2), gl(n, least) USING KEY (n) AS (SELECT n, n FROM go UNION SELECT w.n, w.least FROM (SELECT gp.n, min(gl.least) AS least FROM gl JOIN gp ON gp.other = gl.n GROUP BY gp.n) w JOIN recurring.gl k ON k.n = w.n WHERE w.least < k.least) SELECT g.course AS image, f.id AS cluster, count(*) AS n, min(g.x0) AS x0, min(g.y0) AS y0, max(g.x1) AS x1, max(g.y1) AS y1 FROM gl JOIN go g ON g.n = gl.n JOIN go f ON f.n = gl.least GROUP BY ALL")
def glyph_clusters(spark, sf_dir):
    _checkpoints(spark)
    b = boxes(spark, sf_dir)
    return X.clustered_glyphs(b.select(F.col("course").alias("image"), "id", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]))


STARTS = """sp AS (SELECT event_id, '{"controls":[]' || CASE WHEN event_id % 4 < 3 THEN ',"start":{"x":' || CAST(event_id % 17 AS VARCHAR) || '.5e-1,"y":' || CASE WHEN event_id % 7 = 0 THEN '"0.75"' ELSE '0.25' END || CASE WHEN event_id % 3 = 0 THEN ',"confidence":' || CAST(event_id % 5 - 1 AS VARCHAR) ELSE '' END || '}' ELSE ',"start":null' END || '}' AS reply FROM events)"""


@query("vlm_start_parse", f"WITH {STARTS}, p AS (SELECT event_id, TRY_CAST(json_extract_string(reply, '$.start.x') AS DOUBLE) AS x, TRY_CAST(json_extract_string(reply, '$.start.y') AS DOUBLE) AS y, least(greatest(coalesce(TRY_CAST(json_extract_string(reply, '$.start.confidence') AS DOUBLE), 0.7), 0.0), 1.0) AS score FROM sp) SELECT event_id, round(x, 6) AS x, y, score FROM p WHERE x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1")
def vlm_start_parse(spark, sf_dir):
    e = F.col("event_id")
    start = F.concat(F.lit(',"start":{"x":'), (e % 17).cast("string"), F.lit('.5e-1,"y":'), F.when(e % 7 == 0, '"0.75"').otherwise("0.25"), F.when(e % 3 == 0, F.concat(F.lit(',"confidence":'), (e % 5 - 1).cast("string"))).otherwise(""), F.lit("}"))
    text = F.concat(F.lit('{"controls":[]'), F.when(e % 4 < 3, start).otherwise(F.lit(',"start":null')), F.lit("}"))
    return X.parse_starts(D.table(spark, sf_dir, "events").select("event_id", text.alias("reply"))).withColumn("x", F.round("x", 6))


REPLY = """rp AS (SELECT event_id, '{"controls":[{"number":' || CAST(event_id % 220 AS VARCHAR) || ',"x":' || CAST(event_id % 13 AS VARCHAR) || '.5e-1,"y":0.25' || CASE WHEN event_id % 3 = 0 THEN ',"confidence":' || CAST(event_id % 4 AS VARCHAR) ELSE '' END || '}]}' || CASE WHEN event_id % 11 = 0 THEN '' ELSE ' ' END AS reply FROM events)"""


@query("vlm_json_parse", f"WITH {REPLY}, p AS (SELECT event_id, TRY_CAST(json_extract_string(reply, '$.controls[0].number') AS INT) AS number, TRY_CAST(json_extract_string(reply, '$.controls[0].x') AS DOUBLE) AS x, TRY_CAST(json_extract_string(reply, '$.controls[0].y') AS DOUBLE) AS y, least(greatest(coalesce(TRY_CAST(json_extract_string(reply, '$.controls[0].confidence') AS DOUBLE), 0.7), 0.0), 1.0) AS score FROM rp) SELECT event_id, number, round(x, 6) AS x, y, score FROM p WHERE number BETWEEN 10 AND 199 AND x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1")
def vlm_json_parse(spark, sf_dir):
    e = F.col("event_id")
    text = F.concat(F.lit('{"controls":[{"number":'), (e % 220).cast("string"), F.lit(',"x":'), (e % 13).cast("string"), F.lit('.5e-1,"y":0.25'), F.when(e % 3 == 0, F.concat(F.lit(',"confidence":'), (e % 4).cast("string"))).otherwise(""), F.lit("}]}"))
    fenced = F.when(e % 5 == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).otherwise(text)
    return X.parse_replies(D.table(spark, sf_dir, "events").select("event_id", fenced.alias("reply"))).withColumn("x", F.round("x", 6))


THREE = "dt AS (SELECT course // 3 AS image, course % 3 AS who, number, min(x) AS x, min(y) AS y FROM det GROUP BY ALL)"


@query("detector_compare", f"WITH {D.DETECTIONS}, {THREE}, a AS (SELECT * FROM dt WHERE who = 0), b AS (SELECT * FROM dt WHERE who = 1), c AS (SELECT * FROM dt WHERE who = 2) SELECT image, number, a.x IS NOT NULL AS in_a, b.x IS NOT NULL AS in_b, c.x IS NOT NULL AS in_c, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS d_ab, round(sqrt((a.x - c.x) ** 2 + (a.y - c.y) ** 2), 6) AS d_ac, round(sqrt((b.x - c.x) ** 2 + (b.y - c.y) ** 2), 6) AS d_bc FROM a FULL JOIN b USING (image, number) FULL JOIN c USING (image, number)")
def detector_compare(spark, sf_dir):
    """All courses, each three as three detectors' findings on one image."""
    d = D.detections(spark, sf_dir).withColumn("image", F.floor(F.col("course") / 3))
    return X.compared(*[d.where(F.col("course") % 3 == k).groupBy("image", "number").agg(F.min("x").alias("x"), F.min("y").alias("y")) for k in range(3)])


@query("unused_controls", f"WITH {D.CONTROLS}, {D.DETECTIONS} SELECT course, i, number FROM controls c WHERE NOT EXISTS (SELECT 1 FROM det d WHERE d.course = c.course % 50 AND d.number = c.number)")
def unused_controls(spark, sf_dir):
    """Each course's controls that its image doesn't show."""
    seen = D.detections(spark, sf_dir).select(F.col("course").alias("image"), "number").distinct()
    c = D.controls(spark, sf_dir).select("course", "i", "number", (F.col("course") % 50).cast("long").alias("image"))
    return c.join(seen, ["image", "number"], "left_anti").select("course", "i", "number")


@query("selected_controls", f"WITH {D.CONTROLS}, {D.DETECTIONS} SELECT course, i, number FROM controls c WHERE EXISTS (SELECT 1 FROM det d WHERE d.course = c.course % 50 AND d.number = c.number)")
def selected_controls(spark, sf_dir):
    seen = D.detections(spark, sf_dir).select(F.col("course").alias("image"), "number").distinct()
    c = D.controls(spark, sf_dir).select("course", "i", "number", (F.col("course") % 50).cast("long").alias("image"))
    return c.join(seen, ["image", "number"], "left_semi").select("course", "i", "number")


@query("parse_digits", "SELECT p_partkey, CASE WHEN regexp_full_match(trim(split_part(p_brand, '#', 2)), '\\d{1,3}') AND CAST(trim(split_part(p_brand, '#', 2)) AS INT) <= 199 THEN CAST(trim(split_part(p_brand, '#', 2)) AS INT) END AS number FROM part")
def parse_digits(spark, sf_dir):
    return D.table(spark, sf_dir, "part").select("p_partkey", parse_number(F.coalesce(F.get(F.split("p_brand", "#"), F.lit(1)), F.lit("")), 0, 199).alias("number"))


@query("distance_text", "SELECT p_partkey, CASE WHEN p_retailprice >= 1000 THEN (CAST(round_even(p_retailprice / 1000 * 100, 0) AS BIGINT) // 100) || '.' || lpad(CAST(CAST(round_even(p_retailprice / 1000 * 100, 0) AS BIGINT) % 100 AS VARCHAR), 2, '0') || ' km' ELSE CAST(round_even(p_retailprice, 0) AS BIGINT) || ' m' END AS text FROM part")
def distance_text_query(spark, sf_dir):
    return D.table(spark, sf_dir, "part").select("p_partkey", distance_text(F.col("p_retailprice")).alias("text"))


IMAGES = "im AS (SELECT p_partkey AS image, 300 + p_size * 17 AS height, 200 + p_size * 23 AS width FROM part)"


def images(spark, sf_dir):
    return D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"), (300 + F.col("p_size") * 17).alias("height"), (200 + F.col("p_size") * 23).alias("width"))


for _name, _window, _step in (("window_grid", 512, 256), ("vlm_tiles", 400, 300)):
    query(_name, f"WITH {IMAGES}, ys AS (SELECT DISTINCT image, unnest(list_append(range(0, greatest(height - {_window}, 0) + 1, {_step}), greatest(height - {_window}, 0))) AS y FROM im), xs AS (SELECT DISTINCT image, unnest(list_append(range(0, greatest(width - {_window}, 0) + 1, {_step}), greatest(width - {_window}, 0))) AS x FROM im) SELECT image, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM ys JOIN xs USING (image)")(lambda spark, sf_dir, w=_window, s=_step: W.windows(images(spark, sf_dir), w, s))


@query("blend_weight", "WITH g AS (SELECT i, j, -1 + 2 * i / 8 AS a, -1 + 2 * j / 8 AS b FROM (SELECT unnest(range(9)) AS i), (SELECT unnest(range(9)) AS j)) SELECT i, j, round(exp(-a * a / (2 * 0.35 * 0.35)) * exp(-b * b / (2 * 0.35 * 0.35)), 6) AS gaussian, round(0.25 * (1 + cos(a * 3.141592653589793)) * (1 + cos(b * 3.141592653589793)), 6) + 0.0 AS cosine FROM g")
def blend_weight(spark, sf_dir):
    g, c = W.weights(9, "gaussian", spark), W.weights(9, "cosine", spark)
    return g.select("i", "j", F.round("weight", 6).alias("gaussian")).join(c.select("i", "j", (F.round("weight", 6) + 0.0).alias("cosine")), ["i", "j"])


@query("reflect_pad", "SELECT image, k, CAST(CASE WHEN m < 50 THEN m ELSE 98 - m END AS INT) AS source FROM (SELECT image, k, ((k % 98) + 98) % 98 AS m FROM (SELECT unnest(range(3)) AS image), (SELECT unnest(range(-20, 70)) AS k))")
def reflect_pad(spark, sf_dir):
    k = spark.range(3).select(F.col("id").alias("image")).crossJoin(spark.range(-20, 70).select(F.col("id").alias("k")))
    return k.select("image", "k", W.reflected(F.col("k"), F.lit(50)).cast("int").alias("source"))


TURNS = "CASE k WHEN 0 THEN r WHEN 1 THEN r WHEN 2 THEN 49 - r WHEN 3 THEN 49 - r WHEN 4 THEN c WHEN 5 THEN 49 - r ELSE 49 - c END AS vr, CASE k WHEN 0 THEN c WHEN 1 THEN 49 - c WHEN 2 THEN c WHEN 3 THEN 49 - c WHEN 4 THEN 49 - r WHEN 5 THEN 49 - c ELSE r END AS vc"


@query("tta_variants", f"WITH {D.LABEL}, l AS (SELECT map_id, CAST(floor(r / 50) AS INT) AS y, CAST(floor(c / 50) AS INT) AS x, r % 50 AS r, c % 50 AS c, class_id FROM label), v AS (SELECT *, {TURNS} FROM l, (VALUES (0), (1), (2), (3), (4), (5), (6)) v(k)) SELECT v.map_id, v.y, v.x, v.r, v.c, round(avg(CASE WHEN s.class_id = v.class_id THEN 1.0 ELSE 0.0 END), 6) AS agree FROM v JOIN l s ON s.map_id = v.map_id AND s.y = v.y AND s.x = v.x AND s.r = vr AND s.c = vc GROUP BY ALL")
def tta_variants(spark, sf_dir):
    """How far seven flips and turns of each square of 50 agree with it, pixel by pixel; what falls outside the map isn't asked."""
    r, c = F.col("r"), F.col("c")
    px = D.label(spark, sf_dir).select("map_id", F.floor(r / 50).cast("int").alias("y"), F.floor(c / 50).cast("int").alias("x"), (r % 50).alias("r"), (c % 50).alias("c"), "class_id")
    src = px.select("map_id", "y", "x", F.col("r").alias("vr"), F.col("c").alias("vc"), F.col("class_id").alias("seen"))
    v = W.variants(px, 50).join(src, ["map_id", "y", "x", "vr", "vc"])
    return v.groupBy("map_id", "y", "x", "r", "c").agg(F.round(F.avg((F.col("seen") == F.col("class_id")).cast("double")), 6).alias("agree"))


@query("tta_average", f"WITH {D.LABEL}, l AS (SELECT map_id, CAST(floor(r / 50) AS INT) AS y, CAST(floor(c / 50) AS INT) AS x, r % 50 AS r, c % 50 AS c, (r * 7 + c * 3 + class_id * 11) % 100 / 100 AS prob FROM label), v AS (SELECT *, {TURNS} FROM l, (VALUES (0), (1), (2), (3), (4), (5), (6)) v(k)) SELECT map_id, y, x, vr AS r, vc AS c, round(avg(prob), 6) AS prob FROM v GROUP BY ALL")
def tta_average(spark, sf_dir):
    """Predictions on the seven variants turned back to their own pixels and averaged."""
    r, c = F.col("r"), F.col("c")
    p = D.label(spark, sf_dir).select("map_id", F.floor(r / 50).cast("int").alias("y"), F.floor(c / 50).cast("int").alias("x"), (r % 50).alias("r"), (c % 50).alias("c"), ((r * 7 + c * 3 + F.col("class_id") * 11) % 100 / 100).alias("prob"))
    back = W.undone(W.variants(p, 50))
    return back.groupBy("map_id", "y", "x", "r", "c").agg(F.round(F.avg("prob"), 6).alias("prob"))


@query("tile_index_filter", "SELECT doc_id, source AS map_id, CASE doc_id % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS split, round(n_chars / 20000, 6) AS fg_ratio FROM documents WHERE doc_id % 10 < 8 AND lang IN ('en', 'de') AND n_chars / 20000 >= 0.1")
def tile_index_filter(spark, sf_dir):
    from ..sources.files import tile_index

    k = F.col("doc_id") % 10
    index = D.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("map"), F.when(k == 8, "val").when(k == 9, "test").otherwise("train").alias("split"), F.col("lang").alias("kind"), (F.col("n_chars") / 20000).alias("fg_ratio"))
    return tile_index(index, "train", ("en", "de"), 0.1).select("doc_id", F.col("map").alias("map_id"), "split", F.round("fg_ratio", 6).alias("fg_ratio"))


@query("path_rebase", "SELECT page_id, CASE WHEN starts_with(p, '/') AND list_position(string_split(p, '/'), 'dataset') IS NULL THEN p WHEN list_position(string_split(p, '/'), 'dataset') IS NOT NULL THEN '/root/' || array_to_string(string_split(p, '/')[list_position(string_split(p, '/'), 'dataset') + 1:], '/') ELSE '/root/' || p END AS path FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/a/dataset/x/' WHEN 1 THEN 'rel/' ELSE '/abs/y/' END || page_id || '.png' AS p FROM pages)")
def path_rebase(spark, sf_dir):
    from ..sources.files import rebased

    i = F.col("page_id")
    p = F.concat(F.when(i % 3 == 0, "/a/dataset/x/").when(i % 3 == 1, "rel/").otherwise("/abs/y/"), i.cast("string"), F.lit(".png"))
    return D.table(spark, sf_dir, "pages").select("page_id", rebased(p, "/root").alias("path"))


@query("sampler_weights", "SELECT doc_id, round(pow(greatest(n_chars / 20000, 0.001), 0.5), 6) AS weight, round(sum(pow(greatest(n_chars / 20000, 0.001), 0.5)) OVER (PARTITION BY lang ORDER BY doc_id), 6) AS upto FROM documents")
def sampler_weights(spark, sf_dir):
    w = F.pow(F.greatest(F.col("n_chars") / 20000, F.lit(0.001)), F.lit(0.5))
    return D.table(spark, sf_dir, "documents").select("doc_id", F.round(w, 6).alias("weight"), F.round(F.sum(w).over(Window.partitionBy("lang").orderBy("doc_id")), 6).alias("upto"))


@query("batch_loader", "SELECT doc_id, CAST(floor((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) / 16) AS BIGINT) AS batch FROM documents")
def batch_loader(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")) - 1) / 16).alias("batch"))


@query("batch_loader_shuffled", "WITH b AS (SELECT doc_id, lang, CAST(floor((row_number() OVER (PARTITION BY lang ORDER BY doc_id * 7919 % 10007, doc_id) - 1) / 16) AS BIGINT) AS batch, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, batch FROM b WHERE batch < floor(n / 16)")
def batch_loader_shuffled(spark, sf_dir):
    """In another order, and without a last batch that isn't full."""
    d = D.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return B.batched(d, 16, "lang", F.col("doc_id") * 7919 % 10007, F.col("doc_id"), drop_last=True).select("doc_id", "batch")


@query("sampler_draws", "WITH w AS (SELECT doc_id, lang, CAST(greatest(n_chars, 20) AS BIGINT) AS weight FROM documents), c AS (SELECT *, CAST(sum(weight) OVER (PARTITION BY lang ORDER BY doc_id) AS BIGINT) AS upto FROM w), s AS (SELECT lang, CAST(sum(weight) AS BIGINT) AS total, count(*) AS n FROM w GROUP BY lang), d AS (SELECT lang, total, unnest(range(n)) AS draw FROM s) SELECT d.lang, draw, doc_id FROM d JOIN c ON c.lang = d.lang AND draw * 618033989 % total >= upto - weight AND draw * 618033989 % total < upto")
def sampler_draws(spark, sf_dir):
    """Draws with replacement, in proportion to length."""
    w = D.table(spark, sf_dir, "documents").select("doc_id", "lang", F.greatest(F.col("n_chars"), F.lit(20)).cast("long").alias("weight"))
    return B.drawn(w, "lang", "doc_id", F.col("draw") * 618033989)


@query("plan_json", f"WITH {D.CONTROLS} SELECT course, i, '{{\"number\":' || number || ',\"x\":' || printf('%.1f', x) || ',\"y\":' || printf('%.1f', y) || '}}' AS json FROM controls")
def plan_json(spark, sf_dir):
    return D.controls(spark, sf_dir).select("course", "i", F.to_json(F.struct("number", "x", "y")).alias("json"))
