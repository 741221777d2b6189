"""Queries over regions, paths and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import regions as G
from ..sources import derived as D
from .detect_queries import BOXES, boxes
from .registry import checkpoints as _checkpoints
from .registry import query
from .route_queries import STEP, cells, starts, steps, times_sql

MASK = f"{D.LABEL}, mk AS (SELECT map_id, r, c, CAST(r AS BIGINT) * 2147483648 + c AS id FROM label WHERE class_id IN (6, 10))"
REGION = """mv(a, b) AS (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 0), (0, 1), (1, -1), (1, 0), (1, 1)), sh AS (SELECT id AS other, map_id, r + a AS r, c + b AS c FROM mk, mv), nb AS (SELECT map_id, mk.id, sh.other FROM mk JOIN sh USING (map_id, r, c)),
rg(map_id, id, region) USING KEY (map_id, id) AS (SELECT map_id, id, id FROM mk UNION SELECT w.map_id, w.id, w.region FROM (SELECT nb.map_id, nb.id, min(rg.region) AS region FROM rg JOIN nb ON nb.map_id = rg.map_id AND nb.other = rg.id GROUP BY nb.map_id, nb.id) w JOIN recurring.rg k ON k.map_id = w.map_id AND k.id = w.id WHERE w.region < k.region)"""
HOLES = """px AS MATERIALIZED (SELECT map_id, region, r, c FROM rg JOIN mk USING (map_id, id)), di(a, b) AS (SELECT x, y FROM (SELECT unnest(range(-2, 3)) AS x), (SELECT unnest(range(-2, 3)) AS y) WHERE abs(x) + abs(y) <= 2), gw AS (SELECT DISTINCT map_id, region, r + a AS r, c + b AS c FROM px, di),
cl AS MATERIALIZED (SELECT map_id, region, r + a AS r, c + b AS c FROM gw, di GROUP BY ALL HAVING count(*) = 13), sq AS (SELECT map_id, region, r - i AS qr, c - j AS qc, sum(1 << (2 * i + j)) AS bits FROM cl, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(i, j) GROUP BY ALL),
ho AS (SELECT map_id, region, CAST(1 - sum(CASE WHEN bits IN (1, 2, 4, 8) THEN 1 WHEN bits IN (7, 11, 13, 14) THEN -1 WHEN bits IN (6, 9) THEN -2 ELSE 0 END) / 4 AS INT) AS holes FROM sq GROUP BY map_id, region)"""


def mask(spark, sf_dir):
    return D.label(spark, sf_dir).where("class_id IN (6, 10)").select("map_id", "r", "c")


@query("connected_regions", f"WITH RECURSIVE {MASK}, {REGION} SELECT r, c, region FROM rg JOIN mk USING (map_id, id)")
def connected_regions(spark, sf_dir):
    _checkpoints(spark)
    return G.label_regions(mask(spark, sf_dir)).select("r", "c", "region")


#: The outer border of each closed region, a side at a time from its first pixel's top, with 8-connected pixels: bd (map_id, region, straight, slant, a2).
BORDER = """sd(s, dr, dc, br, bc) AS (VALUES (0, 0, 1, -1, 0), (1, 1, 0, 0, 1), (2, 0, -1, 1, 0), (3, -1, 0, 0, -1)), ck AS (SELECT map_id, region, r, c, s, dr, dc, br, bc FROM cl, sd WHERE NOT EXISTS (SELECT 1 FROM cl o WHERE o.map_id = cl.map_id AND o.region = cl.region AND o.r = cl.r + br AND o.c = cl.c + bc)),
nx AS MATERIALIZED (SELECT ck.map_id, ck.region, ck.r, ck.c, s, CASE WHEN g.r IS NOT NULL THEN g.r WHEN f.r IS NOT NULL THEN f.r ELSE ck.r END AS nr, CASE WHEN g.r IS NOT NULL THEN g.c WHEN f.r IS NOT NULL THEN f.c ELSE ck.c END AS nc, CASE WHEN g.r IS NOT NULL THEN (s + 3) % 4 WHEN f.r IS NOT NULL THEN s ELSE (s + 1) % 4 END AS ns FROM ck
  LEFT JOIN cl g ON g.map_id = ck.map_id AND g.region = ck.region AND g.r = ck.r + dr + br AND g.c = ck.c + dc + bc LEFT JOIN cl f ON f.map_id = ck.map_id AND f.region = ck.region AND f.r = ck.r + dr AND f.c = ck.c + dc),
f0 AS (SELECT map_id, region, arg_min({'r': r, 'c': c}, {'r': r, 'c': c}) AS p FROM cl GROUP BY map_id, region), wk(map_id, region, r, c, s) AS (SELECT map_id, region, p.r, p.c, 0 FROM f0 UNION SELECT nx.map_id, nx.region, nr, nc, ns FROM wk JOIN nx USING (map_id, region, r, c, s)),
bd AS (SELECT map_id, region, count(*) FILTER ((r <> nr) <> (c <> nc)) AS straight, count(*) FILTER (r <> nr AND c <> nc) AS slant, sum(c * nr - nc * r) AS a2 FROM wk JOIN nx USING (map_id, region, r, c, s) GROUP BY map_id, region)"""


@query("region_stats", f"WITH RECURSIVE {MASK}, {REGION}, {HOLES}, {BORDER}, s AS (SELECT map_id, region, count(*) AS area, min(c) AS x0, max(c) + 1 AS x1, min(r) AS y0, max(r) + 1 AS y1, avg(c) AS cx, avg(r) AS cy FROM px GROUP BY map_id, region HAVING count(*) >= 8), im AS (SELECT map_id, (max(r) + 1) * (max(c) + 1) AS size FROM label GROUP BY map_id), k AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h, straight + slant * sqrt(CAST(2 AS DOUBLE)) AS perimeter FROM s JOIN ho USING (map_id, region) JOIN bd USING (map_id, region)), a AS (SELECT *, area / (w * h) AS fill, greatest(w, h) / least(w, h) AS aspect, least(w, h) AS lo, greatest(w, h) AS hi, CASE WHEN perimeter > 1e-3 THEN 4 * pi() * area / (perimeter * perimeter) ELSE 0.0 END AS roundness FROM k) SELECT region, area, x0, x1, y0, y1, round(cx, 6) AS cx, round(cy, 6) AS cy, round(fill, 6) AS fill, lo / 2 AS radius, holes, round(perimeter, 6) AS perimeter, round(roundness, 6) AS roundness, CASE WHEN (aspect >= 4 AND fill < 0.35 AND area < 0.02 * size) OR (aspect >= 3 AND lo <= 6 AND hi >= 40) THEN 'line' WHEN abs(w - h) <= 0.4 * hi AND lo >= 26 AND area >= 220 AND (holes > 0 OR (fill BETWEEN 0.15 AND 0.65 AND roundness > 0.35) OR (fill BETWEEN 0.2 AND 0.55 AND roundness > 0.55)) THEN 'circle' WHEN area BETWEEN 12 AND 8000 AND aspect <= 3.5 AND fill >= 0.15 AND hi <= 120 THEN 'digit' ELSE 'noise' END AS kind FROM a JOIN im USING (map_id)")
def region_stats(spark, sf_dir):
    _checkpoints(spark)
    s = G.region_stats(G.label_regions(mask(spark, sf_dir)), D.images(spark, sf_dir))
    return s.select("region", "area", "x0", "x1", "y0", "y1", *[F.round(n, 6).alias(n) for n in ("cx", "cy", "fill")], "radius", "holes", *[F.round(n, 6).alias(n) for n in ("perimeter", "roundness")], "kind")


@query("contours", f"WITH RECURSIVE {MASK}, {REGION}, cl AS MATERIALIZED (SELECT map_id, region, r, c FROM rg JOIN mk USING (map_id, id)), {BORDER} SELECT region, straight + slant AS points, round(straight + slant * sqrt(CAST(2 AS DOUBLE)), 6) AS perimeter, CAST(abs(a2) / 2 AS DOUBLE) AS area FROM bd")
def contours(spark, sf_dir):
    """The outer border of every region."""
    _checkpoints(spark)
    return G.contours(G.label_regions(mask(spark, sf_dir))).where("outer").select("region", "points", F.round("perimeter", 6).alias("perimeter"), F.col("area").cast("double").alias("area"))


@query("start_triangles")
def start_triangles(spark, sf_dir):
    """Even triangles among the drawn ones and specks of all maps, where no control is near."""
    _checkpoints(spark)
    t = G.start_triangles(D.start_mask(spark, sf_dir), D.images(spark, sf_dir), D.controls(spark, sf_dir).where("i = 1"), 24.0, 9.0)
    return t.select("map_id", *[F.round(n, 6).alias(n) for n in ("x", "y", "side", "score")])


@query("best_start")
def best_start(spark, sf_dir):
    _checkpoints(spark)
    return G.best_start(G.start_triangles(D.start_mask(spark, sf_dir), D.images(spark, sf_dir), size=24.0)).select("map_id", *[F.round(n, 6).alias(n) for n in ("x", "y", "side", "score")])


@query("annulus_centre", f"WITH {D.LABEL}, {D.CONTROLS}, m AS (SELECT map_id, r, c FROM label WHERE class_id IN (8, 13)) SELECT point AS ring, round(avg(c), 6) AS cx, round(avg(r), 6) AS cy, count(*) AS n FROM controls JOIN m ON m.map_id = controls.map_id AND 100 * ((c - CAST(x AS INT)) * (c - CAST(x AS INT)) + (r - CAST(y AS INT)) * (r - CAST(y AS INT))) BETWEEN 49 * 81 AND 169 * 81 GROUP BY point HAVING count(*) >= 12")
def annulus_centre(spark, sf_dir):
    rings = D.controls(spark, sf_dir).select("map_id", F.col("point").alias("ring"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.lit(9).alias("radius"))
    m = D.label(spark, sf_dir).where("class_id IN (8, 13)")
    return G.annulus_centres(rings, m).select("ring", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "n")


@query("containment_join", f"WITH {BOXES} SELECT b.id, count(d.seq) AS inside FROM bx b JOIN det d ON d.course = b.course AND d.x BETWEEN b.x0 AND b.x1 AND d.y BETWEEN b.y0 AND b.y1 GROUP BY b.id")
def containment_join(spark, sf_dir):
    """Points inside boxes: an equi-join on the tiles that a box touches, then the exact test."""
    t = 40.0
    b = boxes(spark, sf_dir).select("*", F.explode(F.sequence(F.floor(F.col("x0") / t), F.floor(F.col("x1") / t))).alias("tx")).select("*", F.explode(F.sequence(F.floor(F.col("y0") / t), F.floor(F.col("y1") / t))).alias("ty"))
    d = D.detections(spark, sf_dir).select("course", "seq", "x", "y", F.floor(F.col("x") / t).alias("tx"), F.floor(F.col("y") / t).alias("ty"))
    return b.join(d, ["course", "tx", "ty"]).where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1").groupBy("id").agg(F.count("seq").alias("inside"))


@query("path_steps", f"{STEP} SELECT route, seq, round(t * f, 6) AS step_s, round(f * 4.0, 6) AS step_m FROM d WHERE t IS NOT NULL")
def path_steps(spark, sf_dir):
    c = cells(spark, sf_dir).withColumn("time_s", F.coalesce("time_s", F.lit(99.0)))
    o = Window.partitionBy("route").orderBy("seq")
    j = steps(spark, sf_dir).join(c, ["map_id", "cr", "cc"]).select("route", "seq", "time_s", F.lag("time_s").over(o).alias("t0"), (F.col("cr") - F.lag("cr").over(o)).alias("a"), (F.col("cc") - F.lag("cc").over(o)).alias("b")).where("a IS NOT NULL")
    f = F.when(F.col("a") * F.col("b") != 0, 1.41421356237).otherwise(1.0)
    return j.select("route", "seq", F.round((F.col("time_s") + F.col("t0")) / 2 * f, 6).alias("step_s"), F.round(f * 4.0, 6).alias("step_m"))


@query("wave_normalise", times_sql("SELECT s AS course, cr, cc, round((row_number() OVER (PARTITION BY s ORDER BY round(t, 9), cc, cr) - 1) / greatest(count(*) OVER (PARTITION BY s) - 1, 1), 6) AS wave FROM tm"))
def wave_normalise(spark, sf_dir):
    from ..operators import graph

    cs = cells(spark, sf_dir)
    at = graph.visits_from(cs, starts(spark, sf_dir, cs))
    return at.select(F.col("i").alias("course"), "cr", "cc", F.round(F.col("visit") / F.greatest(F.col("n") - 1, F.lit(1)), 6).alias("wave"))


@query("backtrack", times_sql(""", pr AS (SELECT m.s, m.cr, m.cc, arg_min(struct_pack(r := e.cr, c := e.cc), {'d': round(p.t + e.w, 9), 'r': e.cr, 'c': e.cc}) AS up FROM tm m JOIN ed e ON e.map_id = m.map_id AND e.nr = m.cr AND e.nc = m.cc JOIN tm p ON p.map_id = m.map_id AND p.s = m.s AND p.cr = e.cr AND p.cc = e.cc WHERE m.t > 0 GROUP BY ALL) SELECT s AS course, cr, cc, up.r AS pr, up.c AS pc FROM pr""".replace(", pr AS", "SELECT * FROM (WITH pr AS") + ")"))
def backtrack(spark, sf_dir):
    """Each cell's canonical parent: the neighbour through which it is reached soonest, the smaller row and column of equals."""
    from ..operators import graph

    cs = cells(spark, sf_dir)
    return graph.parents_from(cs, starts(spark, sf_dir, cs)).select(F.col("i").alias("course"), "cr", "cc", "pr", "pc")


@query("detection_union", f"WITH {D.DETECTIONS} SELECT DISTINCT CAST(floor(course / 2) AS BIGINT) AS pair, number FROM det")
def detection_union(spark, sf_dir):
    """Two detectors' numbers (an even course and the odd one after it), each once."""
    d = D.detections(spark, sf_dir).select(F.floor(F.col("course") / 2).alias("pair"), "course", "number")
    return d.where("course % 2 = 0").select("pair", "number").union(d.where("course % 2 = 1").select("pair", "number")).distinct()


@query("controls_sorted", f"WITH {D.DETECTIONS} SELECT course, number, seq, score, row_number() OVER (PARTITION BY course ORDER BY number, -score, seq) AS place FROM det")
def controls_sorted(spark, sf_dir):
    """Each course's controls in order."""
    return D.detections(spark, sf_dir).select("course", "number", "seq", "score", F.row_number().over(Window.partitionBy("course").orderBy("number", -F.col("score"), "seq")).cast("long").alias("place"))
