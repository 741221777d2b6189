"""Queries over the derived label raster."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..operators import raster as R
from ..sources import derived as D
from .registry import query

DIM = dims.values_sql()
FAST = "[8, 9, 13, 14]"


def image(spark, sf_dir):
    return D.label(spark, sf_dir).select("map_id", "r", "c", ((F.col("r") * 7 + F.col("c") * 3) % 256).alias("red"), ((F.col("r") * 5 + F.col("c") * 11) % 256).alias("green"), ((F.col("r") * 13 + F.col("c")) % 256).alias("blue"))


IMAGE = "image AS (SELECT map_id, r, c, (r * 7 + c * 3) % 256 AS red, (r * 5 + c * 11) % 256 AS green, (r * 13 + c) % 256 AS blue FROM label)"
#: Overlays resolved, cells, and the class of each cell.
RESOLVED = """ov AS (SELECT map_id, r, c FROM label WHERE class_id IN (11, 15)), re AS (SELECT * FROM label WHERE class_id NOT IN (11, 15)),
nn AS (SELECT ov.map_id, ov.r, ov.c, arg_min(re.class_id, {'d': (re.r - ov.r) * (re.r - ov.r) + (re.c - ov.c) * (re.c - ov.c), 'r': re.r, 'c': re.c}) AS class_id FROM ov JOIN re ON re.map_id = ov.map_id GROUP BY ALL),
res AS (SELECT * FROM re UNION ALL SELECT ov.map_id, ov.r, ov.c, CAST(coalesce(nn.class_id, 2) AS INT) FROM ov LEFT JOIN nn USING (map_id, r, c))"""
CELLS = """edge AS (SELECT map_id, CAST(floor((max(r) + 1) / 4) AS INT) AS h, CAST(floor((max(c) + 1) / 4) AS INT) AS w FROM label GROUP BY map_id)"""


def cells_of(src: str, out: str) -> str:
    return f"{out} AS (SELECT s.map_id, r, c, class_id, CAST(floor(r / 4) AS INT) AS cr, CAST(floor(c / 4) AS INT) AS cc FROM {src} s JOIN edge USING (map_id) WHERE floor(r / 4) < h AND floor(c / 4) < w)"


def down_of(src: str, out: str) -> str:
    return f"""{out}_n AS (SELECT map_id, cr, cc, class_id, count(*) AS n, min(r * 1000000 + c) AS pos FROM {src} GROUP BY ALL),
{out} AS (SELECT map_id, cr, cc, class_id FROM (SELECT *, row_number() OVER (PARTITION BY map_id, cr, cc ORDER BY CASE WHEN class_id IN (8, 9, 13, 14) THEN 0 WHEN class_id NOT IN (6, 12) THEN 1 ELSE 2 END,
  CASE WHEN class_id IN (8, 9, 13, 14) THEN list_position({FAST}, class_id) ELSE 0 END, CASE WHEN class_id IN (6, 12) THEN 0 ELSE -n END, CASE WHEN class_id IN (6, 12) THEN pos ELSE 0 END, class_id) AS k FROM {out}_n) WHERE k = 1)"""


DENSITY = "dens AS (SELECT map_id, cr, cc, avg(CASE WHEN class_id = 11 THEN 1.0 ELSE 0.0 END) AS density FROM rawcell GROUP BY ALL)"
GRID = f"""{D.LABEL}, {DIM}, {RESOLVED}, {CELLS}, {cells_of("res", "cell")}, {down_of("cell", "down")}, {cells_of("label", "rawcell")}, {DENSITY},
grid AS (SELECT down.map_id, cr, cc, down.class_id, density, CASE WHEN coalesce(speed, 0.2) > 0 THEN 4 / coalesce(speed, 0.2) * (1 + 2.0 * density) END AS time_s FROM down JOIN dens USING (map_id, cr, cc) LEFT JOIN dim USING (class_id))"""


@query("cost_grid", f"WITH {GRID} SELECT map_id, cr, cc, class_id, round(density, 6) AS density, round(time_s, 6) AS time_s, time_s IS NOT NULL AND time_s < 1e8 AS passable FROM grid")
def cost_grid(spark, sf_dir):
    g = R.cost_grid(D.label(spark, sf_dir))
    return g.withColumn("density", F.round("density", 6)).withColumn("time_s", F.round("time_s", 6))


@query("overlay_resolve", f"WITH {D.LABEL}, {RESOLVED} SELECT map_id, r, c, class_id FROM res")
def overlay_resolve(spark, sf_dir):
    return R.resolve_overlays(D.label(spark, sf_dir))


@query("downsample_mode", f"WITH {D.LABEL}, {CELLS}, {cells_of('label', 'cell')}, {down_of('cell', 'down')} SELECT map_id, cr, cc, class_id FROM down")
def downsample_mode(spark, sf_dir):
    return R.downsample(D.label(spark, sf_dir), 4)


@query("contour_density", f"WITH {D.LABEL}, {CELLS}, {cells_of('label', 'rawcell')}, {DENSITY} SELECT map_id, cr, cc, round(density, 6) AS density FROM dens")
def contour_density(spark, sf_dir):
    return R.contour_density(D.label(spark, sf_dir), 4).withColumn("density", F.round("density", 6))


@query("channels_to_index", f"""WITH {D.LABEL}, {D.CHANNELS}, {DIM}, t AS (SELECT map_id, r, c, arg_min(channel, priority) AS top FROM channels JOIN dim ON channel = class_id WHERE value > 0 AND channel <> 0 GROUP BY ALL)
SELECT map_id, r, c, CAST(coalesce(top, 0) AS INT) AS class_id FROM label LEFT JOIN t USING (map_id, r, c)""")
def channels_to_index(spark, sf_dir):
    return R.channels_to_index(D.channels(spark, sf_dir), D.label(spark, sf_dir))


@query("class_lookup", f"WITH {DIM} SELECT class_id, name, is_empty, is_critical, is_linear, priority FROM dim")
def class_lookup(spark, sf_dir):
    return dims.dim_class(spark).select("class_id", "name", "is_empty", "is_critical", "is_linear", "priority")


@query("colorize", f"WITH {D.LABEL}, {DIM} SELECT map_id, r, c, coalesce(red, 0) AS red, coalesce(green, 0) AS green, coalesce(blue, 0) AS blue FROM label LEFT JOIN dim USING (class_id)")
def colorize(spark, sf_dir):
    return R.colorize(D.label(spark, sf_dir))


@query("overlay_blend", f"""WITH {D.LABEL}, {DIM}, {IMAGE} SELECT map_id, r, c, {', '.join(f"CAST(CASE WHEN class_id = 0 THEN i.{n} ELSE floor(i.{n} * (1 - CAST(0.45 AS DOUBLE)) + dim.{n} * CAST(0.45 AS DOUBLE)) END AS INT) AS {n}" for n in ('red', 'green', 'blue'))}
FROM image i JOIN label USING (map_id, r, c) LEFT JOIN dim USING (class_id)""")
def overlay_blend(spark, sf_dir):
    return R.overlay_blend(image(spark, sf_dir), D.label(spark, sf_dir), 0.45)


@query("cost_export", f"WITH {D.LABEL}, {DIM} SELECT map_id, r, c, coalesce(cost, 5.0) AS cost FROM label LEFT JOIN dim USING (class_id)")
def cost_export(spark, sf_dir):
    return R.cost_export(D.label(spark, sf_dir))


@query("cost_png_scale", f"""WITH {D.LABEL}, {DIM}, k AS (SELECT map_id, r, c, coalesce(cost, 5.0) AS cost FROM label LEFT JOIN dim USING (class_id)), m AS (SELECT map_id, greatest(max(cost), 1.0) AS top FROM k WHERE cost < 1e8 GROUP BY ALL)
SELECT map_id, r, c, CAST(CASE WHEN cost >= 1e8 THEN 255 ELSE floor(greatest(0.0, least(255.0, cost / coalesce(top, 1.0) * 255))) END AS INT) AS grey FROM k LEFT JOIN m USING (map_id)""")
def cost_png_scale(spark, sf_dir):
    return R.cost_image(R.cost_export(D.label(spark, sf_dir)))


@query("close_linear", f"""WITH {D.LABEL}, plus(dr, dc) AS (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)),
g AS (SELECT DISTINCT l.map_id, l.r + dr AS r, l.c + dc AS c, l.class_id FROM label l, plus WHERE l.class_id IN (8, 9, 11, 12, 13, 14)),
gi AS (SELECT g.* FROM g SEMI JOIN label l ON l.map_id = g.map_id AND l.r = g.r AND l.c = g.c),
s AS (SELECT map_id, r + dr AS r, c + dc AS c, class_id, count(*) AS n FROM gi, plus GROUP BY ALL), room AS (SELECT map_id, r + dr AS r, c + dc AS c, count(*) AS room FROM label, plus GROUP BY ALL),
f AS (SELECT map_id, r, c, arg_min(class_id, list_position([8, 9, 11, 12, 13, 14], class_id)) AS fill FROM s JOIN room USING (map_id, r, c) WHERE n = room GROUP BY ALL)
SELECT map_id, r, c, CASE WHEN class_id = 0 AND fill IS NOT NULL THEN fill ELSE class_id END AS class_id FROM label LEFT JOIN f USING (map_id, r, c)""")
def close_linear(spark, sf_dir):
    return R.close_linear(D.label(spark, sf_dir))


@query("speed_field", f"""WITH {D.LABEL}, {DIM}, {RESOLVED}, v AS (SELECT map_id, r, c, coalesce(speed, 0.0) AS speed FROM res LEFT JOIN dim USING (class_id)), m AS (SELECT map_id, coalesce(max(CASE WHEN speed > 0 THEN speed END), 1.0) AS top FROM v GROUP BY ALL)
SELECT map_id, r, c, speed, round(least(greatest(speed / top, 0.0), 1.0), 6) AS level FROM v JOIN m USING (map_id)""")
def speed_field(spark, sf_dir):
    return R.speed_field(D.label(spark, sf_dir)).withColumn("level", F.round("level", 6))


@query("class_share", f"""WITH {D.LABEL}, {DIM}, n AS (SELECT map_id, class_id, count(*) AS n FROM label GROUP BY ALL)
SELECT map_id, class_id, coalesce(name, 'class_' || class_id) AS name, coalesce(speed, 0.0) AS speed, n, round(n * 100 / sum(n) OVER (PARTITION BY map_id), 6) AS share FROM n LEFT JOIN dim USING (class_id)""")
def class_share(spark, sf_dir):
    return R.class_share(D.label(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query("speed_legend", f"WITH {DIM} SELECT name, speed, row_number() OVER (ORDER BY -speed, name) AS place FROM dim WHERE NOT is_overlay")
def speed_legend(spark, sf_dir):
    """Sixteen rows, so one ordered window over all."""
    from pyspark.sql import Window

    d = dims.dim_class(spark).where(~F.col("is_overlay"))
    return d.select("name", "speed", F.row_number().over(Window.orderBy(-F.col("speed"), "name")).cast("long").alias("place"))


@query("class_reveal_order", f"WITH {D.LABEL}, {DIM}, p AS (SELECT DISTINCT map_id, class_id FROM label) SELECT map_id, class_id, row_number() OVER (PARTITION BY map_id ORDER BY speed, class_id) AS place FROM p JOIN dim USING (class_id)")
def class_reveal_order(spark, sf_dir):
    from pyspark.sql import Window

    p = D.label(spark, sf_dir).select("map_id", "class_id").distinct()
    return p.join(F.broadcast(dims.dim_class(spark).select("class_id", "speed")), "class_id").select("map_id", "class_id", F.row_number().over(Window.partitionBy("map_id").orderBy("speed", "class_id")).cast("long").alias("place"))


@query("max_speed", f"WITH {D.LABEL}, {DIM} SELECT map_id, coalesce(max(CASE WHEN speed > 0 THEN speed END), 1.0) AS max_speed FROM label JOIN dim USING (class_id) GROUP BY ALL")
def max_speed(spark, sf_dir):
    return D.label(spark, sf_dir).join(F.broadcast(dims.dim_class(spark)), "class_id").groupBy("map_id").agg(F.coalesce(F.max(F.when(F.col("speed") > 0, F.col("speed"))), F.lit(1.0)).alias("max_speed"))


@query("speeds_from_costs", f"WITH {DIM} SELECT class_id, CASE WHEN cost >= 1e7 THEN 0.0 ELSE round(1.0 / greatest(cost, 1e-6), 6) END AS speed FROM dim")
def speeds_from_costs(spark, sf_dir):
    from ..functions.scalars import speed_from_cost

    return dims.dim_class(spark).select("class_id", F.round(speed_from_cost(F.col("cost"), 1.0), 6).alias("speed"))


@query("scale_speeds", f"WITH {DIM} SELECT class_id, round(CASE WHEN speed <= 0 THEN 0.0 ELSE speed * (0.5 / (SELECT speed FROM dim WHERE class_id = 2)) END, 6) AS speed FROM dim")
def scale_speeds(spark, sf_dir):
    from ..functions.scalars import scaled_speeds

    return scaled_speeds(dims.dim_class(spark), 0.5).select("class_id", F.round("speed", 6).alias("speed"))


@query("meters_per_pixel", "SELECT p_partkey, round(coalesce(CASE WHEN p_size % 3 = 0 THEN p_size / 10 END, CASE WHEN p_size % 3 = 1 THEN p_size * 1000 * 0.0254 / coalesce(CASE WHEN p_partkey % 2 = 0 THEN 150 END, 300) END, 1.0), 6) AS m_per_px FROM part")
def meters_per_pixel(spark, sf_dir):
    from ..functions.scalars import resolution

    s, k = F.col("p_size"), F.col("p_partkey")
    return D.table(spark, sf_dir, "part").select("p_partkey", F.round(resolution(F.when(s % 3 == 0, s / 10), F.when(s % 3 == 1, s * 1000), F.when(k % 2 == 0, F.lit(150))), 6).alias("m_per_px"))


@query("pixel_to_cell", f"WITH {D.DETECTIONS} SELECT seq, CAST(least(greatest(floor(trunc(x) / 4), 0), 199) AS INT) AS cc, CAST(least(greatest(floor(trunc(y) / 4), 0), 149) AS INT) AS cr, (least(greatest(floor(trunc(x) / 4), 0), 199) + 0.5) * 4 AS px FROM det")
def pixel_to_cell(spark, sf_dir):
    from ..functions.scalars import cell_of, pixel_of

    d = D.detections(spark, sf_dir)
    return d.select("seq", cell_of(F.col("x"), 4, 200).alias("cc"), cell_of(F.col("y"), 4, 150).alias("cr"), pixel_of(cell_of(F.col("x"), 4, 200), 4).alias("px"))


@query("pink_mask", f"WITH {D.LABEL}, {IMAGE} SELECT map_id, r, c FROM image WHERE red > 90 AND blue > 70 AND green < 0.85 * least(red, blue) AND (red + blue) / 2 - green > 25")
def pink_mask(spark, sf_dir):
    return image(spark, sf_dir).where(R.pink(F.col("red"), F.col("green"), F.col("blue"))).select("map_id", "r", "c")


HSV = """mx AS (SELECT *, greatest(red, green, blue) AS t, least(red, green, blue) AS l FROM image), hs AS (SELECT map_id, r, c, t, l, coalesce(CASE WHEN t = l THEN NULL WHEN t = red THEN 60.0 * (green - blue) / (t - l) WHEN t = green THEN 120 + 60.0 * (blue - red) / (t - l) ELSE 240 + 60.0 * (red - green) / (t - l) END, 0.0) AS h FROM mx)"""


@query("pink_mask_hsv", f"WITH {D.LABEL}, {IMAGE}, {HSV} SELECT map_id, r, c, round(CASE WHEN h < 0 THEN h + 360 ELSE h END / 2, 6) AS hue, round(CASE WHEN t > 0 THEN 255.0 * (t - l) / t ELSE 0.0 END, 6) AS sat FROM hs WHERE (CASE WHEN h < 0 THEN h + 360 ELSE h END / 2 >= 135 OR CASE WHEN h < 0 THEN h + 360 ELSE h END / 2 <= 15) AND CASE WHEN t > 0 THEN 255.0 * (t - l) / t ELSE 0.0 END >= 60")
def pink_mask_hsv(spark, sf_dir):
    h, s, _ = R.hsv(F.col("red"), F.col("green"), F.col("blue"))
    return image(spark, sf_dir).select("map_id", "r", "c", h.alias("hue"), s.alias("sat")).where(((F.col("hue") >= 135) | (F.col("hue") <= 15)) & (F.col("sat") >= 60)).select("map_id", "r", "c", F.round("hue", 6).alias("hue"), F.round("sat", 6).alias("sat"))


MASKS = "pk AS (SELECT map_id, r, c FROM image WHERE red > 90 AND blue > 70 AND green < 0.85 * least(red, blue) AND (red + blue) / 2 - green > 25), pr AS (SELECT map_id, r, c FROM label WHERE class_id = 15)"


@query("mask_set_ops", f"WITH {D.LABEL}, {IMAGE}, {MASKS} SELECT 'or' AS op, * FROM (SELECT * FROM pk UNION SELECT * FROM pr) UNION ALL SELECT 'and', * FROM (SELECT * FROM pk INTERSECT SELECT * FROM pr) UNION ALL SELECT 'and_not', * FROM (SELECT * FROM pk EXCEPT SELECT * FROM pr)")
def mask_set_ops(spark, sf_dir):
    pk = pink_mask(spark, sf_dir)
    prior = D.label(spark, sf_dir).where(F.col("class_id") == 15).select("map_id", "r", "c")
    parts = [("or", pk.union(prior).distinct()), ("and", pk.intersect(prior)), ("and_not", pk.subtract(prior))]
    out = None
    for name, d in parts:
        d = d.select(F.lit(name).alias("op"), "*")
        out = d if out is None else out.union(d)
    return out


@query("normalise_pixels", f"WITH {D.LABEL}, {IMAGE} SELECT map_id, r, c, round((red / 255 - 0.485) / 0.229, 6) AS red, round((green / 255 - 0.456) / 0.224, 6) AS green, round((blue / 255 - 0.406) / 0.225, 6) AS blue FROM image")
def normalise_pixels(spark, sf_dir):
    mean, sd = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
    return image(spark, sf_dir).select("map_id", "r", "c", *[F.round((F.col(n) / 255 - m) / s, 6).alias(n) for n, m, s in zip(("red", "green", "blue"), mean, sd, strict=True)])


@query("distinct_classes", f"WITH {D.LABEL} SELECT map_id, list_sort(list(DISTINCT class_id))::VARCHAR AS classes FROM label GROUP BY map_id")
def distinct_classes(spark, sf_dir):
    return D.label(spark, sf_dir).groupBy("map_id").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_set("class_id")), ", "), F.lit("]")).alias("classes"))
