"""Queries over the cost grid: edges, times, tours, route descriptions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import points
from ..operators import graph as G
from ..operators import raster as R
from ..operators import tour as T
from ..sources import derived as D
from .raster_queries import GRID
from .registry import checkpoints as _checkpoints
from .registry import query

CELLS = f"{GRID}, cells AS MATERIALIZED (SELECT map_id, cr, cc, class_id, time_s FROM grid)"


def cells(spark, sf_dir):
    """The cost grid of whole maps, computed once: searches read it several times."""
    _checkpoints(spark)
    return R.cost_grid(D.label(spark, sf_dir)).select("map_id", "cr", "cc", "class_id", "time_s").checkpoint()


EDGES = """fr AS MATERIALIZED (SELECT * FROM cells WHERE time_s IS NOT NULL), mv(a, b) AS (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)), st AS (SELECT map_id, cr, cc, cr + a AS nr, cc + b AS nc, time_s AS t1, a * b <> 0 AS slant FROM fr, mv),
ed AS MATERIALIZED (SELECT s.map_id, s.cr, s.cc, s.nr, s.nc, (s.t1 + f.time_s) / 2 * CASE WHEN slant THEN 1.41421356237 ELSE 1.0 END AS w FROM st s JOIN fr f ON f.map_id = s.map_id AND f.cr = s.nr AND f.cc = s.nc
LEFT JOIN fr x ON x.map_id = s.map_id AND x.cr = s.cr AND x.cc = s.nc LEFT JOIN fr y ON y.map_id = s.map_id AND y.cr = s.nr AND y.cc = s.cc WHERE NOT slant OR x.cr IS NOT NULL OR y.cr IS NOT NULL)"""


@query("edges", f"WITH {CELLS}, {EDGES} SELECT map_id, cr, cc, nr, nc, round(w, 6) AS w FROM ed")
def edges(spark, sf_dir):
    return G.edges(cells(spark, sf_dir)).withColumn("w", F.round("w", 6))


SNAP = """eg AS (SELECT map_id, max(cr) AS h, max(cc) AS w FROM cells GROUP BY map_id), pts AS (SELECT map_id, course, point, i, number, least(greatest(floor(y / 4), 0), h) AS pr, least(greatest(floor(x / 4), 0), w) AS pc FROM controls JOIN eg USING (map_id)),
sn AS MATERIALIZED (SELECT map_id, course, point, i, number, cr, cc FROM (SELECT p.*, cr, cc, row_number() OVER (PARTITION BY point ORDER BY (cr - pr) * (cr - pr) + (cc - pc) * (cc - pc), cr, cc) AS k FROM pts p JOIN fr USING (map_id)) WHERE k = 1)"""


def snapped(spark, sf_dir, cs):
    """Every control's cell: map_id, course, point, i, number, cr, cc."""
    p = D.controls(spark, sf_dir)
    at = G.snap(p.select("map_id", F.col("point").alias("i"), "x", "y"), cs, 4).select("map_id", F.col("i").alias("point"), "cr", "cc")
    return at.join(p.select("map_id", "point", "course", "i", "number"), ["map_id", "point"])


def starts(spark, sf_dir, cs):
    """Where each course starts: its first control; the course is the source's number."""
    return snapped(spark, sf_dir, cs).where("i = 1").select("map_id", F.col("course").alias("i"), "cr", "cc")


@query("snap_points", f"WITH {CELLS}, {EDGES}, {D.CONTROLS}, {SNAP} SELECT course, i, number, cr, cc FROM sn")
def snap_points(spark, sf_dir):
    return snapped(spark, sf_dir, cells(spark, sf_dir)).select("course", "i", "number", "cr", "cc")


STARTS = "src AS (SELECT map_id, course AS s, cr, cc FROM sn WHERE i = 1)"
ALL_POINTS = "src AS (SELECT map_id, point AS s, cr, cc FROM sn)"
TIMES = """tm(map_id, s, cr, cc, t) USING KEY (map_id, s, cr, cc) AS (SELECT map_id, s, cr, cc, CAST(0 AS DOUBLE) AS t FROM src UNION SELECT w.map_id, w.s, w.nr, w.nc, w.t FROM (SELECT r.map_id, r.s, e.nr, e.nc, min(r.t + e.w) AS t FROM tm r JOIN ed e ON e.map_id = r.map_id AND e.cr = r.cr AND e.cc = r.cc GROUP BY ALL) w
LEFT JOIN recurring.tm k ON k.map_id = w.map_id AND k.s = w.s AND k.cr = w.nr AND k.cc = w.nc WHERE k.t IS NULL OR w.t < k.t)"""


def times_sql(tail: str, sources: str = STARTS) -> str:
    return f"WITH RECURSIVE {CELLS}, {EDGES}, {D.CONTROLS}, {SNAP}, {sources}, {TIMES} {tail}"


@query("dijkstra_times", times_sql("SELECT s AS course, cr, cc, round(t, 6) AS time_s FROM tm"))
def dijkstra_times(spark, sf_dir):
    """Times from each course's start to every cell of its map."""
    cs = cells(spark, sf_dir)
    return G.times_from(cs, starts(spark, sf_dir, cs)).select(F.col("i").alias("course"), "cr", "cc", F.round("time_s", 6).alias("time_s"))


@query("visit_order", times_sql("SELECT s AS course, cr, cc, row_number() OVER (PARTITION BY s ORDER BY round(t, 9), cc, cr) - 1 AS visit FROM tm"))
def visit_order(spark, sf_dir):
    cs = cells(spark, sf_dir)
    return G.visits_from(cs, starts(spark, sf_dir, cs)).select(F.col("i").alias("course"), "cr", "cc", F.col("visit").cast("long").alias("visit"))


@query("relaxed_times", times_sql("SELECT s AS course, cr, cc, round(t, 6) AS time_s FROM tm"))
def relaxed_times(spark, sf_dir):
    """The cross-check of the kernel, from the table of edges."""
    cs = cells(spark, sf_dir)
    return G.relax(cs, starts(spark, sf_dir, cs)).select(F.col("i").alias("course"), "cr", "cc", F.round("time_s", 6).alias("time_s"))


@query("tiled_times", times_sql("SELECT s AS course, cr, cc, round(t, 6) AS time_s FROM tm"))
def tiled_times(spark, sf_dir):
    """The same times tile by tile, as on maps beyond a task; tiles of eight cells, so that ways cross many."""
    cs = cells(spark, sf_dir)
    return G.tiled_times(cs, starts(spark, sf_dir, cs), side=8).select(F.col("i").alias("course"), "cr", "cc", F.round("time_s", 6).alias("time_s"))


@query("time_matrix", times_sql("SELECT a.course, a.i, b.i AS j, round(t, 6) AS time_s FROM sn a JOIN sn b ON b.map_id = a.map_id AND b.course = a.course JOIN tm ON tm.map_id = a.map_id AND tm.s = a.point AND tm.cr = b.cr AND tm.cc = b.cc", ALL_POINTS))
def time_matrix(spark, sf_dir):
    """Times between the controls of each course."""
    cs = cells(spark, sf_dir)
    points_ = snapped(spark, sf_dir, cs).select("map_id", F.col("course").alias("group"), "i", "cr", "cc")
    return G.time_matrix(cs, points_).select(F.col("group").alias("course"), "i", "j", F.round("time_s", 6).alias("time_s"))


# Tour problems with whole-number times: each course's start 0 and its controls.
PROBLEM = """ctl AS (SELECT course AS problem, i, number FROM controls), ends AS (SELECT problem, i FROM ctl UNION SELECT problem, 0 FROM ctl),
mx AS (SELECT a.problem, a.i, b.i AS j, CAST(CASE WHEN a.i = b.i THEN 0 ELSE 40 + (a.i * 37 + b.i * 53 + a.i * b.i * 11 + a.problem * 17) % 90 END AS DOUBLE) AS t FROM ends a JOIN ends b USING (problem)),
pt AS (SELECT problem, i, CAST(substr(CAST(number AS VARCHAR), 1, 1) AS INT) AS p FROM ctl)"""
BUDGET = 420.0


def problem(spark, sf_dir):
    """A problem for each course: its matrix (problem, i, j, time_s) and its points (problem, i, points)."""
    _checkpoints(spark)
    c = D.controls(spark, sf_dir).select(F.col("course").alias("problem"), "i", "number")
    ends = c.groupBy("problem").agg(F.array_union(F.array(F.lit(0)), F.collect_set("i")).alias("ends"))  # eight at most
    i, j = F.col("i"), F.col("j")
    m = ends.select("problem", "ends", F.explode("ends").alias("i")).select("problem", "i", F.explode("ends").alias("j"))
    m = m.select("problem", "i", "j", F.when(i == j, 0).otherwise(40 + (i * 37 + j * 53 + i * j * 11 + F.col("problem") * 17) % 90).cast("double").alias("time_s"))
    return m, c.select("problem", "i", points(F.col("number")).alias("points"))


STATES = f"""st(problem, mask, last, t) AS (SELECT problem, CAST(1 AS BIGINT) << (j - 1), j, t FROM mx WHERE i = 0 AND j > 0 AND t <= {BUDGET} UNION SELECT s.problem, s.mask | (CAST(1 AS BIGINT) << (m.j - 1)), m.j, s.t + m.t FROM st s JOIN mx m ON m.problem = s.problem AND m.i = s.last AND m.j > 0 AND m.j <> s.last WHERE s.mask & (CAST(1 AS BIGINT) << (m.j - 1)) = 0 AND s.t + m.t <= {BUDGET}),
bs AS (SELECT problem, mask, last, min(t) AS t FROM st GROUP BY ALL), tr AS (SELECT bs.problem, mask, last, bit_count(mask) AS size, bs.t + mx.t AS total_s, (SELECT sum(p) FROM pt WHERE pt.problem = bs.problem AND mask & (CAST(1 AS BIGINT) << (i - 1)) <> 0) AS points FROM bs JOIN mx ON mx.problem = bs.problem AND mx.i = last AND mx.j = 0 WHERE bs.t + mx.t <= {BUDGET})"""


def solved(spark, sf_dir):
    m, p = problem(spark, sf_dir)
    return T.tours(T.exact_states(m, BUDGET), m, p, BUDGET)


@query("tour_dp", f"WITH RECURSIVE {D.CONTROLS}, {PROBLEM}, {STATES} SELECT problem AS course, mask, last, CAST(size AS INT) AS size, total_s, CAST(points AS BIGINT) AS points FROM (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY points DESC, total_s, mask, last) AS k FROM tr) WHERE k = 1")
def tour_dp(spark, sf_dir):
    """Each course's best tour."""
    return T.best(solved(spark, sf_dir)).select(F.col("problem").alias("course"), "mask", "last", "size", "total_s", "points")


@query("best_by_size", f"WITH RECURSIVE {D.CONTROLS}, {PROBLEM}, {STATES} SELECT problem AS course, mask, last, CAST(size AS INT) AS size, total_s, CAST(points AS BIGINT) AS points FROM (SELECT *, row_number() OVER (PARTITION BY problem, size ORDER BY points DESC, total_s, mask, last) AS k FROM tr) WHERE k = 1")
def best_by_size(spark, sf_dir):
    return T.best(solved(spark, sf_dir), "size").select(F.col("problem").alias("course"), "mask", "last", "size", "total_s", "points")


@query("tour_improvements", f"WITH RECURSIVE {D.CONTROLS}, {PROBLEM}, {STATES} SELECT problem AS course, mask, last, total_s, CAST(points AS BIGINT) AS points FROM tr a WHERE NOT EXISTS (SELECT 1 FROM tr b WHERE b.problem = a.problem AND (b.mask < a.mask OR (b.mask = a.mask AND b.last < a.last)) AND (b.points > a.points OR (b.points = a.points AND b.total_s <= a.total_s)))")
def tour_improvements(spark, sf_dir):
    """Tours that beat all before them in the order of (set, last): more points, or as many in less time."""
    return T.improvements(solved(spark, sf_dir)).select(F.col("problem").alias("course"), "mask", "last", "total_s", "points")


#: A course's controls in the order of their numbers, from the start 0 and back to it.
WALK = "wk AS (SELECT problem, row_number() OVER (PARTITION BY problem ORDER BY o) AS leg, a, b FROM (SELECT problem, o, i AS b, lag(i) OVER (PARTITION BY problem ORDER BY o) AS a FROM (SELECT problem, i, number * 10 + i AS o FROM ctl UNION ALL SELECT DISTINCT problem, 0, 0 FROM ctl UNION ALL SELECT DISTINCT problem, 0, 1000000 FROM ctl)) WHERE a IS NOT NULL)"


def walk(spark, sf_dir):
    """problem, leg (from 1), a, b: from the start over all controls of a course by number, and back."""
    c = D.controls(spark, sf_dir).select(F.col("course").alias("problem"), "i", (F.col("number") * 10 + F.col("i")).alias("o"))
    ends = c.select("problem").distinct().select("problem", F.lit(0).alias("i"), F.explode(F.array(F.lit(0), F.lit(1000000))).alias("o"))
    order = Window.partitionBy("problem").orderBy("o")
    legs = c.unionByName(ends).select("problem", F.lag("i").over(order).alias("a"), F.col("i").alias("b"), (F.row_number().over(order) - 1).cast("long").alias("leg"))
    return legs.where(F.col("a").isNotNull())


@query("tour_time", f"WITH {D.CONTROLS}, {PROBLEM}, {WALK} SELECT problem AS course, sum(t) AS total_s, count(*) AS legs FROM wk JOIN mx USING (problem) WHERE mx.i = a AND mx.j = b GROUP BY problem")
def tour_time(spark, sf_dir):
    m, _ = problem(spark, sf_dir)
    legs = walk(spark, sf_dir).join(m.withColumnsRenamed({"i": "a", "j": "b"}), ["problem", "a", "b"])
    return legs.groupBy(F.col("problem").alias("course")).agg(F.sum("time_s").alias("total_s"), F.count("*").alias("legs"))


@query("points", f"WITH {D.CONTROLS} SELECT course, i, number, CAST(substr(CAST(abs(number) AS VARCHAR), 1, 1) AS INT) AS points FROM controls")
def points_query(spark, sf_dir):
    return D.controls(spark, sf_dir).select("course", "i", "number", points(F.col("number")).alias("points"))


@query("plan_table", f"WITH {D.CONTROLS}, {PROBLEM}, {WALK} SELECT wk.problem AS course, leg, b AS i, p AS points, round_even(t / 60, 2) AS leg_min, round_even(sum(t) OVER o / 60, 2) AS cumulative_min, CAST(sum(p) OVER o AS BIGINT) AS cumulative_points FROM wk JOIN mx ON mx.problem = wk.problem AND mx.i = a AND mx.j = b LEFT JOIN pt ON pt.problem = wk.problem AND pt.i = b WINDOW o AS (PARTITION BY wk.problem ORDER BY leg)")
def plan_table(spark, sf_dir):
    """Legs with cumulative times and points; a plan has as many rows as legs."""
    m, p = problem(spark, sf_dir)
    run = Window.partitionBy("problem").orderBy("leg")
    legs = walk(spark, sf_dir).join(m.withColumnsRenamed({"i": "a", "j": "b"}), ["problem", "a", "b"]).join(p.withColumnRenamed("i", "b"), ["problem", "b"], "left")
    return legs.select(F.col("problem").alias("course"), "leg", F.col("b").alias("i"), "points", F.bround(F.col("time_s") / 60, 2).alias("leg_min"), F.bround(F.sum("time_s").over(run) / 60, 2).alias("cumulative_min"), F.sum("points").over(run).alias("cumulative_points"))


# Walks for the descriptive queries.
STEP = f"""WITH {CELLS}, {D.WALKS}, sj AS (SELECT s.*, class_id, coalesce(time_s, 99.0) AS time_s FROM steps s JOIN cells USING (map_id, cr, cc)),
d AS (SELECT route, seq, class_id, CASE WHEN cr <> lag(cr) OVER o AND cc <> lag(cc) OVER o THEN 1.41421356237 ELSE 1.0 END AS f, (time_s + lag(time_s) OVER o) / 2 AS t FROM sj WINDOW o AS (PARTITION BY route ORDER BY seq))"""


steps = D.walks


def timed_cells(spark, sf_dir):
    return cells(spark, sf_dir).withColumn("time_s", F.coalesce("time_s", F.lit(99.0)))


@query("retime", f"{STEP} SELECT route, round(sum(t * f), 6) AS time_s, round(sum(f), 6) AS length FROM d WHERE t IS NOT NULL GROUP BY route")
def retime(spark, sf_dir):
    return G.retimed(steps(spark, sf_dir), timed_cells(spark, sf_dir)).select("route", F.round("time_s", 6).alias("time_s"), F.round("length", 6).alias("length"))


RLE = f"""{STEP}, n AS (SELECT *, CASE WHEN class_id = lag(class_id) OVER (PARTITION BY route ORDER BY seq) THEN 0 ELSE 1 END AS nw FROM d WHERE t IS NOT NULL), g AS (SELECT *, sum(nw) OVER (PARTITION BY route ORDER BY seq) AS run FROM n)"""


@query("rle_segments", f"{RLE}, q AS (SELECT route, CAST(run AS BIGINT) AS run, class_id, sum(f * 4.0) AS m, sum(t * f) AS s, count(*) AS n_cells FROM g GROUP BY ALL) SELECT route, run, class_id, round(m, 6) AS distance_m, round(s, 6) AS time_s, n_cells, round(m / sum(m) OVER (PARTITION BY route), 6) AS share FROM q")
def rle_segments(spark, sf_dir):
    j = steps(spark, sf_dir).join(timed_cells(spark, sf_dir), ["map_id", "cr", "cc"])
    return G.segments(j, 4.0).select("route", "run", "class_id", F.round("distance_m", 6).alias("distance_m"), F.round("time_s", 6).alias("time_s"), "n_cells", F.round("share", 6).alias("share"))


@query("terrain_distance", f"{RLE} SELECT route, class_id, round(sum(f * 4.0), 6) AS distance_m FROM g GROUP BY ALL")
def terrain_distance(spark, sf_dir):
    j = steps(spark, sf_dir).join(timed_cells(spark, sf_dir), ["map_id", "cr", "cc"])
    return G.segments(j, 4.0).groupBy("route", "class_id").agg(F.round(F.sum("distance_m"), 6).alias("distance_m"))


@query("route_similarity", f"WITH {D.WALKS}, c AS (SELECT DISTINCT route, map_id, cr, cc FROM steps), n AS (SELECT route, count(*) AS n FROM c GROUP BY route), k AS (SELECT a.route AS a, b.route AS b, count(*) AS nb FROM c a JOIN c b ON a.map_id = b.map_id AND a.cr = b.cr AND a.cc = b.cc AND a.route < b.route GROUP BY ALL) SELECT k.a, k.b, round(nb / least(x.n, y.n), 6) AS similarity FROM k JOIN n x ON x.route = k.a JOIN n y ON y.route = k.b")
def route_similarity(spark, sf_dir):
    c = steps(spark, sf_dir).select("route", "map_id", "cr", "cc").distinct()
    n = c.groupBy("route").agg(F.count("*").alias("n"))
    k = c.withColumnRenamed("route", "a").join(c.withColumnRenamed("route", "b"), ["map_id", "cr", "cc"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    k = k.join(n.select(F.col("route").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("route").alias("b"), F.col("n").alias("nb")), "b")
    return k.select("a", "b", F.round(F.col("both") / F.least("na", "nb"), 6).alias("similarity"))


@query("corridor_inflate", f"WITH {CELLS}, {D.WALKS}, k AS (SELECT map_id, cr, cc, count(DISTINCT route) AS n FROM (SELECT route, map_id, cr + a AS cr, cc + b AS cc FROM steps, (SELECT unnest(range(-1, 2)) AS a), (SELECT unnest(range(-1, 2)) AS b)) GROUP BY ALL) SELECT map_id, cr, cc, round(time_s * pow(CAST(1.05 AS DOUBLE), coalesce(n, 0)), 6) AS time_s FROM cells LEFT JOIN k USING (map_id, cr, cc)")
def corridor_inflate(spark, sf_dir):
    """Every walk's corridor penalised, once for each walk."""
    return G.inflate(cells(spark, sf_dir), steps(spark, sf_dir), 1, 1.05).select("map_id", "cr", "cc", F.round("time_s", 6).alias("time_s"))


@query("k_routes")
def k_routes(spark, sf_dir):
    """Three routes from each course's first control to its second."""
    cs = cells(spark, sf_dir)
    s = snapped(spark, sf_dir, cs)
    end = lambda i, r, c: s.where(F.col("i") == i).select("map_id", F.col("course").alias("pair"), F.col("cr").alias(r), F.col("cc").alias(c))
    return G.k_routes(cs, end(1, "sr", "sc").join(end(2, "gr", "gc"), ["map_id", "pair"])).withColumn("time_s", F.round("time_s", 6))


@query("tour_legs", times_sql("""SELECT course, leg, round(t, 6) AS time_s, round(sum(t) OVER (PARTITION BY course ORDER BY leg), 6) AS upto_s FROM (WITH o AS (SELECT *, lead(point) OVER w AS nxt, row_number() OVER w AS leg FROM sn WINDOW w AS (PARTITION BY course ORDER BY number, i))
SELECT o.course, CAST(o.leg AS INT) AS leg, t FROM o JOIN sn b ON b.point = o.nxt JOIN tm ON tm.map_id = o.map_id AND tm.s = o.point AND tm.cr = b.cr AND tm.cc = b.cc)""", ALL_POINTS))
def tour_legs(spark, sf_dir):
    """Each leg's fastest time, by A*, and the time up to its end: every course over its controls by number."""
    cs = cells(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("course").orderBy("number", "i"))
    ways = snapped(spark, sf_dir, cs).select("map_id", F.col("course").alias("tour"), place.alias("place"), "cr", "cc")
    each = G.legs(cs, ways).where("seq = 0").select("tour", "leg", "time_s")
    return each.select(F.col("tour").alias("course"), "leg", F.round("time_s", 6).alias("time_s"), F.round(F.sum("time_s").over(Window.partitionBy("tour").orderBy("leg")), 6).alias("upto_s"))


POLY = "p AS (SELECT route, seq, cr, cc FROM steps), l AS (SELECT route, seq, cr, cc, CAST(floor(seq / 4) AS INT) + 1 AS leg FROM p UNION ALL SELECT route, seq, cr, cc, CAST(floor(seq / 4) AS INT) FROM p WHERE seq % 4 = 0 AND seq > 0)"


@query("tour_polyline", f"WITH {D.WALKS}, {POLY}, k AS (SELECT route, leg, seq, cr, cc, row_number() OVER (PARTITION BY route, leg ORDER BY seq) AS n FROM l) SELECT route, string_agg(printf('%.1f,%.1f', (cc + 0.5) * 4, (cr + 0.5) * 4), ';' ORDER BY leg, seq) AS pixels FROM k WHERE leg = 1 OR n > 1 GROUP BY route")
def tour_polyline(spark, sf_dir):
    """Pixel centres of a walk in order, put together from legs of four steps that share their ends."""
    p = steps(spark, sf_dir).withColumn("leg", (F.floor(F.col("seq") / 4) + 1).cast("int"))
    shared = p.where("seq % 4 = 0 AND seq > 0").withColumn("leg", F.col("leg") - 1)
    legs = p.union(shared).withColumn("seq", F.row_number().over(Window.partitionBy("route", "leg").orderBy("seq")) - 1)
    lines = G.polylines(legs.withColumnRenamed("route", "tour"), 4)
    return lines.select(F.col("tour").alias("route"), F.array_join(F.transform("pixels", lambda q: F.concat_ws(",", q["x"].cast("decimal(12,1)").cast("string"), q["y"].cast("decimal(12,1)").cast("string"))), ";").alias("pixels"))


@query("smooth_segments")
def smooth_segments(spark, sf_dir):
    return G.smoothed(rle_segments(spark, sf_dir).drop("share").withColumn("run", F.col("run").cast("int")))


@query("greedy_local")
def greedy_local(spark, sf_dir):
    """Each course's tour by insertion and local search."""
    return T.heuristic(*problem(spark, sf_dir), BUDGET)
