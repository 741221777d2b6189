"""Hand-checked cases."""

import itertools
import json
import math
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fellside import dims
from fellside.functions import scalars
from fellside.operators import augment, detect, graph, masks, metrics, raster, refine, regions, tiling, tour
from fellside.operators import settings as S
from fellside.plans import api
from fellside.sources import files
from fellside.streaming import live


def pixels(spark, grid):
    return spark.createDataFrame([(0, r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row)], "map_id int, r int, c int, class_id int")


@pytest.mark.parametrize(("block", "want"), [([1, 1, 2, 2], 1), ([8, 1, 1, 1], 8), ([6, 12, 12, 12], 6), ([6, 2, 6, 6], 2), ([13, 9, 9, 1], 9)])
def test_downsample(spark, block, want):
    assert raster.downsample(pixels(spark, [block[:2], block[2:]]), 2).first().class_id == want


def test_overlays_take_the_nearest(spark):
    assert [r.class_id for r in raster.resolve_overlays(pixels(spark, [[1, 11, 2]])).orderBy("c").collect()] == [1, 1, 2]
    assert {r.class_id for r in raster.resolve_overlays(pixels(spark, [[11, 15]])).collect()} == {2}
    far = raster.resolve_overlays(pixels(spark, [[11] * 12 + [5]])).collect()
    assert {r.class_id for r in far} == {5} and len(far) == 13


def test_images_without_rings_have_a_radius(spark):
    images = spark.createDataFrame([(1, 100, 90), (2, 100, 90), (3, 1000, 700), (4, 700, 9000)], "image int, height int, width int")
    rings = spark.createDataFrame([(1, r) for r in (20.0, 21.0, 22.0, 90.0)], "image int, radius double")
    assert {r.image: round(r.radius, 9) for r in detect.ring_radius(images, rings).collect()} == {1: 21.0, 2: 12.0, 3: 18.0, 4: 40.0}


def test_cost(spark):
    r = raster.cost_grid(pixels(spark, [[2, 2], [2, 11]]), 2).first()
    assert (r.density, r.time_s, r.passable) == (0.25, 3.0, True)


def test_closing(spark):
    assert [r.class_id for r in raster.close_linear(pixels(spark, [[8, 0, 8]])).orderBy("c").collect()] == [8, 8, 8]


def cells(spark, grid):
    return spark.createDataFrame([(0, r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row)], "map_id int, cr int, cc int, time_s double")


def test_corner_rule(spark):
    both, one = cells(spark, [[1.0, None], [None, 1.0]]), cells(spark, [[1.0, None], [1.0, 1.0]])
    slants = lambda c: graph.edges(c).where("cr <> nr AND cc <> nc").count()
    assert slants(both) == 0 and slants(one) == 2


def test_times_agree_with_joins(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = np.random.default_rng(1)
    grid = [[None if rng.random() < 0.2 else float(rng.integers(1, 9)) for _ in range(9)] for _ in range(9)]
    grid[0][0] = 1.0
    c = cells(spark, grid)
    s = spark.createDataFrame([(0, 0, 0, 0)], "map_id int, i int, cr int, cc int")
    key = lambda df: sorted((r.cr, r.cc, round(r.time_s, 9)) for r in df.collect())
    assert key(graph.times_from(c, s)) == key(graph.relax(c, s))


def test_goal_search_has_the_same_time():
    rng = np.random.default_rng(2)
    grid = rng.integers(1, 9, (15, 15)).astype(float)
    grid[rng.random((15, 15)) < 0.15] = np.inf
    grid[0, 0] = grid[14, 14] = 1.0
    full, *_ = graph.search(grid, (0, 0))
    best, parent, visit = graph.search(grid, (0, 0), (14, 14))
    assert best[14, 14] == pytest.approx(full[14, 14]) and (visit >= 0).sum() <= 225
    path = graph.trail(parent, (0, 0), (14, 14))
    assert path[0] == (0, 0) and graph._walked(grid, path)[0] == pytest.approx(full[14, 14])
    even = np.ones((15, 15))
    assert (graph.search(even, (0, 0), (0, 14))[2] >= 0).sum() < 60  # the goal draws the search


def test_far_overlays(spark):
    """Distances over 600 pixels, and a place whose row and column hold overlays only."""
    line = pixels(spark, [[11] * 650 + [5]])
    assert {r.class_id for r in raster.resolve_overlays(line).collect()} == {5}
    grid = [[15] * 7 for _ in range(7)]
    grid[0][3], grid[5][6], grid[3][0] = 4, 8, 9
    got = {(r.r, r.c): r.class_id for r in raster.resolve_overlays(pixels(spark, grid)).collect()}
    real = [(r, c) for r in range(7) for c in range(7) if grid[r][c] != 15]
    near = lambda r, c: min(real, key=lambda q: ((q[0] - r) ** 2 + (q[1] - c) ** 2, q))
    assert got == {(r, c): grid[near(r, c)[0]][near(r, c)[1]] for r in range(7) for c in range(7)}


def test_snapping_far_and_nowhere(spark):
    grid = [[None] * 90 for _ in range(3)]
    grid[1][88] = 2.0
    p = spark.createDataFrame([(0, 1, 2.0, 2.0)], "map_id int, i int, x double, y double")
    assert [(r.cr, r.cc) for r in graph.snap(p, cells(spark, grid), 4).collect()] == [(1, 88)]
    with pytest.raises(ValueError, match="no passable cell"):
        graph.snap(p, cells(spark, [[None, None]]), 4)


def test_legs(spark):
    c = cells(spark, [[1.0, 3.0, 1.0], [None, None, None]])
    ways = spark.createDataFrame([(0, 0, n, 0, k) for n, k in enumerate((0, 2, 1))], "map_id int, tour int, place int, cr int, cc int")
    way = graph.legs(c, ways)
    assert [(r.leg, r.seq, r.cc, r.time_s, r.length) for r in way.orderBy("leg", "seq").collect()] == [(1, 0, 0, 4.0, 2.0), (1, 1, 1, 4.0, 2.0), (1, 2, 2, 4.0, 2.0), (2, 0, 2, 2.0, 1.0), (2, 1, 1, 2.0, 1.0)]
    assert [(p["x"], p["y"]) for p in graph.polylines(way, 4).first().pixels] == [(2.0, 2.0), (6.0, 2.0), (10.0, 2.0), (6.0, 2.0)]


def test_window_weights(spark):
    """Half of one plus the cosine of pi times the place, -1 to 1: 0 at the ends, 1 in the middle."""
    w = {(r.i, r.j): r.weight for r in tiling.weights(5, "cosine", spark).collect()}
    assert w[2, 2] == pytest.approx(1) and w[0, 2] == pytest.approx(0) and w[1, 2] == pytest.approx(0.5) and w[1, 1] == pytest.approx(0.25)


def test_dice_and_weights_by_hand(spark):
    px = spark.createDataFrame([(0, 0.8, 1), (0, 0.4, 0), (1, 0.2, 0), (1, 0.6, 1), (2, 0.0, 0)], "class_id int, prob double, hit int")
    one = [1 - (1.6 + 1e-6) / (2.2 + 1e-6), 1 - (1.2 + 1e-6) / (1.8 + 1e-6), 0.0]
    assert metrics.soft_dice(px).first().loss == pytest.approx(sum(one) / 3)
    w = spark.createDataFrame([(0, 2.0), (1, 1.0), (2, 0.0)], "class_id int, weight double")
    assert metrics.soft_dice(px, w).first().loss == pytest.approx((2 * one[0] + one[1]) / 3)
    none = spark.createDataFrame([(0, 0.0), (1, 0.0), (2, 0.0)], "class_id int, weight double")
    assert metrics.soft_dice(px, none).first().loss == pytest.approx(sum(one) / 3)
    b = spark.createDataFrame([(2, 100.0), (3, 300.0)], "class_id int, pixels double")
    got = {r.class_id: r.weight for r in metrics.class_weights(b, "inverse_freq", boost={3: 0.1, 9: 20.0, 1: 5.0}).collect()}
    assert (got[2], got[3], got[9], got[1], got[5], got[0]) == (1.5, 0.25, 20.0, 0.0, 1.0, 1.0)
    assert {r.class_id: r.weight for r in metrics.class_weights(b, "none").collect()}[5] == 1.0


HIT = "image int, seq int, number int, conf double, x0 int, y0 int, x1 int, y1 int, cx double, cy double"


def hit(seq, number, conf, x, y=0, size=10):
    return (1, seq, number, conf, x, y, x + size, y + size, x + size / 2, y + size / 2)


@pytest.mark.parametrize(
    ("hits", "want"),
    [
        ([hit(1, 31, 0.5, 0), hit(2, 31, 0.9, 5), hit(3, 31, 0.7, 500)], {2, 3}),  # the same number near: the surer
        ([hit(1, 3, 0.9, 0), hit(2, 31, 0.8, 5)], {2}),  # two digits rank higher, and the part goes
        ([hit(1, 131, 0.9, 0), hit(2, 31, 0.95, 5)], {2}),  # the longer one is less sure, so it's no better
        ([hit(1, 131, 0.99, 0), hit(2, 31, 0.5, 5)], {1}),
        ([hit(1, 45, 0.6, 0), hit(2, 67, 0.6, 5), hit(3, 89, 0.6, 27)], {1}),  # equals: the first; near in x and in y alike
        ([hit(1, 45, 0.6, 0), hit(2, 67, 0.5, 27, 27), hit(3, 89, 0.4, 29, 0)], {1, 3}),  # 38 away, but within 28 in both
    ],
)
def test_merging_hits(spark, hits, want):
    assert {r.seq for r in detect.merge_hits(spark.createDataFrame(hits, HIT)).collect()} == want


def test_votes_of_candidates(spark):
    ring = (1, 0.0, 0.0, 20.0)
    rows = [  # seq, number, conf, box
        (1, 7, 0.9, 30, -8, 50, 8), (2, 31, 0.2, 30, -8, 50, 8), (3, 31, 0.5, 30, -8, 50, 8), (4, 45, 0.6, -50, -8, -30, 8), (5, 45, 0.3, -50, -8, -30, 8),
        (6, 131, 0.8, 30, -8, 50, 8), (7, 231, 0.99, 30, -8, 50, 8), (8, 88, 0.99, -10, -8, 10, 8), (9, 88, 0.99, 80, -8, 99, 8), (10, 88, 0.99, 20, -2, 40, 2), (11, 88, 0.99, 22, -8, 80, 8),
    ]
    hits = spark.createDataFrame([(*ring, n, k, c, float(a), float(b), float(x), float(y), (a + x) / 2, (b + y) / 2) for n, k, c, a, b, x, y in rows], "ring int, rx double, ry double, radius double, seq int, number int, conf double, x0 double, y0 double, x1 double, y1 double, cx double, cy double")
    cand = detect.digit_candidates(hits)
    assert {r.seq: round(r.score, 6) for r in cand.collect()} == {3: 0.7, 4: 0.75, 5: 0.45}
    assert tuple(detect.vote(cand).first()) == (1, 45, 1.2, pytest.approx(0.75), 4)


def test_regions_have_holes(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    ring = {(r, c) for r in range(30) for c in range(30) if 11**2 <= (r - 14.5) ** 2 + (c - 14.5) ** 2 <= 14.6**2}
    broken = {(r, c + 40) for r, c in ring if not (r > 14 and 14 <= c <= 15)}  # a gap of two is closed
    open_ = {(r, c + 80) for r, c in ring if not (r > 14 and 8 <= c <= 21)}
    bar = {(r, c) for r in range(40, 43) for c in range(60)}
    digit = {(50 + r, c) for r in range(12) for c in range(5)}
    dust = {(70, c) for c in range(9)}
    px = spark.createDataFrame([(0, r, c) for r, c in ring | broken | open_ | bar | digit | dust], "map_id int, r int, c int")
    got = {(r.x0, r.y0): (r.kind, r.holes) for r in regions.region_stats(regions.label_regions(px), spark.createDataFrame([(0, 100, 200)], "map_id int, height int, width int")).collect()}
    assert got[0, 0] == ("circle", 1) and got[40, 0] == ("circle", 1) and got[80, 0][1] == 0 and got[80, 0][0] != "circle"
    assert got[0, 40] == ("line", 0) and got[0, 50] == ("digit", 0) and got[0, 70][0] == "noise"


def test_glyphs_of_a_number(spark):
    rows = [(1, 1, 0.0, 0.0, 8.0, 16.0), (1, 2, 11.0, 1.0, 19.0, 16.0), (1, 3, 27.0, 0.0, 35.0, 16.0), (1, 4, 50.0, 0.0, 58.0, 16.0), (1, 5, 0.0, 30.0, 8.0, 46.0), (2, 6, 1.0, 0.0, 8.0, 16.0)]
    got = detect.clustered_glyphs(spark.createDataFrame(rows, "image long, id long, x0 double, y0 double, x1 double, y1 double"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 3, 0.0, 0.0, 35.0, 16.0), (1, 4, 1, 50.0, 0.0, 58.0, 16.0), (1, 5, 1, 0.0, 30.0, 8.0, 46.0), (2, 6, 1, 1.0, 0.0, 8.0, 16.0)]


def test_suppression_of_rings(spark):
    rows = [(1, 1, 0.0, 0.0, 0.9), (1, 2, 50.0, 0.0, 0.8), (1, 3, 100.0, 0.0, 0.7), (1, 4, 60.0, 0.0, 0.95), (2, 5, 0.0, 0.0, 0.1)]
    got = detect.suppress(spark.createDataFrame(rows, "course int, seq int, x double, y double, score double"), 60.0)
    assert {r.seq for r in got.collect()} == {4, 1, 5}


def ring_of(mask, x, y, radius, height=100, width=100):
    """The plain rule for one ring: rim, fill, hollow."""
    rim = 0
    for k in range(48):
        a = 2 * math.pi * k / 48
        rim += any((round(y + s * max(radius, 1) * math.sin(a)), round(x + s * max(radius, 1) * math.cos(a))) in mask for s in (0.85, 1.0, 1.15))
    half = max(1, round(0.5 * radius))
    disk = [(r, c) for r in range(max(0, int(y) - half), min(height, int(y) + half + 1)) for c in range(max(0, int(x) - half), min(width, int(x) + half + 1)) if (r - y) ** 2 + (c - x) ** 2 <= half * half]
    fill = sum(p in mask for p in disk) / len(disk) if disk else 1.0
    return rim / 48, fill, rim / 48 - fill


def test_quality_of_rings(spark):
    """A full circle of radius 10 is all rim and no filling; a disk is both. Half of 7 is 4, of 11 it's 6: marks between count as filling. Pixels outside the image don't count."""
    on = {(r, c) for r in range(40) for c in range(40) if 8**2 <= (r - 20) ** 2 + (c - 20) ** 2 <= 12**2} | {(r, c) for r in range(40) for c in range(60, 100) if (r - 20) ** 2 + (c - 80) ** 2 <= 12**2} | {(60 + d, 60) for d in (-4, 4)} | {(60, 56), (60, 64)} | {(90, c) for c in range(8)}
    mask = spark.createDataFrame([(0, r, c) for r, c in on], "map_id int, r int, c int")
    images = spark.createDataFrame([(0, 100, 100)], "map_id int, height int, width int")
    rings = {1: (20.0, 20.0, 10.0), 2: (80.0, 20.0, 10.0), 3: (200.0, 20.0, 10.0), 4: (60.0, 60.0, 7.0), 5: (60.0, 60.0, 11.0), 6: (1.25, 90.5, 7.0), 7: (80.5, 20.25, 15.0), 8: (0.0, 99.0, 0.5)}
    got = {r.ring: (r.rim, r.fill, r.hollow) for r in detect.ring_quality(spark.createDataFrame([(0, k, *v) for k, v in rings.items()], "map_id int, ring int, x double, y double, radius double"), mask, images).collect()}
    assert got[1] == (1.0, 0.0, 1.0) and got[2] == (1.0, 1.0, 0.0) and got[3] == (0.0, 1.0, -1.0)
    assert got[4][1] == 4 / 49 and got[5][1] == 4 / 113
    for k, ring in rings.items():
        assert got[k] == pytest.approx(ring_of(on, *ring)), k


def test_sure_readings_beside_a_ring_stand(spark):
    """At 0.90 or more the wide window isn't read, even where it has the same number and is surer: 0.92 * (0.55 + 0.45 * 0.8) = 0.8372."""
    rings = spark.createDataFrame([(1, 1, 5.0, 5.0, 12.0, 0.8), (1, 2, 50.0, 5.0, 12.0, 0.8)], "image int, ring int, x double, y double, radius double, hollow double")
    read = lambda rows: spark.createDataFrame(rows, "image int, ring int, number int, conf double")
    got = {r.ring: (r.number, round(r.score, 6)) for r in detect.arbitrated(rings, read([(1, 1, 31, 0.92), (1, 2, 31, 0.85)]), read([(1, 1, 31, 0.97), (1, 2, 31, 0.97)])).collect()}
    assert got == {1: (31, 0.8372), 2: (31, round(0.97 * 0.91, 6))}


def test_narrow_tiles_are_not_asked(spark):
    tiles = [(1, 1, 0, 0, 31, 400, 1, 31, 0.5, 0.5, 0.9), (1, 2, 0, 0, 400, 31, 2, 32, 0.5, 0.5, 0.9), (1, 3, 0, 0, 32, 32, 3, 33, 0.5, 0.5, 0.9)]
    replies = spark.createDataFrame(tiles, "image int, tile int, x0 int, y0 int, width int, height int, seq int, number int, x double, y double, score double")
    rings = spark.createDataFrame([], "image int, ring int, rx double, ry double, radius double, hollow double")
    assert [(r.number, r.x, r.y) for r in detect.merged_tiles(replies, rings, 15.0).collect()] == [(33, 16.0, 16.0)]


def test_suppression_equals_a_greedy_pass(spark):
    """100,000 rings of one course, crowded places and ties among them."""
    rng = np.random.default_rng(5)
    n = 100_000
    xy = np.concatenate([rng.integers(0, 3000, (n - 4000, 2)), rng.integers(0, 12, (4000, 2)) + 500]).astype(float)
    score = rng.integers(0, 5000, n) / 5000
    got = {r.seq for r in detect.suppress(spark.createDataFrame(pd.DataFrame({"course": 1, "seq": np.arange(n), "x": xy[:, 0], "y": xy[:, 1], "score": score})), 20.0).select("seq").collect()}
    kept, cells = set(), {}
    for i in np.lexsort((np.arange(n), -score)).tolist():
        x, y = xy[i]
        a, b = int(x // 20), int(y // 20)
        if all((x - xy[k][0]) ** 2 + (y - xy[k][1]) ** 2 >= 400 for p in (-1, 0, 1) for q in (-1, 0, 1) for k in cells.get((a + p, b + q), ())):
            kept.add(i)
            cells.setdefault((a, b), []).append(i)
    assert got == kept


def test_digits_are_matched_once(spark):
    """Against the rule one after the other: the surest first, a number once, a centre once, none that is taken."""
    rng = np.random.default_rng(11)
    rings = [(1, i, float(x), float(y), 10.0, float(h)) for i, (x, y, h) in enumerate(zip(rng.integers(0, 400, 90), rng.integers(0, 400, 90), rng.integers(20, 100, 90) / 100, strict=True))]
    hits = []
    for i in range(160):
        x, y = (float(v) for v in rng.integers(0, 400, 2))
        hits.append((1, i, int(rng.integers(5, 60)), float(rng.integers(1, 99)) / 100, float(rng.integers(0, 5)) / 100, x + 6, y + 8, x, y, x + 12, y + 16))
    placed = [(1, 20, 100.0, 100.0), (1, 21, 250.0, 300.0)]
    df = spark.createDataFrame(hits, "image int, digit int, number int, conf double, overlap double, cx double, cy double, x0 double, y0 double, x1 double, y1 double")
    got = {r.number: (r.x, r.y, round(r.score, 9)) for r in detect.digit_assist(df, spark.createDataFrame(rings, "image int, ring int, x double, y double, radius double, hollow double"), spark.createDataFrame(placed, "image int, number int, x double, y double")).collect()}
    numbers, used, want = {20, 21}, [p[2:] for p in placed], {}
    for _, i, number, conf, overlap, cx, cy, x0, y0, x1, y1 in sorted(hits, key=lambda h: (-h[3], h[1])):
        if not 10 <= number <= 199 or number in numbers or (overlap < 0.02 and conf < 0.7):
            continue
        reach = int(min(max(max(3.2 * 16, 36.0, 2.2 * 14.5), 2.2 * 16), 3.5 * 16, 90.0))
        fits = [(round(h - 1.25 * math.hypot(x - cx, y - cy) / reach, 9), -k, x, y, h) for _, k, x, y, r, h in rings if 0.45 * 16 <= r <= 0.95 * 16 and math.hypot(x - cx, y - cy) <= reach and not (x0 - 2 <= x <= x1 + 2 and y0 - 2 <= y <= y1 + 2)]
        if fits:
            _, _, x, y, h = max(fits)
            if h >= 0.35 and all(math.hypot(x - a, y - b) >= 14 for a, b in used):
                numbers.add(number)
                used.append((x, y))
                want[number] = (x, y, round(conf * (0.55 + 0.45 * h) * 0.95, 9))
    assert len(want) > 5 and got == want


def test_glyph_clusters_equal_a_plain_closure(spark):
    rng = np.random.default_rng(6)
    n = 400
    x, y, w, h = rng.integers(0, 500, n), rng.integers(0, 500, n), rng.integers(1, 40, n), rng.integers(0, 60, n)
    x[50:60], y[50:60], w[50:60], h[50:60] = x[49], y[49], w[49], h[49]  # copies
    box = np.stack([x, y, x + w, y + h], 1).astype(float)
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    order = sorted(range(n), key=lambda i: ((box[i][1] + box[i][3]) / 2, (box[i][0] + box[i][2]) / 2, i))
    rank = {i: k for k, i in enumerate(order)}
    for a in range(n):
        for b in range(a):
            mean = (max(1, box[a][3] - box[a][1]) + max(1, box[b][3] - box[b][1])) / 2
            if abs(box[a][1] + box[a][3] - box[b][1] - box[b][3]) / 2 <= 0.45 * mean and max(0, box[b][0] - box[a][2], box[a][0] - box[b][2]) <= 0.55 * mean:
                p, q = sorted((top(a), top(b)), key=rank.get)
                up[q] = p
    want = {}
    for i in range(n):
        want.setdefault(top(i), []).append(i)
    df = spark.createDataFrame([(1, i, *box[i].tolist()) for i in range(n)], "image long, id long, x0 double, y0 double, x1 double, y1 double")
    got = {r.cluster: (r.n, r.x0, r.y0, r.x1, r.y1) for r in detect.clustered_glyphs(df).collect()}
    assert got == {k: (len(v), *box[v].min(0)[:2], *box[v].max(0)[2:]) for k, v in want.items()}


def test_planted_rings_are_found(spark):
    """Rings of known centres, one crossed by a line, beside a full disk and specks: each within a pixel, and nothing else."""
    rng = np.random.default_rng(7)
    planted = {(30, 30): 12, (30, 90): 15, (95, 40): 17}
    on = {(r, c) for (y, x), k in planted.items() for r in range(140) for c in range(140) if (k - 1) ** 2 <= (r - y) ** 2 + (c - x) ** 2 <= (k + 1) ** 2}
    on |= {(r, c) for r in range(140) for c in range(140) if (r - 100) ** 2 + (c - 100) ** 2 <= 15**2} | {(30, c) for c in range(140)} | {tuple(p) for p in rng.integers(0, 140, (60, 2)).tolist()}
    got = detect.control_rings(spark.createDataFrame([(2, r, c) for r, c in on], "map_id int, r int, c int"), spark.createDataFrame([(2, 140, 140)], "map_id int, height int, width int")).collect()
    near = {p: [g for g in got if math.hypot(g.y - p[0], g.x - p[1]) <= 1 and abs(g.radius - k) <= 1] for p, k in planted.items()}
    assert all(len(v) == 1 for v in near.values()) and len(got) == 3


def traced(px):
    """Plain Moore tracing of the outer border: the pixels in order."""
    start = min(px)
    around = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]
    at, back, out = start, 0, [start]
    while True:
        for k in range(1, 9):
            j = (back + k) % 8
            p = (at[0] + around[j][0], at[1] + around[j][1])
            if p in px:
                break
        else:
            return out
        nxt = (p, around.index((at[0] + around[(j - 1) % 8][0] - p[0], at[1] + around[(j - 1) % 8][1] - p[1])))
        if p == start and len(out) > 1 and nxt[1] in (0, 1, 2) or len(out) > 4 * len(px) + 8:
            return out
        out.append(p)
        at, back = nxt


def test_borders_of_regions(spark):
    shapes = {1: {(r, c) for r in range(5) for c in range(8)}, 2: {(3, 3)}, 3: {(r, c) for r in range(9) for c in range(9) if 9 <= (r - 4) ** 2 + (c - 4) ** 2 <= 18}, 4: {(k, k) for k in range(6)}, 5: {(0, 1), (1, 0), (1, 2), (2, 1)}}
    df = spark.createDataFrame([(0, k, r, c) for k, v in shapes.items() for r, c in v], "map_id int, region long, r int, c int")
    rows = regions.contours(df).collect()
    got = {r.region: r for r in rows if r.outer}
    assert (got[1].perimeter, got[1].area, got[1].cx, got[1].cy, got[1].points) == (22.0, 28.0, 3.5, 2.0, 22)
    assert (got[2].perimeter, got[2].points, got[2].cx) == (0.0, 0, None)
    assert got[4].perimeter == pytest.approx(10 * 2**0.5) and got[4].area == 0
    assert got[5].perimeter == pytest.approx(4 * 2**0.5)
    assert sum(not r.outer for r in rows) == 2 and {r.region for r in rows if not r.outer} == {3, 5}
    line = traced(shapes[3])
    assert got[3].perimeter == pytest.approx(sum(math.dist(a, b) for a, b in zip(line, [*line[1:], line[0]], strict=True)))
    order = [(r.r, r.c) for r in regions.ordered(regions.loops(regions.cracks(df.where("region = 1")))).orderBy("place").collect()]
    assert order == [*[(0, c) for c in range(7)], *[(r, 7) for r in range(4)], *[(4, c) for c in range(7, 0, -1)], *[(r, 0) for r in range(4, 0, -1)]]


def test_kinds_of_round_regions(spark):
    """An open ring is no hole, but round enough for its filling; a square frame with a gap isn't."""
    arc = {(r, c) for r in range(40) for c in range(40) if 13**2 <= (r - 20) ** 2 + (c - 20) ** 2 <= 16**2 and not (c > 20 and abs(r - 20) < 4)}
    full = {(r, c) for r in range(40) for c in range(60, 100) if (r - 20) ** 2 + (c - 80) ** 2 <= 15**2}
    px = spark.createDataFrame([(0, r, c) for r, c in arc | full], "map_id int, r int, c int")
    s = {r.x0 < 50: r for r in regions.region_stats(regions.label_regions(px), spark.createDataFrame([(0, 400, 400)], "map_id int, height int, width int")).collect()}
    assert s[True].holes == 0 and s[True].roundness < 0.35 and s[True].kind == "digit"
    assert s[False].fill > 0.65 and s[False].roundness > 0.7 and s[False].kind == "digit"
    line = spark.createDataFrame([(0, 5, c) for c in range(60)] + [(0, r, c) for r in range(20, 30) for c in range(20, 30)], "map_id int, r int, c int")
    lab = regions.label_regions(line)
    left = regions.without_lines(lab, regions.region_stats(lab, spark.createDataFrame([(0, 400, 400)], "map_id int, height int, width int")))
    assert left.count() == 100 and left.where("r < 20").count() == 0


def test_planted_triangles_are_starts(spark):
    tri = lambda y, x, n: {(y + a, x + b) for a in range(n) for b in range(-n, n + 1) if 26 * abs(b) <= 15 * a}
    on = tri(10, 30, 22) | tri(60, 80, 24) | {(r, c) for r in range(60, 80) for c in range(20, 40)} | {(r, c) for r in range(20, 45) for c in range(70, 95) if (r - 32) ** 2 + (c - 82) ** 2 <= 144}
    mask = spark.createDataFrame([(0, r, c) for r, c in on], "map_id int, r int, c int")
    images = spark.createDataFrame([(0, 120, 120)], "map_id int, height int, width int")
    got = {(round(r.x), round(r.y)) for r in regions.start_triangles(mask, images, size=24.0).collect()}
    assert len(got) == 2 and all(any(math.hypot(x - a, y - b) <= 2 for x, y in got) for a, b in ((30, 24.7), (80, 76)))
    taken = spark.createDataFrame([(0, 31.0, 30.0)], "map_id int, x double, y double")
    assert [round(r.x) for r in regions.start_triangles(mask, images, taken, 24.0).collect()] == [80]
    assert round(regions.best_start(regions.start_triangles(mask, images, size=24.0)).first().x) in (30, 80)


def test_tiles_give_the_same_times(spark, monkeypatch):
    """Walls, walls that only a diagonal passes, ways that leave a tile and come back, unreachable cells; several tile sides."""
    rng = np.random.default_rng(8)
    grid = rng.integers(1, 9, (37, 29)).astype(float)
    grid[rng.random(grid.shape) < 0.3] = np.inf
    grid[0, 0] = grid[20, 11] = 1.0
    c = spark.createDataFrame([(3, r, k, None if grid[r, k] == np.inf else float(grid[r, k])) for r in range(37) for k in range(29)], "map_id int, cr int, cc int, time_s double")
    sources = spark.createDataFrame([(3, 1, 0, 0), (3, 2, 20, 11)], "map_id int, i int, cr int, cc int")
    want = {(i, int(r), int(k)): t[r, k] for i, at in ((1, (0, 0)), (2, (20, 11))) for t in [graph.search(grid, at)[0]] for r, k in np.argwhere(t < np.inf)}
    for side in (5, 16, 64):
        rows = graph.tiled_times(c, sources, side=side).collect()
        got = {(r.i, r.cr, r.cc): r.time_s for r in rows}
        assert len(rows) == len(got) and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    monkeypatch.setattr(graph, "SIDE", 8)
    pair = lambda large: {(r.i, r.j): round(r.time_s, 9) for r in graph.time_matrix(c, sources, large).collect()}
    assert pair(100) == pair(10_000) and len(pair(100)) >= 2


def test_exchanges_come_before_turned_stretches(spark):
    """A plain local search that tries every exchange before it turns a stretch ends at the same tours."""
    rng = np.random.default_rng(9)
    for _ in range(3):
        n = 6
        m = rng.integers(5, 60, (n + 1, n + 1)).astype(float)
        worth = [int(v) for v in rng.integers(1, 6, n)]
        budget = float(rng.integers(90, 200))
        rows = spark.createDataFrame([(0, i, j, 0.0 if i == j else float(m[i, j])) for i in range(n + 1) for j in range(n + 1)], "problem int, i int, j int, time_s double")
        got = [r.i for r in tour.heuristic(rows, spark.createDataFrame([(0, i + 1, w) for i, w in enumerate(worth)], "problem int, i int, points int"), budget).orderBy("place").collect()]
        length = lambda o: sum(0.0 if a == b else m[a, b] for a, b in zip([0, *o], [*o, 0], strict=True))
        value = lambda o: sum(worth[i - 1] for i in o)
        assert length(got) <= budget + 1e-6
        for a in range(len(got)):  # nothing is left to gain by one exchange or one turned stretch
            for b in range(a + 1, len(got)):
                swapped = list(got)
                swapped[a], swapped[b] = swapped[b], swapped[a]
                for new in (swapped, got[:a] + got[a : b + 1][::-1] + got[b + 1 :]):
                    assert not (length(new) <= budget and value(new) == value(got) and length(new) < length(got) - 1e-9)


def test_improvements_beyond_a_million_seconds(spark):
    rows = [(0, 1, 1, 1, 10.0, 5), (0, 2, 2, 1, 3_000_000.0, 6), (0, 3, 1, 2, 20.0, 5), (1, 1, 1, 1, 9.0, 5), (1, 70, 1, 2, 8.0, 5), (1, 71, 1, 2, 8.0, 5)]
    got = tour.improvements(spark.createDataFrame(rows, "problem int, mask long, last int, size int, total_s double, points long"))
    assert sorted((r.problem, r.mask) for r in got.collect()) == [(0, 1), (0, 2), (1, 1), (1, 70)]


def test_routes_differ_and_start_with_the_fastest(spark):
    c = cells(spark, [[1.0] * 12 for _ in range(12)])
    pair = spark.createDataFrame([(0, 0, 0, 0, 0, 11)], "map_id int, pair int, sr int, sc int, gr int, gc int")
    rows = graph.k_routes(c, pair).collect()
    ways = {}
    for r in sorted(rows, key=lambda r: (r["rank"], r.seq)):
        ways.setdefault(r["rank"], []).append((r.cr, r.cc))
    assert len(ways) == 3 and ways[0][0] == (0, 0) and ways[0][-1] == (0, 11) and {r.time_s for r in rows if r["rank"] == 0} == {11.0}
    assert all(len(set(ways[a]) & set(ways[b])) / min(len(set(ways[a])), len(set(ways[b]))) < dims.SIMILARITY for a in ways for b in ways if a < b)


def test_retime(spark):
    steps = spark.createDataFrame([(0, 0, i, 0, i) for i in range(3)], "route int, map_id int, seq int, cr int, cc int")
    r = graph.retimed(steps, cells(spark, [[1.0, 3.0, 1.0]])).first()
    assert (r.time_s, r.length) == (4.0, 2.0)


@pytest.mark.parametrize(("runs", "want"), [([(8, 12.0, 3), (1, 4.0, 1), (8, 8.0, 2)], [(8, 24.0, 6)]), ([(1, 4.0, 1), (2, 10.0, 2), (3, 3.0, 1), (4, 20.0, 5)], [(2, 14.0, 3), (4, 23.0, 6)])])
def test_smoothing(spark, runs, want):
    df = spark.createDataFrame([(0, n, c, m, 0.0, k) for n, (c, m, k) in enumerate(runs)], "route int, run int, class_id int, distance_m double, time_s double, n_cells long")
    assert [(r.class_id, r.distance_m, r.n_cells) for r in graph.smoothed(df).orderBy("run").collect()] == want


@pytest.mark.parametrize(("budget", "want"), [(25.0, (8, 25.0)), (24.0, (5, 20.0)), (19.0, None)])
def test_small_tour(spark, tmp_path, budget, want):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    t = {(0, 1): 10.0, (0, 2): 10.0, (1, 2): 5.0}
    m = spark.createDataFrame([(4, i, j, 0.0 if i == j else t[min(i, j), max(i, j)]) for i in range(3) for j in range(3)], "problem int, i int, j int, time_s double")
    p = spark.createDataFrame([(4, 1, 3), (4, 2, 5)], "problem int, i int, points int")
    top = tour.best(tour.tours(tour.exact_states(m, budget), m, p, budget)).first()
    assert (top and (top.points, top.total_s)) == want


def test_tour_is_the_best_and_bounds_the_heuristic(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = np.random.default_rng(3)
    xy = rng.random((7, 2)) * 100
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    worth = {i: int(rng.integers(1, 9)) for i in range(1, 7)}
    best = max(((sum(worth[i] for i in o), -sum(d[a, b] for a, b in zip((0, *o), (*o, 0), strict=True))) for k in range(1, 7) for o in itertools.permutations(range(1, 7), k) if sum(d[a, b] for a, b in zip((0, *o), (*o, 0), strict=True)) <= 220))
    m = spark.createDataFrame([(0, i, j, float(d[i, j])) for i in range(7) for j in range(7)], "problem int, i int, j int, time_s double")
    p = spark.createDataFrame([(0, *w) for w in worth.items()], "problem int, i int, points int")
    top = tour.best(tour.tours(tour.exact_states(m, 220.0), m, p, 220.0)).first()
    assert (top.points, -top.total_s) == pytest.approx(best)
    h = tour.heuristic(m, p, 220.0).first()
    assert h.total_points <= top.points and h.total_s <= 220 + 1e-6


def test_metrics(spark):
    px = spark.createDataFrame(list(zip([0, 0, 1, 1, 2], [0, 1, 1, 1, 0], strict=True)), "gt int, pred int")
    s = metrics.class_scores(metrics.confusion(px, classes=3), classes=3)
    assert [round(r.iou, 6) for r in s.orderBy("class_id").collect()] == [0.333333, 0.666667, 0.0]
    r = metrics.summary(s, exclude=(0,)).first()
    assert (round(r.miou, 6), round(r.mdice, 6), round(r.pixel_acc, 6)) == (0.333333, 0.4, 0.6)


@pytest.mark.parametrize(("mode", "want"), [("inverse_freq", (1.5, 0.5)), ("inverse_sqrt_freq", (1.267949, 0.732051)), ("effective_number", (1.409212, 0.590788))])
def test_class_weights(spark, mode, want):
    b = spark.createDataFrame([(2, 100.0), (3, 300.0)], "class_id int, pixels double")
    w = {r.class_id: round(r.weight, 6) for r in metrics.class_weights(b, mode).collect()}
    assert (w[2], w[3], w[0], w[1]) == (*want, 1.0, 0.0)


def test_scalars(spark):
    df = spark.createDataFrame([(31,), (5,), (108,), (-42,), (0,)], "n int")
    assert [r[0] for r in df.select(scalars.points(F.col("n"))).collect()] == [3, 5, 1, 4, 0]
    fast = {r.class_id: r.speed for r in scalars.scaled_speeds(dims.dim_class(spark), 0.5).collect()}
    assert fast[8] == pytest.approx(0.835) and fast[6] == 0
    m = spark.range(1).select(scalars.resolution(F.lit(None).cast("double"), F.lit(25000), F.lit(None).cast("int"))).first()[0]
    assert m == pytest.approx(2.116667, abs=1e-6)


def test_replies(spark):
    from fellside.operators.detect import parse_replies

    text = '```json\n{"controls":[{"number":31,"x":0.5,"y":0.5},{"number":5,"x":0.1,"y":0.1},{"number":"44","x":"0.2","y":0.3,"confidence":2},{"number":40,"x":1.2,"y":0}]}\n```'
    got = parse_replies(spark.createDataFrame([(1, text), (2, "no json"), (3, None)], "tile long, reply string")).collect()
    assert [(r.number, r.x, r.y, r.score) for r in got] == [(31, 0.5, 0.5, 0.7), (44, 0.2, 0.3, 1.0)]


def test_channels_source(spark, tmp_path):
    a = np.zeros((3, 4, 5), np.uint8)
    a[1, 2, 3], a[2, 0, 0] = 7, 1
    np.save(tmp_path / "channels.npy", a)
    files.register(spark)
    got = spark.read.format("channels_npy").load(f"file://{tmp_path}/channels.npy").collect()
    assert sorted(map(tuple, got)) == [(1, 2, 3, 7), (2, 0, 0, 1)]


def test_channels_in_bands(tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 3, (2, 9, 6)).astype(np.uint8)
    np.save(tmp_path / "channels.npy", a)
    monkeypatch.setattr(files, "PART_BYTES", 14)  # two rows a part
    reader = files.ChannelsReader(f"file://{tmp_path}/channels.npy")
    assert len(reader.partitions()) == 10
    got = sorted(tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist())
    assert got == sorted((c, y, x, int(a[c, y, x])) for c, y, x in zip(*np.nonzero(a), strict=True))


def test_centres_are_taken_once(spark):
    rows = [(1, 1, 31, 0.0, 0.0, 0.6), (1, 2, 45, 10.0, 0.0, 0.9), (1, 3, 31, 100.0, 0.0, 0.8), (1, 4, 45, 3.0, 0.0, 0.5), (1, 5, 31, 200.0, 0.0, 0.7), (2, 6, 31, 0.0, 0.0, 0.5)]
    got = detect.placed_controls(spark.createDataFrame(rows, "image long, ring long, number int, x double, y double, score double"))
    assert sorted((r.image, r.number, r.ring) for r in got.collect()) == [(1, 31, 3), (1, 45, 4), (2, 31, 6)]


def test_index_meta_balance_cache(spark, tmp_path):
    (tmp_path / "i.csv").write_text("map,sample,split,kind,image,channels,label,fg_ratio\nm,a,train,tile,x/dataset/y.png,,,0.5\nm,b,train,tile,z.png,,,\n")
    index = files.tile_index(files.read_index(spark, str(tmp_path / "i.csv")), "train", ("tile",), 0.1)
    assert index.select(files.rebased(F.col("image"), "/r")).first()[0] == "/r/y.png" and index.count() == 1
    (tmp_path / "m.json").write_text('{"scale": 10000, "dpi": null}')
    assert files.read_meta(spark, str(tmp_path / "m.json")).first().scale == 10000
    (tmp_path / "b.json").write_text('[{"class_index": 1, "pixels": 2}, {"class_index": 1, "pixels": 5}]')
    assert files.read_class_balance(spark, str(tmp_path / "b.json")).first().pixels == 5
    first = files.cached(spark.range(3), f"file://{tmp_path}/cache", a=1)
    assert first.count() == 3 and files.cached(spark.range(9), f"file://{tmp_path}/cache", a=1).count() == 3 and files.cached(spark.range(9), f"file://{tmp_path}/cache", a=2).count() == 9


def test_streams(spark, tmp_path):
    spark.createDataFrame([(0, 1), (0, 1), (2, 2)], "gt int, pred int").write.parquet(f"{tmp_path}/px")
    q = live.confusion_stream(spark.readStream.schema("gt int, pred int").parquet(f"{tmp_path}/px")).writeStream.outputMode("complete").format("memory").queryName("conf").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("conf").collect())) == [(0, 1, 2), (2, 2, 1)]


def test_plan_and_routes(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    label = pixels(spark, [[2] * 40 for _ in range(40)])
    controls = spark.createDataFrame([(1, 31, 30.0, 2.0), (2, 52, 30.0, 30.0)], "i int, number int, x double, y double")
    plan = api.plan_course(label, controls, (2.0, 2.0), 200.0)
    assert plan["method"] == "dp" and plan["points"] == 8 and set(plan["order"]) == {31, 52} and plan["time_s"] <= 200
    assert plan["n_legs"] == 3 and plan["cumulative_s"][-1] == pytest.approx(plan["time_s"]) and plan["distance_m"] == pytest.approx(plan["time_s"])  # a metre a second
    assert [r["order"] for r in api.controls_table(plan)] == [1, 2] and api.controls_table(plan)[0]["time_s"] == round(plan["cumulative_s"][0], 1) and '"n_legs": 3' in api.plan_json(plan)
    assert api.plan_course(label, controls.limit(0), (2.0, 2.0), 9.0)["method"] == "empty"
    steps, segs = api.compute_routes(label, (2.0, 2.0), (30.0, 30.0), 2)
    assert steps.where("rank = 0").count() == 8 and {r.class_id for r in segs.collect()} == {2}
    calls = []
    model = lambda df: calls.append(1) or df.select("map_id", "r", "c", F.lit(2).alias("class_id"))
    image = label.select("map_id", "r", "c", F.lit(7).alias("red"))
    for data in (image, image, image.withColumn("red", F.lit(8))):
        steps, _ = api.find_routes(data, (2.0, 2.0), (30.0, 30.0), cache=f"file://{tmp_path}/labels", model=model, version="a", k=1)
        assert steps.count() == 8
    assert len(list((tmp_path / "labels").iterdir())) == 2
    with pytest.raises(ValueError, match="model"):
        api.find_routes(image, (2.0, 2.0), (30.0, 30.0))


def test_hooks(spark):
    tiles = spark.createDataFrame([(1, b"ab"), (2, b"c")], "tile long, pixels binary")
    assert [r.probs[0] for r in api.predict_tiles(tiles, lambda xs: [[len(x)] for x in xs]).orderBy("tile").collect()] == [2.0, 1.0]
    got = api.ask_tiles(tiles, lambda x: '{"controls":[{"number":31,"x":0.5,"y":0.5}]}').collect()
    assert [r.number for r in got] == [31, 31]


def test_raster_in_bands(spark, tmp_path, monkeypatch):
    """What is written is read again, band by band; places without a value hold the filling; a second write replaces the first."""
    monkeypatch.setattr(files, "PART_BYTES", 60)  # three rows of five 4-byte numbers
    rows = [(m, r, c, float(m * 100 + r * 10 + c)) for m in (1, 2) for r in range(8) for c in range(5) if (r + c) % 4]
    values = spark.createDataFrame([*rows, (1, 99, 0, 5.0), (3, 0, 0, 1.0), (1, 0, 0, None)], "map_id int, r int, c int, value double").repartition(3)
    images = spark.createDataFrame([(1, 8, 5), (2, 8, 5)], "map_id int, height int, width int")
    path = f"file://{tmp_path}/costs"
    for _ in range(2):
        files.write_raster(values, images, path, fill=-1.0)
    got = spark.read.format("raster_bands").load(path).collect()
    want = {(m, r, c): -1.0 for m in (1, 2) for r in range(8) for c in range(5)} | {(m, r, c): v for m, r, c, v in rows}
    assert len(got) == 80 and {(x.map_id, x.r, x.c): x.value for x in got} == want
    assert len(list((tmp_path / "costs").glob("*.npy"))) == 6
    files.whole_raster(spark, path, 2, f"file://{tmp_path}/two.npy")
    two = np.load(tmp_path / "two.npy")
    assert two.dtype == np.float32 and two.shape == (8, 5) and all(two[r, c] == want[2, r, c] for r in range(8) for c in range(5))


def test_failed_write_leaves_no_bands(spark, tmp_path):
    images = spark.createDataFrame([(1, 8, 5)], "map_id int, height int, width int")
    values = spark.createDataFrame([(1, r, 0, float(r)) for r in range(8)], "map_id int, r int, c int, value double")
    bad = values.withColumn("value", F.when(F.col("r") == 7, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        files.write_raster(bad, images, f"file://{tmp_path}/bad")
    assert not list((tmp_path / "bad").glob("*")) if (tmp_path / "bad").exists() else True
    writer = files.BandsWriter(f"file://{tmp_path}/part", "f4", 0.0)
    batch = pa.RecordBatch.from_pydict({"map_id": [1], "first": [0], "last": [8], "width": [5], "r": [2], "c": [3], "value": [1.5]})
    one, lost = writer.write(iter([batch])), writer.write(iter([batch]))
    assert one.files != lost.files
    writer.commit([one, None])
    assert [p.name for p in (tmp_path / "part").glob("*.npy")] == [one.files[0][-1]]
    writer.abort([writer.write(iter([batch]))])
    assert [p.name for p in (tmp_path / "part").glob("*.npy")] == [one.files[0][-1]]


def plain_closing(on, height, width, kernel, order):
    for grow in order:
        inside = {(r, c) for r in range(height) for c in range(width)}
        on = {(r + a, c + b) for r, c in on for a, b in kernel} & inside if grow else {(r, c) for r, c in inside if all((r + a, c + b) in on for a, b in kernel if (r + a, c + b) in inside)}
    return on


@pytest.mark.parametrize("kernel", [[(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)], [(0, 0), (0, 1), (1, 2)]])
def test_morphology(spark, kernel):
    """Against sets, with an uneven kernel too, and at the edges."""
    rng = np.random.default_rng(8)
    on = {(int(r), int(c)) for r, c in zip(*np.nonzero(rng.random((12, 9)) < 0.6), strict=True)}
    mask, images = spark.createDataFrame([(4, r, c) for r, c in on], "map_id int, r int, c int"), spark.createDataFrame([(4, 12, 9), (5, 3, 3)], "map_id int, height int, width int")
    pixels = lambda d: sorted((r.r, r.c) for r in d.collect())
    assert pixels(masks.opened(mask, images, kernel)) == sorted(plain_closing(on, 12, 9, kernel, (False, True)))
    assert pixels(masks.closed(mask, images, kernel, 2)) == sorted(plain_closing(on, 12, 9, kernel, (True, True, False, False)))
    assert masks.closed(mask.limit(0), images, kernel).count() == 0


def test_equalised_by_hand(spark):
    """An image of 8 x 8 pixels has a pixel a tile: its level is the only one, and stands at the limit of one, so a value becomes the share of levels up to it: all."""
    px = spark.createDataFrame([(0, r, c, (r * 8 + c) * 4) for r in range(8) for c in range(8)], "map_id int, r int, c int, v int")
    images = spark.createDataFrame([(0, 8, 8)], "map_id int, height int, width int")
    got = masks.equalised(px, images).collect()
    assert len(got) == 64
    # between middles the four tiles around count alike: 255 for each one whose own value isn't above this one's
    level = {(r.r, r.c): r.level for r in got}
    at = {(r, c): (r * 8 + c) * 4 for r in range(8) for c in range(8)}
    for (r, c), v in level.items():
        around = [(max(min(r + a, 7), 0), max(min(c + b, 7), 0)) for a in (-1, 0) for b in (-1, 0)]
        assert v == round(sum(255 * (at[p] <= at[r, c]) for p in around) / 4), (r, c)
    grey = masks.byte_hsv(F.lit(255), F.lit(0), F.lit(128))
    assert tuple(spark.range(1).select(*grey).first()) == (165, 255, 255)
    back = masks.byte_rgb(F.lit(165), F.lit(255), F.lit(255))
    assert tuple(spark.range(1).select(*back).first()) == (255, 0, 128)


def plain_refined(mask, x, y, radius, height, width, search):
    """The plain rule: a grid, a centroid, half a pixel."""
    worth = lambda a, b: ring_of(mask, a, b, radius, height, width)
    best, at = round(worth(x, y)[2], 9), (x, y)
    for dy in range(-math.ceil(search), math.ceil(search) + 1):
        for dx in range(-math.ceil(search), math.ceil(search) + 1):
            rim, _, h = worth(x + dx, y + dy)
            if rim >= 0.25 and round(h, 9) > best:
                best, at = round(h, 9), (x + dx, y + dy)
    rr, (bx, by) = max(radius, 1.0), at
    own = [(r, c) for r, c in mask if 0.7 * rr <= math.hypot(c - bx, r - by) <= 1.3 * rr and max(abs(c - int(bx)), abs(r - int(by))) <= math.ceil(rr + 4)]
    if len(own) >= 12:
        cx, cy = sum(c for _, c in own) / len(own), sum(r for r, _ in own) / len(own)
        h = round(worth(cx, cy)[2], 9)
        if h + 0.02 >= best:
            best, at = h, (cx, cy)
    for dy in (-0.5, 0.0, 0.5):
        for dx in (-0.5, 0.0, 0.5):
            h = round(worth(at[0] + dx, at[1] + dy)[2], 9)
            if h > best:
                best, at = h, (at[0] + dx, at[1] + dy)
    return (*at, best)


def test_refined_rings(spark):
    """Planted rings are found from some pixels off, at the edge of the image too; a ring without pixels stays."""
    rng = np.random.default_rng(5)
    centres = {1: (30, 30, 10.0), 2: (3, 80, 9.0), 3: (80, 20, 12.5)}
    on = {(int(r), int(c)) for r, c in zip(*np.nonzero(rng.random((100, 100)) < 0.02), strict=True)}
    on |= {(r, c) for r in range(100) for c in range(100) for x, y, d in centres.values() if abs(math.hypot(c - x, r - y) - d) <= 1.2}
    given = {k: (x + dx, y + dy, d) for (k, (x, y, d)), (dx, dy) in zip(centres.items(), ((3.0, -4.0), (1.5, 2.25), (-2.0, 5.0)), strict=True)}
    rings = spark.createDataFrame([*[(0, k, *v) for k, v in given.items()], (9, 4, 5.0, 5.0, 8.0), (0, 5, None, 1.0, 2.0)], "map_id int, ring int, x double, y double, radius double")
    mask, images = spark.createDataFrame([(0, r, c) for r, c in on], "map_id int, r int, c int"), spark.createDataFrame([(0, 100, 100), (9, 20, 20)], "map_id int, height int, width int")
    got = {r.ring: (r.x, r.y, r.hollow) for r in refine.refined_rings(rings, mask, images, 6.0).collect()}
    assert set(got) == {1, 2, 3, 4} and got[4] == (5.0, 5.0, 0.0)
    for k, (x, y, d) in given.items():
        assert got[k] == pytest.approx(plain_refined(on, x, y, d, 100, 100, 6.0)), k
        # where most of a ring lies outside, the rule itself moves off
        assert k == 2 or math.dist(got[k][:2], centres[k][:2]) < math.dist((x, y), centres[k][:2]) / 2
    # moved points are refined on the mask: a candidate three pixels off leads to the planted centre
    points = spark.createDataFrame([(0, 7, 40.0, 36.0, 0.8)], "image int, seq int, x double, y double, score double")
    near = spark.createDataFrame([(0, 1, 33.0, 31.0, 10.0, 0.5)], "image int, ring int, rx double, ry double, radius double, hollow double")
    put = detect.snapped(points, near, 10.0, mask.withColumnRenamed("map_id", "image"), images.withColumnRenamed("map_id", "image")).first()
    assert math.hypot(put.x - 30, put.y - 30) <= 1.0 and put.source == "circle" and put.score > 0.8 * (0.55 + 0.45 * 0.5)


def plain_merge(a, b):
    return {**a, **{k: plain_merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}}


def test_settings_are_merged_at_any_depth(spark):
    pairs = [
        ({"a": {"b": {"c": 1, "d": [1, {"e": 2}]}}, "x": None}, {"a": {"b": {"c": None, "n": {"m": {}}}}, "x": {"y": "z"}}),
        ({"a": 1}, {"a": {}}), ({"a": {}}, {"a": {}}), ({"a": {"b": 1}}, {"a": {}}), ({}, {}), ({"a": {"b": 1, "c": 2}}, {}), ({}, {"q\"u o.t\\e": {"ä": "\n"}}),
        ({"a": {"b": 1}}, {"a": 5}), ({"a": {"b": {}}}, {"a": {"b": {"c": {}}}}), ({"a": [1, 2]}, {"a": [3]}), ({"a": {"b": {"c": 1}}, "a.b": 3}, {"a": {"b": 2}}),
    ]
    side = lambda n: S.leaves(spark.createDataFrame([(i, json.dumps(p[n])) for i, p in enumerate(pairs)] + ([(90, "no json"), (91, None), (92, "[1]")] if n else [(90, '{"k":1}')]), "id int, body string"))
    got = {r.id: json.loads(r.body) for r in S.documents(S.merged(side(0), side(1))).collect()}
    assert got == {**{i: plain_merge(a, b) for i, (a, b) in enumerate(pairs)}, 90: {"k": 1}, 91: {}, 92: {}}
    assert S.leaves(spark.createDataFrame([], "id int, body string")).count() == 0
    assert tuple(spark.range(1).select(S.resolved(F.lit("a/b"), "/r/"), S.resolved(F.lit("/c"), "/r")).first()) == ("/r/a/b", "/c")


def test_moved_images(spark):
    """No move leaves an image alone; a quarter turn about the middle and a whole pixel's shift are exact; what comes from outside is paper or nothing."""
    px = [(0, r, c, 10 * r + c) for r in range(4) for c in range(4)]
    image, images = spark.createDataFrame(px, "map_id int, r int, c int, red int"), spark.createDataFrame([(0, 4, 4)], "map_id int, height int, width int")
    move = lambda *m: spark.createDataFrame([(0, *map(float, m))], "map_id int, tx double, ty double, scale double, angle double")
    seen = lambda d, n: {(r.r, r.c): r[n] for r in d.collect()}
    assert seen(augment.affine(image, images, move(0, 0, 1, 0)), "red") == {(r, c): v for _, r, c, v in px}
    turned = seen(augment.affine(image, images, move(0, 0, 1, 90)), "red")
    assert turned == {(c, 3 - r): v for _, r, c, v in px} or turned == {(3 - c, r): v for _, r, c, v in px}
    shifted = seen(augment.affine(image, images, move(0.25, 0, 1, 0)), "red")
    assert shifted == {(r, c): 10 * r + c - 1 if c else 255 for r in range(4) for c in range(4)}
    half = seen(augment.affine(image, images, move(0.125, 0, 1, 0)), "red")
    assert half[1, 1] == math.floor((10 + 11) / 2 + 0.5) and half[1, 0] == math.floor((255 + 10) / 2 + 0.5)
    label = image.withColumnRenamed("red", "class_id")
    assert seen(augment.affine_label(label, images, move(0.25, 0, 1, 0)), "class_id") == {(r, c): 10 * r + c - 1 if c else 0 for r in range(4) for c in range(4)}
    many = spark.range(400).select(F.col("id").cast("int").alias("map_id"), F.lit(4).alias("height"), F.lit(4).alias("width"))
    one, two = (sorted(map(tuple, augment.drawn(many.repartition(k), 7).collect())) for k in (1, 5))
    moved = [m for m in one if m[1:] != (0.0, 0.0, 1.0, 0.0)]
    assert one == two and 120 < len(moved) < 200 and all(abs(m[1]) <= 0.06 and abs(m[3] - 1) <= 0.1 + 1e-9 and abs(m[4]) <= 15 for m in moved)


@pytest.mark.parametrize("shape", [(6, 7), (2, 9), (1, 1)])
def test_blur_mirrors_at_edges(spark, shape):
    h, w = shape
    a = np.random.default_rng(2).integers(0, 256, shape)
    image = spark.createDataFrame([(0, r, c, int(a[r, c])) for r in range(h) for c in range(w)], "map_id int, r int, c int, red int")
    k = np.array(augment.bell(5))
    at = lambda n, p: min(p % max(2 * (n - 1), 1), max(2 * (n - 1), 1) - p % max(2 * (n - 1), 1)) if n > 1 else 0
    want = {(r, c): math.floor(round(sum(k[i] * k[j] * a[at(h, r + i - 2), at(w, c + j - 2)] for i in range(5) for j in range(5)), 6) + 0.5) for r in range(h) for c in range(w)}
    got = augment.blurred(image, spark.createDataFrame([(0, h, w)], "map_id int, height int, width int"), augment.bell(5)).collect()
    assert {(r.r, r.c): r.red for r in got} == want


def test_start_triangles_need_no_labels(spark, monkeypatch):
    """Borders come from closed bits of the mask, as from its closed, labelled pixels, holes and words' edges included; outer ones are told without labels."""
    rng = np.random.default_rng(17)
    on = {(int(r), int(c)) for r, c in np.argwhere(rng.random((50, 100)) < 0.18)} | {(r, c) for r in range(60, 90) for c in range(25, 70) if not (66 < r < 84 and 34 < c < 61)} | {(r, c) for r in range(72, 78) for c in range(44, 50)}
    mask = spark.createDataFrame([(m, r, c) for m in (0, 1) for r, c in on], "map_id int, r int, c int")
    whole = regions.closed_regions(mask.withColumn("region", F.lit(0).cast("long"))).select("map_id", "r", "c")
    cracks = lambda d: sorted(tuple(r) for r in d.select("map_id", "id", "r", "c", "next", "nr", "nc").collect())
    assert cracks(regions._sides_of(regions.closed_border(mask))) == cracks(regions.cracks(whole.withColumn("region", F.lit(0).cast("long"))))
    monkeypatch.setattr(regions, "spread_labels", None)
    tri = [(0, 10 + a, 30 + b) for a in range(22) for b in range(-22, 23) if 26 * abs(b) <= 15 * a]
    assert regions.start_triangles(spark.createDataFrame(tri, "map_id int, r int, c int"), spark.createDataFrame([(0, 120, 120)], "map_id int, height int, width int"), size=24.0).count() == 1


def test_an_images_many_hits_meet_those_around_them(spark):
    """Work grows with hits, not with their square; what is kept is what a pass over all kept ones keeps."""
    many = spark.range(20_000).selectExpr("1 AS image", "CAST(id AS INT) AS seq", "CAST(10 + id % 80 AS INT) AS number", "0.5D AS conf", "CAST(id * 40 AS INT) AS x0", "0 AS y0", "CAST(id * 40 + 10 AS INT) AS x1", "10 AS y1", "id * 40 + 5D AS cx", "5D AS cy")
    began = time.monotonic()
    assert detect.merge_hits(many).count() == 20_000
    assert time.monotonic() - began < 40


def test_rounds_of_joins_grow_with_the_logarithm_of_ways(spark, monkeypatch):
    """A corridor of 200 cells takes fewer written tables than cells; times are those of the corridor."""
    written, plain = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(1) or plain(df))
    c = spark.createDataFrame([(0, k, 0, 2.0) for k in range(200)], "map_id int, cr int, cc int, time_s double")
    source = spark.createDataFrame([(0, 0, 3, 0)], "map_id int, i int, cr int, cc int")
    assert {r.cr: r.time_s for r in graph.relax(c, source).collect()} == {k: 2.0 * abs(k - 3) for k in range(200)}
    assert len(written) < 120


@pytest.mark.parametrize(("reach", "most", "part"), [(256, 2048, 1024), (8, 2048, 2), (8, 60, 3)])
def test_blocks_of_tiles_give_the_same_times(spark, monkeypatch, reach, most, part):
    """One block, blocks joined further, blocks whose lines are passed in rounds; two maps, ways that leave a block and come back, sources on lines, in one cell, walled in and on a wall; few tables are written."""
    monkeypatch.setattr(graph, "REACH", reach)
    monkeypatch.setattr(graph, "MOST_PLACES", most)
    monkeypatch.setattr(graph, "PART", part)
    written, plain = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(1) or plain(df))
    rng = np.random.default_rng(13)
    grids, rows, at = {}, [], {3: [(1, 0, 0), (2, 20, 11), (7, 20, 11), (4, 7, 7), (5, 35, 3), (6, 5, 20)], 4: [(8, 2, 2), (9, 6, 9)]}
    for m, shape in ((3, (37, 29)), (4, (7, 11))):
        grid = rng.integers(1, 9, shape).astype(float)
        grid[rng.random(shape) < 0.3] = np.inf
        for _, r, k in at[m]:
            grid[r, k] = 1.0
        if m == 3:
            grid[34:37, 2:5] = np.inf
            grid[35, 3] = 2.0
            grid[5, 20] = np.inf
        grids[m] = grid
        rows += [(m, r, k, None if grid[r, k] == np.inf else float(grid[r, k])) for r in range(shape[0]) for k in range(shape[1])]
    c = spark.createDataFrame(rows, "map_id int, cr int, cc int, time_s double")
    sources = spark.createDataFrame([(m, *s) for m, own in at.items() for s in own], "map_id int, i int, cr int, cc int")
    want = {(m, i, int(r), int(k)): t[r, k] for m, own in at.items() for i, y, x in own for t in [graph.search(grids[m], (y, x))[0]] for r, k in np.argwhere(t < np.inf) if grids[m][y, x] < np.inf or (r, k) == (y, x)}
    for times in (graph.tiled_times(c, sources, side=4), graph.relax(c, sources)):
        got = times.collect()
        found = {(g.map_id, g.i, g.cr, g.cc): g.time_s for g in got}
        assert len(got) == len(found) and found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)
    if most > 60:
        assert len(written) <= 26


def test_steps_are_joined_in_blocks_not_table_by_table(spark, monkeypatch):
    """Two blocks of a corridor take few written tables, and none has a row for each of a source's places."""
    written, plain = [], graph.cut

    def cut(df):
        out = plain(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", cut)
    c = spark.createDataFrame([(0, k, 0, 2.0) for k in range(300)], "map_id int, cr int, cc int, time_s double")
    sources = spark.createDataFrame([(0, i, 30 * i, 0) for i in range(10)], "map_id int, i int, cr int, cc int")
    got = {(r.i, r.cr): r.time_s for r in graph.relax(c, sources).collect()}
    assert got == {(i, k): 2.0 * abs(k - 30 * i) for i in range(10) for k in range(300)}
    assert len(written) <= 6 and max(written) <= 4
