"""How queries are planned: small files stand for many rows, so what is made of them isn't broadcast by a file's size."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fellside.operators import graph
from fellside.plans import catalogue

from test_queries import rows

SF = "/root/testdata/sf0.001"


def planned(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["retime", "path_steps", "rle_segments", "route_similarity", "terrain_distance", "smooth_segments", "corridor_inflate"])
def test_walks_are_not_broadcast(spark, name):
    assert "BroadcastHashJoin" not in planned(catalogue.QUERIES[name](spark, SF))


def test_annuli_are_not_broadcast(spark):
    assert "BroadcastHashJoin" not in planned(catalogue.QUERIES["annulus_centre"](spark, SF))


def test_votes_meet_sizes_before_they_are_cast(spark):
    from fellside.operators import detect

    mask = spark.createDataFrame([(0, 1, 1)], "map_id int, r int, c int")
    images = spark.createDataFrame([(0, 9, 9)], "map_id int, height int, width int")
    plan = planned(detect.circle_votes(mask, images))
    assert plan.index("Generate explode") < plan.index("Join [map_id")


def test_many_sources_at_once_have_the_times_of_a_search():
    """Mazes with walls, starts in neighbouring rows and in one cell, wide and high grids."""
    rng = np.random.default_rng(5)
    for h, w, walls in ((40, 9, 0.3), (9, 40, 0.3), (25, 25, 0.45), (1, 7, 0.0), (7, 1, 0.2)):
        grid = rng.integers(1, 9, (h, w)).astype(float)
        grid[rng.random((h, w)) < walls] = np.inf
        free = np.argwhere(grid < np.inf)
        starts = [tuple(int(v) for v in free[n % len(free)]) for n in (0, 0, 1, len(free) // 2, len(free) - 1)]
        got = graph.sweep(grid, starts)
        for n, s in enumerate(starts):
            assert np.array_equal(got[:, :, n], graph.search(grid, s)[0])


def test_a_map_is_told_once_for_many_courses(spark):
    """Not once for each course or for every four: a task has many of a map's courses."""
    cells = spark.createDataFrame([(0, r, 0, 1.0) for r in range(200)], "map_id int, cr int, cc int, time_s double")
    ways = spark.createDataFrame([(0, t, p, t + p, 0) for t in range(100) for p in (0, 1)], "map_id int, tour int, place int, cr int, cc int")
    sides = graph.legs(cells, ways)
    assert sides.groupBy(F.spark_partition_id()).count().count() <= 2 and sides.count() == 200


@pytest.mark.parametrize("name", ["connected_regions", "contours", "region_stats"])
def test_regions_of_two_maps_are_apart(spark, tmp_path, name):
    """The same pixels in two maps, of different sizes: SQL tells them apart as the query does."""
    orders = pd.read_parquet(f"{SF}/orders.parquet")
    again = orders.assign(o_orderkey=orders["o_orderkey"] + 1_000_000)
    pd.concat([orders, again[again["o_orderkey"] % 2_000 < 1_200]]).to_parquet(tmp_path / "orders.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    want = rows(duck.execute(catalogue.ORACLE_SQL[name]).df())
    assert rows(catalogue.QUERIES[name](spark, str(tmp_path)).toPandas()) == want


def test_copies_of_boxes_are_members_and_no_pairs(spark):
    from fellside.operators import detect

    boxes = [(0, i, 0.0, 0.0, 9.0, 9.0) for i in (3, 4, 5, 6)] + [(0, 7, 5.0, 5.0, 14.0, 14.0), (0, 1, 5.0, 5.0, 14.0, 14.0), (0, 9, 48.0, 48.0, 120.0, 52.0), (0, 8, 49.0, 40.0, 110.0, 51.0), (1, 2, 0.0, 0.0, 9.0, 9.0)]
    got = detect.overlapping(spark.createDataFrame(boxes, "course int, id int, x0 double, y0 double, x1 double, y1 double"), 50.0).collect()
    assert sorted((r.a_id, r.b_id) for r in got if r.copy) == [(1, 7), (3, 4), (3, 5), (3, 6)]
    assert sorted((r.a_id, r.b_id) for r in got if not r.copy) == [(1, 3), (8, 9)]


def test_equal_digits_meet_equal_rings_once(spark):
    """A hundred equal boxes by a hundred equal rings: each has the hollowest, the first of equals, and few pairs are made."""
    from fellside.operators import detect

    digits = spark.createDataFrame([(0, i, 50.0, 50.0, 40.0, 40.0, 60.0, 60.0) for i in range(100)], "image int, digit int, cx double, cy double, x0 double, y0 double, x1 double, y1 double")
    rings = spark.createDataFrame([(0, 100 + i, 75.0, 50.0, 12.0, (i % 10) / 10) for i in range(100)], "image int, ring int, x double, y double, radius double, hollow double")
    got = detect.ring_near_digit(digits, rings, 60.0)
    assert sorted((r.digit, r.ring) for r in got.collect()) == [(i, 109) for i in range(100)]
    assert planned(got).count("Aggregate") > 2  # both sides are reduced before they meet


def test_boxes_are_not_exchanged_as_pixels(spark):
    from fellside.operators import detect

    rng = np.random.default_rng(3)
    on = rng.random((90, 90)) < 0.4
    mask = spark.createDataFrame([(0, int(r), int(c)) for r, c in np.argwhere(on)], "map_id int, r int, c int")
    boxes = [(i, 0, *(int(v) for v in rng.integers(0, 70, 2)), *(int(v) for v in rng.integers(1, 70, 2))) for i in range(60)] + [(60, 1, 3, 3, 5, 5), (61, 0, 0, 0, 32, 32)]
    got = detect.mask_share(spark.createDataFrame(boxes, "id int, map_id int, x0 int, y0 int, w int, h int"), mask).collect()
    want = {i: on[y : y + h, x : x + w].sum() / (w * h) if m == 0 else 0.0 for i, m, x, y, w, h in boxes}
    assert len(got) == 62 and {r.id: r.share for r in got} == pytest.approx(want)


def test_documents_of_one_file_are_dealt_out(spark):
    from fellside.operators import settings

    docs = spark.range(400).coalesce(1).select("id", F.format_string('{"a":{"b":%d}}', "id").alias("body"))
    got = settings.leaves(docs)
    assert got.count() == 400 and got.groupBy(F.spark_partition_id()).count().count() > 1


def test_circles_are_found_square_by_square_without_an_exchange_of_votes(spark, monkeypatch):
    """Small squares, so that circles cross their borders: the peaks of all votes, and the rings' shares; a mask without circles has none."""
    from fellside.operators import detect

    monkeypatch.setattr(detect, "SQUARE", 32)
    rng = np.random.default_rng(11)
    on = {(r, c) for y, x, k in ((31, 32, 12), (60, 20, 15), (8, 61, 13), (75, 66, 17)) for r in range(-2, 90) for c in range(75) if (k - 1) ** 2 <= (r - y) ** 2 + (c - x) ** 2 <= (k + 1) ** 2}
    on |= {(int(r), int(c)) for r, c in rng.integers(0, 75, (150, 2))}
    mask = spark.createDataFrame([(m, r, c) for r, c in on for m in (0, 4)], "map_id int, r int, c int")
    images = spark.createDataFrame([(0, 90, 75), (4, 80, 70)], "map_id int, height int, width int")
    votes = {(v.map_id, v.r, v.c, v.radius): v.votes for v in detect.circle_votes(mask, images).where("votes >= 8").collect()}
    near = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    want = {(m, r, c, k): v for (m, r, c, k), v in votes.items() if max((votes.get((m, r + i, c + j, k + d), 0), -i, -j, -d) for i, j, d in near) == (v, 0, 0, 0)}
    got = detect.hough_circles(mask, images)
    assert {(g.map_id, g.ring.r, g.ring.c, g.ring.radius): g.votes for g in got.collect()} == want and len(want) > 100
    assert "Aggregate" not in planned(got)
    shares = {(q.map_id, *q.ring): (q.rim, q.fill) for q in detect.ring_quality(got, mask, images).collect()}
    found = detect._circles(mask, images, *detect.RADII, detect.LEAST_VOTES).collect()
    assert len(found) == len(want) and all(shares[f.map_id, f.r, f.c, f.radius] == pytest.approx((f.rim, f.fill), abs=1e-12) for f in found)
    assert detect.control_rings(mask.limit(1), images).count() == 0


def test_all_pairs_of_boxes_are_told_copies_too(spark, monkeypatch):
    """Many copies, in lists of two ids; boxes over several tiles, touching ones, one without area."""
    from fellside.operators import detect

    monkeypatch.setattr(detect, "IDS_A_ROW", 2)
    rng = np.random.default_rng(12)
    kinds = [(float(x), float(y), float(x + w), float(y + h)) for x, y, w, h in zip(*rng.integers(0, 120, (2, 25)), *rng.integers(1, 70, (2, 25)), strict=True)] + [(3.0, 3.0, 3.0, 9.0)]
    boxes = [(int(k % 2), int(n), *kinds[k]) for n, k in enumerate(rng.integers(0, len(kinds), 120))]
    got = detect.paired(detect.overlapping_lists(spark.createDataFrame(boxes, "course int, id int, x0 double, y0 double, x1 double, y1 double"), 50.0)).collect()
    want = {}
    for c, a, *p in boxes:
        for d, b, *q in boxes:
            both = max(min(p[2], q[2]) - max(p[0], q[0]), 0) * max(min(p[3], q[3]) - max(p[1], q[1]), 0)
            if c == d and a < b and both > 0:
                want[c, a, b] = both / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - both)
    assert len(got) == len(want) and all(want[g.course, g.a_id, g.b_id] == pytest.approx(g.iou, abs=1e-12) for g in got)


def test_bbox_iou_tells_every_pair(spark):
    """No classes and members in place of pairs, in neither the query nor its SQL."""
    got = catalogue.QUERIES["bbox_iou"](spark, SF)
    assert got.columns == ["course", "a_id", "b_id", "iou"] and "copy" not in catalogue.ORACLE_SQL["bbox_iou"]


def test_routes_are_smoothed_many_at_once(spark):
    """Not a call of Python for each route; each has its own runs, in order, and none that is too short beside another."""
    runs = [(k, n, (k + n * n) % 4, float(1 + (k * 7 + n * 5) % 13), float(n), 1 + n) for k in range(300) for n in range(1 + k % 6)]
    df = spark.createDataFrame(runs[::-1], "route int, run int, class_id int, distance_m double, time_s double, n_cells long")
    smooth = graph.smoothed(df, 9.0)
    assert "FlatMapGroupsInPandas" not in planned(smooth)
    got = {}
    for r in smooth.orderBy("route", "run").collect():
        got.setdefault(r.route, []).append(r)
    assert got.keys() == set(range(300)) and smooth.where("route > 999").count() == 0
    for k, own in got.items():
        mine = [r for r in runs if r[0] == k]
        assert [r.run for r in own] == list(range(1, len(own) + 1)) and len(own) == 1 or all(r.distance_m >= 9.0 for r in own)
        assert [sum(r[i] for r in own) for i in ("distance_m", "time_s", "n_cells")] == [sum(r[i] for r in mine) for i in (3, 4, 5)]


@pytest.mark.parametrize("name", ["wave_normalise", "visit_order"])
def test_cells_are_numbered_where_they_are_reached(spark, name):
    """No window over all cells of a course."""
    assert "Window" not in planned(catalogue.QUERIES[name](spark, SF)).split("FlatMapCoGroupsInPandas")[0]


def test_visits_go_by_time_column_and_row(spark):
    c = spark.createDataFrame([(0, r, k, 1.0) for r in range(3) for k in range(3)] + [(0, 4, 4, 1.0)], "map_id int, cr int, cc int, time_s double")
    got = graph.visits_from(c, spark.createDataFrame([(0, 5, 1, 1), (0, 6, 4, 4)], "map_id int, i int, cr int, cc int")).collect()
    assert [(r.cr, r.cc, r.n) for r in sorted(got, key=lambda r: r.visit) if r.i == 5] == [(1, 1, 9), (1, 0, 9), (0, 1, 9), (2, 1, 9), (1, 2, 9), (0, 0, 9), (2, 0, 9), (0, 2, 9), (2, 2, 9)]
    assert [(r.cr, r.cc, r.visit, r.n) for r in got if r.i == 6] == [(4, 4, 0, 1)]
