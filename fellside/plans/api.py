"""Entry points: a course plan from its parts, routes between two points, evaluation, and hooks for models."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.scalars import points
from ..operators import detect, graph, metrics, raster, tour
from ..sources import files


def plan_course(label: DataFrame, controls: DataFrame, start: tuple[float, float], budget_s: float, open_land: float = 1.0, size: int = dims.CELL_SIZE, m_per_px: float = 1.0, with_legs: bool = True) -> dict:
    """``label``: one map; ``controls``: i (1..n), number, x, y. Cost grid, snapped points, time matrix, tour; exact up to ``EXACT_LIMIT`` controls, heuristic beyond; then the
    legs from the start over the chosen controls and back, by A*. Returned are the plan's record (method, order of numbers, points, time_s: of the legs if all can be walked,
    n_legs, distance_m, cumulative_s after each leg) and, under legs, the table of their cells (None without legs)."""
    spark = label.sparkSession
    map_id = label.select("map_id").first()[0]
    cells = raster.cost_grid(label, size, m_per_px).select("map_id", "cr", "cc", "time_s")
    cells = cells.withColumn("time_s", F.col("time_s") / open_land)
    n = controls.count()
    empty = {"start": list(start), "budget_s": budget_s, "order": [], "points": 0, "time_s": 0.0, "n_legs": 0, "distance_m": 0.0, "cumulative_s": [], "legs": None}
    if n == 0 or budget_s <= 0:
        return empty | {"method": "empty"}
    at = controls.select(F.lit(map_id).alias("map_id"), "i", "x", "y").unionByName(spark.createDataFrame([(map_id, 0, *map(float, start))], "map_id int, i int, x double, y double"))
    snapped = graph.snap(at, cells, size).persist()
    matrix = graph.time_matrix(cells, snapped).select(F.lit(0).alias("problem"), "i", "j", "time_s").persist()
    worth = controls.select(F.lit(0).alias("problem"), "i", points(F.col("number")).alias("points"))
    number = {r.i: r.number for r in controls.select("i", "number").collect()}
    if n <= dims.EXACT_LIMIT:
        states = tour.exact_states(matrix, budget_s).persist()
        top = tour.best(tour.tours(states, matrix, worth, budget_s)).first()
        order = tour.order_of(states, top["mask"], top["last"]) if top else []
        plan = empty | {"method": "dp", "points": top["points"] if top else 0, "time_s": top["total_s"] if top else 0.0}
        states.unpersist()
    else:
        rows = tour.heuristic(matrix, worth, budget_s).orderBy("place").collect()
        order = [r.i for r in rows]
        plan = empty | {"method": "greedy_local", "points": rows[0].total_points if rows else 0, "time_s": rows[0].total_s if rows else 0.0}
    plan["order"] = [number[i] for i in order]
    if order and with_legs:
        places = spark.createDataFrame(list(enumerate([0, *order, 0])), "place int, i int")
        way = graph.legs(cells, snapped.join(places, "i").select("map_id", F.lit(0).alias("tour"), "place", "cr", "cc")).persist()
        each = way.where("seq = 0").orderBy("leg").select("time_s", "length").collect()  # a row for each leg
        times = [r["time_s"] for r in each]
        if all(t < float("inf") for t in times):
            plan["time_s"] = sum(times)
        plan |= {"legs": way, "n_legs": len(each), "distance_m": sum(r["length"] for r in each) * size * m_per_px, "cumulative_s": list(accumulate(times))}
    matrix.unpersist()
    snapped.unpersist()
    return plan


def controls_table(plan: dict) -> list[dict]:
    """A row for each chosen control: order, number, points, and the time until it (without the way back), in seconds and minutes."""
    return [{"order": n + 1, "number": k, "points": int(str(abs(k))[0]), "time_s": round(t, 1), "time_min": round(t / 60, 2)} for n, (k, t) in enumerate(zip(plan["order"], plan["cumulative_s"], strict=False))]


def plan_json(plan: dict) -> str:
    """The plan's record without its table of cells."""
    return json.dumps({k: v for k, v in plan.items() if k != "legs"}, sort_keys=True)


def compute_routes(label: DataFrame, start: tuple[float, float], goal: tuple[float, float], k: int = dims.ROUTES, size: int = dims.CELL_SIZE, m_per_px: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Steps of up to ``k`` routes, and their segments by terrain, smoothed."""
    spark = label.sparkSession
    grid = raster.cost_grid(label, size, m_per_px)
    cells = grid.select("map_id", "cr", "cc", "time_s")
    map_id = label.select("map_id").first()[0]
    ends = spark.createDataFrame([(map_id, 0, *map(float, start)), (map_id, 1, *map(float, goal))], "map_id int, i int, x double, y double")
    s, g = (graph.snap(ends, cells, size).where(F.col("i") == i) for i in (0, 1))
    pair = s.select("map_id", F.col("cr").alias("sr"), F.col("cc").alias("sc")).join(g.select("map_id", F.col("cr").alias("gr"), F.col("cc").alias("gc")), "map_id").withColumn("pair", F.lit(0))
    steps = graph.k_routes(cells, pair, k)
    walk = steps.select("map_id", F.col("rank").alias("route"), "seq", "cr", "cc").join(grid.select("map_id", "cr", "cc", "class_id", "time_s"), ["map_id", "cr", "cc"])
    runs = graph.segments(walk, size * m_per_px).drop("share").withColumn("run", F.col("run").cast("int"))
    return steps, graph.smoothed(runs)


def find_routes(source: DataFrame, start: tuple[float, float], goal: tuple[float, float], cache: str | None = None, model: Callable | None = None, version: str = "", **params) -> tuple[DataFrame, DataFrame]:
    """Routes on a map given as labels (map_id, r, c, class_id), or as anything else with a ``model`` that makes labels of it. With ``cache`` the labels are
    kept under a key of the input's content, ``version`` (of the model) and nothing else, so that other data are never served."""
    label = source if {"map_id", "r", "c", "class_id"} <= set(source.columns) else None
    if label is None:
        if model is None:
            raise ValueError("neither labels nor a model to make them with")
        label = model(source)
        if cache:
            # order doesn't matter to the sum; rows are counted too
            seen = source.agg(F.count("*"), F.sum(F.xxhash64(*source.columns).cast("decimal(38,0)"))).first()
            label = files.cached(label, cache, content=[str(v) for v in seen], columns=source.columns, version=version)
    return compute_routes(label, start, goal, **params)


def evaluate(pixels: DataFrame, *by: str) -> DataFrame:
    return metrics.summary(metrics.class_scores(metrics.confusion(pixels, *by), *by), *by)


def predict_tiles(tiles: DataFrame, model: Callable, classes: int = len(dims.CLASSES)) -> DataFrame:
    """``tiles``: tile, pixels (binary). ``model`` takes a list of byte strings and gives a list of lists of probabilities; any network fits behind it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"tile": f["tile"], "probs": [[float(p) for p in x] for x in model(f["pixels"].tolist())]})

    return tiles.mapInPandas(run, "tile long, probs array<double>")


def ask_tiles(tiles: DataFrame, client: Callable) -> DataFrame:
    """``tiles``: tile, pixels (binary). ``client`` takes bytes and gives a reply's text, which is parsed; the client isn't part of the plan."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"tile": f["tile"], "reply": [client(p) for p in f["pixels"]]})

    return detect.parse_replies(tiles.mapInPandas(run, "tile long, reply string"))
