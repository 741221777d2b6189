"""Centres of given rings, refined on the mask."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Directions and circles of a rim, the least share of rim on the grid, the annulus that gives a centroid, its least pixels, how much worse a centroid may be.
ANGLES, SCALES, LEAST_RIM, ANNULUS, LEAST_PIXELS, SLACK = 48, (0.85, 1.0, 1.15), 0.25, (0.70, 1.30), 12, 0.02
#: Side of the squares by which rings meet pixels.
TILE = 64


class Window:
    """The mask around one ring, with sums along rows: a disk's filling is two lookups a row."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, height: int, width: int, radius: float):
        self.height, self.width, self.radius = height, width, radius
        self.top, self.left = (int(rows.min()), int(cols.min())) if len(rows) else (0, 0)
        shape = (int(rows.max()) - self.top + 1, int(cols.max()) - self.left + 1) if len(rows) else (1, 1)
        self.on = np.zeros(shape, bool)
        self.on[rows - self.top, cols - self.left] = True
        self.sums = np.pad(np.cumsum(self.on, 1), ((0, 0), (1, 0)))

    def quality(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of rim, and how hollow, for each centre."""
        turn = np.arange(ANGLES) * (2 * np.pi / ANGLES)
        reach = np.array(SCALES) * max(self.radius, 1.0)
        r = np.rint(y[:, None, None] + np.round(np.sin(turn)[:, None] * reach, 6)).astype(int) - self.top
        c = np.rint(x[:, None, None] + np.round(np.cos(turn)[:, None] * reach, 6)).astype(int) - self.left
        within = (r >= 0) & (c >= 0) & (r < self.on.shape[0]) & (c < self.on.shape[1])
        hit = within & self.on[np.where(within, r, 0), np.where(within, c, 0)]
        rim = hit.any(2).mean(1)
        half = max(1, int(np.rint(0.5 * self.radius)))
        rows = np.trunc(y).astype(int)[:, None] + np.arange(-half, half + 1)
        room = half * half - np.square(rows - y[:, None])
        span = np.sqrt(np.maximum(room, 0))
        middle = np.trunc(x).astype(int)[:, None]
        first = np.maximum(np.maximum(np.ceil(x[:, None] - span).astype(int), middle - half), 0)
        last = np.minimum(np.minimum(np.floor(x[:, None] + span).astype(int), middle + half), self.width - 1)
        n = np.where((room >= 0) & (rows >= 0) & (rows < self.height), np.maximum(last - first + 1, 0), 0)
        known = (n > 0) & (rows >= self.top) & (rows < self.top + self.on.shape[0])
        at, edge = np.where(known, rows - self.top, 0), self.on.shape[1]
        filled = self.sums[at, np.clip(last + 1 - self.left, 0, edge)] - self.sums[at, np.clip(first - self.left, 0, edge)]
        total = n.sum(1)
        fill = np.where(total > 0, np.where(known, filled, 0).sum(1) / np.maximum(total, 1), 1.0)
        return rim, np.round(rim - fill, 9)

    def centroid(self, x: float, y: float) -> tuple[float, float] | None:
        """Of the mask in the annulus around a centre, if it's enough."""
        reach = max(self.radius, 1.0)
        pad = int(np.ceil(reach + 4))
        r, c = np.nonzero(self.on)
        r, c = r + self.top, c + self.left
        away = np.sqrt(np.square(c - x) + np.square(r - y))
        own = (np.abs(c - int(x)) <= pad) & (np.abs(r - int(y)) <= pad) & (away >= ANNULUS[0] * reach) & (away <= ANNULUS[1] * reach)
        return (c[own].sum() / own.sum(), r[own].sum() / own.sum()) if own.sum() >= LEAST_PIXELS else None

    def refined(self, x: float, y: float, search: float, step: float) -> tuple[float, float, float]:
        """Centre and hollowness: the best on a grid (the first of equals, the given one before all), then the centroid around it, then half a pixel from there, from each better place on."""
        one = lambda a, b: float(self.quality(np.array([a]), np.array([b]))[1][0])
        best = (x, y, one(x, y))
        side = np.arange(-int(np.ceil(search)), int(np.ceil(search)) + 1e-6, step)
        gy, gx = (g.ravel() for g in np.meshgrid(y + side, x + side, indexing="ij"))
        rim, hollow = self.quality(gx, gy)
        hollow = np.where(rim >= LEAST_RIM, hollow, -np.inf)
        k = int(hollow.argmax())
        if hollow[k] > best[2]:
            best = (float(gx[k]), float(gy[k]), float(hollow[k]))
        middle = self.centroid(best[0], best[1])
        if middle:
            h = one(*middle)
            if round(h + SLACK, 9) >= best[2]:
                best = (*middle, h)
        for dy in (-0.5, 0.0, 0.5):
            for dx in (-0.5, 0.0, 0.5):
                a, b = best[0] + dx, best[1] + dy
                h = one(a, b)
                if h > best[2]:
                    best = (a, b, h)
        return best


def refined_rings(rings: DataFrame, mask: DataFrame, images: DataFrame, search: float = 8.0, step: float = 1.0) -> DataFrame:
    """``rings``: map_id, ring, x, y, radius; ``mask``: map_id, r, c; ``images``: map_id, height, width. map_id, ring, radius, and the refined x, y and hollow.

    A ring asks for the pixels that its radius and ``search`` can reach, square by square (an equi-join), and gets them as one row, which radius and search bound; the grid of centres is looked at there.
    A ring without any pixels stays where it is, as does one without an image inside which it lies; rings with null in any column go."""
    reach = F.ceil(F.lit(float(search)) + 2.5 * F.greatest(F.col("radius"), F.lit(1.0)) + 3)
    tiles = lambda c: F.sequence(F.floor((F.col(c) - reach) / TILE), F.floor((F.col(c) + reach) / TILE))
    given = rings.select("map_id", "ring", "x", "y", "radius").dropna()
    asked = given.select("*", reach.alias("_reach"), F.explode(tiles("y")).alias("_ty")).select("*", F.explode(tiles("x")).alias("_tx"))
    px = mask.select("map_id", "r", "c", F.floor(F.col("r") / TILE).alias("_ty"), F.floor(F.col("c") / TILE).alias("_tx"))
    met = asked.join(px, ["map_id", "_ty", "_tx"]).where((F.abs(F.col("r") - F.col("y")) <= F.col("_reach")) & (F.abs(F.col("c") - F.col("x")) <= F.col("_reach")))
    around = met.groupBy("map_id", "ring").agg(F.collect_list("r").alias("_rows"), F.collect_list("c").alias("_cols"))
    whole = given.join(around, ["map_id", "ring"], "left").join(images.select("map_id", "height", "width"), "map_id", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for t in f.itertuples(index=False):
                at = [np.asarray([] if v is None else v, int) for v in (t[5], t[6])]
                size = [0 if pd.isna(v) else int(v) for v in (t.height, t.width)]
                out.append(Window(*at, *size, t.radius).refined(t.x, t.y, search, step))
            put = f[["map_id", "ring", "radius"]].copy()
            put[["x", "y", "hollow"]] = np.array(out, float).reshape(-1, 3)
            yield put

    kinds = dict(rings.dtypes)
    return whole.mapInPandas(run, f"map_id {kinds['map_id']}, ring {kinds['ring']}, radius double, x double, y double, hollow double")
