"""Connected regions of a mask, and what is measured on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

NEAR = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def spread_labels(nodes: DataFrame, links: DataFrame, *by: str) -> DataFrame:
    """``nodes``: ``by``, id, label (each node its own); ``links``: ``by``, id, other, both ways. ``by``, id, label: the least label of the node's component. Labels spread to neighbours and
    jump to their label's node's label, so rounds grow with the logarithm of a component's extent in most shapes; each is written."""
    links = links.transform(cut)
    now = nodes.select(*by, "id", F.col("label").alias("own"), "label").transform(cut)
    while True:
        spread = links.join(now.select(*by, F.col("id").alias("other"), F.col("label").alias("seen")), [*by, "other"]).groupBy(*by, "id").agg(F.min("seen").alias("seen"))
        low = now.join(spread, [*by, "id"], "left").select(*by, "id", "own", "label", F.least("label", F.coalesce("seen", "label")).alias("new"))
        jump = low.select(*by, F.col("own").alias("new"), F.col("new").alias("far"))
        nxt = low.join(jump, [*by, "new"]).select(*by, "id", "own", "label", F.least("new", "far").alias("new")).transform(cut)
        now = nxt.select(*by, "id", "own", F.col("new").alias("label"))
        if nxt.where("new <> label").isEmpty():
            return now.select(*by, "id", "label")


def label_regions(mask: DataFrame) -> DataFrame:
    """``mask``: map_id, r, c. 8-connected components: each pixel's region is the least r * 2^31 + c in it."""
    own = F.col("r").cast("long") * (1 << 31) + F.col("c")
    px = mask.select("map_id", "r", "c").distinct().withColumn("id", own)
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in NEAR]))
    links = px.select("map_id", "id", moves.alias("m"), "r", "c").select("map_id", "id", (F.col("r") + F.col("m.a")).alias("r"), (F.col("c") + F.col("m.b")).alias("c"))
    links = links.join(px.select("map_id", "r", "c", F.col("id").alias("other")), ["map_id", "r", "c"]).select("map_id", "id", "other")
    return px.join(spread_labels(px.select("map_id", "id", F.col("id").alias("label")), links, "map_id"), ["map_id", "id"]).select("map_id", "r", "c", F.col("label").alias("region"))


DIAMOND = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if abs(a) + abs(b) <= 2]


def closed_regions(labelled: DataFrame) -> DataFrame:
    """map_id, region, r, c: each region closed by a plus, twice (an image counts as going on beyond its edges)."""
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in DIAMOND]))
    spread = lambda px: px.select("map_id", "region", "r", "c", moves.alias("m")).select("map_id", "region", (F.col("r") + F.col("m.a")).alias("r"), (F.col("c") + F.col("m.b")).alias("c"))
    grown = spread(labelled).distinct()
    return spread(grown).groupBy("map_id", "region", "r", "c").agg(F.count("*").alias("n")).where(F.col("n") == len(DIAMOND)).drop("n")


def hole_counts(closed: DataFrame) -> DataFrame:
    """map_id, region, holes: how many holes each closed region has. It is in one piece, so its holes follow from its Euler number, which is a sum over
    squares of two by two pixels: no background is searched."""
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(1 << (2 * i + j)).alias("bit")) for i in (0, 1) for j in (0, 1)]))
    squares = closed.select("map_id", "region", "r", "c", corners.alias("q")).groupBy("map_id", "region", (F.col("r") - F.col("q.i")).alias("qr"), (F.col("c") - F.col("q.j")).alias("qc")).agg(F.sum("q.bit").alias("bits"))
    n = F.bit_count("bits")
    turn = F.when(n == 1, 1).when(n == 3, -1).when(F.col("bits").isin(6, 9), -2).otherwise(0)
    return squares.groupBy("map_id", "region").agg((1 - F.sum(turn) / 4).cast("int").alias("holes"))


#: The sides of a pixel, clockwise from the top: where one goes along it with the pixel on the right, and what lies beyond it.
SIDES = [((0, 1), (-1, 0)), ((1, 0), (0, 1)), ((0, -1), (1, 0)), ((-1, 0), (0, -1))]


def _crack(r, c, side):
    return (r.cast("long") * (1 << 31) + c) * 4 + side


def cracks(px: DataFrame) -> DataFrame:
    """``px``: map_id, region, r, c (rows and columns from 0). A row for each side between a pixel of a region and what isn't: map_id, region, id (by row, column and side), r, c, and the next one along the
    region's border with its pixel: next, nr, nc. Pixels that meet at a corner are joined there (regions are 8-connected). Pixels learn of their neighbours by one aggregation."""
    bit = {p: 1 << n for n, p in enumerate([(0, 0), *[p for p in NEAR]])}
    told = px.select("map_id", "region", "r", "c", F.explode(F.array(*[F.struct(F.lit(-a).alias("a"), F.lit(-b).alias("b"), F.lit(v).alias("bit")) for (a, b), v in bit.items()])).alias("m"))
    return _sides_of(told.groupBy("map_id", "region", (F.col("r") + F.col("m.a")).alias("r"), (F.col("c") + F.col("m.b")).alias("c")).agg(F.sum("m.bit").alias("code")).where(F.col("code").bitwiseAND(F.lit(1)) > 0))


def _sides_of(code: DataFrame) -> DataFrame:
    """``code``: map_id, region, r, c, code: a bit for the pixel and each of its neighbours, in the order of ``NEAR``. As :func:`cracks`."""
    bit = {p: 1 << n for n, p in enumerate([(0, 0), *NEAR])}
    has = lambda p: F.col("code").bitwiseAND(F.lit(bit[p])) > 0
    out = []
    for side, ((dr, dc), (br, bc)) in enumerate(SIDES):
        go = lambda a, b, to: F.struct((F.col("r") + a).cast("int").alias("nr"), (F.col("c") + b).cast("int").alias("nc"), F.lit(to).alias("ns"))
        nxt = F.when(has((dr + br, dc + bc)), go(dr + br, dc + bc, (side + 3) % 4)).when(has((dr, dc)), go(dr, dc, side)).otherwise(go(0, 0, (side + 1) % 4))
        out.append(F.when(~has((br, bc)), F.struct(F.lit(side).alias("side"), nxt.alias("n"))))
    each = code.select("map_id", "region", "r", "c", F.explode(F.filter(F.array(*out), lambda x: x.isNotNull())).alias("k"))
    return each.select("map_id", "region", _crack(F.col("r"), F.col("c"), F.col("k.side")).alias("id"), "r", "c", _crack(F.col("k.n.nr"), F.col("k.n.nc"), F.col("k.n.ns")).alias("next"), F.col("k.n.nr").alias("nr"), F.col("k.n.nc").alias("nc"))


def loops(cracks_: DataFrame) -> DataFrame:
    """``cracks_`` with the least id of the closed border that each is on (loop). By pointer doubling: in each round everything learns the least id of twice as long a
    stretch before it, so the rounds are the logarithm of the longest border; each is written."""
    key = ["map_id", "region"]
    now = cracks_.select(*key, "id", "next", F.col("id").alias("low")).transform(cut)
    while True:
        far = now.select(*key, F.col("id").alias("next"), F.col("next").alias("then"), F.col("low").alias("seen"))
        nxt = now.join(far, [*key, "next"]).select(*key, "id", F.col("then").alias("next"), F.least("low", "seen").alias("low"), (F.col("seen") < F.col("low")).alias("better")).transform(cut)
        if nxt.where("better").isEmpty():
            return cracks_.join(nxt.select(*key, "id", F.col("low").alias("loop")), [*key, "id"])
        now = nxt.drop("better")


def contours(px: DataFrame) -> DataFrame:
    """``px``: map_id, region, r, c. A row for each closed border of a region, as one goes from pixel to pixel along it: map_id, region, loop, outer (the others are holes'), points, perimeter (steps of one or the
    diagonal's length), area (inside the pixels' centres), cx, cy (of that area), box x0, y0, x1, y1 (ends exclusive). All are sums over the border, so no order is needed."""
    return _measured(loops(cracks(px).transform(cut)))


def _measured(on: DataFrame, joined: bool = False) -> DataFrame:
    """With ``joined``, all pixels of a map have the same region, and outer borders are told from holes' by the way they turn: along the pixels' own edges, the area on their right is positive."""
    moved = (F.col("r") != F.col("nr")) | (F.col("c") != F.col("nc"))
    slant = (F.col("r") != F.col("nr")) & (F.col("c") != F.col("nc"))
    cross = F.col("c").cast("long") * F.col("nr") - F.col("nc").cast("long") * F.col("r")
    sums = on.groupBy("map_id", "region", "loop").agg(
        F.sum((moved & ~slant).cast("long")).alias("straight"), F.sum(slant.cast("long")).alias("slant"), F.sum(cross).alias("a2"), F.sum((F.col("c") + F.col("nc")) * cross).alias("mx"), F.sum((F.col("r") + F.col("nr")) * cross).alias("my"),
        F.min("c").alias("x0"), F.min("r").alias("y0"), (F.max("c") + 1).alias("x1"), (F.max("r") + 1).alias("y1"), F.sum(_turn()).alias("turned"))
    first = on.groupBy("map_id", "region").agg(F.min("id").alias("first"))
    centre = lambda m: F.when(F.col("a2") != 0, F.col(m) / (3 * F.col("a2")))
    out = sums if joined else sums.join(first, ["map_id", "region"])
    return out.select("map_id", "region", "loop", (F.col("turned") > 0 if joined else F.col("loop") == F.col("first")).alias("outer"), (F.col("straight") + F.col("slant")).alias("points"), (F.col("straight") + F.col("slant") * F.sqrt(F.lit(2.0))).alias("perimeter"), (F.abs("a2") / 2).alias("area"), centre("mx").alias("cx"), centre("my").alias("cy"), "x0", "y0", "x1", "y1")


def _turn():
    """What a pixel's side adds to twice the area on its right."""
    side = F.col("id").bitwiseAND(F.lit(3))
    return F.when(side == 0, -F.col("r")).when(side == 1, F.col("c") + 1).when(side == 2, F.col("r") + 1).otherwise(-F.col("c")).cast("long")


#: Pixels of a row that are the bits of one number, and bits on both sides for what lies beside them.
BITS, MARGIN = 32, 16


def _around(words: DataFrame, reach: int) -> DataFrame:
    """``words``: map_id, r, q, bits (columns from ``BITS`` * q on). map_id, r, q, and rows r - ``reach`` to r + ``reach`` there as v0, v1, ..., with two pixels beside them on both sides."""
    full = F.col("bits")
    parts = [(0, F.shiftleft(full, MARGIN)), (1, F.shiftleft(F.shiftright(full, BITS - 2), MARGIN - 2)), (-1, F.shiftleft(full.bitwiseAND(F.lit(3)), MARGIN + BITS))]
    each = words.select("map_id", "r", "q", F.explode(F.filter(F.array(*[F.struct(F.lit(d).alias("d"), v.alias("v")) for d, v in parts]), lambda p: p["v"] != 0)).alias("p"))
    each = each.select("map_id", "r", (F.col("q") + F.col("p.d")).alias("q"), "p.v", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("k"))
    rows = [F.coalesce(F.bit_or(F.when(F.col("k") == k, F.col("v"))), F.lit(0).cast("long")).alias(f"v{k + reach}") for k in range(-reach, reach + 1)]
    return each.select("map_id", (F.col("r") - F.col("k")).alias("r"), "q", "k", "v").groupBy("map_id", "r", "q").agg(*rows)


def _moved(v, by: int):
    return F.shiftleft(v, by) if by > 0 else F.shiftright(v, -by) if by else v


def closed_border(mask: DataFrame) -> DataFrame:
    """``mask``: map_id, r, c. The mask closed as by :func:`closed_regions`, without telling regions apart, and of it the pixels with a side neighbour that isn't in it, as for :func:`_sides_of` (region 0).
    Pixels are bits of numbers, so a number stands for ``BITS`` of them in each exchange and only border pixels become rows."""
    words = mask.groupBy("map_id", "r", F.floor(F.col("c") / BITS).alias("q")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(c, {BITS}) AS INT))")).alias("bits"))
    inside = F.lit((1 << BITS) - 1)
    for grow in (True, False):
        seen = [_moved(F.col(f"v{k + 2}"), by) for k in range(-2, 3) for by in range(abs(k) - 2, 3 - abs(k))]
        all_ = seen[0]
        for one in seen[1:]:
            all_ = all_.bitwiseOR(one) if grow else all_.bitwiseAND(one)
        words = _around(words, 2).select("map_id", "r", "q", F.shiftright(all_, MARGIN).bitwiseAND(inside).alias("bits")).where("bits <> 0")
    edge = "v1 & ~(v0 & v2 & shiftleft(v1, 1) & shiftright(v1, 1))"
    at = _around(words, 1).withColumn("p", F.explode(F.expr(f"filter(sequence(0, {BITS - 1}), p -> (shiftright({edge}, p + {MARGIN}) & 1L) = 1L)")))
    code = " + ".join(f"(shiftright(v{a + 1}, p + {MARGIN + b}) & 1L) * {1 << n}L" for n, (a, b) in enumerate([(0, 0), *NEAR]))
    return at.select("map_id", F.lit(0).cast("long").alias("region"), "r", (F.col("q") * BITS + F.col("p")).cast("int").alias("c"), F.expr(code).alias("code"))


def ordered(on: DataFrame) -> DataFrame:
    """``on``: from :func:`loops`. map_id, region, loop, place, r, c: each border's pixels in order from its first side on. Ranks come from pointer doubling as well: how many
    sides lie before the border's first one comes round again."""
    key = ["map_id", "region"]
    last = F.col("next") == F.col("loop")  # it stands for what follows it, so nothing needs leaving out
    now = on.select(*key, "id", F.when(last, F.col("id")).otherwise(F.col("next")).alias("next"), F.when(last, 0).otherwise(1).cast("long").alias("left")).transform(cut)
    while True:
        far = now.select(*key, F.col("id").alias("next"), F.col("next").alias("then"), F.col("left").alias("more"))
        nxt = now.join(far, [*key, "next"]).select(*key, "id", F.col("then").alias("next"), (F.col("left") + F.col("more")).alias("left"), (F.col("then") != F.col("next")).alias("moved")).transform(cut)
        now = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            break
    stepped = on.where((F.col("r") != F.col("nr")) | (F.col("c") != F.col("nc")))
    return stepped.join(now.select(*key, "id", (-F.col("left")).alias("place")), [*key, "id"]).select(*key, "loop", "place", "r", "c")


def corners_of(points: list[tuple[float, float]], eps: float) -> list[tuple[float, float]]:
    """The corners of a closed line of points: two that lie far apart, and in each stretch between two corners the point farthest from their line, while it is farther than ``eps``."""
    if len(points) < 3:
        return points
    p = np.asarray(points, float)
    a = int(((p - p[0]) ** 2).sum(1).argmax())
    b = int(((p - p[a]) ** 2).sum(1).argmax())
    a, b = sorted((a, b))
    kept, stack = {a, b}, [(a, b), (b, a + len(p))]
    while stack:
        lo, hi = stack.pop()
        if hi - lo < 2:
            continue
        some = p[np.arange(lo + 1, hi) % len(p)] - p[lo % len(p)]
        line = p[hi % len(p)] - p[lo % len(p)]
        size = np.hypot(*line)
        away = np.abs(some[:, 0] * line[1] - some[:, 1] * line[0]) / size if size else np.hypot(*some.T)
        if away.max() > eps:
            at = lo + 1 + int(away.argmax())
            kept.add(at % len(p))
            stack += [(lo, at), (at, hi)]
    return [tuple(p[i]) for i in sorted(kept)]


#: Fixed values of the start mark: shares of the border's length that a corner may be off, ratio of sides, filling of the box.
OFF, UNEVEN, FILLED = (0.03, 0.04, 0.05, 0.06), 1.55, (0.15, 0.75)


def start_triangles(mask: DataFrame, images: DataFrame, controls: DataFrame | None = None, size: float | None = None, near: float = 25.0) -> DataFrame:
    """``mask``: map_id, r, c; ``images``: map_id, height, width; ``controls``: map_id, x, y. Marks of three even sides: map_id, region, x, y, side (mean), score. The mask is closed, and the outer borders of its
    regions that are of a fitting area and filling are simplified, with more and more tolerance, until three corners stay. Sides are 0.55 to 2.2 of ``size``
    (without it 18 pixels to 0.12 of the image's shorter side); a triangle nearer than ``near`` to a control isn't a start. What stands in a hole is looked at as well."""
    on = loops(_sides_of(closed_border(mask)).transform(cut)).transform(cut)
    low, high = (F.lit(0.55 * size), F.lit(2.2 * size)) if size else (F.lit(18.0), F.least("height", "width") * F.lit(0.12))
    third = 3**0.5 / 4
    c = _measured(on, True).where("outer").join(images.select("map_id", low.alias("low"), high.alias("high")), "map_id")
    fill = F.col("area") / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    c = c.where(F.col("area").between(0.3 * third * F.col("low") * F.col("low"), 1.4 * third * F.col("high") * F.col("high")) & fill.between(*FILLED))
    # area and filling bound the box, and it the border, so a border fits a row
    line = ordered(on.join(c.select("map_id", "region", "loop"), ["map_id", "region", "loop"], "left_semi")).groupBy("map_id", "region", "loop").agg(F.sort_array(F.collect_list(F.struct("place", "c", "r"))).alias("line"))

    def run(frames):
        for f in frames:
            found = []
            for line, perimeter in zip(f["line"], f["perimeter"], strict=True):
                three = (corners_of([(p["c"], p["r"]) for p in line], off * perimeter) for off in OFF)
                found.append(next(([v for p in t for v in p] for t in three if len(t) == 3), None))
            yield f.drop(columns="line").assign(corners=found)

    kinds = ", ".join(f"{n} {k}" for n, k in c.dtypes)
    t = c.join(line, ["map_id", "region", "loop"]).select(*c.columns, "line").mapInPandas(run, f"{kinds}, corners array<double>").where(F.col("corners").isNotNull())
    at = lambda n: F.col("corners")[n]
    sides = [F.hypot(at(2 * i) - at((2 * i + 2) % 6), at(2 * i + 1) - at((2 * i + 3) % 6)) for i in range(3)]
    t = t.withColumn("side", (sides[0] + sides[1] + sides[2]) / 3).withColumn("longest", F.greatest(*sides)).withColumn("shortest", F.least(*sides))
    t = t.where(F.col("side").between(F.col("low"), F.col("high")) & (F.col("longest") <= UNEVEN * F.col("shortest")))
    # the upper corner is always the highest, so each has the quarter for it
    score = 2 * (1 - (F.col("longest") - F.col("shortest")) / F.col("side")) + 0.25 + F.least(F.lit(1.0), F.col("area") / F.greatest(1.4 * third * F.col("high") * F.col("high"), F.lit(1.0)))
    # an outer border begins at the top of its region's least pixel
    t = t.select("map_id", F.shiftright("loop", 2).alias("region"), F.col("cx").alias("x"), F.col("cy").alias("y"), "side", score.alias("score"))
    if controls is None:
        return t
    tile = lambda d: d.withColumn("tx", F.floor(F.col("x") / near)).withColumn("ty", F.floor(F.col("y") / near))
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    other = tile(controls.select("map_id", "x", "y")).select("*", around.alias("a")).select("*", around.alias("b")).select("map_id", F.col("x").alias("ox"), F.col("y").alias("oy"), (F.col("tx") + F.col("a")).alias("tx"), (F.col("ty") + F.col("b")).alias("ty"))
    taken = tile(t).join(other, ["map_id", "tx", "ty"]).where(F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) < near).select("map_id", "region").distinct()
    return t.join(taken, ["map_id", "region"], "left_anti")


def best_start(triangles: DataFrame) -> DataFrame:
    """The best triangle of each map; the first region of equals."""
    return triangles.groupBy("map_id").agg(F.max_by(F.struct("x", "y", "side", "score"), F.struct("score", -F.col("region"))).alias("b")).select("map_id", "b.*")


#: Fixed values of a circle's mark: evenness of the box, least side and area, filling and roundness without a hole.
SQUARE, CIRCLE_SIDE, CIRCLE_AREA, ROUND_RULES = 0.4, 26, 220, (((0.15, 0.65), 0.35), ((0.20, 0.55), 0.55))


def region_stats(labelled: DataFrame, images: DataFrame, least: int = 8) -> DataFrame:
    """Area, box (ends exclusive), centre, fill, radius, holes, perimeter (of the closed region's outer border) and roundness (4 pi area / perimeter squared) of the regions with at least
    ``least`` pixels, and what kind of mark each may be. ``images``: map_id, height, width."""
    s = labelled.groupBy("map_id", "region").agg(F.count("*").alias("area"), F.min("c").alias("x0"), (F.max("c") + 1).alias("x1"), F.min("r").alias("y0"), (F.max("r") + 1).alias("y1"), F.avg("c").alias("cx"), F.avg("r").alias("cy")).where(F.col("area") >= least)
    closed = closed_regions(labelled.join(s.select("map_id", "region"), ["map_id", "region"], "left_semi")).transform(cut)
    border = contours(closed).where("outer").select("map_id", "region", "perimeter")
    s = s.join(hole_counts(closed), ["map_id", "region"]).join(border, ["map_id", "region"]).join(images.select("map_id", "height", "width"), "map_id")
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    long, short = F.greatest(w, h), F.least(w, h)
    s = s.withColumn("fill", F.col("area") / (w * h)).withColumn("radius", short / 2)
    s = s.withColumn("roundness", F.when(F.col("perimeter") > 1e-3, 4 * F.pi() * F.col("area") / (F.col("perimeter") * F.col("perimeter"))).otherwise(0.0))
    aspect = long / short
    line = ((aspect >= 4.0) & (F.col("fill") < 0.35) & (F.col("area") < 0.02 * F.col("height") * F.col("width"))) | ((aspect >= 3.0) & (short <= 6) & (long >= 40))
    like = F.col("holes") > 0
    for fill, roundness in ROUND_RULES:
        like = like | (F.col("fill").between(*fill) & (F.col("roundness") > roundness))
    circle = (F.abs(w - h) <= SQUARE * long) & (short >= CIRCLE_SIDE) & (F.col("area") >= CIRCLE_AREA) & like
    digit = F.col("area").between(12, 8000) & (aspect <= 3.5) & (F.col("fill") >= 0.15) & (long <= 120)
    return s.withColumn("kind", F.when(line, "line").when(circle, "circle").when(digit, "digit").otherwise("noise")).drop("height", "width")


def without_lines(labelled: DataFrame, stats: DataFrame) -> DataFrame:
    """The mask's pixels (map_id, r, c) without regions that are lines; regions too small for ``stats`` stay."""
    return labelled.join(stats.where("kind = 'line'").select("map_id", "region"), ["map_id", "region"], "left_anti").select("map_id", "r", "c")


def annulus_centres(rings: DataFrame, mask: DataFrame, least: int = 12) -> DataFrame:
    """``rings``: map_id, ring, x, y, radius (whole numbers). Mean of the mask's pixels between 0.7 and 1.3 radii, if there are ``least``. Rings are pixels before the join, hundreds
    each, so it's asked to sort and merge: by the size of the rings' table they would be broadcast."""
    reach = F.ceil(F.col("radius") * 1.3).cast("int")
    p = rings.select("*", F.explode(F.sequence(-reach, reach)).alias("a"), reach.alias("k")).select("*", F.explode(F.sequence(-F.col("k"), F.col("k"))).alias("b"))
    d2 = F.col("a") * F.col("a") + F.col("b") * F.col("b")
    p = p.where((100 * d2 >= 49 * F.col("radius") * F.col("radius")) & (100 * d2 <= 169 * F.col("radius") * F.col("radius")))
    p = p.select("map_id", "ring", (F.col("y") + F.col("a")).alias("r"), (F.col("x") + F.col("b")).alias("c")).hint("merge").join(mask.select("map_id", "r", "c"), ["map_id", "r", "c"])
    return p.groupBy("map_id", "ring").agg(F.avg("c").alias("cx"), F.avg("r").alias("cy"), F.count("*").alias("n")).where(F.col("n") >= least)
