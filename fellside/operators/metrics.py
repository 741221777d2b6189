"""Segmentation metrics, class weights and losses, over pixels (map_id, gt, pred, ...) or their confusion counts.

Pixels are counted once, with map-side combining; everything else works on at most classes x classes rows of a map.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims

CLASSES = len(dims.CLASSES)
EPS = 1e-6


def confusion(pixels: DataFrame, *by: str, classes: int = CLASSES) -> DataFrame:
    """Only the truth's class is checked to be in range."""
    return pixels.where(F.col("gt").between(0, classes - 1)).groupBy(*by, "gt", "pred").agg(F.count("*").alias("n"))


def class_scores(conf: DataFrame, *by: str, classes: int = CLASSES) -> DataFrame:
    """``by``, class_id, tp, iou, dice for every class of the domain; one that is nowhere has 0."""
    spark = conf.sparkSession
    domain = F.broadcast(spark.range(classes).select(F.col("id").cast("int").alias("class_id")))
    tp = F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0))
    gt = conf.groupBy(*by, F.col("gt").alias("class_id")).agg(F.sum("n").alias("gts"), tp.alias("tp"))
    pr = conf.groupBy(*by, F.col("pred").alias("class_id")).agg(F.sum("n").alias("prs"))
    keys = conf.select(*by).distinct().crossJoin(domain) if by else domain
    j = keys.join(gt, [*by, "class_id"], "left").join(pr, [*by, "class_id"], "left").fillna(0, ["gts", "prs", "tp"])
    union = F.greatest((F.col("gts") + F.col("prs") - F.col("tp")).cast("double"), F.lit(EPS))
    both = F.greatest((F.col("gts") + F.col("prs")).cast("double"), F.lit(EPS))
    return j.select(*by, "class_id", "tp", "gts", "prs", (F.col("tp") / union).alias("iou"), (2 * F.col("tp") / both).alias("dice"))


def summary(scores: DataFrame, *by: str, exclude: tuple[int, ...] = (0, *dims.EMPTY)) -> DataFrame:
    """miou, mdice over the included classes, critical_iou, pixel_acc."""
    kept = ~F.col("class_id").isin(*exclude)
    critical = F.col("class_id").isin(*dims.CRITICAL)
    return scores.groupBy(*by).agg(
        F.avg(F.when(kept, F.col("iou"))).alias("miou"), F.avg(F.when(kept, F.col("dice"))).alias("mdice"), F.avg(F.when(critical, F.col("iou"))).alias("critical_iou"),
        (F.sum("tp") / F.greatest(F.sum("gts").cast("double"), F.lit(EPS))).alias("pixel_acc"),
    )


def class_weights(balance: DataFrame, mode: str, low: float = 0.25, high: float = 10.0, beta: float = 0.9999, boost: dict[int, float] | None = None, empty: float = 0.0, classes: int = CLASSES) -> DataFrame:
    """``balance``: class_id, pixels. Classes with pixels, but for background and the empty ones, are active: their weights are over their mean, then
    clipped. Empty classes have ``empty``, all others 1, as all have in mode none. Boosts multiply after that; active classes are clipped again.
    Sixteen rows, so one window over all is bounded."""
    spark = balance.sparkSession
    p = spark.range(classes).select(F.col("id").cast("int").alias("class_id")).join(balance, "class_id", "left").fillna(0.0, ["pixels"])
    nothing = F.col("class_id").isin(*dims.EMPTY)
    active = ~nothing & (F.col("class_id") != 0) & (F.col("pixels") > 0)
    f = F.greatest(F.col("pixels") / F.sum(F.when(active, F.col("pixels"))).over(Window.partitionBy()), F.lit(1e-12))
    raw = {
        "none": F.lit(1.0),
        "inverse_freq": 1 / f,
        "inverse_sqrt_freq": 1 / F.sqrt(f),
        "effective_number": (1 - beta) / (1 - F.pow(F.lit(beta), F.greatest(f * 10000, F.lit(1.0)))),
    }
    if mode not in raw:
        raise ValueError(f"no such mode: {mode}")
    w = p.select("class_id", nothing.alias("_e"), active.alias("_a"), F.when(active, raw[mode]).alias("_raw"))
    clip = lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high))
    value = F.lit(1.0) if mode == "none" else F.when(F.col("_a"), clip(F.col("_raw") / F.avg("_raw").over(Window.partitionBy()))).otherwise(1.0)
    if boost:
        value = value * F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in boost.items() for x in kv]), F.col("class_id")), F.lit(1.0))
        value = F.when(F.col("_a"), clip(value)).otherwise(value)
    return w.select("class_id", F.when(F.col("_e"), F.lit(empty)).otherwise(value).alias("weight"))


def soft_dice(pixels: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """One less Dice, the mean over classes, weighted by ``weights`` (class_id, weight) over those above 0 if any is; ``pixels``: class_id, prob, hit (1 where the
    class is the truth)."""
    each = pixels.groupBy("class_id").agg(F.sum(F.col("prob") * F.col("hit")).alias("i"), F.sum(F.col("prob") + F.col("hit")).alias("u"))
    each = each.withColumn("one", 1 - (2 * F.col("i") + EPS) / (F.col("u") + EPS))
    if weights is None:
        return each.agg(F.avg("one").alias("loss"))
    each = each.join(weights.where("weight > 0"), "class_id", "left")
    return each.agg(F.coalesce(F.sum(F.col("one") * F.col("weight")) / F.sum("weight"), F.avg("one")).alias("loss"))


def weighted_ce(pixels: DataFrame, weights: DataFrame) -> DataFrame:
    """``pixels``: gt, p; the weighted mean of -ln p."""
    j = pixels.join(F.broadcast(weights), F.col("gt") == F.col("class_id"))  # a row for each class
    return j.agg((F.sum(F.col("weight") * -F.log("p")) / F.sum("weight")).alias("loss"))


def combined_loss(probs: DataFrame, weights: DataFrame, ce: float = 0.5, dice: float = 0.5, lovasz_part: float = 0.0) -> DataFrame:
    """``probs``: pixel, gt, class_id, prob; every class of each pixel. loss, ce, dice, lovasz: cross-entropy and Dice by the same class weights, and the
    mean Lovász loss of the classes that are present, each times its share. A row each, so joining them is no product."""
    hit = (F.col("gt") == F.col("class_id")).cast("int")
    parts = [
        weighted_ce(probs.where(hit == 1).select("gt", F.col("prob").alias("p")), weights).select(F.lit(1).alias("k"), F.col("loss").alias("ce")),
        soft_dice(probs.withColumn("hit", hit), weights).select(F.lit(1).alias("k"), F.col("loss").alias("dice")),
        lovasz(probs.select("class_id", F.abs(hit - F.col("prob")).alias("err"), hit.alias("fg"))).agg(F.avg("loss").alias("lovasz")).withColumn("k", F.lit(1)),
    ]
    all_ = parts[0].join(parts[1], "k").join(parts[2], "k")
    total = ce * F.col("ce") + dice * F.col("dice") + (lovasz_part * F.col("lovasz") if lovasz_part > 0 else F.lit(0.0))
    return all_.select(total.alias("loss"), "ce", "dice", "lovasz")


def lovasz(pixels: DataFrame) -> DataFrame:
    """Lovász-softmax of classes that are present; ``pixels``: class_id, err, fg. A class's errors are ranked over the cluster's
    distinct error values, so a window has a row for each value, not each pixel; pixels with equal errors may be
    in any order, and together they add their error times the change of the Jaccard index across them."""
    by_value = pixels.groupBy("class_id", "err").agg(F.count("*").alias("n"), F.sum("fg").alias("f"))
    own = Window.partitionBy("class_id")
    run = own.orderBy(F.desc("err"))
    t = by_value.select("*", F.sum("f").over(own).alias("all"), F.sum("f").over(run).alias("cf"), F.sum("n").over(run).alias("cn")).where(F.col("all") > 0)
    jac = 1 - (F.col("all") - F.col("cf")) / (F.col("all") + F.col("cn") - F.col("cf"))
    t = t.select("class_id", "err", jac.alias("jac"))
    step = t.select("class_id", (F.col("err") * (F.col("jac") - F.coalesce(F.lag("jac").over(run), F.lit(0.0)))).alias("part"))
    return step.groupBy("class_id").agg(F.sum("part").alias("loss"))
