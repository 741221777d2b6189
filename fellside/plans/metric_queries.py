"""Queries over derived predictions and probabilities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import dims
from ..operators import metrics as M
from ..sources import derived as D
from .registry import query

DIM = dims.values_sql()
CONF = f"{D.PREDICTIONS}, conf AS (SELECT gt, pred, count(*) AS n FROM pred GROUP BY ALL)"


def scores_sql(by: str, src: str) -> str:
    k = f"{by}, " if by else ""
    keys = f"(SELECT * FROM (SELECT DISTINCT {by} FROM {src}), (SELECT CAST(unnest(range(16)) AS INT) AS class_id))" if by else "(SELECT CAST(unnest(range(16)) AS INT) AS class_id)"
    return f"""g_ AS (SELECT {k}gt AS class_id, sum(n) AS gts, sum(CASE WHEN gt = pred THEN n ELSE 0 END) AS tp FROM {src} GROUP BY ALL), p_ AS (SELECT {k}pred AS class_id, sum(n) AS prs FROM {src} GROUP BY ALL),
sc AS (SELECT {k}class_id, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(gts, 0) AS BIGINT) AS gts, CAST(coalesce(prs, 0) AS BIGINT) AS prs, CAST(coalesce(tp, 0) AS DOUBLE) / greatest(CAST(coalesce(gts, 0) + coalesce(prs, 0) - coalesce(tp, 0) AS DOUBLE), 1e-6) AS iou,
CAST(2 * coalesce(tp, 0) AS DOUBLE) / greatest(CAST(coalesce(gts, 0) + coalesce(prs, 0) AS DOUBLE), 1e-6) AS dice FROM {keys} LEFT JOIN g_ USING ({k}class_id) LEFT JOIN p_ USING ({k}class_id))"""


CRIT = ", ".join(map(str, dims.CRITICAL))
SUMMARY = f"round(avg(CASE WHEN class_id NOT IN (0, 1, 7, 14) THEN iou END), 6) AS miou, round(avg(CASE WHEN class_id NOT IN (0, 1, 7, 14) THEN dice END), 6) AS mdice, round(avg(CASE WHEN class_id IN ({CRIT}) THEN iou END), 6) AS critical_iou, round(CAST(sum(tp) AS DOUBLE) / greatest(CAST(sum(gts) AS DOUBLE), 1e-6), 6) AS pixel_acc"


def rounded(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


@query("confusion", f"WITH {CONF} SELECT gt, pred, n FROM conf")
def confusion(spark, sf_dir):
    return M.confusion(D.predictions(spark, sf_dir))


@query("class_scores", f"WITH {CONF}, {scores_sql('', 'conf')} SELECT class_id, tp, gts, prs, round(iou, 6) AS iou, round(dice, 6) AS dice FROM sc")
def class_scores(spark, sf_dir):
    return rounded(M.class_scores(confusion(spark, sf_dir)), "iou", "dice")


@query("miou_summary", f"WITH {CONF}, {scores_sql('', 'conf')} SELECT {SUMMARY} FROM sc")
def miou_summary(spark, sf_dir):
    return rounded(M.summary(M.class_scores(confusion(spark, sf_dir))), "miou", "mdice", "critical_iou", "pixel_acc")


GS = f"{D.PREDICTIONS}, gs AS (SELECT coalesce(map_id, 'all') AS map_id, gt, pred, count(*) AS n FROM pred GROUP BY GROUPING SETS ((map_id, gt, pred), (gt, pred)))"


@query("miou_grouping_sets", f"WITH {GS}, {scores_sql('map_id', 'gs')} SELECT map_id, {SUMMARY} FROM sc GROUP BY map_id")
def miou_grouping_sets(spark, sf_dir):
    """Per map and overall from one scan: the counts are grouped twice by grouping sets."""
    p = D.predictions(spark, sf_dir)
    gs = p.groupingSets([[F.col("map_id"), F.col("gt"), F.col("pred")], [F.col("gt"), F.col("pred")]], "map_id", "gt", "pred").agg(F.count("*").alias("n")).select(F.coalesce("map_id", F.lit("all")).alias("map_id"), "gt", "pred", "n")
    return rounded(M.summary(M.class_scores(gs, "map_id"), "map_id"), "miou", "mdice", "critical_iou", "pixel_acc")


@query("batch_metrics", f"WITH {CONF}, b AS (SELECT pixel % 20 AS batch, avg(-ln(p)) AS loss FROM pred GROUP BY ALL) SELECT (SELECT round(avg(loss), 6) FROM b) AS loss, (SELECT round(sum(CASE WHEN gt = pred THEN n ELSE 0 END) / sum(n), 6) FROM conf) AS acc, (SELECT count(*) FROM b) AS batches")
def batch_metrics(spark, sf_dir):
    """The loss is the mean of the batches' mean losses, each batch alike; the accuracy is that of the counts of all batches together."""
    ok = (F.col("gt") == F.col("pred")).cast("long")
    b = D.predictions(spark, sf_dir).groupBy((F.col("pixel") % 20).alias("batch")).agg(F.avg(-F.log("p")).alias("loss"), F.sum(ok).alias("right"), F.count("*").alias("n"))
    return b.agg(F.round(F.avg("loss"), 6).alias("loss"), F.round(F.sum("right") / F.sum("n"), 6).alias("acc"), F.count("*").alias("batches"))


@query("focused_confusion_topk", f"WITH {CONF} SELECT pred, n, round(n * 100.0 / (SELECT sum(n) FROM conf WHERE gt = 8), 6) AS share FROM conf WHERE gt = 8 ORDER BY n DESC, pred LIMIT 5")
def focused_confusion_topk(spark, sf_dir):
    own = confusion(spark, sf_dir).where(F.col("gt") == 8)
    total = own.agg(F.sum("n").alias("all"))
    return own.crossJoin(F.broadcast(total)).select("pred", "n", F.round(F.col("n") * 100.0 / F.col("all"), 6).alias("share")).orderBy(F.desc("n"), "pred").limit(5)


@query("agreement", f"WITH {D.PREDICTIONS} SELECT map_id, round(avg(CASE WHEN gt = pred THEN 100.0 ELSE 0.0 END), 6) AS percent FROM pred GROUP BY map_id")
def agreement(spark, sf_dir):
    return D.predictions(spark, sf_dir).groupBy("map_id").agg(F.round(F.avg(F.when(F.col("gt") == F.col("pred"), 100.0).otherwise(0.0)), 6).alias("percent"))


BALANCE = f"{D.PREDICTIONS}, bal AS (SELECT CAST(c AS INT) AS class_id, coalesce(n, 0) AS px FROM (SELECT unnest(range(16)) AS c) LEFT JOIN (SELECT gt, count(*) AS n FROM pred WHERE gt < 13 GROUP BY gt) ON gt = c)"


def weights_sql(mode: str, boost: str = "") -> str:
    """Of classes 13 and 15, which have no pixels here but aren't among the empty ones, the weight is 1; classes 1, 7 and 14 are empty."""
    raw = {"none": "1.0", "inverse_freq": "1 / f", "inverse_sqrt_freq": "1 / sqrt(f)", "effective_number": "(1 - CAST(0.9999 AS DOUBLE)) / (1 - pow(CAST(0.9999 AS DOUBLE), greatest(f * 10000, 1)))"}[mode]
    v = "1.0" if mode == "none" else "CASE WHEN raw IS NULL THEN 1.0 ELSE least(greatest(raw / m, 0.25), 10.0) END"
    v = f"CASE b.class_id WHEN 8 THEN least(greatest(2.0 * {v}, 0.25), 10.0) WHEN 13 THEN 3.0 * {v} ELSE {v} END" if boost else v
    return f"""WITH {BALANCE}, act AS (SELECT class_id, CAST(px AS DOUBLE) / (SELECT sum(px) FROM bal WHERE class_id NOT IN (0, 1, 7, 14)) AS f FROM bal WHERE class_id NOT IN (0, 1, 7, 14) AND px > 0), w AS (SELECT class_id, CAST({raw} AS DOUBLE) AS raw FROM act),
mm AS (SELECT avg(raw) AS m FROM w) SELECT b.class_id, round(CASE WHEN b.class_id IN (1, 7, 14) THEN 0.0 ELSE {v} END, 6) AS weight FROM bal b LEFT JOIN w ON w.class_id = b.class_id, mm"""


def _weights(mode, boost=None):
    def run(spark, sf_dir):
        p = D.predictions(spark, sf_dir).where(F.col("gt") < 13).groupBy(F.col("gt").alias("class_id")).agg(F.count("*").cast("double").alias("pixels"))
        return rounded(M.class_weights(p, mode, boost=boost), "weight")

    return run


for _mode in ("none", "inverse_freq", "inverse_sqrt_freq", "effective_number"):
    query(f"class_weights_{_mode}", weights_sql(_mode))(_weights(_mode))
query("class_weights_boosted", weights_sql("inverse_sqrt_freq", "8"))(_weights("inverse_sqrt_freq", {8: 2.0, 13: 3.0}))


def probabilities(spark, sf_dir):
    """vec, px (from 0), class_id, prob: a softmax over each sixteen values of an embedding, a pixel each."""
    e = D.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    x = e.select("vec_id", F.floor(F.col("k") / 16).cast("int").alias("px"), (F.col("k") % 16).cast("int").alias("class_id"), F.exp(F.col("v").cast("double")).alias("e"))
    return x.withColumn("prob", F.col("e") / F.sum("e").over(Window.partitionBy("vec_id", "px"))).drop("e")


PROBS = """ex AS (SELECT vec_id, unnest(range(len(embedding))) AS k, unnest(embedding) AS v FROM embeddings), xe AS (SELECT vec_id, CAST(k // 16 AS INT) AS px, CAST(k % 16 AS INT) AS class_id, exp(CAST(v AS DOUBLE)) AS e FROM ex),
probs AS (SELECT vec_id, px, class_id, e / sum(e) OVER (PARTITION BY vec_id, px) AS prob FROM xe)"""


@query("softmax_blend", f"""WITH {PROBS}, b AS (SELECT vec_id // 2 AS pixel, class_id, sum(prob * (1 + px)) / sum(1 + px) AS p FROM probs GROUP BY ALL) SELECT pixel, arg_max(class_id, {{'p': round(p, 9), 'c': -class_id}}) AS class_id, round(max(p), 6) AS confidence FROM b GROUP BY pixel""")
def softmax_blend(spark, sf_dir):
    """Weighted mean of overlapping windows' probabilities, then the first largest class."""
    b = probabilities(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 2).alias("pixel"), "class_id").agg((F.sum(F.col("prob") * (1 + F.col("px"))) / F.sum(1 + F.col("px"))).alias("p"))
    return b.groupBy("pixel").agg(F.max_by("class_id", F.struct(F.round("p", 9), -F.col("class_id"))).alias("class_id"), F.round(F.max("p"), 6).alias("confidence"))


@query("confidence", f"WITH {PROBS}, c AS (SELECT vec_id, px, max(prob) AS conf FROM probs GROUP BY ALL) SELECT vec_id, round(avg(conf), 6) AS mean_confidence, round(max(conf), 6) AS max_confidence FROM c GROUP BY vec_id")
def confidence(spark, sf_dir):
    c = probabilities(spark, sf_dir).groupBy("vec_id", "px").agg(F.max("prob").alias("conf"))
    return c.groupBy("vec_id").agg(F.round(F.avg("conf"), 6).alias("mean_confidence"), F.round(F.max("conf"), 6).alias("max_confidence"))


TRUTH = f"{PROBS}, tr AS (SELECT *, CAST((vec_id + px) % 16 AS INT) AS gt FROM probs)"


def truth(spark, sf_dir):
    return probabilities(spark, sf_dir).withColumn("gt", ((F.col("vec_id") + F.col("px")) % 16).cast("int"))


DICE = "d AS (SELECT class_id, 1 - (2 * sum(CASE WHEN gt = class_id THEN prob ELSE 0 END) + 1e-6) / (sum(prob + CASE WHEN gt = class_id THEN 1 ELSE 0 END) + 1e-6) AS one FROM tr GROUP BY ALL), wt AS (SELECT class_id, CAST(greatest(priority - 3, 0) AS DOUBLE) AS weight FROM dim)"


def class_weight_table(spark):
    """A weight for each class; four are 0."""
    return dims.dim_class(spark).select("class_id", F.greatest(F.col("priority") - 3, F.lit(0)).cast("double").alias("weight"))


@query("soft_dice", f"WITH {TRUTH}, {DIM}, {DICE} SELECT round(sum(one * weight) / sum(weight), 6) AS loss, (SELECT round(avg(one), 6) FROM d) AS plain FROM d JOIN wt USING (class_id) WHERE weight > 0")
def soft_dice(spark, sf_dir):
    t = truth(spark, sf_dir).withColumn("hit", (F.col("gt") == F.col("class_id")).cast("int"))
    one = F.lit(1).alias("k")
    plain = M.soft_dice(t).select(one, F.round("loss", 6).alias("plain"))
    return M.soft_dice(t, class_weight_table(spark)).select(one, F.round("loss", 6).alias("loss")).join(plain, "k").drop("k")


LOVASZ = """le AS (SELECT class_id, abs(CASE WHEN gt = class_id THEN 1.0 ELSE 0.0 END - prob) AS err, CASE WHEN gt = class_id THEN 1 ELSE 0 END AS fg, vec_id, px FROM tr),
ls AS (SELECT class_id, err, sum(fg) OVER (PARTITION BY class_id) AS al, sum(fg) OVER w AS cf, row_number() OVER w AS cn FROM le WINDOW w AS (PARTITION BY class_id ORDER BY err DESC, vec_id, px ROWS UNBOUNDED PRECEDING)),
lj AS (SELECT class_id, err, cn, 1 - (al - cf) / (al + cn - cf) AS jac FROM ls WHERE al > 0), lq AS (SELECT class_id, err * (jac - coalesce(lag(jac) OVER (PARTITION BY class_id ORDER BY cn), 0)) AS part FROM lj),
lv AS (SELECT class_id, sum(part) AS loss FROM lq GROUP BY class_id)"""


@query("combined_loss", f"WITH {TRUTH}, {DIM}, {DICE}, {LOVASZ}, c AS (SELECT sum(weight * -ln(prob)) / sum(weight) AS ce FROM tr JOIN wt USING (class_id) WHERE gt = class_id), di AS (SELECT sum(one * weight) / sum(weight) AS dice FROM d JOIN wt USING (class_id) WHERE weight > 0), lo AS (SELECT avg(loss) AS lovasz FROM lv) SELECT round(0.4 * ce + 0.4 * dice + 0.2 * lovasz, 6) AS loss, round(ce, 6) AS ce, round(dice, 6) AS dice, round(lovasz, 6) AS lovasz FROM c, di, lo")
def combined_loss(spark, sf_dir):
    t = truth(spark, sf_dir).select(F.struct("vec_id", "px").alias("pixel"), "gt", "class_id", "prob")
    return rounded(M.combined_loss(t, class_weight_table(spark), 0.4, 0.4, 0.2), "loss", "ce", "dice", "lovasz")


@query("weighted_ce", f"WITH {TRUTH}, {DIM} SELECT round(sum((1 + priority) * -ln(prob)) / sum(1 + priority), 6) AS loss FROM tr JOIN dim USING (class_id) WHERE gt = class_id")
def weighted_ce(spark, sf_dir):
    w = dims.dim_class(spark).select("class_id", (1 + F.col("priority")).cast("double").alias("weight"))
    t = truth(spark, sf_dir).where(F.col("gt") == F.col("class_id")).select("gt", F.col("prob").alias("p"))
    return rounded(M.weighted_ce(t, w), "loss")


@query("lovasz", f"""WITH {TRUTH}, e AS (SELECT class_id, abs(CASE WHEN gt = class_id THEN 1.0 ELSE 0.0 END - prob) AS err, CASE WHEN gt = class_id THEN 1 ELSE 0 END AS fg, vec_id, px FROM tr),
s AS (SELECT class_id, err, sum(fg) OVER (PARTITION BY class_id) AS al, sum(fg) OVER w AS cf, row_number() OVER w AS cn FROM e WINDOW w AS (PARTITION BY class_id ORDER BY err DESC, vec_id, px ROWS UNBOUNDED PRECEDING)),
j AS (SELECT class_id, err, cn, 1 - (al - cf) / (al + cn - cf) AS jac FROM s WHERE al > 0), q AS (SELECT class_id, err * (jac - coalesce(lag(jac) OVER (PARTITION BY class_id ORDER BY cn), 0)) AS part FROM j) SELECT class_id, round(sum(part), 6) AS loss FROM q GROUP BY class_id""")
def lovasz(spark, sf_dir):
    hit = (F.col("gt") == F.col("class_id")).cast("int")
    return rounded(M.lovasz(truth(spark, sf_dir).select("class_id", F.abs(hit - F.col("prob")).alias("err"), hit.alias("fg"))), "loss")


@query("lr_schedule", "SELECT step, round(CASE WHEN step < 10 THEN 0.001 * (step + 1) / 10 ELSE 0.001 * pow(1 - least((step - 10) / 90, 1.0), 0.9) END, 9) AS poly, round(CASE WHEN step < 10 THEN 0.001 * (step + 1) / 10 ELSE 0.001 * (1 + cos(least((step - 10) / 90, 1.0) * 3.141592653589793)) / 2 END, 9) AS cosine FROM (SELECT unnest(range(100)) AS step)")
def lr_schedule(spark, sf_dir):
    from ..functions.scalars import learning_rate

    s = F.col("step")
    return spark.range(100).select(F.col("id").alias("step")).select("step", F.round(learning_rate(s, 100, 10, 0.001, 0.9), 9).alias("poly"), F.round(learning_rate(s, 100, 10, 0.001, None), 9).alias("cosine"))


@query("ema", "SELECT vec_id, round(list_reduce(CAST(embedding AS DOUBLE[]), lambda a, x: a * 0.9 + x * 0.1), 6) AS ema FROM embeddings")
def ema(spark, sf_dir):
    """Exponential moving average of a value's updates, in order, from the first one on."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    rest = F.slice(e, F.lit(2), F.greatest(F.size(e) - 1, F.lit(0)))
    return D.table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(rest, F.get(e, F.lit(0)), lambda a, x: a * 0.9 + x * 0.1), 6).alias("ema"))


@query("focused_confusion", f"WITH {CONF}, s AS (SELECT 'truth' AS side, gt AS class_id, pred AS other, n FROM conf UNION ALL SELECT 'prediction', pred, gt, n FROM conf), t AS (SELECT side, class_id, sum(n) AS total FROM s GROUP BY ALL), u AS (SELECT class_id, sum(CASE WHEN side = 'truth' THEN total ELSE 0 END) + sum(CASE WHEN side = 'prediction' THEN total ELSE 0 END) AS all_n FROM t GROUP BY ALL), hit AS (SELECT gt AS class_id, n AS tp FROM conf WHERE gt = pred) SELECT side, class_id, other, n, round(n * 100.0 / total, 6) AS share, round(coalesce(tp, 0) / (all_n - coalesce(tp, 0)), 6) AS iou FROM s JOIN t USING (side, class_id) JOIN u USING (class_id) LEFT JOIN hit USING (class_id)")
def focused_confusion(spark, sf_dir):
    """For each class, what it is taken for and what is taken for it, with shares and its IoU. At most classes x classes x 2 rows."""
    c = confusion(spark, sf_dir)
    s = c.select(F.lit("truth").alias("side"), F.col("gt").alias("class_id"), F.col("pred").alias("other"), "n").union(c.select(F.lit("prediction"), "pred", "gt", "n"))
    own = F.sum("n").over(Window.partitionBy("side", "class_id"))
    both = F.sum("n").over(Window.partitionBy("class_id"))
    tp = F.sum(F.when((F.col("other") == F.col("class_id")) & (F.col("side") == "truth"), F.col("n")).otherwise(0)).over(Window.partitionBy("class_id"))
    return s.select("side", "class_id", "other", "n", F.round(F.col("n") * 100.0 / own, 6).alias("share"), F.round(tp / (both - tp), 6).alias("iou"))


@query("early_stopping", f"WITH {D.PREDICTIONS}, ep AS (SELECT CAST(pixel % 40 AS INT) AS epoch, round(avg(CASE WHEN gt = pred THEN 1.0 ELSE 0.0 END), 9) AS score FROM pred GROUP BY ALL), b AS (SELECT *, coalesce(max(score) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS best FROM ep), i AS (SELECT *, max(CASE WHEN score > best THEN epoch END) OVER (ORDER BY epoch) AS last FROM b) SELECT epoch, score, score > best AS improved, epoch - last AS waited FROM i")
def early_stopping(spark, sf_dir):
    """Epochs since the last strict improvement; a row for each epoch."""
    ep = D.predictions(spark, sf_dir).groupBy((F.col("pixel") % 40).cast("int").alias("epoch")).agg(F.round(F.avg((F.col("gt") == F.col("pred")).cast("double")), 9).alias("score"))
    run = Window.orderBy("epoch")
    b = ep.withColumn("best", F.coalesce(F.max("score").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1.0)))
    i = b.withColumn("last", F.max(F.when(F.col("score") > F.col("best"), F.col("epoch"))).over(run))
    return i.select("epoch", "score", (F.col("score") > F.col("best")).alias("improved"), (F.col("epoch") - F.col("last")).alias("waited"))
