"""Operator 7, quality rules with robust multivariate outliers.

*Base rules.* A document with fewer than ten words, or with more than a fifth of its words in five-word windows that the
text holds twice or more, fails.

*Method.* For each language and source, location and scatter of four transformed statistics (``FEATURES``) are estimated
by the minimum covariance determinant over all documents that pass the base rules, and a document is rejected
if its squared Mahalanobis distance exceeds ``CUTOFF``. The estimate has two starts, medians with quartiles and means with the covariance
of all rows. Each takes ``STEPS`` concentration steps: distances, the half with the least, mean and covariance of that half. Of
the two, the one with the least determinant counts; then follows a reweighting step over all within the 0.975 quantile. Covariances are made consistent for the
share of rows they stem from, and ``FLOORS`` are
added to their diagonal: a group of copies, or a statistic that is the same almost everywhere, doesn't make all else
an outlier, and a group of one row has a verdict like any other.

A concentration step is one aggregation. Statistics are whole thousandths, so sums and products add up exactly
in any order. Rows are summed up by group, start and distance class (sixteenths of a power of two), in an exchange of its own; only then do the
few hundred classes of a group meet, and give the half and its moments (of the class that the half ends in, the share that is
needed). Quartiles come likewise from counts of each value. Estimates are two rows for each group: broadcast, if their number is at most
``GROUPS``, else joined with the large groups apart. No task gets the rows of a hot source, only sums of them.

Defined results: a null or empty text has no words and fails; a null language or source is a group of its own; rows are
judged each for itself, repeated ones alike; an empty table gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, table, with_facts, written

MIN_WORDS = 10
WINDOW = 5
REPEAT_PERCENT = 20
# Symbols that count, the least standard deviation of each statistic, the cut on squared distances.
SYMBOLS = b"#*$%&|<>"
FEATURES = ("word_length", "symbols", "dup_lines", "repeats")
FLOORS = (0.15, 0.15, 0.5, 0.05)
CUTOFF = 36.0
STEPS = 6
GROUPS = 1 << 16
SCALE = 1000
CLASSES_PER_OCTAVE = 16
_P = len(FEATURES)
# Quantiles of the chi-squared distribution with four degrees of freedom.
CHI_HALF, CHI_975 = 3.356694, 11.143287


def _chi6(x: float) -> float:
    """Distribution function of chi-squared with six degrees of freedom."""
    return 1 - math.exp(-x / 2) * (1 + x / 2 + x * x / 8)


def consistency(share: float, quantile: float) -> float:
    """By what the covariance of a Gaussian's inner ``share`` falls short."""
    return share / _chi6(quantile)


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text. Splitting bytes parts words at just the
    characters that part them here."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    chars = len(text) - sum(text.count(c) for c in " \t\n\r\x0b\x0c")
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        end = 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + WINDOW - max(i, end)
                end = i + WINDOW
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = np.array([statistics(t.as_py()) for t in b.column(0)], np.int64).reshape(-1, 5)
        yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], names=[*b.schema.names[1:], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``keep``, the statistics, base_failed, _g0.. (groups, null apart) and _x0.. (transformed, in thousandths)."""
    ship(docs.sparkSession)
    groups = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("")).alias(f"_g{i}") for i, c in enumerate(group_cols)]
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text"), *[F.col(f"`{k}`").alias(k) for k in keep], *groups)
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[1:])
    out = rows.mapInArrow(_measured, f"{kinds}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    n = F.greatest(F.col("n_words"), F.lit(1))
    x = [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), F.log1p(10 * F.col("n_symbols") / n), F.log1p(F.col("n_dup_lines")), F.col("n_repeat_words") / n]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.select("*", failed.alias("base_failed"), *[F.round(c * SCALE).cast("long").alias(f"_x{i}") for i, c in enumerate(x)])


_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]
_ESTIMATE = ", ".join([*(f"c{i} double" for i in range(_P)), *(f"w{i}{j} double" for i, j in _PAIRS)])


def _distance() -> Column:
    """Squared, of _x0.. from the estimate's centre c0.. by its inverse covariance w00.. (both in units, not thousandths)."""
    d = [F.col(f"_x{i}") / F.lit(float(SCALE)) - F.col(f"c{i}") for i in range(_P)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + (1.0 if i == j else 2.0) * F.col(f"w{i}{j}") * d[i] * d[j]
    return F.greatest(total, F.lit(0.0))


def _solved(factor: float, names: list[str]):
    """From rows (group, _n, sums s0.. and products p00.. of thousandths) to estimates with their determinants."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = f["_n"].to_numpy(float)
            s = f[[f"s{i}" for i in range(_P)]].to_numpy(float) / n[:, None] / SCALE
            cov = np.zeros((len(f), _P, _P))
            for i, j in _PAIRS:
                cov[:, i, j] = cov[:, j, i] = f[f"p{i}{j}"].to_numpy(float) / n / SCALE**2 - s[:, i] * s[:, j]
            cov = factor * cov + np.diag(np.square(FLOORS))
            w = np.linalg.inv(cov)
            out = f[names].copy()
            for i in range(_P):
                out[f"c{i}"] = s[:, i]
            for i, j in _PAIRS:
                out[f"w{i}{j}"] = w[:, i, j]
            out["det"] = np.linalg.det(cov)
            yield out

    return run


def _quartiles(rows: DataFrame, names: list[str]) -> DataFrame:
    """``names``, q0.. (arrays of the three quartiles of each statistic), from counts of each of its values."""
    long = rows.select(*names, F.posexplode(F.array(*[F.col(f"_x{i}") for i in range(_P)])).alias("_i", "_v"))
    counts = long.groupBy(*names, "_i", "_v").agg(F.count("*").alias("_n"))
    own = Window.partitionBy(*names, "_i")
    counts = counts.withColumn("_upto", F.sum("_n").over(own.orderBy("_v"))).withColumn("_all", F.sum("_n").over(own))
    cut = lambda part: F.min(F.when(F.col("_upto") >= F.col("_all") * part, F.col("_v")))
    each = counts.groupBy(*names, "_i").agg(F.array(cut(0.25), cut(0.5), cut(0.75)).alias("_q"))
    return each.groupBy(*names).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(f"q{i}") for i in range(_P)])


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """The minimum-covariance-determinant estimate of each group (_g0..) of ``rows`` (_x0..), with det, its determinant, and rows, the group's."""
    names = [n for n in rows.columns if n.startswith("_g")]
    kinds = ", ".join(f"{n} string" for n in names)

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = f[names].copy()
            q = [np.array(f[f"q{i}"].tolist(), float).reshape(-1, 3) / SCALE for i in range(_P)]
            for i in range(_P):
                out[f"c{i}"] = q[i][:, 1]
            for i, j in _PAIRS:
                out[f"w{i}{j}"] = 1 / (np.square((q[i][:, 2] - q[i][:, 0]) / 1.349) + FLOORS[i] ** 2) if i == j else 0.0
            out["det"] = np.inf
            yield out

    out_kinds = f"{kinds}, {_ESTIMATE}, det double"
    moments = [F.sum(f"_x{i}").alias(f"s{i}") for i in range(_P)] + [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"p{i}{j}") for i, j in _PAIRS]
    all_, _ = written(rows.groupBy(*names).agg(F.count("*").alias("_n"), *moments), "mcd-all")
    starts = [_quartiles(rows, names).mapInPandas(first, out_kinds), all_.mapInPandas(_solved(1.0, names), out_kinds)]
    sizes = all_.select(*names, F.col("_n").alias("_rows"))
    now, _ = written(reduce(DataFrame.unionByName, [x.withColumn("_start", F.lit(k)) for k, x in enumerate(starts)]).join(sizes, names), "mcd")
    keyed = [*names, "_start", "_rows"]
    keyed_kinds = f"{kinds}, _start int, _rows long, {_ESTIMATE}, det double"
    summed = ["_n", *(f"s{i}" for i in range(_P)), *(f"p{i}{j}" for i, j in _PAIRS)]
    for _ in range(steps):
        near = _with_estimates(rows, now, names).withColumn("_d", _distance())
        classes = near.withColumn("_c", F.floor(CLASSES_PER_OCTAVE * F.log2(1 + F.col("_d"))).cast("int")).groupBy(*keyed, "_c").agg(F.count("*").alias("_n"), *moments)
        own = Window.partitionBy(*keyed)
        before = F.coalesce(F.sum("_n").over(own.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        half = F.greatest(F.floor((F.col("_rows") + _P + 1) / 2), F.lit(1))
        part = F.least((half - F.col("_before")) / F.col("_n"), F.lit(1.0))
        inner = classes.withColumn("_before", before).withColumn("_part", part).where("_part > 0").groupBy(*keyed).agg(*[F.sum(F.col(c) * F.col("_part")).alias(c) for c in summed])
        now, _ = written(inner.mapInPandas(_solved(consistency(0.5, CHI_HALF), keyed), keyed_kinds), "mcd")
    best = now.groupBy(*names).agg(F.min_by(F.struct(*[c for c in now.columns if c not in names]), F.struct("det", "_start")).alias("_e")).select(*names, "_e.*")
    best, _ = written(best, "mcd")
    inner = _with_estimates(rows, best, names).where(_distance() <= CHI_975).groupBy(*keyed).agg(F.count("*").alias("_n"), *moments)
    solved, _ = written(inner.mapInPandas(_solved(consistency(0.975, CHI_975), keyed), keyed_kinds), "mcd")
    # a group with no row within the quantile keeps its last estimate
    return written(solved.unionByName(best.join(solved.select(*names), names, "left_anti")).drop("_start"), "mcd")[0]


def _with_estimates(rows: DataFrame, found: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with the estimates of their group. Those of at most ``GROUPS`` groups are broadcast; of more, those of large groups are."""
    if found.count() <= 2 * GROUPS:
        return rows.join(F.broadcast(found), names)
    held = found.groupBy(F.struct(*names).alias("_key")).agg(F.max("_rows").alias("_size"), F.collect_list(F.struct(*[c for c in found.columns if c not in names])).alias("_e"))
    total = held.agg(F.sum("_size")).first()[0] or 0
    joined = with_facts(rows.withColumn("_key", F.struct(*names)), held, "_key", "_size", total)
    return joined.select("*", F.explode("_e").alias("_one")).select(*rows.columns, "_one.*")


def judged(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"), cutoff: float = CUTOFF) -> DataFrame:
    """``keep``, the statistics, base_failed, distance (squared; null if the base rules fail) and kept."""
    rows, _ = written(measured(docs, keep, text_col, group_cols), "stats")
    names = [n for n in rows.columns if n.startswith("_g")]
    found = estimates(rows.where(~F.col("base_failed")).select(*names, *[f"_x{i}" for i in range(_P)]))
    fields = [c for c in found.columns if c not in names]
    # every group with a row that passes the base rules has an estimate; the others' rows need none
    none = rows.where("base_failed").withColumn("distance", F.lit(None).cast("double"))
    both = _with_estimates(rows.where(~F.col("base_failed")), found, names).withColumn("distance", _distance()).drop(*fields).unionByName(none)
    return both.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", (~F.col("base_failed") & (F.col("distance") <= cutoff)).alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, that pass. Statistics depend on the text, verdicts on text and group, so these
    name the rows to drop."""
    key = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("key")
    bad = judged(docs.select(key, "text", "lang", "source"), ("key", "lang", "source")).where(~F.col("kept"))
    bad = bad.select(F.col("key").alias("bad_key"), F.col("lang").alias("bad_lang"), F.col("source").alias("bad_source")).distinct()
    rows = docs.select(F.struct("*").alias("row"), key, "lang", "source")
    same = (rows["key"] == bad["bad_key"]) & rows["lang"].eqNullSafe(bad["bad_lang"]) & rows["source"].eqNullSafe(bad["bad_source"])
    return rows.join(bad, same, "left_anti").select("row.*")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).drop("distance")
