"""Operator 4, best-fit packing by patterns and non-negative least squares.

Pieces of documents (only documents longer than a sequence are cut) are packed into sequences of ``capacity`` tokens.
The plan is made in the driver from the histogram of lengths alone, at most ``capacity`` numbers however many
documents there are:

1. *Patterns.* Lengths are put into ``CLASSES`` classes of equal width. Every way to fill a sequence with up
   to two classes, or three, is a pattern; of the two plans the one with fewer sequences is taken.
2. *Fit.* Non-negative least squares gives repeat counts of patterns that come nearest to the histogram of classes; an
   active-set method solves it, so at most as many patterns are used as there are classes. Short classes weigh
   less, as what is left of them fills gaps.
3. *Round.* Counts are rounded down and laid out with lengths that are there: the longer parts of a
   pattern take lengths of their classes, and what they leave is filled by the longest lengths that fit.
4. *Residual.* What is left is packed by best fit, longest first, into the gaps and into new sequences.

Steps 3 and 4 work on runs of equal sequences, never on single documents.

The plan says for each length which ranks go to which run. Pieces are sorted by length over the cluster, ranks
are places in that order (sums of the sizes of the sorted parts, and places within them, both written to the
shared folder first), and each piece finds its run by binary search in the broadcast plan.

Defined results: a null text is the empty text, whose one piece is the end id; equal rows are packed
each for itself; null identifiers are packed like others; an empty table gives no rows; other columns aren't
looked at. Ties in length are ordered by identifier, piece and checksum.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked, ship, table, text_or_empty, tokenizer_path, written
from .tokens import coder, encoded

CAPACITY = 4096
CLASSES = 64
PARTS = (2, 3)
SHORT_WEIGHT = 0.1


def patterns(classes: int, parts: int) -> list[tuple[int, ...]]:
    """Ways to write ``classes`` as a sum of at most ``parts`` positive numbers, largest first."""

    def split(rest: int, most: int, left: int) -> Iterator[tuple[int, ...]]:
        if rest == 0:
            yield ()
        elif left:
            for c in range(min(rest, most), 0, -1):
                if c * left >= rest:
                    for more in split(rest - c, c, left - 1):
                        yield (c, *more)

    return list(split(classes, classes, parts))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 0) -> np.ndarray:
    """x >= 0 that makes a @ x nearest to b (active sets)."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    ata, atb = a.T @ a, a.T @ b
    tolerance = 1e-9 * max(1.0, float(np.abs(atb).max(initial=0)))
    for _ in range(rounds or 6 * a.shape[0]):
        slope = atb - ata @ x
        slope[free] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= tolerance:
            break
        free[best] = True
        while True:
            at = np.flatnonzero(free)
            s = np.zeros(n)
            s[at] = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if not (s[at] <= 1e-12).any():
                break
            low = at[s[at] <= 1e-12]
            gap = x[low] - s[low]
            step = float(np.min(np.where(gap > 0, x[low] / np.where(gap > 0, gap, 1), 0)))
            x = x + step * (s - x)
            free &= x > 1e-12
            x[~free] = 0
        x = s
    return np.maximum(x, 0)


class _Stock:
    """Lengths that are still to be packed, and how many of each."""

    def __init__(self, counts: dict[int, int]):
        self.left = {k: v for k, v in counts.items() if v}
        self.order = sorted(self.left)

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.order.pop(bisect_left(self.order, length))

    def longest(self, most: int, least: int = 1) -> int | None:
        i = bisect_left(self.order, most + 1)
        return self.order[i - 1] if i and self.order[i - 1] >= least else None


def _filled(stock: _Stock, n: int, parts: tuple, gap: int, done: list) -> None:
    """``n`` equal sequences with ``parts`` (length, times): fills their gaps with the longest lengths that fit."""
    open_ = [(n, parts, gap)]
    while open_:
        n, parts, gap = open_.pop()
        length = stock.longest(gap)
        if length is None:
            done.append((n, parts, gap))
            continue
        now = min(n, stock.left[length])
        stock.take(length, now)
        open_.append((now, (*parts, (length, 1)), gap - length))
        if now < n:
            open_.append((n - now, parts, gap))


def plan(counts: dict[int, int], capacity: int = CAPACITY, classes: int = CLASSES, parts: tuple[int, ...] = PARTS) -> list[tuple[int, tuple]]:
    """Runs: how many equal sequences, and the lengths in each with how often, in order. Of the plans with patterns of up to
    each of ``parts`` lengths, the one with the fewest sequences."""
    return min((_plan(counts, capacity, classes, p) for p in parts), key=lambda runs: sum(n for n, _ in runs))


def _plan(counts: dict[int, int], capacity: int, classes: int, parts: int) -> list[tuple[int, tuple]]:
    stock = _Stock(counts)
    done: list[tuple[int, tuple, int]] = []
    classes = min(classes, capacity)
    width = capacity / classes
    of = lambda length: max(1, min(classes, round(length / width)))
    if stock.left:
        ways = patterns(classes, parts)
        a, b = np.zeros((classes, len(ways))), np.zeros(classes)
        for j, w in enumerate(ways):
            for c in w:
                a[c - 1, j] += 1
        for length, n in counts.items():
            b[of(length) - 1] += n
        weight = np.where(np.arange(1, classes + 1) * 4 <= classes, SHORT_WEIGHT, 1.0)
        repeats = np.floor(nnls(a * weight[:, None], b * weight) + 1e-6).astype(np.int64)
        for j in sorted(np.flatnonzero(repeats), key=lambda j: ways[j], reverse=True):
            todo = [(int(repeats[j]), (), capacity)]
            for c in ways[j][:-1]:  # the last part is whatever fits best
                nxt = []
                while todo:
                    n, held, gap = todo.pop()
                    length = stock.longest(min(gap, int((c + 0.5) * width)))
                    if length is None or of(length) != c:
                        if held:
                            nxt.append((n, held, gap))
                        continue
                    now = min(n, stock.left[length])
                    stock.take(length, now)
                    nxt.append((now, (*held, (length, 1)), gap - length))
                    if now < n:
                        todo.append((n - now, held, gap))
                todo = nxt
            for n, held, gap in todo:
                if held:
                    _filled(stock, n, held, gap, done)
    # best fit, longest first: gaps in order, each with the runs that have it
    gaps: dict[int, list] = {}
    order: list[int] = []

    def keep(n: int, held: tuple, gap: int) -> None:
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append((n, held))

    for n, held, gap in done:
        keep(n, held, gap)
    while stock.order:
        length = stock.order[-1]
        n = stock.left[length]
        i = bisect_left(order, length)
        if i == len(order):
            many = capacity // length
            if n >= many:
                made = n // many
                stock.take(length, made * many)
                keep(made, ((length, many),), capacity - many * length)
            else:
                stock.take(length, n)
                keep(1, ((length, n),), capacity - n * length)
            continue
        gap = order[i]
        m, held = gaps[gap].pop()
        if not gaps[gap]:
            del gaps[gap]
            order.pop(i)
        many = gap // length
        if n >= many:
            now = min(m, n // many)
            stock.take(length, now * many)
            keep(now, (*held, (length, many)), gap - many * length)
        else:
            now = 1
            stock.take(length, n)
            keep(1, (*held, (length, n)), gap - n * length)
        if now < m:
            keep(m - now, held, gap)
    return [(n, held) for gap in sorted(gaps) for n, held in gaps[gap]]


def lookup(runs: list[tuple[int, tuple]]) -> dict[str, np.ndarray]:
    """For a length, from which rank on its pieces go to which run: first (rank over all lengths in ascending order),
    sequence of the run's first, offset, length, times."""
    rows, sequence = [], 0
    for n, held in runs:
        offset = 0
        for length, times in held:
            rows.append((length, n * times, sequence, offset, times))
            offset += length * times
        sequence += n
    rows.sort(key=lambda r: r[0])
    out = {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "count", "sequence", "offset", "times"))}
    out["first"] = np.cumsum(out["count"]) - out["count"]
    return out


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 1, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, piece, start, length, ids_crc32, and ids (little-endian unsigned 32-bit) if asked for."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, step = coder(vocabulary), 4 * capacity
        for b in batches:
            for part, coded in encoded(b, 1, code, end_id):
                at, rows = [], []
                for i, ids in enumerate(coded):
                    raw = ids.tobytes()
                    for n, s in enumerate(range(0, len(raw), step)):
                        x = raw[s : s + step]
                        at.append(i)
                        rows.append((n, n * capacity, len(x) // 4, zlib.crc32(x), x if keep_ids else None))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at)), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())))], names=["id", "piece", "start", "length", "ids_crc32", "ids"]
                )
        code.forget()

    rows = picked(docs, id_col, text_col).select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    out = rows.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long, ids binary").withColumnRenamed("id", id_col)
    return out if keep_ids else out.drop("ids")


def packed(cut: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """What :func:`pieces` returns, with sequence_id and offset."""
    order = [F.col("length"), F.col(id_col), F.col("piece"), F.col("ids_crc32")]
    cut, _ = written(cut, "cut")  # sorting by ranges reads its input twice
    rows, _ = written(cut.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "pieces")
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most `capacity` rows
    sizes = dict(rows.groupBy(F.shiftright("_at", 33).alias("part")).count().collect())  # a row for each sorted part
    parts = np.zeros(max(sizes, default=-1) + 2, np.int64)
    for p, n in sizes.items():
        parts[p + 1] = n
    before = np.cumsum(parts)
    plans = lookup(plan(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            rank = before[at >> 33] + (at & ((1 << 33) - 1))
            row = np.searchsorted(plans["first"], rank, "right") - 1
            nth = rank - plans["first"][row]
            times = plans["times"][row]
            sequence = plans["sequence"][row] + nth // times
            offset = plans["offset"][row] + nth % times * plans["length"][row]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_at")
    return rows.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (bytes), offsets (where a document's piece begins)."""
    rows = packed(pieces(docs, vocabulary, capacity, keep_ids=True, id_col=id_col, text_col=text_col), capacity, id_col)
    part = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence has at most `capacity` pieces
    return rows.groupBy("sequence_id").agg(part.alias("_p")).select("sequence_id", F.aggregate("_p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.transform("_p", lambda x: x["offset"]).alias("offsets"))


def pack_documents(docs: DataFrame) -> DataFrame:
    return packed(pieces(docs, tokenizer_path("word_bpe_49k.json"))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
