"""Operator 9, sharding by longest-processing-time scheduling.

Rows with equal texts form a group that stays together. A group's load is the sum of its rows' sizes. Groups
are put, from the largest to the smallest, on the least-loaded shard, which a heap gives.

Groups of equal load can change places, so the driver needs how many there are of each load, not which: a histogram. Its loads
are different and add up to at most the total, so there are at most ``sqrt(2 * total)`` of them, however many groups. A run of
few equal groups goes through the heap one by one; of a long run, the level to which it fills the shards gives at once how many each
shard takes, which is just what the heap would give. Groups are sorted by load over the cluster (ties by hash, so that
equal loads spread over tasks), and a group's place in its run says which shard it is for.

Equal texts are found by 64-bit hash: two different texts with equal hashes would stay
together as well, which breaks no rule. A text, or a load, that makes up more than one in 1,024 of the rows is broadcast with its
shard rather than met in a join.

Rows are numbered within a shard without gathering a shard in one task: each row keeps the number that its
first task gave it (task, place), counts for each (task, shard) are summed up to offsets, and a window over
(task, shard) numbers the rest. The numbers are written to the shared folder first, so that a task that runs
again sees the same ones.

Defined results: a null text has no bytes (size 1) and is grouped with the empty text; a null or repeated
identifier is a row like any other; an empty table gives no rows; of equally loaded shards the lower is
filled first, and of equal groups the one with the lower hash comes first; other columns of the input are not carried.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import picked, table, with_facts, written

SINGLY = 64


def level_shares(filled: list[int], load: int, count: int) -> list[int]:
    """How many of ``count`` equal groups each shard takes if one after the other goes to the least loaded (the lower of equals)."""
    below = lambda level: [max(0, -(-(level - x) // load)) for x in filled]  # noqa: E731 groups that were put below a level
    low, high = min(filled), max(filled) + load * count + 1
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if sum(below(middle)) <= count else (low, middle)
    shares = below(low)
    rest = count - sum(shares)
    for s in range(len(filled)):  # these stand at the level itself
        if rest and filled[s] + shares[s] * load == low:
            shares[s] += 1
            rest -= 1
    return shares


def longest_first(runs: list[tuple[int, int]], shards: int) -> list[list[int]]:
    """``runs``: (load, count) from the largest load to the smallest. For each run, how many of its groups each shard takes."""
    heap, out = [(0, s) for s in range(shards)], []
    for load, count in runs:
        if count <= SINGLY:
            shares = [0] * shards
            for _ in range(count):
                filled, s = heap[0]
                heapq.heapreplace(heap, (filled + load, s))
                shares[s] += 1
        else:
            filled = [x for _, x in sorted((s, x) for x, s in heap)]
            shares = level_shares(filled, load, count)
            heap = [(x + n * load, s) for s, (x, n) in enumerate(zip(filled, shares, strict=True))]
            heapq.heapify(heap)
        out.append(shares)
    return out


def _group_shards(rows: DataFrame, shards: int) -> DataFrame:
    """``rows``: text_hash, size. Distinct text_hash, n (its rows), shard."""
    spark = rows.sparkSession
    sums = rows.groupBy("text_hash").agg(F.sum("size").alias("load"), F.count("*").alias("n"))
    order = [F.desc("load"), F.asc("text_hash")]
    groups, _ = written(sums.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "shard-groups")
    runs = [(r[0], r[1]) for r in groups.groupBy("load").count().collect()]  # at most sqrt(2 * total)
    runs.sort(reverse=True)
    starts = [0, *accumulate(c for _, c in runs)]
    plan = [(load, count, start, list(accumulate(shares))) for (load, count), start, shares in zip(runs, starts, longest_first(runs, shards), strict=False)]
    plan = spark.createDataFrame(plan, "load long, _count long, _start long, _upto array<long>")
    part = F.shiftright("_at", 33)
    sizes = sorted((r[0], r[1]) for r in groups.groupBy(part.alias("p")).count().collect())  # a row for each task
    before = spark.createDataFrame(list(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False)), "_part long, _before long")
    placed = groups.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("_rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    known = with_facts(placed.select("text_hash", "n", "load", "_rank"), plan, "load", "_count", starts[-1])
    return known.select("text_hash", "n", F.size(F.filter("_upto", lambda u: u <= F.col("_rank") - F.col("_start"))).alias("shard"))


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, size, text_crc32, text_hash, shard (int), slot (long, from 0 without gaps in a shard)."""
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows, _ = written(
        picked(docs, id_col, text_col).select(
            F.col(id_col),
            (F.octet_length(data) + F.lit(1)).cast("long").alias("size"),
            F.crc32(data).alias("text_crc32"),
            F.xxhash64(data).alias("text_hash"),
            F.monotonically_increasing_id().alias("_at"),
        ),
        "shard-rows",
    )
    groups, _ = written(_group_shards(rows, shards), "shard-of-groups")
    put = with_facts(rows, groups, "text_hash", "n", rows.count()).withColumn("_task", F.shiftright("_at", 33))
    before = Window.partitionBy("shard").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = put.groupBy("shard", "_task").agg(F.count("*").alias("_n")).select("shard", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_task").orderBy("_at")
    return (
        put.withColumn("_nth", F.row_number().over(within))
        .join(offsets, ["shard", "_task"])
        .select(id_col, "size", "text_crc32", "text_hash", "shard", (F.col("_before") + F.col("_nth") - 1).cast("long").alias("slot"))
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The documents themselves as Parquet, one folder for each shard. Equal texts may differ in id, so rows
    follow the hash of their text rather than their id."""
    where = assign_shards(docs, shards, id_col=id_col, text_col=text_col).select("text_hash", "shard").distinct()
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    docs.withColumn("_hash", F.xxhash64(data)).join(where.withColumnRenamed("text_hash", "_hash"), "_hash").drop("_hash").write.partitionBy("shard").parquet(path)


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    out = assign_shards(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
