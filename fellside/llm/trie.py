"""Operator 12, the trie of conversation prefixes.

A turn is told by 128 bits of the SHA-256 of its role and text, so texts aren't moved beyond the first step. Conversations that are alike turn for turn are first
added up to one sequence (how many, the least identifier, the hash of all identifiers); what follows sees each sequence once.

*Dealing.* Sequences are dealt by the digest of their first turn: many first turns share a bucket of about ``BUCKET`` turns. The subtrie of a
first turn with over ``LIMIT`` turns is not built in one task: what all its sequences begin with is found (the common beginning of the least
and the greatest of them), those nodes are made by aggregation, and the sequences are dealt again by the turn after it, until no subtrie is too large. So a
round goes at least one branching deeper, and a long common beginning costs one round.

*Building.* A bucket is built in applyInPandas as a dictionary from (node, digest) to node. Nodes are numbered as they are made, parents first, so going through
the numbers backwards visits children before their parents, without recursion. Sums over the subtries of large first turns are then carried up a round at a time, by aggregation.

*Hash of identifiers.* Conversations of one sequence are sorted over the cluster; tasks join runs of identifiers to text, and one task a sequence only hashes these texts one
after another, without keeping them (SHA-256 has no other order).

Bounds: a conversation is one row of 24 bytes a turn, so it must have fewer than some 50 million turns. Keys of large subtries are at most the number of turns over ``LIMIT``; up to ``MARKED`` of them are
broadcast, more are joined by a shuffle.

Defined results: a null role or text is the empty one; turns with equal numbers are ordered by role, then by digest; repeated rows are turns of their own; rows without a conversation's identifier belong to none and
have no result; a conversation without turns ends at the root; an empty table gives no rows, not even a root; other columns aren't looked at."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked, ship, table, with_facts, written

LIMIT = 1 << 16
BUCKET = 1 << 14
MARKED = 1 << 16
#: Identifiers that are joined to one text.
RUN = 1 << 15

_HASHED = "conv_id long, sid binary, seq array<binary>, lens array<long>"
_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, above binary"
NOBODY = hashlib.sha256(b"").hexdigest()


def _digest(column):
    return F.substring(F.unhex(F.sha2(column, 256)), 1, 16)


def _cut(array, start, length):
    return F.slice(array, start, length)


def sequences(turns: DataFrame) -> DataFrame:
    """``turns``: conv_id, turn, role, text. A row (conv_id, seq, lens) a conversation: digests and code points of its turns in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = picked(turns, "conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull())
    turn = F.struct("turn", role.alias("role"), _digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.length(text).cast("long").alias("n"))
    each = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return each.select("conv_id", F.col("t.digest").alias("seq"), F.col("t.n").alias("lens"))


def spliced(convs: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """The first h turns of conversation c - c % ``group``, then each one's own turns after its first h; h is the CRC-32 of the decimal c, modulo ``most``."""
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), *[_cut(c, 1, most - 1).alias(f"head_{c}") for c in ("seq", "lens")])
    rows = convs.withColumn("base", base).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")).join(heads, "base", "left")
    # a conversation has a row of its own, so a base stands for fewer than two hundred
    joined = [F.concat(F.coalesce(_cut(f"head_{c}", F.lit(1), F.col("h")), _cut(c, 1, 0)), _cut(c, F.col("h") + 1, F.greatest(F.size(c), F.lit(1)))).alias(c) for c in ("seq", "lens")]
    return rows.select("conv_id", *joined)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (sid, conv_id): runs of one sequence as texts."""

    def out(sid, ids):
        return pa.RecordBatch.from_pydict({"sid": [sid], "first": [ids[0]], "ids": [",".join(map(str, ids))]}, pa.schema([("sid", pa.binary()), ("first", pa.int64()), ("ids", pa.string())]))

    now, ids = None, []
    for b in batches:
        for sid, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if ids and (sid != now or len(ids) >= RUN):
                yield out(now, ids)
                ids = []
            now = sid
            ids.append(conv)
    if ids:
        yield out(now, ids)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sid, first, ids) sorted by the first two: the hash of each sequence's texts."""
    now, state = None, None
    out: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.binary()), pa.array([h for _, h in out], pa.string())], ["sid", "ends"])

    for b in batches:
        for sid, ids in zip(b.column(0), b.column(2), strict=True):
            sid = sid.as_py()
            if sid != now:
                if state is not None:
                    out.append((now, state.hexdigest()))
                now, state = sid, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_py().encode())
            if len(out) >= 1 << 12:
                yield batch()
                out = []
    if state is not None:
        out.append((now, state.hexdigest()))
        yield batch()


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """A row (seq, lens, n, low, ends) for each distinct sequence: its conversations' number, least identifier and hash. Written."""
    sid = _digest(F.concat_ws("", F.transform("seq", F.hex)))
    rows, _ = written(convs.select("conv_id", sid.alias("sid"), "seq", "lens"), "conversations")
    counts, _ = written(rows.groupBy("sid").agg(F.count("*").alias("n"), F.min("conv_id").alias("low")), "sequences")
    several = counts.where(F.col("n") > 1)
    members = with_facts(rows.select("sid", "conv_id"), several.select("sid", "n", F.lit(True).alias("more")), "sid", "n", rows.count()).select("sid", "conv_id")
    runs = members.repartitionByRange("sid", "conv_id").sortWithinPartitions("sid", "conv_id").mapInArrow(_joined, "sid binary, first long, ids string")
    ends, _ = written(runs.repartition("sid").sortWithinPartitions("sid", "first").mapInArrow(_hashed, "sid binary, ends string"), "sequence-ends")
    once = counts.where(F.col("n") == 1).select("n", "low", F.sha2(F.col("low").cast("string"), 256).alias("ends"))
    facts = once.union(several.join(ends, "sid").select("n", "low", "ends"))
    return written(facts.join(rows.select("conv_id", "seq", "lens"), F.col("low") == F.col("conv_id")).select("seq", "lens", "n", "low", "ends"), "distinct-sequences")[0]


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    """The subtries of a bucket: ``key`` names a subtrie, whose top is at depth ``base``."""
    at: dict[tuple, int] = {}
    parent, depth, convs, low, length, ends, children, above, conv_above = [], [], [], [], [], [], [], [], []

    def new(up, d, code_points, key, conv):
        parent.append(up)
        depth.append(d)
        length.append(code_points)
        above.append(key)
        conv_above.append(conv)
        convs.append(0)
        low.append(None)
        ends.append(NOBODY)
        children.append(0)
        return len(parent) - 1

    for key, base, over, conv, seq, lens, n, least, hashed in zip(*(rows[c] for c in ("key", "base", "above", "above_conv", "seq", "lens", "n", "low", "ends")), strict=True):
        node = at.get((-1, key))
        if node is None:
            node = at[-1, key] = new(-1, base, int(lens[base - 1]), over, conv)
        for d in range(base, len(seq) + 1):
            if d > base:
                down = at.get((node, seq[d - 1]))
                if down is None:
                    down = at[node, seq[d - 1]] = new(node, d, int(lens[d - 1]), None, None)
                    children[node] += 1
                node = down
            convs[node] += n
            low[node] = least if low[node] is None else min(low[node], least)
        ends[node] = hashed
    leaves, saved = [int(not c) for c in children], [(n - 1) * x for n, x in zip(convs, length, strict=True)]
    for node in reversed(range(len(parent))):  # children first
        if (up := parent[node]) >= 0:
            leaves[up] += leaves[node]
            saved[up] += saved[node]
            conv_above[node] = low[up]
    return pd.DataFrame({"conv_id": low, "depth": depth, "parent_conv_id": conv_above, "n_convs": convs, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "above": above})


def _common(a, b):
    """How many first elements two arrays share."""
    least = F.least(F.size(a), F.size(b))
    differ = F.array_position(F.zip_with(_cut(a, F.lit(1), least), _cut(b, F.lit(1), least), lambda x, y: x == y), F.lit(False))
    return F.when(differ > 0, differ - 1).otherwise(least).cast("int")


def _rounds(seqs: DataFrame) -> tuple[DataFrame | None, list[DataFrame]]:
    """Rows of subtries that fit a task, and for each round the beginnings (key, above, above_conv, base, upto, n, low, lens, ends) of those that didn't."""
    spark = seqs.sparkSession
    units = F.size("seq") - F.col("base") + 1
    key = lambda before, upto: _digest(F.concat(before, upto.cast("string").cast("binary"), F.element_at("seq", upto + 1)))
    n, low, ends = seqs.agg(F.sum("n"), F.min("low"), F.max(F.when(F.size("seq") == 0, F.col("ends")))).first()
    if n is None:
        return seqs.select(F.lit(b"").alias("key"), F.lit(0).alias("base"), F.lit(b"").alias("above"), F.lit(0).cast("long").alias("above_conv"), *seqs.columns), []
    top = b"\x00" * 16  # the root, which isn't dealt: every sequence goes on by its first turn
    large = [spark.createDataFrame([(top, None, None, 0, 0, n, low, [0], ends or NOBODY)], "key binary, above binary, above_conv long, base int, upto int, n long, low long, lens array<long>, ends string")]
    now = seqs.where(F.size("seq") > 0).select(key(F.lit(top), F.lit(0)).alias("key"), F.lit(1).alias("base"), F.lit(top).alias("above"), F.lit(low).cast("long").alias("above_conv"), "seq", "lens", "n", "low", "ends")
    now, _ = written(now, "subtries")
    small = None
    names = ["key", "base", "above", "above_conv"]
    while True:
        facts = now.groupBy("key").agg(F.sum(units).alias("units"))
        big, _ = written(facts.where(F.col("units") > LIMIT).select("key", F.lit(True).alias("big")), "large-subtries")
        count = big.count()
        if not count:
            break
        marked = now.join(F.broadcast(big) if count <= MARKED else big, "key", "left")
        rest = marked.where(F.col("big").isNull()).drop("big")
        small = rest if small is None else small.unionByName(rest)
        rows = marked.where(F.col("big")).drop("big")
        found = rows.groupBy(*names).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.min(F.struct("seq", "lens")).alias("first"), F.max("seq").alias("last"))
        found = found.select(*names, "n", "low", _common(F.col("first.seq"), F.col("last")).alias("upto"), F.col("first.lens").alias("lens"))
        found, _ = written(found.withColumn("lens", _cut("lens", F.col("base"), F.col("upto") - F.col("base") + 1)), "beginnings")
        facts = found.select("key", "upto", F.col("low").alias("least"))
        dealt = rows.join(F.broadcast(facts) if count <= MARKED else facts, "key")
        ended = dealt.where(F.size("seq") == F.col("upto")).select("key", "ends")  # at most one sequence a beginning
        large.append(written(found.join(ended, "key", "left").withColumn("ends", F.coalesce("ends", F.lit(NOBODY))), "spines")[0])
        onward = dealt.where(F.size("seq") > F.col("upto")).select(key(F.col("key"), F.col("upto")).alias("key"), (F.col("upto") + 1).alias("base"), F.col("key").alias("above"), F.col("least").alias("above_conv"), "seq", "lens", "n", "low", "ends")
        now, _ = written(onward, "subtries")
    return (now if small is None else small.unionByName(now)), large


def prefix_trie(convs: DataFrame) -> DataFrame:
    """``convs``: conv_id (each once), seq, lens. A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ship(convs.sparkSession)
    small, large = _rounds(distinct_sequences(convs))
    small, _ = written(small.withColumn("units", F.size("seq") - F.col("base") + 1), "small-subtries")
    total = small.agg(F.sum("units")).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET))
    dealt = small.drop("units").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    built, _ = written(dealt.groupBy("bucket").applyInPandas(_built, _NODES), "trie-nodes")
    tops = built.where(F.col("above").isNotNull()).select("above", "n_leaves", "saved_tokens")
    nodes = built.drop("above")
    below = tops
    for spine in reversed(large):
        sums = below.groupBy("above").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"), F.count("*").alias("children")).withColumnRenamed("above", "key")
        full = spine.join(sums, "key", "left").withColumns({"n_leaves": F.coalesce("n_leaves", F.lit(1)), "saved": F.coalesce("saved", F.lit(0)), "children": F.coalesce("children", F.lit(0))})
        full, _ = written(full, "spines-summed")
        at = F.posexplode("lens").alias("i", "own")
        cost = (F.col("n") - 1) * F.aggregate(_cut("lens", F.col("i") + 1, F.size("lens")), F.lit(0).cast("long"), lambda a, b: a + b)
        last = F.col("i") == F.size("lens") - 1
        each = full.select("*", at).select(
            F.col("low").alias("conv_id"), (F.col("base") + F.col("i")).cast("long").alias("depth"), F.when(F.col("i") == 0, F.col("above_conv")).otherwise(F.col("low")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", (F.col("saved") + cost).cast("long").alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(NOBODY).alias("ends_sha256"))
        nodes = nodes.unionByName(each)
        whole = (F.col("n") - 1) * F.aggregate("lens", F.lit(0).cast("long"), lambda a, b: a + b)
        below = tops.unionByName(full.where(F.col("above").isNotNull()).select("above", "n_leaves", (F.col("saved") + whole).cast("long").alias("saved_tokens")))
    return nodes


def op12_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spliced(sequences(table(spark, sf_dir, "conversations"))))


OP12_SQL = """
WITH k AS (SELECT list(e ORDER BY i) AS crcs FROM (SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], LAMBDA c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS e FROM (SELECT unnest(range(256)) AS i))),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS d, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce([4294967295] || [ord(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')], LAMBDA a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), k),
r AS (SELECT c.conv_id, d, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND d <= h UNION ALL SELECT c.conv_id, d + 100, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND d > h),
p AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY d) AS path FROM r GROUP BY conv_id),
w AS (SELECT conv_id, coalesce(path, []) AS path FROM c LEFT JOIN p USING (conv_id)),
m AS (SELECT conv_id, len(path) AS whole, d, path[1:d] AS path FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM w)),
n AS (SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce((count(*) - 1) * length(path[-1].t), 0) AS own, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (whole = d), '')) AS ends_sha256 FROM m GROUP BY path),
e AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN e USING (path)),
s AS (SELECT path[1:u] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS u FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth, g.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM f JOIN s USING (path) LEFT JOIN f g ON f.depth > 0 AND g.path = f.path[1:f.depth - 1]
"""
