"""The trie of conversation prefixes against a plain version, large subtries, and odd tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fellside.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_splice(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = tuple(own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + ts[h:])
    return out


def plain_trie(convs):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[: d - 1]].add(path[:d])
        ends[path].append(c)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[p] for p in children[path]) or 1
        saved[path] = (len(members[path]) - 1) * (len(path[-1][1]) if path else 0) + sum(saved[p] for p in children[path])
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()),
        key=repr,
    )


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=repr)


def random_rows(seed, n):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-150, 4 * n), n):
        rows += [(c, t if t else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "é😀", "", None]) if t % 3 else "same") for t in range(rng.randint(1, 9))]
    return rows


@pytest.mark.parametrize("limit", [1, 10, 100, 1 << 16])
def test_trie_equals_a_plain_version(spark, monkeypatch, limit):
    monkeypatch.setattr(trie, "LIMIT", limit)
    monkeypatch.setattr(trie, "BUCKET", max(20, limit // 2))
    monkeypatch.setattr(trie, "MARKED", 3 if limit == 10 else 1 << 16)  # beyond it, keys are joined by a shuffle
    monkeypatch.setattr(trie, "RUN", 3)
    rows = random_rows(limit, 150)
    got = trie.prefix_trie(trie.spliced(trie.sequences(spark.createDataFrame(rows, SCHEMA).repartition(5))))
    assert rows_of(got) == plain_trie(plain_splice(rows))


def test_long_common_beginnings_cost_one_round(spark, monkeypatch):
    """300 turns that all share, then a branching: the rounds don't go turn by turn."""
    monkeypatch.setattr(trie, "LIMIT", 50)
    convs = {c: tuple(("u", f"t{d}") for d in range(300)) + (("u", f"x{c % 3}"),) for c in range(6)} | {9: tuple(("u", f"t{d}") for d in range(250))}
    rows = [(c, d, *turn) for c, path in convs.items() for d, turn in enumerate(path)]
    seqs = trie.sequences(spark.createDataFrame(rows, SCHEMA))
    assert len(trie._rounds(trie.distinct_sequences(seqs))[1]) <= 3
    assert rows_of(trie.prefix_trie(seqs)) == plain_trie(convs)


def test_many_copies_are_one_sequence(spark, monkeypatch):
    monkeypatch.setattr(trie, "RUN", 7)
    rows = [(c, d, "user", f"turn {d}") for c in range(500) for d in range(3)] + [(1000, 0, "user", "turn 0")]
    seqs = trie.sequences(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert trie.distinct_sequences(seqs).count() == 2
    want = plain_trie({c: tuple(("user", f"turn {d}") for d in range(3)) for c in range(500)} | {1000: (("user", "turn 0"),)})
    assert rows_of(trie.prefix_trie(seqs)) == want


def test_odd_tables(spark):
    rows = [(None, 0, "user", "nobody"), (7, None, None, None), (7, 1, "user", "x" * 200_000), (7, 1, "a", "tie"), (7, 1, "a", "tie"), (107, 0, "user", None), (-5, 3, "", ""), (200, 0, "user", "hot")]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("seq", "lens", "base", "key", "t", "n", "h", "low"):
        df = df.withColumn(name, F.lit("x"))
    make = lambda d: trie.prefix_trie(trie.spliced(trie.sequences(d)))
    assert rows_of(make(df)) == plain_trie(plain_splice(rows))
    assert rows_of(make(df.limit(0))) == []
    assert rows_of(make(df.where("conv_id is null"))) == []
    assert rows_of(make(df.where("conv_id = 107 and turn = 0"))) == plain_trie(plain_splice([rows[5]]))
