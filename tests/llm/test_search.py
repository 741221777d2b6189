"""Ranked search against a plain version, the shape of treaps, and odd tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fellside.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)) for w in TERM.findall(text or "")]


def plain_search(docs, items, k=20):
    parts = [(i, plain_terms(t)) for i, t in docs]
    parts = [(i, w, Counter(w)) for i, w in parts if w]
    n_docs, n_terms = len(parts), sum(len(w) for _, w, _ in parts)
    df = Counter(t for _, _, c in parts for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(plain_terms(text)), []
        for doc_id, words, c in parts:
            m = 100 - 25 + 25 * len(words) * n_docs // n_terms
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, n in asked.items() if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def random_docs(rng, n, words=60):
    names = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    docs = [(i, " ".join(rng.choices(names, weights, k=rng.randint(1, 40)))) for i in range(n)]
    return docs + [(n + i, docs[5][1]) for i in range(30)]  # thirty copies: ties by identifier


@pytest.mark.parametrize("size", [1, 7, 50, 8192])
def test_search_equals_a_plain_version(spark, monkeypatch, size):
    rng = random.Random(size)
    docs, items = random_docs(rng, 200), [(i, " ".join(rng.choices([f"w{i}" for i in range(70)], k=rng.randint(1, 12)))) for i in range(12)]
    items.append((99, docs[5][1]))
    monkeypatch.setattr(search, "BLOCK_DOCS", size)
    monkeypatch.setattr(search, "WALKED", 64)
    want = plain_search(docs, items)
    a, b = frames(spark, docs, items)
    assert rows_of(search.search_documents(a.repartition(3), b)) == want
    # an index of all terms, and queries in several rounds
    monkeypatch.setattr(search, "VOCABULARY", 3)
    monkeypatch.setattr(search, "SLICE", 20)
    assert rows_of(search.search_documents(a.repartition(2), b)) == want


def test_odd_tables(spark):
    docs = [(1, None), (2, ""), (3, " ,;\n"), (4, "One two, TWO"), (4, "One two, TWO"), (None, "two Three"), (None, "two Three"), (-7, "Zwei Ähre Éa ÉA"), (8, "two " * 50_000), (9, "x" * 100_000), (10, "a_b\x00c")]
    items = [(0, None), (1, ""), (2, "two"), (2, "TWO one"), (None, "three é ähre Éa"), (4, "absent"), (5, "a b c"), (6, "x" * 100_000)]
    a, b = frames(spark, docs, items)
    for name in ("term", "id", "q", "part", "df", "ids", "text_"):
        a, b = a.selectExpr("*", f"'x' AS {name}"), b.selectExpr("*", f"1 AS {name}")
    want = plain_search(docs, items)
    assert rows_of(search.search_documents(a, b)) == want
    assert rows_of(search.search_documents(a, b.limit(0))) == []
    assert rows_of(search.search_documents(a.limit(0), b)) == []


def test_texts_are_read_whole(monkeypatch):
    monkeypatch.setattr(search, "PIECE", 5)
    assert [w for ws in search.terms_of("One-two  three444 É".encode()) for w in ws] == [b"one", b"two", b"three444", "É".encode()]


def test_treaps_have_both_orders():
    rng = np.random.default_rng(1)
    for impacts in (rng.integers(0, 9, 500), np.arange(500), np.arange(500)[::-1], np.zeros(500, np.int64)):
        starts = np.array([0, 1, 40, 41, 300, 500])
        left, right, roots = search.treaps(starts, np.asarray(impacts, np.int64))
        assert len(roots) == len(starts) - 1
        for root, lo, hi in zip(roots, starts[:-1], starts[1:], strict=True):
            order, stack, node, depth = [], [], root, 0
            while stack or node >= 0:
                while node >= 0:
                    stack.append(node)
                    node = left[node]
                depth = max(depth, len(stack))
                node = stack.pop()
                order.append(node)
                node = right[node]
            assert order == list(range(lo, hi))
        for child in (left, right):
            has = np.flatnonzero(child >= 0)
            assert (np.asarray(impacts)[child[has]] <= np.asarray(impacts)[has]).all()


def test_most_documents_are_left_out():
    """The bound prunes: one rare term decides, so few of 4,000 documents are scored."""
    rng, block = random.Random(3), search._Block(None)
    for i in range(4000):
        block.add(i, ("common " * rng.randint(1, 3) + ("rare " if i % 100 == 7 else "") + "filler " * rng.randint(0, 9)).encode())
    x = search._arrays(next(search._planted(4000, 40_000)(iter([block.record(None)]))), 0)
    x["doc"], x["null"], x["impacts"] = x["ids"].to_numpy(), np.zeros(4000, bool), x["impacts"].astype(np.int64)
    scored = []
    best = search.Best(1, 20)
    add = best.add
    best.add = lambda q, *more: (scored.append(len(q)), add(q, *more))
    place = {t: i for i, t in enumerate(x["terms"].to_pylist())}
    nodes = np.array([x["roots"][place[t]] for t in (b"common", b"rare")], np.int64)
    search.walk(x, np.zeros(2, np.int64), nodes, np.array([1, 4000]), best)
    assert len(best.q) == 20 and all(d % 100 == 7 for d in best.doc) and sum(scored) < 400
