"""Operator 11, ranked lexical search with inverted treaps.

*Index.* Documents are cut into blocks of at most ``BLOCK_DOCS`` documents and about ``BLOCK_POSTINGS`` postings, in the tasks that read
them; no posting is shuffled. In a block every term has a treap of its documents: search order by document, heap order by
impact (what one occurrence of the term in a query of weight one adds to the document's score), equal impacts by a mixed place, so that
documents alike don't make a chain. The impact needs counts over all documents, so blocks are written with frequencies
first, the counts are summed over these, and the treaps are made from them. A task finds the children of all of a block's
nodes at once: a node's parent is the lesser of the nearest greater impacts on both sides.

*Search.* Each task takes a set of queries (``SLICE`` terms at most, further sets in further rounds) against its blocks. For a query
the treaps of its terms are walked together from the whole block down: the sum of the current nodes' weighted impacts bounds
every score in the current range of documents; a range whose bound can't enter the best k so far is left out, and otherwise the document of
the greatest summand is scored and parts the range in two. All ranges of a level, of all queries, are walked by array operations. The best k
of a task bound what its next blocks must look at; the best of all tasks meet in a window that keeps k a query in each task before the exchange.

Given a vocabulary, the index holds these terms' postings only, which changes no result for queries of such terms.

Defined results: a null or empty text, or one without terms, is no document to the counts and is never found; a null
identifier is found like any other and comes last among equal scores; rows with one identifier are documents each (queries: queries each); a query
without terms, or whose terms no document holds, has no rows; an empty table gives no rows; other columns aren't looked at. Texts of any length are read whole."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_path, picked, ship, table, written

BLOCK_DOCS = 8192
BLOCK_POSTINGS = 1 << 20
#: Terms of queries that go to every task at once.
SLICE = 1 << 20
#: Distinct terms up to which a vocabulary goes to every task.
VOCABULARY = 1 << 20
#: Nodes that the queries walked together may have in a block.
WALKED = 1 << 21
#: Bytes of a text that are split into terms at a time.
PIECE = 1 << 22

_APART = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TABLE = bytes(32 if c in _APART else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))

_BLOCK = "ids array<long>, sizes array<long>, terms array<binary>, starts array<int>, docs array<int>"
POSTINGS = f"{_BLOCK}, tfs array<int>"
TREAPS = f"{_BLOCK}, impacts array<int>, left array<int>, right array<int>, roots array<int>"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in order, in lists for pieces of it."""
    text, lo = text.translate(_TABLE), 0
    while lo < len(text):
        hi = text.find(b" ", lo + PIECE)
        hi = len(text) if hi < 0 else hi
        yield text[lo:hi].split()
        lo = hi


def _lists(values, lengths=None, kind=None) -> pa.ListArray:
    """One list for a record."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))


def _record(schema: str, **columns) -> pa.RecordBatch:
    kinds = {"array<long>": pa.int64(), "array<int>": pa.int32(), "array<binary>": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([_lists(columns[n], kind=kinds[k]) for n, k in fields], [n for n, _ in fields])


class _Block:
    """Documents that a task has read, until they make a block."""

    def __init__(self, vocabulary: dict[bytes, int] | None):
        self.only = vocabulary
        self.clear()

    def clear(self) -> None:
        self.ids, self.sizes, self.known = [], [], {}
        self.terms, self.tfs, self.lengths, self.size = [], [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        n, found = 0, []
        for words in terms_of(text):
            n += len(words)
            if self.only is None:
                known = self.known
                places = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
            else:
                places = np.fromiter(map(self.only.get, words, _NONE), np.int64, len(words))
                places = places[places >= 0]
            found.append(np.unique(places, return_counts=True))
        if not n:
            return
        if len(found) > 1:
            terms, at = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
            tfs = np.bincount(at, np.concatenate([c for _, c in found]), len(terms)).astype(np.int64)
        else:
            terms, tfs = found[0]
        self.ids.append(doc_id)
        self.sizes.append(n)
        self.terms.append(terms)
        self.tfs.append(tfs)
        self.lengths.append(len(terms))
        self.size += len(terms)

    def record(self, words: list[bytes] | None) -> pa.RecordBatch:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        docs = np.repeat(rank, self.lengths)
        terms, tfs = np.concatenate(self.terms), np.concatenate(self.tfs)
        by = np.lexsort((docs, terms))
        own, counts = np.unique(terms, return_counts=True)
        names = list(self.known) if words is None else words
        out = _record(
            POSTINGS, ids=[self.ids[i] for i in order], sizes=[self.sizes[i] for i in order], terms=[names[t] for t in own.tolist()],
            starts=np.append(0, np.cumsum(counts)), docs=docs[by], tfs=tfs[by],
        )
        self.clear()
        return out


class _Nones:
    """Endless -1."""

    def __iter__(self):
        while True:
            yield -1


_NONE = _Nones()


def _postings(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None if vocabulary is None else vocabulary.value
        block = _Block(None if words is None else {w: i for i, w in enumerate(words)})
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                block.add(doc_id, text.as_py())
                if len(block.ids) >= BLOCK_DOCS or block.size >= BLOCK_POSTINGS:
                    yield block.record(words)
        if block.ids:
            yield block.record(words)

    return run


def _nearest_higher(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``at``: each node's neighbour on one side, -1 at the end. The nearest on that side whose rank is higher, or -1."""
    active = np.flatnonzero(at >= 0)
    while len(active):
        lower = rank[at[active]] < rank[active]
        active = active[lower]
        at[active] = at[at[active]]
        active = active[at[active] >= 0]
    return at


def treaps(starts: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right child of each node (-1: none) and the root of each term's treap."""
    n = len(impacts)
    place = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((place * 2654435761 & 0xFFFFFFFF, impacts))] = place
    before, after = place - 1, place + 1
    before[starts[:-1]] = -1
    after[starts[1:] - 1] = -1
    before, after = _nearest_higher(rank, before), _nearest_higher(rank, after)
    below = (before >= 0) & ((after < 0) | (rank[before] < rank[after]))  # hangs on the right of what stands before it
    left, right = np.full(n, -1), np.full(n, -1)
    right[before[below]] = place[below]
    above = ~below & (after >= 0)
    left[after[above]] = place[above]
    return left, right, place[(before < 0) & (after < 0)]


def _arrays(batch: pa.RecordBatch, i: int) -> dict[str, np.ndarray]:
    out = {}
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        values = column[i].values
        out[name] = values if name in ("terms", "ids") else values.to_numpy(zero_copy_only=False)
    return out


def _planted(n_docs: int, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                x = _arrays(b, i)
                m = 75 + np.array([25 * n * n_docs // n_terms for n in x["sizes"].tolist()], np.int64)
                tfs = x["tfs"].astype(np.int64)
                impacts = 1_000_000_000 * tfs // (1000 * tfs + 12 * m[x["docs"]])
                left, right, roots = treaps(x["starts"], impacts)
                yield _record(TREAPS, ids=x["ids"], sizes=x["sizes"], terms=x["terms"], starts=x["starts"], docs=x["docs"], impacts=impacts, left=left, right=right, roots=roots)

    return run


@dataclass
class Index:
    """Blocks of treaps, how many documents hold each term, and the path of either."""

    blocks: DataFrame
    frequencies: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, vocabulary: list[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """``docs``: a whole-number ``id_col`` and ``text_col``. ``vocabulary``: terms to which postings may be confined (a bounded list)."""
    spark = docs.sparkSession
    ship(spark)
    rows = picked(docs, id_col, text_col).where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    only = None if vocabulary is None else spark.sparkContext.broadcast(vocabulary)
    postings, path = written(rows.mapInArrow(_postings(only), POSTINGS), "postings")
    n_docs, n_terms = postings.select(F.sum(F.size("ids")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()
    n_docs, n_terms = n_docs or 0, n_terms or 0
    counts = F.transform("terms", lambda t, i: F.struct(t.alias("term"), (F.col("starts")[i + 1] - F.col("starts")[i]).alias("n")))
    frequencies, _ = written(postings.select(F.inline(counts)).groupBy("term").agg(F.sum("n").cast("long").alias("df")), "term-frequencies")
    blocks, _ = written(postings.mapInArrow(_planted(n_docs, max(1, n_terms)), TREAPS), "treaps")
    drop_path(spark, path)
    return Index(blocks, frequencies, n_docs, n_terms)


class Best:
    """The best k of each query, of all that was added."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.q = self.score = self.doc = np.empty(0, np.int64)
        self.null = np.empty(0, bool)
        self.least = np.ones(queries, np.int64)  # what a score must reach
        self.last = np.full(queries, np.iinfo(np.int64).max)  # beyond this identifier it must exceed it

    def add(self, q, score, doc, null) -> None:
        good = score >= self.least[q]
        if not good.any():
            return
        q, score, doc, null = (np.concatenate([a, b[good]]) for a, b in ((self.q, q), (self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score, q))
        q, score, doc, null = q[order], score[order], doc[order], null[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        nth = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = nth < self.k
        self.q, self.score, self.doc, self.null = q[keep], score[keep], doc[keep], null[keep]
        full = nth == self.k - 1
        self.least[q[full]] = score[full]
        self.last[q[full]] = np.where(null[full], np.iinfo(np.int64).max, doc[full])


def _within(x: dict[str, np.ndarray], nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The node of greatest impact below each of ``nodes`` whose document is from ``low`` to ``high``, or -1."""
    nodes, active = nodes.copy(), np.arange(len(nodes))
    while len(active):
        at = nodes[active]
        doc = x["docs"][at]
        to = np.where(doc > high[active], x["left"][at], np.where(doc < low[active], x["right"][at], at))
        nodes[active] = to
        active = active[(to != at) & (to >= 0)]
    return nodes


def walk(x: dict[str, np.ndarray], q: np.ndarray, node: np.ndarray, weight: np.ndarray, best: Best) -> None:
    """``x``: a block. ``q`` (ascending), ``node`` and ``weight``: for each query and each of its terms in the block, the treap's root and the term's weight."""
    query, item = np.unique(q, return_inverse=True)
    low, high = np.zeros(len(query), np.int64), np.full(len(query), len(x["doc"]) - 1)
    while len(node):
        first = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        some = item[first]
        query, low, high = query[some], low[some], high[some]
        item = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(item))))
        parts = weight * x["impacts"][node]
        bound = np.add.reduceat(parts, first)
        # of equal scores the lower identifiers count; a null one is the last
        open_ = (bound > best.least[query]) | ((bound == best.least[query]) & ((x["doc"][low] <= best.last[query]) & ~x["null"][low]))
        open_ |= (bound == best.least[query]) & (best.last[query] == np.iinfo(np.int64).max)
        kept = open_[item]
        if not kept.any():
            return
        node, weight, parts = node[kept], weight[kept], parts[kept]
        query, low, high = query[open_], low[open_], high[open_]
        item = (np.cumsum(open_) - 1)[item[kept]]
        first = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        top = np.maximum.reduceat(parts, first)
        pivot = np.minimum.reduceat(np.where(parts == top[item], np.arange(len(parts)), len(parts)), first)
        doc = x["docs"][node[pivot]].astype(np.int64)
        there = _within(x, node, doc[item], doc[item])
        score = np.add.reduceat(np.where(there >= 0, weight * x["impacts"][there], 0), first)
        best.add(query, score, x["doc"][doc], x["null"][doc])
        before, after = _within(x, node, low[item], doc[item] - 1), _within(x, node, doc[item] + 1, high[item])
        a, b = before >= 0, after >= 0
        node, weight, item = np.concatenate([before[a], after[b]]), np.concatenate([weight[a], weight[b]]), np.concatenate([item[a], item[b] + len(query)])
        query, low, high = np.concatenate([query, query]), np.concatenate([low, doc + 1]), np.concatenate([doc - 1, high])


def _found(asked, k: int):
    """``asked``: broadcast (numbers of the queries, ascending, in a row for each term; terms; weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, terms, weights = asked.value
        named, q = np.unique(numbers, return_inverse=True)
        best = Best(len(named), k)
        for b in batches:
            for i in range(len(b)):
                x = _arrays(b, i)
                x["null"] = x["ids"].is_null().to_numpy(zero_copy_only=False)
                x["doc"] = x["ids"].fill_null(0).to_numpy(zero_copy_only=False)
                x["impacts"] = x["impacts"].astype(np.int64)
                place = dict(zip(x["terms"].to_pylist(), range(len(x["roots"])), strict=True))
                at = np.fromiter(map(place.get, terms, _NONE), np.int64, len(terms))
                there = np.flatnonzero(at >= 0)
                if not len(there):
                    continue
                lengths = np.diff(x["starts"])[at[there]]
                # as many queries together as have WALKED nodes; a query isn't parted
                ends = np.flatnonzero(np.append(q[there][1:] != q[there][:-1], True)) + 1
                sums, lo = np.cumsum(lengths), 0
                while lo < len(there):
                    done = sums[lo - 1] if lo else 0
                    j = np.searchsorted(sums[ends - 1], done + WALKED, "right")
                    hi = max(ends[j - 1] if j else 0, ends[np.searchsorted(ends, lo, "right")])
                    mine = there[lo:hi]
                    walk(x, q[mine], x["roots"][at[mine]].astype(np.int64), weights[mine], best)
                    lo = hi
        if len(best.q):
            yield pa.RecordBatch.from_arrays([pa.array(named[best.q]), pa.array(best.doc, mask=best.null), pa.array(best.score)], ["q", "doc_id", "score"])

    return run


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """A row (q, id, term, n) for each query and distinct term; q numbers the queries. Written, as the numbers must stay."""
    ship(queries.sparkSession)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, term, n = [], [], []
            for i, text in enumerate(b.column(2)):
                counts: dict[bytes, int] = {}
                for words in terms_of(text.as_py() or b""):
                    for w in words:
                        counts[w] = counts.get(w, 0) + 1
                q += [i] * len(counts)
                term += counts
                n += counts.values()
            at = pa.array(q, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(term, pa.binary()), pa.array(n, pa.int64())], ["q", "id", "term", "n"])

    kind = queries.schema[id_col].dataType.simpleString()
    rows = picked(queries, id_col, text_col).select(F.monotonically_increasing_id().alias("q"), F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return written(rows.mapInArrow(split, f"q long, id {kind}, term binary, n long"), "query-terms")[0]


def search(index: Index, asked: DataFrame, k: int = 20) -> DataFrame:
    """``asked``: from :func:`query_terms`. Rows (id, rank, doc_id, score)."""
    spark: SparkSession = asked.sparkSession
    ship(spark)
    slices = max(1, math.ceil(asked.count() / SLICE))
    dealt, _ = written(asked.join(index.frequencies, "term").select("q", "term", "n", "df", F.pmod(F.xxhash64("q"), F.lit(slices)).alias("part")), "query-weights")
    found = None
    for i in range(slices):
        rows = sorted(tuple(r) for r in dealt.where(F.col("part") == i).select("q", "term", "n", "df").collect())  # about SLICE rows
        if rows:
            weights = np.array([n * math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * df + 1))) for _, _, n, df in rows], np.int64)
            sent = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), [bytes(r[1]) for r in rows], weights))
            some = index.blocks.mapInArrow(_found(sent, k), "q long, doc_id long, score long")
            found = some if found is None else found.union(some)
    if found is None:
        found = spark.createDataFrame([], "q long, doc_id long, score long")
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked.select("q", "id").distinct(), "q").select("id", "rank", "doc_id", "score")


def search_documents(docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Index and search in one; the index holds the queries' terms only, if these are at most ``VOCABULARY``."""
    asked = query_terms(queries, id_col, text_col)
    terms = asked.select("term").distinct()
    some = [bytes(r[0]) for r in terms.limit(VOCABULARY + 1).collect()]
    index = build_index(docs, sorted(some) if len(some) <= VOCABULARY else None)
    return search(index, asked, k).withColumnRenamed("id", id_col)


def op11_search(spark, sf_dir: str) -> DataFrame:
    return search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ws) AS t FROM d) GROUP BY r, t),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
q AS (SELECT q, item_id, t, count(*) AS n FROM (SELECT q, item_id, unnest(ws) AS t FROM (SELECT row_number() OVER () AS q, item_id, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL)) GROUP BY q, item_id, t),
w AS (SELECT q, item_id, t, n * floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM q JOIN f USING (t), s),
m AS (SELECT r, doc_id, 75 + (25 * len(ws) * n_docs) // n_terms AS m FROM d, s),
x AS (SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM w JOIN p USING (t) JOIN m USING (r) GROUP BY q, item_id, r, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS nth FROM x WHERE score > 0)
SELECT item_id, nth::INTEGER AS rank, doc_id, score FROM o WHERE nth <= 20
"""
