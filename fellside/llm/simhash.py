"""Operator 1, near-duplicates by SimHash with deletion-variant signatures.

*Fingerprint.* A-Z are lower-cased, words are runs of non-space characters, and each of a document's
three-word shingles (repeats included; all words if there are fewer) has the XXH64 of its UTF-8 with seed 42.
A bit of the fingerprint is set if it is set in over half of these.

*Links.* Fingerprints that differ in at most ``distance`` bits (two; up to three) are linked. They are cut into two halves: one half differs
by at most one bit. Each half is indexed by its one-wildcard variants, the half with one bit deleted and the
place of that bit, so that linked fingerprints meet under an equal key; whoever meets is verified.
Documents with equal fingerprints are one entry of the index.

*Hot keys.* The index is range-free: rows are dealt out and sorted by key and streamed past a window of
``RUN`` rows, so memory doesn't depend on how many share a key. A key with more than ``RUN`` fingerprints is not
compared; its fingerprints are marked and indexed again, by all 120 ways to leave out two of sixteen
four-bit pieces (or three, 560 ways, for a distance of three). Two linked fingerprints agree on the other pieces, and at most 256 (4,096) distinct fingerprints
can share such a key, so the second index needs no limit. Nothing is dropped.

*Components.* Tasks pass on the forest of the links they verified, and ``components`` unites these.

Defined results: null and empty texts have fingerprint zero, which is linked like any other; a null identifier is
never a component's name unless all of its identifiers are null (then it is null); repeated rows come back as
often; an empty table gives no rows; other columns aren't looked at by ``near_duplicates``. Of rows alike in identifier and
text, ``representatives`` keeps the one with the least hash of all its columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, table, with_facts, written
from .components import Forest, components

SHINGLE = 3
SEED = 42
DISTANCE = 2
RUN = 512
_HASHES = 1 << 14


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Of one text. Hashes are counted in pieces, so memory is the text's own."""
    words = (text or "").encode().lower().split()  # of bytes: only A-Z, and only at ASCII white space
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    total = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, total, _HASHES):
        part = words[lo : lo + _HASHES + shingle - 1]
        h = np.array([digest(b" ".join(x), SEED) for x in zip(*(part[j:] for j in range(shingle)), strict=False)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(0)), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(prints.view(np.int64), pa.int64())], names=[*b.schema.names[1:], "print"])

    return run


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``keep`` and print, the fingerprint as a signed long."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text"), *[F.col(f"`{k}`").alias(k) for k in keep])
    return rows.mapInArrow(_fingerprints(shingle), ", ".join([*(f"`{n}` {k}" for n, k in rows.dtypes[1:]), "print long"]))


def _deletion_variants() -> list[tuple[int, int, int]]:
    """(shift, mask over the 32-bit half, number) for each half and each deleted bit."""
    return [(half * 32, 0xFFFFFFFF ^ (1 << bit), half * 32 + bit) for half in (0, 1) for bit in range(32)]


def _piece_variants(distance: int) -> list[tuple[int, int, int]]:
    return [(0, 0xFFFFFFFFFFFFFFFF ^ sum(0xF << 4 * i for i in out), n) for n, out in enumerate(combinations(range(16), distance))]


def _indexed(variants: list[tuple[int, int, int]]):
    """Emits (key, part, print): ``part`` is the number of the variant, ``key`` what it leaves of the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            step = max(1, (1 << 19) // len(variants))
            for lo in range(0, len(prints), step):
                p = prints[lo : lo + step]
                key = np.concatenate([(p >> np.uint64(s)) & np.uint64(m) for s, m, _ in variants])
                part = np.repeat(np.array([n for *_, n in variants], np.int16), len(p))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part), pa.array(np.tile(p, len(variants)).view(np.int64))], ["key", "part", "print"])

    return run


def _met(run: int, distance: int):
    """Over rows sorted by (key, part, print): the forest of the links among rows of a key with at most ``run`` rows,
    and for larger keys rows (print, null)."""

    def links(key, part, prints):
        same = (key[1:] == key[:-1]) & (part[1:] == part[:-1])
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        nth = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
        at = np.flatnonzero(nth >= 1)
        lag = 1
        while len(at):
            near = np.bitwise_count(prints[at] ^ prints[at - lag]) <= distance
            yield prints[at[near]].view(np.int64), prints[at[near] - lag].view(np.int64)
            lag += 1
            at = at[nth[at] >= lag]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held = (np.empty(0, np.int64), np.empty(0, np.int16), np.empty(0, np.uint64))
        hot = None  # the large key that is going on

        def mark(p):
            return pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.nulls(len(p), pa.int64())], ["node", "root"])

        def chunk(key, part, prints, last: bool):
            nonlocal held, hot
            if hot is not None:
                n = int(np.argmin(np.append((key == hot[0]) & (part == hot[1]), False)))
                if n:
                    yield mark(prints[:n])
                    key, part, prints = key[n:], part[n:], prints[n:]
                if len(key):
                    hot = None
            if not len(key):
                held = (key, part, prints)
                return
            same = (key[1:] == key[:-1]) & (part[1:] == part[:-1])
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            sizes = np.diff(np.append(starts, len(key)))
            big = np.repeat(sizes > run, sizes)
            end = len(key)
            if not last and sizes[-1] <= run:
                end = int(starts[-1])  # it may go on: kept for the next piece
            elif not last:
                hot = (key[-1], part[-1])
            held = (key[end:], part[end:], prints[end:])
            if big[:end].any():
                yield mark(prints[:end][big[:end]])
            keep = ~big[:end]
            for a, b in links(key[:end][keep], part[:end][keep], prints[:end][keep]):
                yield from forest.add(a, b)

        for b in batches:
            new = (b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False).view(np.uint64))
            yield from chunk(*(np.concatenate([x, y]) for x, y in zip(held, new, strict=True)), False)
        yield from chunk(*held, True)
        yield from forest.rest()

    return go


def _through(prints: DataFrame, variants, run: int, distance: int) -> DataFrame:
    index = prints.mapInArrow(_indexed(variants), "key long, part short, print long")
    dealt = index.repartition(F.col("key"), F.col("part")).sortWithinPartitions("key", "part", "print")
    return written(dealt.mapInArrow(_met(run, distance), "node long, root long"), "links")[0]


def linked(prints: DataFrame, run: int = RUN, distance: int = DISTANCE) -> DataFrame:
    """``prints``: one column of distinct fingerprints. Rows (node, root) of every fingerprint linked to another."""
    if not 1 <= distance <= 3:
        raise ValueError("of two halves, one differs by at most one bit only up to a distance of three")
    ship(prints.sparkSession)
    first = _through(prints, _deletion_variants(), run, distance)
    edges = first.where(F.col("root").isNotNull())
    hot = first.where(F.col("root").isNull()).select(F.col("node").alias("print")).distinct()
    if not hot.isEmpty():
        edges = edges.union(_through(hot, _piece_variants(distance), 16**distance, distance))
    return components(edges)


def classes(rows: DataFrame, run: int = RUN, distance: int = DISTANCE) -> DataFrame:
    """``rows``: what :func:`fingerprints` returns, written. Distinct print, with root: the least print of its component."""
    prints = rows.select("print").distinct()
    roots = linked(prints, run, distance)
    known = prints.join(roots.withColumnRenamed("node", "print"), "print", "left").select("print", F.coalesce("root", "print").alias("root"))
    return written(known, "roots")[0]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``id_col``, fingerprint (16 hexadecimal digits), component_id (the least identifier of the component)."""
    rows, _ = written(fingerprints(docs, (id_col,), text_col, shingle), "prints")
    known = classes(rows, run, distance)
    lows = rows.groupBy("print").agg(F.min(id_col).alias("low"), F.count("*").alias("n"))
    known, _ = written(known.join(lows, "print"), "lows")
    names, _ = written(known.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("k")), "names")
    named, _ = written(with_facts(known.select("print", "root", "n"), names, "root", "k", known.count()).select("print", "n", "component_id"), "named")
    return with_facts(rows, named, "print", "n", rows.count()).select(id_col, F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs``, all columns, with one row of each component: that with the least identifier (null last), then the
    least MD5 of its text."""
    text = F.col(f"`{text_col}`").cast("string")
    keyed = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("key"), text.alias("text"))
    rows, _ = written(fingerprints(keyed, ("id", "key"), "text", shingle), "prints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    stays = rows.join(classes(rows, run, distance), "print").groupBy("root").agg(first.alias("s")).select(F.col("s.id").alias("stay_id"), F.col("s.key").alias("stay_key"))
    left = keyed.join(stays, keyed["id"].eqNullSafe(stays["stay_id"]) & (keyed["key"] == stays["stay_key"]), "left_semi")
    # rows alike in identifier and text may differ in other columns: that with the least hash of all of them stays
    return left.groupBy("id", "key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
