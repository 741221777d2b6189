"""Operator 3, fuzzy line dedup by MinHash.

Lines that hold anything but white space are compared in lower case with runs of white space made one space. Lines are
linked if the Jaccard similarity of their sets of ``SHINGLE``-character shingles is ``SIMILARITY`` or more (a shorter line is one
shingle). Of each connected component one occurrence stays, the first by identifier and line
number; every other occurrence is removed, exact repeats within a document included.

1. *Signatures.* A line's shingle hashes are dealt to ``BANDS * ROWS`` bins, each bin keeps its least (one-permutation MinHash), empty
   bins borrow from bins that a fixed order names. At similarity 0.8 a pair shares one of nine bands of three with
   probability 0.998. A task gives the keys of a line when it first comes, not with every copy.
2. *Candidates.* Band keys are dealt out and sorted, and a line is paired with the first and with the ``LAGS`` lines before it under
   its key: all pairs of a key with few lines. Keys of more lines are handed on, line by line, to step 5, which finds the pairs that are
   left out here. A slot of keys with more than one in ``HOT`` of all rows (there are at most ``HOT`` such slots, so their list is broadcast) is
   dealt out over several tasks by the lines' hashes, and all of its lines are handed on.
3. *Verification.* Only texts of lines in pairs are fetched: a bitmap of bounded size, built from their hashes, filters the
   documents' lines in the task that reads them (once it's full every line's text is dealt by hash). The similarity of every pair is computed exactly.
4. *Components* come from the distributed union-find of ``components``.
5. *Keys that were handed on* are looked at again unless all their lines are in one component by now. The lines of a key of at most ``BLOCK``
   lines meet in one task, and every pair of different components is compared: first by bounds on the common shingles that refuse no pair at the
   similarity, then exactly. Lines of larger keys go to an exact second index. Shingles are ordered from rare to common among them (by counts in
   ``2**SKETCH_BITS`` slots; any order is right). Two lines at the similarity share one of the first ``n - ceil(SIMILARITY * n) + 1``
   of their n shingles, so lines are joined on these; a shingle of many lines is dealt out as blocks against blocks of about
   ``BLOCK`` lines. Nothing is capped: work grows with the square of a group whose lines share a rare-most shingle and
   aren't linked already.

Lines are named by 64 bits of XXH3; a billion distinct lines make 0.03 coincidences expected.

Defined results: a null text stays null and has no lines; an empty text stays empty; lines of white space only are kept where
they are; rows alike in identifier and text are one document and are treated alike, and rows alike in identifier
only keep lines that they have at the same number; identifiers are whole numbers, null comes first; an empty table gives no rows; other columns are carried by ``without_repeats`` and not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, picked, ship, table, with_facts, written
from .components import components

SHINGLE = 8
SIMILARITY = 0.8
BANDS, ROWS = 9, 3
LAGS = 4
BITMAP_BITS = 27  # at most
PIECE_CHARS = 1 << 14
FETCH_CHARS = 1 << 20
SLOTS = 1 << 16
SKETCH_BITS = 18
BLOCK = 4096
SEEN = 1 << 18
MAP_BITS = 12
NO_ID = -9223372036854775809
_BINS = BANDS * ROWS
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def normal(line: str) -> str:
    line = line.strip().lower()
    # white space other than single spaces isn't printable, or comes twice
    return " ".join(line.split()) if "  " in line or not line.isprintable() else line


def shingles(line: str, size: int = SHINGLE) -> set[str]:
    """Of a line in normal form."""
    return {line[i : i + size] for i in range(len(line) - size + 1)} or {line}


def line_hash(line: str) -> int:
    h = xxhash.xxh3_64_intdigest(line)
    return h - (1 << 64) if h >> 63 else h


@lru_cache(maxsize=2)
def _all_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:], down[1:] = np.uint64(_BASE), np.uint64(inverse)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse modulo 2**64."""
    up, down = _all_powers(max(2 * PIECE_CHARS, 1 << (n - 1).bit_length()))
    return up[:n], down[:n]


_ORDER = np.random.default_rng(7).integers(0, _BINS, (64, _BINS))


def _hashed(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle of each line (normal form, none empty), repeats included."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4").astype(np.uint64)
    up, down = _powers(len(codes) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((codes + np.uint64(1)) * down[:-1], dtype=np.uint64)])
    ends = np.cumsum(sizes)
    counts = np.maximum(sizes - SHINGLE + 1, 1)  # shingles of each line
    row = np.repeat(np.arange(len(lines)), counts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(ends - sizes, counts)
    to = np.minimum(at + SHINGLE, ends[row])
    h = (sums[to] - sums[at]) * up[at]  # the same for equal shingles wherever they stand
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= _MIX
    return row, h


def signatures(lines: list[str]) -> np.ndarray:
    """A row of ``_BINS`` least hashes for each line (normal form, none empty)."""
    row, h = _hashed(lines)
    slot = row * _BINS + ((h >> np.uint64(40)) * np.uint64(_BINS) >> np.uint64(24)).astype(np.int64)
    out = np.full(len(lines) * _BINS, _NONE)
    np.minimum.at(out, slot, (h << np.uint64(24)) | (h >> np.uint64(40)))
    out = out.reshape(-1, _BINS)
    empty = out == _NONE
    full = out.copy()
    for order in _ORDER:
        r, c = np.nonzero(empty)
        if not len(r):
            return full
        got = out[r, order[c]]
        found = got != _NONE
        full[r[found], c[found]] = got[found] + np.uint64(1)  # borrowed
        empty[r[found], c[found]] = False
    r, c = np.nonzero(empty)
    full[r, c] = out.min(1)[r]
    return full


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_BASE), parts.shape[:2]).copy()
    for i in range(ROWS):
        key = (key ^ parts[:, :, i]) * _MIX
        key ^= key >> np.uint64(31)
    return key


def _lined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (id, key, text): a row (id, key, line, h, b0..) for each line that holds anything. A line has its band keys when it comes first among the
    last ``SEEN`` different ones of the task."""
    names = ["id", "key", "line", "h", *(f"b{j}" for j in range(BANDS))]
    seen: set[int] = set()
    for b in batches:
        at, no, hs, first, keys = [], [], [], [], []
        piece, size = [], 0
        for i, t in enumerate(b.column(2)):
            for n, line in enumerate((t.as_py() or "").split("\n")):
                x = normal(line)
                if x:
                    h = line_hash(x)
                    at.append(i)
                    no.append(n)
                    if h not in seen:
                        seen.add(h)
                        first.append(len(hs))
                        piece.append(x)
                        size += len(x)
                    hs.append(h)
                    if size > PIECE_CHARS:
                        keys.append(band_keys(signatures(piece)))
                        piece, size = [], 0
        if piece:
            keys.append(band_keys(signatures(piece)))
        if len(seen) > SEEN:
            seen = set()
        values = np.zeros((len(hs), BANDS), np.uint64)
        none = np.ones(len(hs), bool)
        none[first] = False
        if keys:
            values[first] = np.concatenate(keys)
        values = values.view(np.int64)
        take = pa.array(at, pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(no, pa.int32()), pa.array(hs, pa.int64()), *(pa.array(np.ascontiguousarray(values[:, j]), mask=none) for j in range(BANDS))], names)


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (band, salt, h) sorted by these: pairs (a, b, null), a > b, of lines that share a band, and (h, null, band) for each
    line of a band that not all pairs are given of: one of more than ``LAGS`` + 1 lines, or one that is dealt out by salt (0 or above)."""
    held = tuple(np.empty(0, np.int64) for _ in range(5))  # band, salt, h, place in its run, first line of its run
    for batch in batches:
        if not batch.num_rows:
            continue
        new = len(held[0])
        band, salt, h = (np.concatenate([x, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, x in enumerate(held[:3]))
        other = np.append(True, (band[1:] != band[:-1]) | (salt[1:] != salt[:-1]))
        differs = other | np.append(True, h[1:] != h[:-1])  # the held rows do, of each other
        band, salt, h, other = band[differs], salt[differs], h[differs], other[differs]
        starts = np.flatnonzero(other)
        sizes = np.diff(np.append(starts, len(band)))
        place = np.arange(len(band)) - np.repeat(starts, sizes)
        leader = np.repeat(h[starts], sizes)
        if new:
            place[: sizes[0]] += held[3][0]
            leader[: sizes[0]] = held[4][0]
        fresh = np.arange(new, len(band))
        x, y = [], []
        for lag in range(1, LAGS + 1):
            at = fresh[place[fresh] >= lag]
            x.append(h[at])
            y.append(h[at - lag])
        far = fresh[place[fresh] > LAGS]
        x.append(h[far])
        y.append(leader[far])
        # the line after the window brings those before it along
        turn = far[(place[far] == LAGS + 1) & (salt[far] < 0)]
        mine = np.concatenate([fresh[(place[fresh] > LAGS) | (salt[fresh] >= 0)], *(turn - lag for lag in range(1, LAGS + 1))])
        lines, bands = np.concatenate([h[mine], leader[turn]]), np.concatenate([band[mine], band[turn]])
        x, y = np.concatenate(x), np.concatenate(y)
        none = pa.nulls(len(lines), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y)), pa.nulls(len(x), pa.int64())], ["a", "b", "band"])
        yield pa.RecordBatch.from_arrays([pa.array(lines), none, pa.array(bands)], ["a", "b", "band"])
        held = tuple(c[-LAGS:] for c in (band, salt, h, place, leader))


def _fetch(bits: bytes):
    """The lines whose slot is set: h, text."""
    mask = 8 * len(bits) - 1

    def batch(found: dict[int, str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(list(found.values()), pa.string())], ["h", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, str] = {}
        size = 0
        for b in batches:
            for t in b.column(0):
                for line in (t.as_py() or "").split("\n"):
                    x = normal(line)
                    if x:
                        h = line_hash(x)
                        s = h & mask
                        if bits[s >> 3] >> (s & 7) & 1 and h not in found:
                            found[h] = x
                            size += len(x)
                            if size > FETCH_CHARS:
                                yield batch(found)
                                found, size = {}, 0
        yield batch(found)

    return run


def _packed(line: str) -> np.ndarray | None:
    """The distinct shingles of a line as sorted numbers, if each is eight one-byte characters: the eight bytes themselves."""
    try:
        raw = line.encode("latin-1")
    except UnicodeEncodeError:
        return None
    if SHINGLE != 8 or len(raw) < 8:
        return None
    every = np.sort(np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,)))
    new = np.empty(len(every), bool)
    new[0] = True
    np.not_equal(every[1:], every[:-1], out=new[1:])
    return every[new]


def similar(a: str, b: str, p: np.ndarray | None, q: np.ndarray | None) -> bool:
    """Whether the shingle sets of two lines are; ``p`` and ``q``: the lines packed."""
    if p is None or q is None:
        x, y = shingles(a), shingles(b)
        n, both = len(x) + len(y), len(x & y)
    elif min(len(p), len(q)) < SIMILARITY * max(len(p), len(q)):
        return False
    else:
        all_ = np.sort(np.concatenate([p, q]))
        n, both = len(all_), int(np.count_nonzero(all_[1:] == all_[:-1]))
    return both >= SIMILARITY * (n - both)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep, last, one = [], None, None
        for x, s, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if x != last:  # rows come sorted by b
                last, one = x, _packed(t)
            if one is not None and max(1, len(s) - SHINGLE + 1) < SIMILARITY * len(one):
                keep.append(False)  # too short to hold enough of the other's shingles
            else:
                keep.append(similar(t, s, one, _packed(s)))
        yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _distinct(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of each line, by row and hash."""
    row, h = _hashed(lines)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))
    return row[new], h[new]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows (h, root, text) in pieces of bounded text."""
    for b in batches:
        size = at = 0
        texts = b.column(2).to_pylist()
        for i, t in enumerate(texts):
            size += len(t)
            if size > PIECE_CHARS or i == len(texts) - 1:
                yield b.slice(at, i + 1 - at), texts[at : i + 1]
                size, at = 0, i + 1


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for _, texts in _pieces(batches):
        total += np.bincount(_slots(_distinct(texts)[1]), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])


def least_common(n):
    """Of the n shingles of a line, how many another must share, at the least, to be similar."""
    return np.ceil(SIMILARITY * n - 1e-9).astype(np.int64)


def _posted(counts: bytes):
    """Rows (token, h, root, n) of each of a line's rare-most shingles; n: how many it has."""
    weight = np.frombuffer(counts, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _pieces(batches):
            row, h = _distinct(texts)
            n = np.bincount(row, minlength=len(texts))
            order = np.lexsort((h, weight[_slots(h)], row))
            rank = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            own = rank < np.repeat(n - least_common(n) + 1, n)
            token, take = h[order][own], pa.array(row[own])
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), b.column(0).take(take), b.column(1).take(take), pa.array(n.astype(np.int32)).take(take)], ["token", "h", "root", "n"])

    return run


def _bits(line: str) -> np.ndarray:
    """A bit for each shingle of a line, the same for equal shingles."""
    try:
        raw = line.encode("latin-1")
    except UnicodeEncodeError:
        raw = b""
    if SHINGLE == 8 and len(raw) >= 8:
        every = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    else:
        one_byte = lambda x: max(x) < "\u0100"
        every = np.array([int.from_bytes(x.encode("latin-1"), "little") & 0xFFFFFFFFFFFFFFFF if one_byte(x) else line_hash(x) & 0xFFFFFFFFFFFFFFFF for x in shingles(line)], np.uint64)
    return (every * np.uint64(_BASE)) >> np.uint64(64 - MAP_BITS)


def _sketched(texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """How many distinct shingles each line has; a small and a large map of them, with how many more than the map's bits they are."""
    counts, larges, at = [], [], 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and end - at < 512 and size + len(texts[end]) <= PIECE_CHARS:
            size += len(texts[end])
            end += 1
        part = texts[at:end]
        counts.append(np.bincount(_distinct(part)[0], minlength=len(part)))
        on = np.zeros((len(part), 1 << MAP_BITS), bool)
        for i, t in enumerate(part):
            on[i, _bits(t)] = True
        larges.append(np.packbits(on, axis=1).view(np.uint64))
        at = end
    n, large = np.concatenate(counts), np.concatenate(larges)
    small = np.bitwise_or.reduce(large.reshape(len(texts), 8, -1), axis=1)
    return n, [(x, n - np.bitwise_count(x).sum(1, dtype=np.int64)) for x in (small, large)]


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (token, low, high, block, h, root, text) sorted by cell, which the first three name: links (a, b) of roots, a > b, that join
    whatever similar lines of a cell join; lines of one block only meet in the cell of that block alone."""
    held: list[pa.RecordBatch] = []

    def links(rows: pa.Table) -> pa.RecordBatch:
        token, low, high, block, h, root = (rows.column(i).to_numpy() for i in range(6))
        _, first, line = np.unique(h, return_index=True, return_inverse=True)
        texts = rows.column(6).take(pa.array(first)).to_pylist()
        n, maps = _sketched(texts)
        packed: dict[int, np.ndarray | None] = {}
        roots, label = np.unique(root[first], return_inverse=True)  # lines of equal label are linked
        up = list(range(len(roots)))

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        cell = np.cumsum(np.append(False, (token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
        across = low != high
        now, out, at, lag = label, [], np.arange(len(cell)), 0
        while True:
            lag += 1
            at = at[at >= lag]
            at = at[cell[at] == cell[at - lag]]
            if not len(at):
                break
            meets = ~across[at] | (block[at] != block[at - lag])
            x, y = line[at[meets]], line[at[meets] - lag]
            fits = (now[x] != now[y]) & (np.minimum(n[x], n[y]) >= least_common(np.maximum(n[x], n[y])))
            x, y = x[fits], y[fits]
            for bits, spare in maps:
                common = np.bitwise_count(bits[x] & bits[y]).sum(1, dtype=np.int64) + np.minimum(spare[x], spare[y])
                # both * (1 + similarity) >= similarity * (n + n)
                fits = common * (1 + SIMILARITY) >= SIMILARITY * (n[x] + n[y]) - 1e-6
                x, y = x[fits], y[fits]
            before = len(out)
            for i, j in set(zip(x.tolist(), y.tolist(), strict=True)):
                a, b = find(int(label[i])), find(int(label[j]))
                if a == b:
                    continue
                for k in (i, j):
                    if k not in packed:
                        packed[k] = _packed(texts[k])
                if similar(texts[i], texts[j], packed[i], packed[j]):
                    up[max(a, b)] = min(a, b)
                    out.append((label[i], label[j]))
            if len(out) > before:
                now = np.array([find(k) for k in range(len(up))])[label]
        pairs = roots[np.array(out, np.int64).reshape(-1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(pairs.max(1)), pa.array(pairs.min(1))], ["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        token, low, high = (b.column(i).to_numpy() for i in range(3))
        last = np.flatnonzero((token != token[-1]) | (low != low[-1]) | (high != high[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut or (held and any(held[-1].column(i)[-1].as_py() != b.column(i)[0].as_py() for i in range(3))):
            rows = [*held, b.slice(0, cut)] if cut else held
            yield links(pa.Table.from_batches(rows))
            held = []
        held.append(b.slice(cut))
    if held:
        yield links(pa.Table.from_batches(held))


def _by_tokens(lines: DataFrame) -> DataFrame | None:
    """``lines``: distinct h, root, text, written. Cells of lines that share a rare-most shingle."""
    got = lines.mapInArrow(_counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most 2**SKETCH_BITS rows
    if not len(got):
        return None
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    counts[got["slot"].to_numpy()] = got["n"].to_numpy()
    posted, _ = written(lines.mapInArrow(_posted(counts.tobytes()), "token long, h long, root long, n int"), "line-posted")
    tokens = posted.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token", "blocks")
    dealt = posted.join(tokens, "token").withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "h", "root")
    return dealt.join(lines.select("h", "text"), "h").select("token", "low", "high", "block", "h", "root", "text")


def _missed(known: DataFrame, handed: DataFrame, roots: DataFrame) -> DataFrame | None:
    """``handed``: distinct band, h. Links (a, b) that join every two similar lines of a band that aren't in one component; a and b are roots."""
    rows = handed.join(roots.select(F.col("node").alias("h"), "root"), "h", "left").select("band", "h", F.coalesce("root", "h").alias("root"))
    rows, _ = written(rows, "line-handed")
    open_ = rows.groupBy("band").agg(F.count("*").alias("k"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band", (F.col("k") > BLOCK).alias("large"))
    rows, _ = written(rows.join(open_, "band"), "line-open")
    if rows.isEmpty():
        return None
    small = rows.where(~F.col("large")).select(F.col("band").alias("token"), *[F.lit(0).alias(c) for c in ("low", "high", "block")], "h", "root").join(known, "h")
    cells = small.select("token", "low", "high", "block", "h", "root", "text")
    large = rows.where("large").select("h", "root").distinct().join(known, "h").select("h", "root", "text")
    large, _ = written(large, "line-large")
    more = _by_tokens(large)
    cells = cells if more is None else cells.unionByName(more)
    cells = cells.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high")
    return cells.mapInArrow(_crossed, "a long, b long").distinct()


def _bitmap(hashes: DataFrame) -> bytes:
    """Which slots the hashes take: sixteen bits for each of them, and 2**BITMAP_BITS at the most."""
    bits = min(BITMAP_BITS, max(12, (16 * hashes.count()).bit_length()))
    slot = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = hashes.select((F.shiftright(slot, 6)).alias("w"), F.expr(f"shiftleft(1L, cast(h & {63} as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (bits - 6), np.int64)
    got = words.toPandas()  # at most 2**(BITMAP_BITS - 6) rows
    out[got["w"].to_numpy()] = got["bits"].to_numpy()
    return out.tobytes()


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (band, salt, h), dealt out and sorted; salt is -1 but for the slots of hot keys."""
    bands = rows.where(F.col("b0").isNotNull()).select(F.explode(F.array(*[F.col(f"b{j}") for j in range(BANDS)])).alias("band"), "h")
    slot = F.pmod("band", F.lit(SLOTS))
    counts = bands.groupBy(slot.alias("slot")).agg(F.count("*").alias("k")).toPandas()  # at most SLOTS rows
    # at most HOT slots hold more than one in HOT of all rows; on less than a million rows a slot of HOT rows isn't hot
    share = max(int(counts["k"].sum()) // HOT, HOT)
    hot = [(int(x), -(-int(k) // share)) for x, k in zip(counts["slot"], counts["k"], strict=True) if k > share]
    if hot:
        salts = F.broadcast(bands.sparkSession.createDataFrame(hot, "slot long, salts int"))
        dealt = bands.withColumn("slot", slot).join(salts, "slot", "left").select("band", F.when(F.col("salts").isNull(), -1).otherwise(F.pmod(F.xxhash64("h"), F.col("salts"))).cast("int").alias("salt"), "h")
    else:
        dealt = bands.select("band", F.lit(-1).alias("salt"), "h")
    return dealt.repartition("band", "salt").sortWithinPartitions("band", "salt", "h")


def _rooted(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """``lines``: h, b0..; ``texts``: text. Rows (node, root), both hashes of lines, for every line that is linked to another."""
    both, _ = written(_dealt(lines).mapInArrow(_paired, "a long, b long, band long").distinct(), "line-pairs")
    pairs = both.where(F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b")
    handed = both.where(F.col("b").isNull()).select("band", F.col("a").alias("h"))
    ends = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).union(handed.select("h"))
    known = texts.mapInArrow(_fetch(_bitmap(ends)), "h long, text string").groupBy("h").agg(F.first("text").alias("text"))
    known, _ = written(known, "line-texts")
    one = known.select(F.col("h").alias("a"), F.col("text").alias("s"))
    other = known.select(F.col("h").alias("b"), F.col("text").alias("t"))
    compared = pairs.join(one, "a").join(other, "b").select("a", "b", "s", "t")
    roots = components(compared.mapInArrow(_verified, "a long, b long"))
    missed = _missed(known, handed, roots)
    if missed is None:
        return roots
    more = components(missed)
    if more.isEmpty():
        return roots
    # what was linked later is told by the roots of that time
    later = more.select(F.col("node").alias("root"), F.col("root").alias("low"))
    moved = roots.join(later, "root", "left").select("node", F.coalesce("low", "root").alias("root"))
    return moved.union(later.select(F.col("root").alias("node"), F.col("low").alias("root")).join(roots.select("node"), "node", "left_anti"))


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, key, line, h, b0..) of all lines, written."""
    ship(docs.sparkSession)
    text = F.col(text_col).cast("string")
    keyed = picked(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    return written(keyed.mapInArrow(_lined, f"id long, key long, line int, h long, {', '.join(f'b{j} long' for j in range(BANDS))}"), "lines")[0]


def _place():
    """Identifier and line number in one number: null is below the least identifier."""
    place = F.coalesce(F.col("id").cast("decimal(20,0)"), F.lit(str(NO_ID)).cast("decimal(20,0)")) * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line").cast("decimal(10,0)")
    return place.cast("decimal(38,0)")


def line_components(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (node, root), both hashes of lines, for every line that is linked to another."""
    texts = picked(docs, text_col).select(F.col(text_col).cast("string").alias("text"))
    return _rooted(_read(texts.withColumn("id", F.lit(0)), "id", "text"), texts)


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (a hash of the text), removed (numbers from 0 of lines to remove): a row for each document that loses lines."""
    all_ = _read(docs, id_col, text_col)
    roots = _rooted(all_, picked(docs, text_col).select(F.col(text_col).cast("string").alias("text"))).withColumnRenamed("node", "h")
    rows = all_.select("id", "key", "line", "h")
    firsts = rows.groupBy("h").agg(F.min(_place()).alias("first"), F.count("*").alias("n"))
    lines = firsts.join(roots, "h", "left").where(F.col("root").isNotNull() | (F.col("n") > 1)).select("h", "first", "n", F.coalesce("root", "h").alias("root"))
    lines, _ = written(lines, "line-classes")
    stays, _ = written(lines.groupBy("root").agg(F.min("first").alias("stays")), "line-stays")  # so that a hot root can be split in the join
    repeated, _ = written(lines.join(stays, "root").select("h", "n", "stays"), "line-repeated")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    gone = with_facts(rows, repeated, "h", "n", total).where(_place() != F.col("stays"))
    return gone.groupBy("id", "key").agg(F.collect_set("line").alias("removed"))


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (row, text, removed)."""
    for b in batches:
        texts, lines, counts = [], [], []
        for t, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            parts = (t or "").split("\n")
            lines.append(sum(1 for x in parts if x and not x.isspace()))
            if gone:
                out = set(gone)
                t = "\n".join(x for n, x in enumerate(parts) if n not in out)
            texts.append(t)
            counts.append(len(gone or ()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, b.schema.field(1).type), pa.array(lines, pa.int64()), pa.array(counts, pa.int64())], names=["row", "text", "n_lines", "n_removed"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with repeated lines taken out of the text, and n_lines and n_removed (which replace
    columns of these names)."""
    found = removals(docs, id_col, text_col).select(F.col("id").alias("found_id"), F.col("key").alias("found_key"), "removed")
    text = F.col(f"`{text_col}`").cast("string")
    rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_removed")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    joined = rows.join(found, rows["id"].eqNullSafe(found["found_id"]) & (rows["key"] == found["found_key"]), "left").select("row", "text", "removed")
    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string, n_lines long, n_removed long"
    new = joined.mapInArrow(_rebuilt, schema)
    return new.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c in (*rest, text_col)], "n_lines", "n_removed")


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")
