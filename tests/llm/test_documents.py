"""Operators on documents against plain versions, and their defined results on odd tables."""

import bisect
import hashlib
import heapq
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fellside.llm import decontamination, lines, packing, pii, quality, sharding, simhash, sstable, token_counts
from fellside.llm.common import scratch, tokenizer_path

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    if extra:  # columns whose names the operators use themselves
        for name in ("row", "key", "id", "print", "h", "_at", "_text", "size", "shard", "piece", "n_lines", "spans", "hits"):
            df = df.withColumn(name, F.lit("x"))
    return df


ODD = [(1, None), (2, ""), (3, "   \n\n"), (4, "One two three four."), (4, "One two three four."), (None, "nothing known of this one"), (None, None), (7, "long " * 30_000), (8, "x" * 100_000), (9, "é😀 <|endoftext|> a@b.co\n" * 3)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Whole documents of the smallest table: (doc_id, text)."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return df, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def as_set(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# 1
def slow_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def classes(prints, distance=2):
    values = sorted(set(prints))
    a = np.array(values, np.uint64)
    parent = {p: p for p in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p in values:
        for j in np.flatnonzero(np.bitwise_count(a ^ np.uint64(p)) <= distance):
            x, y = find(p), find(values[j])
            parent[max(x, y)] = min(x, y)
    return {p: find(p) for p in values}


def simhash_expected(rows):
    prints = [slow_print(t) for _, t in rows]
    root = classes(prints)
    low = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            low[root[p]] = min(low.get(root[p], i), i)
    return as_set((i, format(p, "016x"), low.get(root[p])) for (i, _), p in zip(rows, prints, strict=True))


def test_simhash(spark, corpus):
    df, rows = corpus
    assert as_set(simhash.near_duplicates(df).collect()) == simhash_expected(rows)
    assert as_set(simhash.near_duplicates(docs(spark, ODD, True)).collect()) == simhash_expected(ODD)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("run", "distance"), [(3, 2), (512, 2), (3, 3)])
def test_simhash_hot_keys(spark, run, distance):
    random.seed(5)
    base, prints = random.getrandbits(64), set()
    for _ in range(400):
        x = base
        for _ in range(random.randint(0, 5)):
            x ^= 1 << random.randrange(64)
        prints.add(x)
    signed = {int(np.uint64(p).view(np.int64)): p for p in prints}
    got = {signed[r.node]: signed[r.root] for r in simhash.linked(spark.createDataFrame([(k,) for k in signed], "print long"), run, distance).collect()}
    want, mine = classes(prints, distance), {}
    for p in prints:
        mine.setdefault(got.get(p, p), set()).add(want[p])
    assert all(len(v) == 1 for v in mine.values()) and len(mine) == len(set(want.values()))


def test_representatives(spark):
    other = docs(spark, [(2, "a b c d")] * 3).withColumn("lang", F.when(F.rand(1) < 2, F.concat(F.lit("l"), F.monotonically_increasing_id().cast("string"))))
    assert simhash.representatives(other).count() == 1 and simhash.representatives(other).first() == simhash.representatives(other.repartition(3)).first()
    rows = [(5, "a b c d"), (2, "a b c d"), (2, "a b c d"), (9, "quite another text here"), (None, "a b c d"), (None, None)]
    kept = simhash.representatives(docs(spark, rows, True))
    assert as_set(r[:2] for r in kept.collect()) == as_set([(2, "a b c d"), (9, "quite another text here"), (None, None)])


# 3
def lines_expected(rows):
    places = {}
    for i, t in rows:
        for n, x in enumerate((t or "").split("\n")):
            if lines.normal(x):
                places.setdefault(lines.normal(x), set()).add((-(1 << 70) if i is None else i, n))
    keys = list(places)
    sets, parent = [lines.shingles(k) for k in keys], list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    first, gone = {}, set()
    for a, k in enumerate(keys):
        first[find(a)] = min(first.get(find(a), (1 << 70, 0)), min(places[k]))
    for a, k in enumerate(keys):
        gone |= places[k] - {first[find(a)]}
    return as_set((i, t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (-(1 << 70) if i is None else i, n) not in gone)) for i, t in rows)


def test_lines(spark, corpus):
    df, rows = corpus
    rows = rows[:120]
    small = df.where(F.col("doc_id").isin([i for i, _ in rows]))
    assert as_set(lines.without_repeats(small).select("doc_id", "text").collect()) == lines_expected(rows)
    unlike = [(1, "first line of all\nsecond  LINE\n\nfirst line of all"), (2, "Second line\nthe quick brown fox jumps over the lazy dog near the river bank today\n"), (3, "the quick brown fox jumps over the lazy dog near the river bank todax"), (None, None), (6, "")]
    assert as_set(lines.without_repeats(docs(spark, unlike, True)).select("doc_id", "text").collect()) == lines_expected(unlike)
    assert as_set(lines.without_repeats(docs(spark, ODD)).select("doc_id", "text").collect()) == lines_expected(ODD)
    assert lines.without_repeats(docs(spark, [])).count() == 0


def template_lines():
    """Lines that share most of a template: (number, line); some are near copies of others."""
    random.seed(11)
    rest = lambda n: "".join(random.choice("0123456789abcdef") for _ in range(n))
    one = lambda v: f"gateway request finished with status ok for the session of the user in region {v}"
    two = lambda v: f"{v[:11]} listing: two rooms, balcony, quiet street, near the station; offer {v[11:]} see the agent"
    out = []
    for form, size in ((one, 44), (two, 22), (two, 40)):
        for _ in range(500):
            v = rest(size)
            out.append(form(v))
            if random.random() < 0.5:
                i = random.choice((1, size - 2, size // 2))
                out.append(form(v[:i] + "#" + v[i + 1 :]))
    random.shuffle(out)
    return list(enumerate(out))


def test_lines_of_templates(spark, monkeypatch):
    rows = template_lines()
    expected = lines_expected(rows)
    assert 200 < sum(not t for _, t in expected) < 2000
    assert as_set(lines.without_repeats(docs(spark, rows)).select("doc_id", "text").collect()) == expected
    monkeypatch.setattr(lines, "BLOCK", 7)  # shingles dealt out in blocks
    assert as_set(lines.without_repeats(docs(spark, rows)).select("doc_id", "text").collect()) == expected
    monkeypatch.setattr(lines, "SLOTS", 1)  # all keys in one hot slot, dealt out by salt
    monkeypatch.setattr(lines, "HOT", 4)
    assert as_set(lines.without_repeats(docs(spark, rows)).select("doc_id", "text").collect()) == expected


def test_links_of_line_signatures():
    """Of 4,000 pairs of random lines at similarities from 0.8 to 0.85, at least 98 in 100 share a band key."""
    random.seed(12)
    pairs = []
    while len(pairs) < 4000:
        a = "".join(random.choice("abcdefghijklmnop ") for _ in range(random.randint(120, 300))).strip()
        b = a
        for _ in range(random.randint(1, 4)):
            i = random.randrange(len(b))
            b = b[:i] + random.choice("qrstuv") + b[i + 1 :]
        x, y = lines.shingles(lines.normal(a)), lines.shingles(lines.normal(b))
        if 0.8 <= len(x & y) / len(x | y) <= 0.85:
            pairs.append((lines.normal(a), lines.normal(b)))
    keys = lines.band_keys(lines.signatures([x for p in pairs for x in p])).reshape(len(pairs), 2, -1)
    assert (keys[:, 0] == keys[:, 1]).any(1).mean() >= 0.98


def test_equal_shingles_have_equal_bits():
    for a, b in (("abcdefgh", "abcdefgh中"), ("café au lait", "café au lait 中"), ("short", "short")):
        for x in lines.shingles(a) & lines.shingles(b):
            assert set(lines._bits(x)) <= set(lines._bits(a)) & set(lines._bits(b))


def test_similarity_by_packed_shingles():
    random.seed(6)
    for _ in range(3000):
        a = "".join(random.choice("ab é") for _ in range(random.randint(1, 60))) + ("中" if random.random() < 0.05 else "")
        b = list(a)
        for _ in range(random.randint(0, 2)):
            i = random.randrange(len(b) + 1)
            b[i : i + random.randint(0, 3)] = random.choice(["", "x", "ab", "q r"])
        b = "".join(b) or "z"
        x, y = lines.shingles(a), lines.shingles(b)
        assert lines.similar(a, b, lines._packed(a), lines._packed(b)) == (len(x & y) >= 0.8 * len(x | y))


def test_line_signatures_estimate_similarity():
    random.seed(1)
    near = 0
    for _ in range(50):
        a = "".join(random.choice("abcdefgh ") for _ in range(300)).strip()
        b = a[:150] + "##" + a[152:]
        x, y = lines.signatures([lines.normal(a), lines.normal(b), "tiny"])[:2]
        near += int((lines.band_keys(x[None]) == lines.band_keys(y[None])).any())
    assert near >= 49


# 4
def test_plan_uses_every_piece():
    random.seed(2)
    for lengths in ([random.randint(1, 4096) for _ in range(3000)], [1] * 9000, [1500] * 101, [4096] * 3, []):
        counts = {}
        for n in lengths:
            counts[n] = counts.get(n, 0) + 1
        runs, back = packing.plan(counts), {}
        for n, held in runs:
            assert sum(length * k for length, k in held) <= 4096
            for length, k in held:
                back[length] = back.get(length, 0) + n * k
        assert back == counts
        assert sum(n for n, _ in runs) <= 1.02 * sum(lengths) / 4096 + (len(lengths) / 2 if 1500 in lengths else 1)


def opened(lengths, capacity=4096):
    """How many sequences plain best-fit decreasing takes."""
    room, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(room, x)
        if i < len(room):
            left = room.pop(i) - x
        else:
            n, left = n + 1, capacity - x
        if left:
            bisect.insort(room, left)
    return n


@pytest.mark.parametrize("kind", ["even", "short", "long", "documents", "thirds"])
def test_plan_against_plain_best_fit(kind, corpus):
    """At most five sequences more than best-fit decreasing, or three more than the total length demands."""
    rng = np.random.default_rng(7)
    lengths = {
        "even": lambda: rng.integers(1, 4097, 20_000),
        "short": lambda: np.minimum(1 + rng.geometric(0.004, 20_000), 4096),
        "long": lambda: rng.integers(1500, 4097, 20_000),
        "documents": lambda: np.concatenate([[min(4096, len((t or "").split()) * 4 // 3 + 1) for _, t in corpus[1]], np.clip(rng.lognormal(5.5, 1.2, 20_000), 1, 4096).astype(int)]),
        "thirds": lambda: rng.choice([1366, 1365, 1364, 700, 90, 2731], 20_000),
    }[kind]().tolist()
    used = sum(n for n, _ in packing.plan(dict(Counter(lengths))))
    floor = -(-sum(lengths) // 4096)
    assert floor <= used <= max(opened(lengths) + 5, floor + 3)


def test_nnls():
    rng = np.random.default_rng(0)
    a = rng.random((8, 20))
    x = np.where(rng.random(20) < 0.2, rng.random(20), 0)
    got = packing.nnls(a, a @ x)
    assert (got >= 0).all() and np.allclose(a @ got, a @ x, atol=1e-8)


def ids_of(name, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(tokenizer_path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_packing(spark, corpus):
    df, rows = corpus
    for data, table in ((rows, df), (ODD, docs(spark, ODD, True))):
        got = packing.pack_documents(table).toPandas()
        want = []
        for (i, _), ids in zip(data, ids_of(WORD, [t for _, t in data]), strict=True):
            ids = np.array([*ids, 1], "<u4")
            want += [(i, n, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for n, s in enumerate(range(0, len(ids), 4096))]
        mine = [(None if r[0] != r[0] else int(r[0]), *map(int, r[1:])) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
        assert as_set(mine) == as_set(want)
        for _, s in got.sort_values("offset").groupby("sequence_id"):
            ends = (s["offset"] + s["length"]).tolist()
            assert s["offset"].tolist() == [0, *ends[:-1]] and ends[-1] <= 4096
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_sequences(spark):
    rows = [(1, "a b"), (2, None), (3, "hello world")]
    whole = b"".join(r.ids for r in packing.sequences(docs(spark, rows), tokenizer_path(WORD)).collect())
    assert sorted(np.frombuffer(whole, "<u4").tolist()) == sorted(x for ids in ids_of(WORD, [t for _, t in rows]) for x in [*ids, 1])


# 5
PII = [(1, "call +1 (555) 123-4567 or a.b@c.de; card 4111 1111 1111 1111, 4111 1111 1111 1112"), (2, "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3"), (3, "x@y.z_d@e.f a@b@c.d"), (4, "8" * 3000), (5, "1 " * 2000), (6, "a.b" * 2000 + "@x.y"), (7, "+1 2+3 " * 200)]


def test_pii(spark, corpus):
    df, rows = corpus
    for data, table in ((rows, df), (PII + ODD, docs(spark, PII + ODD, True))):
        got = as_set((r.doc_id, pii.as_text.__name__, ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.base)) for r in pii.find_spans(table).collect())
        assert got == as_set((i, "as_text", brute.pii(t)[2]) for i, t in data)


def test_pii_cards_of_parted_digits(spark):
    card = "4111111111111111"
    data = [(1, " ".join(card)), (2, "-".join(card)), (3, f"pay {' '.join(card)} now"), (4, f"12 or {'-'.join(card)}"), (5, " ".join(card[:-1] + "2")), (6, "1  2"), (7, "one 1"), (8, "  ".join(card))]
    got = as_set((r.doc_id, ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.base)) for r in pii.find_spans(docs(spark, data)).collect())
    assert got == as_set((i, brute.pii(t)[2]) for i, t in data)
    assert sum("card" in x for _, x in got) == 4


def test_pii_on_random_texts(spark):
    """10,000 texts of digits, blanks, dashes, dots, plus and at signs and a few letters, also those that no cheap look ahead must skip."""
    random.seed(21)
    marks = ["0123456789 -", "0123456789 -.+", "01 -", "0123456789.+@ab-_%", "12 .()+-x\n", "4 -1"]
    data = [(i, "".join(random.choice(marks[i % len(marks)]) for _ in range(random.randint(1, 60)))) for i in range(10_000)]
    data += [(20_000 + i, f"{random.choice(['', 'x', '4 ', '-'])}{random.choice([' ', '-']).join('4111111111111111')}{random.choice(['', ' 1', '.', '-'])}") for i in range(100)]
    got = as_set((r.doc_id, ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.base)) for r in pii.find_spans(docs(spark, data)).collect())
    assert got == as_set((i, brute.pii(t)[2]) for i, t in data)


def test_pii_digest(spark):
    out = {r.doc_id: r for r in pii.op5_pii.__globals__["find_spans"](docs(spark, PII)).collect()}
    assert [s.kind for s in out[1].spans] == ["phone", "email", "card"]


def test_pii_added_kinds(spark):
    rows = [(1, "iban GB82 WEST 1234 5698 7654 32"), (2, "GB82 WEST 1234 5698 7654 33"), (3, "ssn 123-45-6789"), (4, "123-45-6789"), (5, "DE89370400440532013000"), (6, "123-45-6789 is the ssn"), (7, "123-45-6789" + " " * 60 + "ssn")]
    got = {r.doc_id: [s.kind for s in r.spans if not s.base] for r in pii.find_spans(docs(spark, rows)).collect()}
    assert got == {1: ["iban"], 2: [], 3: ["ssn"], 4: [], 5: ["iban"], 6: ["ssn"], 7: []}


# 6
def leaks(rows, items):
    words = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    split = lambda t: __import__("re").findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", words(t))
    windows = {}
    for item, t in items:
        w = split(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for n in {len(k) for k in windows}:
            for at in range(len(w) - n + 1):
                k = tuple(w[at : at + n])
                if k in windows:
                    hit.update(range(at, at + n))
                    found |= windows[k]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return as_set(out)


@pytest.mark.parametrize("block", [1 << 18, 7])
def test_decontamination(spark, corpus, block):
    df, rows = corpus
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    run = lambda d, b: as_set(r for x in decontamination.judged(decontamination.overlaps(d, b, block=block)).collect() for r in [(x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256)] * x.n_rows)
    assert run(df, bench) == leaks(rows, items)
    short = [(1, "two words"), (2, None), (3, ""), (None, "one two three four five six seven eight nine ten eleven twelve"), (5, "Two WORDS"), (5, "alone")]
    texts = [*ODD, (20, "here two words alone"), (21, "x one two three four five six seven eight nine ten eleven y"), (22, "one two three four five six seven eight nine")]
    assert run(docs(spark, texts, True), spark.createDataFrame(short, "item_id long, text string")) == leaks(texts, short)
    assert run(docs(spark, texts), spark.createDataFrame([], "item_id long, text string")) == leaks(texts, [])


def test_decontaminate_keeps_clean(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    rows = [(1, "a one two three four five six seven eight nine ten b"), (2, "clean"), (None, None), (4, "clean"), (4, "clean")]
    assert as_set(r[:2] for r in decontamination.decontaminate(docs(spark, rows, True), bench).collect()) == as_set([(2, "clean"), (None, None), (4, "clean"), (4, "clean")])


# 7
def base(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else {w for w in set(windows) if windows[0] == w}
    rep = {j for i, w in enumerate(windows) if w in many for j in range(i, i + 5)}
    held = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(held) - len(set(held)), len(rep)


def test_quality_base(corpus):
    _, rows = corpus
    for _, t in [*rows, *ODD, (0, "a b c d e f a b c d e\nx\nx\n \n "), (0, "a\x1cb\x85c d")]:
        assert quality.statistics(t) == base(t)


def test_quality(spark):
    random.seed(4)
    clean = [(100 + i, " ".join(random.choice(["the", "and", "word", "river", "stone", "walked", "slowly"]) + str(random.randrange(99)) for _ in range(random.randint(30, 300)))) for i in range(300)]
    junk = [(1000 + i, " ".join(f"w{i}x{j} ###$$$" for j in range(60))) for i in range(20)]
    rows = [*clean, *junk, *[(2000 + i, clean[0][1]) for i in range(400)], *ODD]
    got = {r.doc_id: r for r in quality.judged(docs(spark, rows, True)).collect()}
    assert len(quality.judged(docs(spark, rows)).collect()) == len(rows)
    assert all(got[i].kept for i, _ in clean) and not any(got[i].kept for i, _ in junk) and not got[1].kept
    again = {r.doc_id: r.kept for r in quality.judged(docs(spark, rows).repartition(7)).collect()}
    assert again == {i: r.kept for i, r in got.items()}
    assert quality.judged(docs(spark, [])).count() == 0


@pytest.mark.parametrize("groups", [1 << 16, 0])
def test_quality_matches_memory_estimate(spark, monkeypatch, groups):
    """The distributed concentration steps against the same steps over arrays; estimates broadcast, and joined with large groups apart."""
    monkeypatch.setattr(quality, "GROUPS", groups)
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(500, 4)) * 300 + 1000).astype(int)
    x[:60] += 5000
    rows = spark.createDataFrame([("g", *map(int, r)) for r in x] + [("other", 1, 2, 3, 4)], "_g0 string, _x0 long, _x1 long, _x2 long, _x3 long").repartition(5)
    got = {r._g0: r for r in quality.estimates(rows).collect()}
    assert set(got) == {"g", "other"} and [got["other"][f"c{i}"] for i in range(4)] == [0.001, 0.002, 0.003, 0.004]
    got = got["g"]
    v, floors = x / 1000, np.diag(np.square(quality.FLOORS))
    q = np.percentile(v, [25, 50, 75], axis=0, method="inverted_cdf")
    starts = [(q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2) + floors), (v.mean(0), np.cov(v.T, bias=True) + floors)]
    found = []
    for c, cov in starts:
        for _ in range(quality.STEPS):
            w = np.linalg.inv(cov)
            k = np.floor(16 * np.log2(1 + np.einsum("ni,ij,nj->n", v - c, w, v - c)))
            half, share = (len(v) + 5) // 2, np.zeros(len(v))
            for value in np.unique(k):
                own = k == value
                share[own] = min(1.0, max(0.0, (half - (k < value).sum()) / own.sum()))
            c = (share[:, None] * v).sum(0) / half
            cov = quality.consistency(0.5, quality.CHI_HALF) * ((share[:, None] * v).T @ v / half - np.outer(c, c)) + floors
        found.append((np.linalg.det(cov), c, cov))
    _, c, cov = min(found, key=lambda f: f[0])
    w = np.linalg.inv(cov)
    inner = v[np.einsum("ni,ij,nj->n", v - c, w, v - c) <= quality.CHI_975]
    c, w = inner.mean(0), np.linalg.inv(quality.consistency(0.975, quality.CHI_975) * np.cov(inner.T, bias=True) + floors)
    assert np.allclose([got[f"c{i}"] for i in range(4)], c) and np.allclose([got[f"w{i}{j}"] for i in range(4) for j in range(i, 4)], [w[i, j] for i in range(4) for j in range(i, 4)])


# 8
def test_sstable(spark, corpus):
    df, rows = corpus
    for data, table in ((rows, df), (ODD, docs(spark, ODD, True))):
        path = scratch(spark, "test-sst")
        made = sstable.write_tables(table, path, tokenizer_path(WORD))
        got = sstable.read_tables(spark, path, made).orderBy("start").collect()
        coded = {}
        for (i, t), ids in zip(data, ids_of(WORD, [t for _, t in data]), strict=True):
            coded.setdefault(i, []).append(np.array([*ids, 1], "<u4").tobytes())
        assert [r.doc_id for r in got] == sorted((i for i, _ in data), key=lambda i: -(1 << 70) if i is None else i)
        at = 0
        for r in got:
            assert r.start == at and bytes(r.ids) in coded[r.doc_id] and zlib.crc32(r.ids) == r.ids_crc32
            at += r.n_tokens
        store, root = sstable._place(path)
        shards = [sstable.Shard(store.open_input_file(f"{root}/{m['file']}")) for m in made]
        for i in {i for i, _ in data}:
            assert sorted(x.tobytes() for s in shards for x in s.get(i)) == sorted(coded[i])
        assert not any(s.get(123456789) for s in shards)
    assert sstable.write_tables(docs(spark, []), scratch(spark, "test-sst"), tokenizer_path(WORD)) == []


def test_word_coder_is_the_tokenizer():
    import pyarrow as pa

    from fellside.llm.tokens import WordCoder

    random.seed(3)
    letters = list("ab 'sS\n\t\x1c\x85  é́İςΣ😀12.!,;:?<|>endoftext ëﬁ\u0000中")
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 30))) for _ in range(800)]
    texts += [t + "<|endoftext|>" + t for t in texts[:50]]
    ids, at = WordCoder(tokenizer_path(WORD)).encode(pa.array(texts, pa.string()))
    assert [ids[s:e].tolist() for s, e in zip(at[:-1], at[1:], strict=True)] == ids_of(WORD, texts)


# 9
def test_sharding(spark, corpus):
    df, rows = corpus
    for data, table in ((rows, df), (ODD, docs(spark, ODD, True)), ([(i, "same") for i in range(50)], docs(spark, [(i, "same") for i in range(50)]))):
        got = sharding.assign_shards(table).toPandas()
        assert as_set((None if r[0] != r[0] else int(r[0]), int(r[1]), int(r[2])) for r in got[["doc_id", "size", "text_crc32"]].itertuples(index=False)) == as_set((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in data)
        assert (got.groupby("text_hash")["shard"].nunique() == 1).all()
        for _, s in got.groupby("shard"):
            assert sorted(s["slot"]) == list(range(len(s)))
    loads = sharding.assign_shards(df).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(loads) == 8 and max(r.n for r in loads) - min(r.n for r in loads) < 0.01 * sum(r.n for r in loads)
    assert sharding.assign_shards(docs(spark, [])).count() == 0


def plain_lpt(loads, shards):
    """Loads of the shards, from a heap that takes every group by itself."""
    heap = [(0, s) for s in range(shards)]
    for x in sorted(loads, reverse=True):
        filled, s = heap[0]
        heapq.heapreplace(heap, (filled + x, s))
    return [x for x, _ in sorted(heap, key=lambda h: h[1])]


def test_longest_first():
    assert sharding.longest_first([(5, 1), (4, 1), (3, 2)], 2) == [[1, 0], [0, 1], [1, 1]]
    random.seed(9)
    for _ in range(200):
        runs = sorted({random.choice((1, 2, 3, 50, 997, 10**6, random.randint(1, 10**5))): random.choice((1, 2, 70, 400)) for _ in range(random.randint(1, 6))}.items(), reverse=True)
        shards = random.randint(1, 9)
        shares = sharding.longest_first(runs, shards)
        assert [sum(x) for x in shares] == [n for _, n in runs]
        assert [sum(load * x[s] for (load, _), x in zip(runs, shares, strict=True)) for s in range(shards)] == plain_lpt([load for load, n in runs for _ in range(n)], shards)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_sharding_is_longest_first_on_whole_tables(spark, sf):
    got = sharding.assign_shards(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet"))
    groups = got.groupBy("text_hash").agg(F.sum("size").alias("n")).toPandas()["n"].tolist()
    loads = {r.shard: r.n for r in got.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    assert [loads.get(s, 0) for s in range(8)] == plain_lpt(groups, 8)


# 10
def test_token_counts_of_nothing(spark):
    assert token_counts.count_tokens(docs(spark, []), tokenizer_path(BYTE)).count() == 0
    with pytest.raises(ValueError, match="other pre-tokens"):
        token_counts.count_tokens(docs(spark, []), tokenizer_path(WORD))


@pytest.mark.parametrize("head", [3, 1 << 18])
def test_token_counts(spark, corpus, head):
    df, rows = corpus
    random.seed(3)
    letters = list("ab 'stre\n\t\x1c\x85    é́😀12.!<|>endoftext ﬁ\u0000中​²_")
    odd = [*ODD, *[(100 + i, "".join(random.choice(letters) for _ in range(30))) for i in range(300)]]
    for data, table in ((rows[:60], df.where(F.col("doc_id").isin([i for i, _ in rows[:60]]))), (odd, docs(spark, odd, True))):
        got = as_set(token_counts.count_tokens(table, tokenizer_path(BYTE), head=head).select("doc_id", "n_bytes", "n_tokens").collect())
        assert got == as_set((i, len((t or "").encode()), len(ids)) for (i, t), ids in zip(data, ids_of(BYTE, [t for _, t in data]), strict=True))


def test_shards_follow_the_size(spark, monkeypatch):
    """More text makes more shards, not larger ones, and their starts still add up."""
    monkeypatch.setattr(sstable, "RANGE_BYTES", 2000)
    rows = [(i, "one two three " * (1 + i % 9)) for i in range(400)]
    path = scratch(spark, "test-sst")
    made = sstable.write_tables(docs(spark, rows).repartition(3), path, tokenizer_path(WORD))
    assert len(made) > 8 and sum(m["docs"] for m in made) == 400 and max(m["docs"] for m in made) < 120
    got = sstable.read_tables(spark, path, made).orderBy("start").collect()
    assert [r.doc_id for r in got] == list(range(400)) and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
