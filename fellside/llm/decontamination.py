"""Operator 6, benchmark decontamination by winnowing.

Words are runs of ASCII letters, digits and non-ASCII characters, after A-Z are lower-cased. A window is
``window`` consecutive words of a benchmark item; a shorter item with any word is one window.

*Winnowing.* Every ``gram`` words have a hash; of the hashes inside ``window`` words the least is the window's fingerprint. Equal windows keep equal hashes, so
a shared span of ``window`` words always shares a fingerprint: nothing is missed. A document's grams are looked up among the benchmark's fingerprints, each gram hashed
once, in the pass that reads them; by a shuffle only those go that are kept in a window of the document too. What meets is extended: every window round
the gram is compared, as text, with the benchmark's windows, and equal windows are hits. Items shorter than
``window`` words have the hash of all their words as fingerprint, which is looked for at every word.

*Size.* The benchmark's windows are written once and counted, rows and bytes. Up to ``BLOCK`` windows and ``BLOCK_BYTES`` bytes they are broadcast, and
no document is shuffled: only a row for each document and the rows that hit are. A larger benchmark is joined by shuffles, of one row for each fingerprint with the
words that its windows cover (so some five times the text), dealt by fingerprint and ``SALTS`` parts of the documents, so that a passage that many
documents share is no hot key; documents are still read once. Rows of one document come together in one group, which its own length bounds.

DataFrame functions only; no Python on the executors.

Defined results: a null or empty text has no words and is never contaminated; a benchmark item without words
has no windows; an item with a null identifier counts as the item ``''``; items with equal identifiers count
once; repeated rows of documents are returned as often as they came; an empty benchmark leaves all
documents clean; other columns, whatever their names, aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, computed, picked, table, text_or_empty, written

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK, BLOCK_BYTES = 1 << 18, 1 << 26
SALTS = 32


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD, -1), "")


def _gram_hash(at: Column, size: int) -> Column:
    """Of ``size`` words from place ``at`` (from 1) in the column ``_hashes``."""
    return F.xxhash64(*[F.try_element_at("_hashes", (at + j).cast("int")) for j in range(size)])


def _least(at: Column, window: int, gram: int) -> Column:
    """The least hash among those of the grams (column ``_grams``) inside the window from ``at``."""
    held = [F.try_element_at("_grams", (at + j).cast("int")) for j in range(window - gram + 1)]
    return F.least(*held) if len(held) > 1 else held[0]


def _places(size: Column, n: int) -> Column:
    """1 .. size - n + 1, or nothing."""
    return F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))


def _hashed(df: DataFrame, window: int, gram: int) -> DataFrame:
    """Adds _hashes of the words (_words), _grams, and _mins: the least gram hash of each full window."""
    df = computed(df, F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"), F.size("_words").alias("_n"))
    df = computed(df, F.transform(_places(F.col("_n"), gram), lambda i: _gram_hash(i, gram)).alias("_grams"))
    return computed(df, F.transform(_places(F.col("_n"), window), lambda i: _least(i, window, gram)).alias("_mins"))


def benchmark_windows(bench: DataFrame, window: int, gram: int, item_col: str, text_col: str) -> DataFrame:
    """The distinct windows: _size, _print (fingerprint), _window (text), _items (identifiers as sorted strings)."""
    items = (
        picked(bench, item_col, text_col)
        .select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("_item"), words_of(text_or_empty(text_col)).alias("_words"))
        .where(F.size("_words") > 0)
    )
    items = _hashed(items, window, gram)
    short = F.coalesce(*[F.when(F.col("_n") == n, _gram_hash(F.lit(1), n)) for n in range(1, window)]) if window > 1 else F.lit(None).cast("long")
    each = items.select("*", F.least("_n", F.lit(window)).alias("_size")).select("*", F.explode(F.sequence(F.lit(1), F.col("_n") - F.col("_size") + 1)).alias("_at"))
    prints = F.when(F.col("_n") < window, short).otherwise(F.try_element_at("_mins", F.col("_at")))
    text = F.array_join(F.slice("_words", F.col("_at"), F.col("_size")), " ")
    return each.select("_item", "_size", prints.alias("_print"), text.alias("_window")).groupBy("_size", "_print", "_window").agg(F.array_sort(F.collect_set("_item")).alias("_items"))


def _kept_somewhere(at: Column, n: Column, window: int, gram: int) -> Column:
    """Whether the gram at ``at`` is the least of some full window: as many grams in a row, itself among them, are no less as a window holds."""
    own, reach = _gram_hash(at, gram), window - gram
    low, high = F.greatest(at - reach, F.lit(1)), F.least(at + reach, n - gram + 1)
    less = lambda j: (at + j >= low) & (at + j <= high) & (_gram_hash(at + j, gram) < own)
    left = F.coalesce(*[F.when(less(-j), F.lit(j - 1)) for j in range(1, reach + 1)], at - low) if reach else F.lit(0)
    right = F.coalesce(*[F.when(less(j), F.lit(j - 1)) for j in range(1, reach + 1)], high - at) if reach else F.lit(0)
    return left + right >= reach


def overlaps(docs: DataFrame, bench: DataFrame, window: int = 10, gram: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """A row for each distinct (identifier, text): ``id_col``, text_key, n_words, n_rows (how often it came), hits
    (array of at: first word from 1, size, items)."""
    windows, _ = written(benchmark_windows(bench, window, gram, item_col, item_text_col), "benchmark-windows")
    seen = windows.groupBy("_size").agg(F.count("*").alias("n"), F.sum(F.octet_length("_window") + F.octet_length(F.array_join("_items", ",")) + 32).alias("bytes")).collect()  # at most `window` rows
    sizes = sorted(r["_size"] for r in seen)
    small = sum(r["n"] for r in seen) <= block and sum(r["bytes"] for r in seen) <= BLOCK_BYTES
    text = text_or_empty(text_col)
    base = picked(docs, id_col, text_col).select(F.col(id_col), F.md5(text.cast("binary")).alias("text_key"), words_of(text).alias("_words"))
    base = base.select("*", F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"), F.size("_words").alias("_n"))
    # place 0 stands for the document itself; the others are those of words
    base = base.select("*", F.explode(F.sequence(F.lit(0), F.col("_n"))).alias("_at"))
    at, n, marks = F.col("_at"), F.col("_n"), F.col("_s") == 0
    entry = lambda size, p: F.struct(F.lit(size).alias("size"), p.alias("print"))
    fits = [entry(k, F.when((at >= 1) & (at <= n - k + 1), _gram_hash(at, k))) if k < window else entry(k, F.when((at >= 1) & (at <= n - gram + 1) & (n >= window), _gram_hash(at, gram))) for k in sizes]
    self = entry(0, F.lit(None).cast("long"))
    if len(fits) > 1:
        rows = base.select("*", F.explode(F.when(at == 0, F.array(self)).otherwise(F.array(*fits))).alias("_c"))
    else:
        rows = base.withColumn("_c", F.when(at == 0, self).otherwise(fits[0] if fits else self))
    rows = rows.withColumn("_s", F.col("_c.size")).withColumn("_p", F.col("_c.print"))
    # the windows that may have this fingerprint, and the words that they cover
    full = F.col("_s") == window
    first = F.when(full, F.greatest(at - (window - gram), F.lit(1))).otherwise(at)
    last = F.when(full, F.least(at, n - window + 1)).otherwise(at)
    columns = [id_col, "text_key", "_n", "_s", "_first", "_last"]
    prints = windows.select(F.col("_size").alias("_of"), F.col("_print").alias("_known")).distinct()
    exact = windows.select(F.col("_size").alias("_len"), F.col("_window").alias("_same"), "_items")
    span = F.when(~marks, F.array_join(F.slice("_words", F.col("_first"), F.col("_last") - F.col("_first") + F.col("_s")), " ")).alias("_span")
    if small:
        met = rows.join(F.broadcast(prints), (F.col("_s") == F.col("_of")) & (F.col("_p") == F.col("_known")), "left").where((at == 0) | F.col("_known").isNotNull())
        met = met.withColumn("_first", first).withColumn("_last", last).select(*columns, span)
        exact = F.broadcast(exact)
        salt, same_salt = F.lit(0), F.lit(True)
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_part")
        salt, same_salt = F.pmod(F.xxhash64("text_key"), F.lit(SALTS)).cast("int"), F.col("_salt") == F.col("_part")
        prints, exact = prints.select("*", salts), exact.select("*", salts)
        kept = rows.where(F.col("_p").isNotNull() & (~full | _kept_somewhere(at, n, window, gram)))
        kept = kept.withColumn("_first", first).withColumn("_last", last).select(*columns, "_p", span, salt.alias("_salt"))
        met = kept.join(prints, (F.col("_s") == F.col("_of")) & (F.col("_p") == F.col("_known")) & same_salt).select(*columns, "_span")
        own = base.where(at == 0).select(id_col, "text_key", "_n", F.lit(0).alias("_s"), F.lit(0).alias("_first"), F.lit(0).alias("_last"), F.lit(None).cast("string").alias("_span"))
        met = met.unionByName(own)
    each = met.select(*columns, F.split("_span", " ").alias("_part_words"), F.explode(F.sequence(F.col("_first"), F.col("_last"))).alias("_at"), salt.alias("_salt"))
    each = each.select(id_col, "text_key", "_n", "_s", "_at", "_salt", F.when(~marks, F.array_join(F.slice("_part_words", F.col("_at") - F.col("_first") + 1, F.col("_s")), " ")).alias("_text"))
    if small:
        found = each.join(exact, (F.col("_s") == F.col("_len")) & (F.col("_text") == F.col("_same")), "left").where(marks | F.col("_same").isNotNull())
    else:
        found = each.where(~marks).join(exact, (F.col("_s") == F.col("_len")) & (F.col("_text") == F.col("_same")) & same_salt).drop("_part")
        found = found.unionByName(each.where(marks), allowMissingColumns=True)
    hit = F.struct(F.col("_at").alias("at"), F.col("_s").alias("size"), F.col("_items").alias("items"))
    return (
        found.select(id_col, "text_key", "_n", "_at", "_s", "_items")
        .groupBy(id_col, "text_key")
        .agg(F.max("_n").cast("long").alias("n_words"), F.count(F.when(marks, 1)).alias("n_rows"), F.array_sort(F.collect_set(F.when(~marks, hit))).alias("hits"))
    )


def judged(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds n_hit, n_items and items_sha256 to what :func:`overlaps` returns."""
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, h: F.struct(
            F.greatest(a["end"], h["at"] + h["size"] - 1).alias("end"),
            (a["n"] + F.greatest(F.lit(0), h["at"] + h["size"] - 1 - F.greatest(a["end"], h["at"] - 1))).cast("long").alias("n"),
        ),
    )["n"]
    items = F.array_sort(F.array_distinct(F.flatten(F.array_distinct(F.transform("hits", lambda h: h["items"])))))
    return (
        found.withColumn("n_hit", covered)
        .withColumn("_ids", items)
        .withColumn("n_items", F.size("_ids").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("_ids", ",").cast("binary"), 256))
        .drop("_ids")
    )


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that share no window with the benchmark."""
    bad = overlaps(docs, bench, window, id_col=id_col, text_col=text_col).where(F.size("hits") > 0).select(F.col(id_col).alias("_bad_id"), F.col("text_key").alias("_bad_key"))
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"), F.md5(text_or_empty(text_col).cast("binary")).alias("key"))
    left = rows.join(bad, rows["id"].eqNullSafe(bad["_bad_id"]) & (rows["key"] == bad["_bad_key"]), "left_anti")
    return left.select("row.*")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    found = judged(overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    each = found.select("*", F.explode(F.sequence(F.lit(1), F.col("n_rows"))).alias("_copy"))
    return each.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


#: The same by comparing every window's text, for DuckDB.
OP6_SQL = r"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i, w FROM b WHERE len(w) > 0),
bt AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM bw),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bt) WHERE len(w) >= n)),
h AS (SELECT r, i, n, item FROM dw JOIN bt USING (n, t)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
