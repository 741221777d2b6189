"""Operator 10, token counts from pre-token frequencies.

A text is cut into pre-tokens as the tokenizer cuts it; how many pieces a pre-token has doesn't depend on its
neighbours. So pieces are counted once for each distinct pre-token of the corpus, and a document's count
is the sum over its own pre-tokens of frequency times pieces. No ids are kept.

1. Tasks list the distinct pre-tokens of their documents; an aggregation makes one table of these.
2. Pieces are counted for each row of it, and the table is written to the shared folder.
3. The most frequent pre-tokens are broadcast, ``HEAD`` of them at most. A task counts a
   document's pre-tokens and sums up those of the head at once. The rest, each too rare to be a hot key, leave as rows (document,
   pre-token, frequency) and are joined to the table, and sums come together by document.

A special string inside a text is one token, as by the tokenizer's default: the text is cut there first.

Defined results: a null text is the empty text with no bytes and no tokens; repeated rows and null identifiers
are rows like any other; texts of any length count whole; an empty table gives no rows; other columns aren't
looked at; a vocabulary that cuts texts in another way is refused. Rows are numbered as a task reads them, so an input must come in the same order when it's read again, as from files:
what comes from a shuffle is to be written first.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked, ship, table, text_or_empty, tokenizer_path, written

HEAD = 1 << 18
# The vocabulary's pattern for pre-tokens, and its special string.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
_CUT = regex.compile(PATTERN)
_TOKENIZERS: dict = {}


def _tokenizer(vocabulary: str):
    if vocabulary not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[vocabulary] = Tokenizer.from_file(vocabulary)
    return _TOKENIZERS[vocabulary]


def checked(vocabulary: str) -> str:
    """The path again, if its file cuts texts as :func:`frequencies` does; what cuts in any other way is refused."""
    with open(vocabulary, encoding="utf-8") as f:
        held = json.load(f)
    cut = held.get("pre_tokenizer") or {}
    same = held.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    if not same or [t["content"] for t in held.get("added_tokens", [])] != [SPECIAL]:
        raise ValueError(f"{vocabulary} has other pre-tokens or special strings than those that are counted here")
    return vocabulary


def frequencies(text: str) -> tuple[Counter, int]:
    """Of a text's pre-tokens, and how often the special string is in it."""
    parts = text.split(SPECIAL)
    out = Counter(_CUT.findall(parts[0]))
    for p in parts[1:]:
        out.update(_CUT.findall(p))
    return out, len(parts) - 1


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for b in batches:
        for t in b.column(0).to_pylist():
            seen.update(frequencies(t)[0])
            if len(seen) > HEAD:
                yield pa.RecordBatch.from_pydict({"pre": list(seen), "n": list(seen.values())})
                seen = Counter()
    if seen:
        yield pa.RecordBatch.from_pydict({"pre": list(seen), "n": list(seen.values())})


def pre_token_table(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """pre, n (occurrences in all documents), pieces: a row for each distinct pre-token, in the shared folder."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary)
        for b in batches:
            pre = b.column(0).to_pylist()
            pieces = [len(x.ids) for x in tokenizer.encode_batch_fast(pre, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pieces, pa.int64())], ["pre", "n", "pieces"])

    seen = picked(docs, text_col).select(text_or_empty(text_col).alias("text")).mapInArrow(_distinct, "pre string, n long")
    return written(seen.groupBy("pre").agg(F.sum("n").alias("n")).mapInArrow(count, "pre string, n long, pieces long"), "pre-tokens")[0]


def _frequent(pieces: DataFrame, head: int) -> list[tuple[str, int]]:
    """The most frequent pre-tokens and their pieces: whole classes of frequency (sixteenths of a power of two) from the top, as
    long as they come to ``head`` rows at most. The driver sees the sizes of the classes, about a thousand, and these rows."""
    level = F.floor(16 * F.log2("n")).cast("int")
    least, total = None, 0
    for n, size in sorted(pieces.groupBy(level.alias("level")).count().collect(), reverse=True):
        total += size
        if total > head:
            break
        least = n
    if least is None:
        return []
    return [(r[0], r[1]) for r in pieces.where(level >= least).select("pre", "pieces").collect()]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """``id_col``, n_bytes, n_tokens."""
    spark = docs.sparkSession
    checked(vocabulary)
    kind = dict(docs.dtypes)[id_col]
    pieces = pre_token_table(docs, vocabulary, text_col)
    known = spark.sparkContext.broadcast(dict(_frequent(pieces, head)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = known.value
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            ids, rows, pres, ns, size, base = [], [], [], [], [], []
            for t in b.column(1).to_pylist():
                found, done = frequencies(t)
                for p, n in found.items():
                    k = of.get(p)
                    if k is not None:
                        done += n * k
                    else:
                        rows.append(row)
                        pres.append(p)
                        ns.append(n)
                ids.append(row)
                base.append(done)
                size.append(len(t.encode()))
                row += 1
            # a document's own row has a key that is no pre-token: letters and punctuation never come together
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids + rows, pa.int64()), pa.array([f"a#{i}" for i in ids] + pres, pa.string()), pa.array(base + ns, pa.int64()), pa.array(size + [None] * len(rows), pa.int64()), pa.concat_arrays([b.column(0), pa.nulls(len(rows), b.column(0).type)]) if n else b.column(0)],
                names=["row", "pre", "n", "n_bytes", "id"],
            )

    rows = picked(docs, id_col, text_col).select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(sums, f"row long, pre string, n long, n_bytes long, id {kind}")
    joined = rows.join(pieces.select("pre", "pieces"), "pre", "left")
    return joined.groupBy("row").agg(F.max("id").alias(id_col), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens")).drop("row")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    out = count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)
