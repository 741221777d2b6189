"""Documents to packed training sequences, in stages. Each stage takes all that its predecessor kept, writes it as
Parquet in the shared folder, and all but the last return the columns of documents.

Documents need the columns doc_id, text, lang, source and n_chars; any others, whatever their names, are carried along but by the last stage.

Defined results, for each stage: a null or repeated identifier is one like any other, and rows alike in all columns are treated alike until near-dedup; an empty table
gives an empty table; texts of any length are read whole.

* quality rules: a null or empty text has no words and goes; a null language or source is a group of its own; copies share their verdict.
* line dedup: a null text stays null; an empty one stays empty; of a line's copies, and of lines like it, the first by identifier (null first) and line number stays; n_chars
  is counted anew where lines went.
* near-dedup: null and empty texts are alike; of a group the least identifier stays (null last), of equals the least MD5 of the text, then the least hash of the row.
* decontamination: a null or empty text is clean; copies share their verdict.
* packing: a null text is the empty text, whose one piece is the end id; ties are ordered by identifier, piece and checksum."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellside.llm.common import table, written
from fellside.llm.decontamination import decontaminate
from fellside.llm.lines import without_repeats
from fellside.llm.packing import pack_documents
from fellside.llm.quality import kept_documents
from fellside.llm.simhash import representatives


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or are outliers of their lang and source (columns that documents must have), go."""
    return kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document stays, if need be with no text. n_chars follows the text."""
    new = without_repeats(docs)
    count = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return new.withColumn("n_chars", count).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (fingerprints of three-word shingles, two bits) stays."""
    return representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: Fingerprints, components, estimates and packing are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
