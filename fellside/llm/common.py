"""What the operators of this subpackage share: tables, the shared folder, shipping code to executors.

Intermediate results that are read more than once are written as Parquet under the folder named by
``spark.checkpoint.dir``. A written table cuts the lineage and outlives the executor that wrote it, so a
lost executor costs a reread, never a wrong row number. A folder of our own is made only for local masters
that have no such setting (tests); anything else without the setting is refused.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOTS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies (the default of every ``vocabulary`` parameter)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL_ROOTS:
        made = tempfile.mkdtemp(prefix="fellside-")
        atexit.register(shutil.rmtree, made, True)
        _LOCAL_ROOTS[sc.applicationId] = made
    return "file://" + _LOCAL_ROOTS[sc.applicationId]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/fellside/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read again, and where it lies."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it by ``sys.path`` alone."""
    root = str(Path(__file__).resolve().parents[2])
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp(prefix="fellside-code-")
    atexit.register(shutil.rmtree, folder, True)
    target = f"{folder}/fellside_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in Path(root, "fellside").rglob("*.py"):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


HOT = 1024


def with_facts(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined to ``facts``, which has each key once and in ``count`` how many rows hold it (``total`` in all). Fewer than
    ``HOT`` keys hold more than one in ``HOT`` of the rows; these are broadcast, so that no task gets more than that share by one key."""
    names = [c for c in facts.columns if c not in (key, count)]
    share = total // HOT
    hot = facts.where(F.col(count) > share).select(key, *[F.col(c).alias(f"_hot_{c}") for c in names], F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    first = marked.where(F.col("_hot")).select(*rows.columns, *[F.col(f"_hot_{c}").alias(c) for c in names])
    rest = marked.where(F.col("_hot").isNull()).select(*rows.columns).join(facts.where(F.col(count) <= share).select(key, *names), key)
    return first.unionByName(rest.select(*first.columns))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def computed(df: DataFrame, *new) -> DataFrame:
    """``df`` with ``new`` columns computed once a row. A plain projection may be merged into the next one, and
    an expression merged into a lambda would be computed again for every element."""
    return df.select(F.inline(F.array(F.struct("*", *new))))


def picked(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that columns of other names can't clash with the operator's own."""
    return df.select(*[F.col(f"`{n}`").alias(n) for n in names])


def ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
