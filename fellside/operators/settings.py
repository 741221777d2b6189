"""Nested settings as rows of paths: many documents are taken apart, merged and put together at once.

Documents are rows (id, body: JSON text). What isn't an object, a null included, is an empty one. A leaf is a value that isn't an object, or an empty object; arrays are leaves, nulls too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT<"))


def leaves(docs: DataFrame) -> DataFrame:
    """id, path (array of keys), value (JSON text) of every leaf. One round opens one level of all documents; ids are different. A document that names a key twice in an object isn't one.
    Documents are dealt out first: a small file is one task's, and what is made of it would stay there."""
    spark = docs.sparkSession
    docs = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    v = F.try_parse_json("body")
    empty = F.lit("{}")
    level = docs.select("id", F.array().cast("array<string>").alias("path"), F.when(_is_object(v), F.to_json(v)).otherwise(empty).alias("value"), F.coalesce(_is_object(v), F.lit(False)).alias("open")).transform(cut)
    found = []
    while True:
        shut = (~F.col("open")) | (F.col("value") == "{}")
        found.append(level.where(shut).select("id", "path", "value"))
        inner = level.where(~shut).select("id", "path", F.parse_json("value").alias("v"))
        if inner.isEmpty():
            break
        kids = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        text = F.coalesce(F.to_json("value"), F.lit("null"))
        level = kids.select("id", F.array_append("path", F.col("key")).alias("path"), text.alias("value"), F.coalesce(_is_object(F.col("value")), F.lit(False)).alias("open")).transform(cut)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def _prefixes(df: DataFrame, first: int, last: int) -> DataFrame:
    """id, path for each beginning of the paths, from ``first`` keys to all but ``last``."""
    size = F.size("path") - last
    return df.where(size >= first).select("id", F.explode(F.transform(F.sequence(F.lit(first), size), lambda n: F.slice("path", 1, n))).alias("path")).distinct()


def merged(base: DataFrame, other: DataFrame) -> DataFrame:
    """Leaves of each document of ``base`` after those of ``other`` (both as ``leaves`` gives them) of the same id: objects are merged at any depth, all else is replaced, by null as well. A document of one side only stays as it is.

    Leaves meet by paths and their beginnings, so by equi-joins: of ``base`` goes what lies at or below a leaf of ``other``, and what stands where ``other`` has an object. An empty object of ``other`` replaces no object."""
    key = ["id", "path"]
    above = _prefixes(base, 0, 1)
    held = above.union(base.where("value = '{}'").select(*key)).distinct()
    new = other.where("value <> '{}'").union(other.where("value = '{}'").join(held, key, "left_anti"))
    marked = base.select("id", "path", "value", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", 1, n))).alias("_at"))
    gone = marked.join(new.select("id", F.col("path").alias("_at")), ["id", "_at"], "left_semi").select(*key).union(_prefixes(other, 0, 1)).distinct()
    return base.join(gone, key, "left_anti").select(*key, "value").union(new.select(*key, "value"))


def documents(rows: DataFrame) -> DataFrame:
    """id, body: documents of leaves, keys in order, put together level by level from the deepest."""
    rows = rows.transform(cut)
    depth = rows.agg(F.max(F.size("path"))).first()[0] or 0
    label = F.concat(F.regexp_replace(F.to_json(F.array(F.element_at("path", -1))), r"^\[|\]$", ""), F.lit(":"))
    for n in range(depth, 0, -1):
        deep = rows.where(F.size("path") == n)
        own = deep.select("id", F.slice("path", 1, n - 1).alias("path"), F.struct(F.element_at("path", -1).alias("key"), F.concat(label, "value").alias("text")).alias("kid"))
        whole = own.groupBy("id", "path").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list("kid")), lambda k: k["text"]), ","), F.lit("}")).alias("value"))
        rows = rows.where(F.size("path") < n).unionByName(whole).transform(cut)
    return rows.select("id", F.col("value").alias("body"))


def resolved(path: Column, root: str) -> Column:
    """An absolute path stays; any other lies below ``root``."""
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
