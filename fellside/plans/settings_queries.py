"""Queries over nested settings: a document and what changes it for each part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import settings as S
from ..sources import derived as D
from .registry import checkpoints as _checkpoints
from .registry import query

BASE = """'{"data":{"size":' || p_size || ',"root":"maps","more":{"a":' || p_partkey % 3 || ',"b":{"c":true}}},"train":{"rate":0.5,"name":"n' || p_partkey % 7 || '"},"mode":' || CASE WHEN p_partkey % 4 = 0 THEN '{}' WHEN p_partkey % 4 = 1 THEN '{"x":{"y":1}}' ELSE '7' END || '}'"""
OTHER = """'{"data":{"size":' || p_partkey || ',"more":' || CASE p_partkey % 3 WHEN 0 THEN '5' WHEN 1 THEN '{"b":{"d":' || p_size || '}}' ELSE '{"a":{"z":{}}}' END || '},"mode":' || CASE WHEN p_partkey % 5 = 0 THEN '{}' WHEN p_partkey % 5 = 1 THEN '{"x":3}' ELSE '"off"' END || ',"new":{"deep":{"er":' || p_size % 9 || '}}}'"""


@query("settings_merge", f"WITH d AS (SELECT p_partkey AS id, CAST(json_merge_patch(CAST({BASE} AS JSON), CAST({OTHER} AS JSON)) AS VARCHAR) AS doc FROM part) SELECT d.id, replace(t.fullkey, '$.', '') AS path, CAST(t.value AS VARCHAR) AS value FROM d, json_tree(d.doc) t WHERE t.type <> 'OBJECT' OR CAST(t.value AS VARCHAR) = '{{}}'")
def settings_merge(spark, sf_dir):
    """Each part's settings after its changes, leaf by leaf."""
    _checkpoints(spark)
    part = D.table(spark, sf_dir, "part")
    base, other = (S.leaves(part.select(F.col("p_partkey").alias("id"), F.expr(t).alias("body"))) for t in (BASE, OTHER))
    return S.merged(base, other).select("id", F.array_join("path", ".").alias("path"), "value")
