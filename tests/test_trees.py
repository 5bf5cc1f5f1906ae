"""Nested records."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from wayline.operators import trees


def test_maps_and_merges(spark):
    df = spark.createDataFrame([((1, ("x", 2)), (7, ("y",), 3))], "a struct<n:int,s:struct<t:string,k:int>>, b struct<n:int,s:struct<t:string>,m:int>")
    a, b = df.schema["a"].dataType, df.schema["b"].dataType
    add = trees.tree_map(F.col("a"), a, lambda c, _, kind: c + 1 if isinstance(kind, T.IntegerType) else c)
    merged = trees.tree_merge(F.col("a"), a, F.col("b"), b)
    picked = trees.selective_map(F.col("a"), a, lambda p: p == "s/k", lambda c: c * 10)
    r = df.select(add.alias("add"), merged.alias("merged"), picked.alias("picked")).first()
    assert r["add"] == (2, ("x", 3)) and r["merged"] == (7, ("y", 2), 3) and r["picked"] == (1, ("x", 20))


def test_names():
    assert trees.matching(["image_a", "depth_a"], "image_*") == ["image_a"]
    assert trees.starting_with(["obs_a", "my_obs"], ["obs"]) == ["obs_a"]
    with pytest.raises(ValueError):
        trees.matching(["a"], "b*")


def test_schema_differences():
    a = T.StructType.fromDDL("x int, s struct<u:string,v:int>")
    b = T.StructType.fromDDL("y int, s struct<u:int>")
    assert trees.schema_differences(a, b) == [("s/u", "type"), ("s/v", "missing"), ("x", "missing"), ("y", "extra")]


def test_tasks(spark):
    df = spark.createDataFrame([("go",)], "language_instruction string")
    r = trees.create_tasks(df, [("language_instruction", T.StringType()), ("image_primary", T.BinaryType())]).first()["task"]
    assert r["language_instruction"] == "go" and bytes(r["image_primary"]) == b"" and r["pad_mask_dict"].asDict() == {"language_instruction": True, "image_primary": False}
    with pytest.raises(ValueError):
        trees.create_tasks(df, [("image_primary", T.BinaryType())])


def test_tolerant_and_norms(spark):
    df = spark.createDataFrame([("1", [3.0]), ("x", [4.0]), (None, [])], "s string, v array<double>")
    assert trees.tolerant(df, "s", F.expr("try_cast(s as int)"), "n").count() == 2
    assert trees.norms(df, "v").first() == (2, 5.0)
