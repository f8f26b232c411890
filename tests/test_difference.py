"""Kept trees of hashes: the same rows in any order have one root, and a difference is named by reading its leaves only."""

import pytest
from pyspark.sql import functions as F

from proofgrid.sinks import difference as D


def keep(df, path, **options):
    return D.keep_tree(df, ["k"], f"file://{path}", **options)


@pytest.fixture
def table(spark):
    return spark.range(300).select(F.when(F.col("id") == 7, None).otherwise(F.col("id")).alias("k"), (F.col("id") % 13).cast("string").alias("v"), F.lit(None).cast("string").alias("none"))


def test_differences_are_named(spark, rows, table, tmp_path):
    one = keep(table, tmp_path / "a", depth=2)
    assert one == keep(table.repartition(5), tmp_path / "same", depth=2) and D.differing_rows(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/same").count() == 0
    other = table.where("k IS NULL OR k NOT IN (3, 199)").withColumn("v", F.when(F.col("k") == 50, None).when(F.col("k").isNull(), "x").otherwise(F.col("v")))
    twice = table.where("k = 9")
    keep(other.unionByName(twice).unionByName(twice.withColumn("k", F.lit(5000).cast("long"))), tmp_path / "b", depth=2)
    left, right = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    assert rows(D.differing_rows(spark, left, right)) == [(199, "missing"), (3, "missing"), (50, "different"), (5000, "unexpected"), (9, "different"), (None, "different")]
    assert 4 <= D.differing_leaves(spark, left, right).count() <= 6
    plan = D.differing_rows(spark, left, right)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [top#" in plan and " IN (" in plan.split("PartitionFilters")[1][:200]


def test_empty_tables_and_trees_that_do_not_fit(spark, rows, table, tmp_path):
    few = table.where("k < 3")
    keep(few.limit(0), tmp_path / "none", depth=2)
    keep(few, tmp_path / "few", depth=2)
    keep(few, tmp_path / "deep", depth=3)
    assert rows(D.differing_rows(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/few")) == [(0, "unexpected"), (1, "unexpected"), (2, "unexpected")]
    assert D.differing_rows(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        D.differing_rows(spark, f"file://{tmp_path}/few", f"file://{tmp_path}/deep")
