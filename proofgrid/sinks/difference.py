"""Where two tables differ: a tree of hashes kept with each, compared from the root down, so only leaves that differ are read.

    folder/levels/level=<n>/       prefix, digest, n: digits of the keys' hashes, and the hash of all rows below
    folder/rows/top=<2 digits>/    the key columns, leaf and hash of each row, in order of leaves

A leaf holds about LEAF rows (more if a key repeats more often), and is hashed by sums, so no list grows with it.
A difference of d rows is found by d times the depth digests and d leaves, however large the tables are.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.functions.columns import row_hash
from proofgrid.sinks.storage import get_text, put_text, staged

LEAF = 1000


def bag_digest(h: str) -> Column:
    """A hash of hexadecimal hashes in any order, as often as they come: their number and sums of four parts of them, which combine before the shuffle."""
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), *parts), 256)


def keep_tree(df: DataFrame, keys: Sequence[str], folder: str, columns: Sequence[str] | None = None, depth: int | None = None) -> str:
    """Writes the tree of a table over the given columns (all, if not given) and returns its root digest; rows that repeat a key count too.

    depth is the number of digits of a leaf; without it, so many that a leaf holds about LEAF rows. Trees of one depth can be compared.
    """
    columns, spark = list(columns or df.columns), df.sparkSession
    if depth is None:
        n, depth = df.count(), 2
        while n / 16**depth > LEAF:
            depth += 1
    leaf = F.substring(F.sha2(F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)])), 256), 1, depth)
    rows = df.select(*keys, leaf.alias("leaf"), row_hash(*columns).alias("h")).withColumn("top", F.substring("leaf", 1, 2))
    rows.repartition("top").sortWithinPartitions("top", "leaf").write.partitionBy("top").parquet(f"{folder}/rows")
    kept = spark.read.schema("leaf string, h string, top string").parquet(f"{folder}/rows")
    level = kept.groupBy(F.col("leaf").alias("prefix")).agg(bag_digest("h").alias("digest"), F.count("*").alias("n"))
    for n in range(depth, -1, -1):
        level = staged(level, "level")
        level.write.parquet(f"{folder}/levels/level={n}")
        if n:
            up = level.groupBy(F.substring("prefix", 1, n - 1).alias("prefix"))
            level = up.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda x: x["digest"]), ""), 256).alias("digest"), F.sum("n").alias("n"))
    top = level.first()
    root = top.digest if top else ""
    put_text(spark, f"{folder}/tree.json", json.dumps({"depth": depth, "root": root, "n": top.n if top else 0, "keys": list(keys), "columns": columns, "schema": ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)}))
    return root


def tree(spark: SparkSession, folder: str) -> dict:
    return json.loads(get_text(spark, f"{folder}/tree.json"))


def differing_leaves(spark: SparkSession, left: str, right: str) -> DataFrame:
    """prefix of every leaf whose rows are not the same: a level a round, and of each level only what is below a difference."""
    a, b = tree(spark, left), tree(spark, right)
    if (a["depth"], a["keys"], a["columns"]) != (b["depth"], b["keys"], b["columns"]):
        raise ValueError("trees of other keys, columns or depth cannot be compared")
    found = spark.createDataFrame([("",)] if a["root"] != b["root"] else [], "prefix string")
    for n in range(1, a["depth"] + 1):
        level = lambda folder: spark.read.schema("prefix string, digest string, n long").parquet(f"{folder}/levels/level={n}")  # noqa: E731, B023
        below = lambda folder, name: level(folder).join(found.select(F.col("prefix").alias("up")), F.substring("prefix", 1, n - 1) == F.col("up"), "left_semi").select("prefix", F.col("digest").alias(name))  # noqa: E731, B023
        both = below(left, "a").join(below(right, "b"), "prefix", "full")
        found = staged(both.where(~F.col("a").eqNullSafe(F.col("b"))).select("prefix"), "differing")
        if found.isEmpty():
            break
    return found


def differing_rows(spark: SparkSession, left: str, right: str) -> DataFrame:
    """The key columns and state (missing: only left has it, unexpected: only right, different) of all rows that two kept trees tell apart.

    Of the rows only those of differing leaves are read; folders of others are left out of the scan. A key that stands in several rows is
    different if its rows are not the same ones, as often.
    """
    said, leaves = tree(spark, left), differing_leaves(spark, left, right)
    tops = [r.top for r in leaves.select(F.substring("prefix", 1, 2).alias("top")).distinct().collect()]  # 256 at most
    keys = said["keys"]

    def side(folder: str, name: str) -> DataFrame:
        rows = spark.read.schema(f"{said['schema']}, leaf string, h string, top string").parquet(f"{folder}/rows").where(F.col("top").isin(tops))
        held = rows.join(leaves.withColumnRenamed("prefix", "leaf"), "leaf", "left_semi")
        return held.groupBy(*keys).agg(bag_digest("h").alias(name))

    a, b = side(left, "_a"), side(right, "_b")
    both = a.alias("a").join(b.alias("b"), [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys], "full")
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").when(F.col("_a") != F.col("_b"), "different")
    return both.select(*[F.coalesce(F.col(f"a.`{k}`"), F.col(f"b.`{k}`")).alias(k) for k in keys], state.alias("state")).where("state IS NOT NULL")
