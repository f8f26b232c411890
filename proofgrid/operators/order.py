"""Positions and digests of whole tables in order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.sinks.storage import staged

LEAF = 1000


def positions(df: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """Adds the row's place (from 0) in a total order.

    Rows are dealt by range and sorted within their range; the driver sees a count a range and turns them into
    offsets. The sorted rows are written once, so places and counts agree even if executors are lost.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = staged(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    counts = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())
    offsets, at = [], 0
    for part, k in counts:
        offsets += [F.lit(part), F.lit(at)]
        at += k
    offset = F.create_map(*offsets)[F.col("_part")] if offsets else F.lit(0)
    return placed.withColumn(name, (offset + F.col("_pos")).cast("long")).drop("_part", "_pos")


def global_rank(table: DataFrame, metric: str, lower_better: bool = False) -> DataFrame:
    """Adds rank (1 + how many rows are strictly better; null for null) and of (how many have a value) over a whole table.

    Only the metric's column is sorted; a value's rank is the first place that it takes.
    """
    known = table.where(F.col(metric).isNotNull()).select(metric)
    placed = positions(known, [F.asc(metric) if lower_better else F.desc(metric)], "_at")
    ranks = placed.groupBy(metric).agg((F.min("_at") + 1).alias("rank"))
    return table.join(ranks, metric, "left").crossJoin(known.agg(F.count("*").alias("of")))  # one row


def whole_median(table: DataFrame, metric: str) -> DataFrame:
    """One row, middle: the exact median of a column without nulls; its values are sorted across the cluster and one or two of them looked up."""
    known = staged(table.where(F.col(metric).isNotNull()).select(metric), "values")
    n = known.count()
    return positions(known, [metric], "_at").where(F.col("_at").isin((n - 1) // 2, n // 2)).agg(F.avg(metric).alias("middle"))


def paired(left: DataFrame, right: DataFrame, left_order: Sequence, right_order: Sequence) -> DataFrame:
    """The rows of two tables side by side by their places in an order; a longer table's last rows have nulls beside them."""
    a, b = positions(left, left_order, "_at"), positions(right, right_order, "_at")
    return a.join(b, "_at", "full").withColumnRenamed("_at", "position")


def page(df: DataFrame, order: Sequence, skip: int, size: int) -> DataFrame:
    """Rows skip to skip + size of an order that the caller makes total: what a reader of pages asks for."""
    return df.orderBy(*order).offset(skip).limit(size)


def chain_digest(df: DataFrame, at: str, digest: str, fan: int = LEAF) -> DataFrame:
    """One row, digest: the SHA-256 over digests in order of their gapless places, in groups of `fan` and groups of groups."""
    level = df.select(F.col(at).cast("long").alias("at"), F.col(digest).alias("d"))
    n = level.count()
    while True:
        level = level.groupBy(F.floor(F.col("at") / fan).alias("at")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "d"))), lambda x: x["d"]), ""), 256).alias("d"))
        n = -(-n // fan)
        if n <= 1:
            return level.select(F.col("d").alias("digest"))


def hash_tree(hashes: DataFrame, column: str, depth: int | None = None) -> DataFrame:
    """One row, digest and n: a tree over hexadecimal hashes by their first `depth` digits, the same for any row order.

    Leaves list the hashes of a prefix in order, each level above the up to 16 digests below it. Without a depth it is chosen so
    that a leaf holds about LEAF hashes, so no list grows with the table.
    """
    level = hashes.select(F.col(column).alias("h"))
    if depth is None:
        n, depth = level.count(), 0
        while n > LEAF * 16**depth:
            depth += 1
    level = level.groupBy(F.substring("h", 1, depth).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"), F.count("*").alias("n"))
    for k in range(depth - 1, -1, -1):
        parts = F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: x["d"])
        level = level.groupBy(F.substring("p", 1, k).alias("p")).agg(F.sha2(F.array_join(parts, ""), 256).alias("d"), F.sum("n").alias("n"))
    return level.select(F.col("d").alias("digest"), "n")
