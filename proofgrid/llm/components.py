"""Connected components of an edge table by contraction: every round merges vertices, and edges within one go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Returns v, c: every vertex of the edges with the least vertex of its component; loops and repeated edges do no harm.

    A round points each vertex to the least among itself and its neighbours, follows pointers once more, and renames the
    ends of the edges by them; edges whose ends meet are done, so later rounds see ever fewer. Minima combine before the
    shuffle, so a vertex of many edges is no hot spot. Only whether edges are left reaches the driver.
    """
    left = materialize(edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("p"), F.greatest(a, b).alias("q")).distinct(), "edges")
    pointers: list[DataFrame] = []
    while not pointers or not left.isEmpty():
        ends = left.select(F.inline(F.array(F.struct(F.col("p").alias("v"), F.col("q").alias("u")), F.struct(F.col("q").alias("v"), F.col("p").alias("u")))))
        least = materialize(ends.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("c")), "pointers")
        to = materialize(least.join(least.select(F.col("v").alias("c"), F.col("c").alias("root")), "c").select("v", F.col("root").alias("c")), "pointers")
        pointers.append(to)
        moved = left.join(to.select(F.col("v").alias("p"), F.col("c").alias("x")), "p").join(to.select(F.col("v").alias("q"), F.col("c").alias("y")), "q")
        left = materialize(moved.where("x <> y").select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q")).distinct(), "edges")
    found = pointers[0]
    for to in pointers[1:]:
        found = found.join(to.select(F.col("v").alias("c"), F.col("c").alias("root")), "c", "left").select("v", F.coalesce("root", "c").alias("c"))
    return materialize(found, "components")
