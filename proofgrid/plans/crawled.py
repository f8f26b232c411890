"""A crawl of paged lists that Spark has laid out from a table: what a server would give is read from the shared folder."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.operators.order import positions
from proofgrid.plans.registry import query
from proofgrid.session import ship_package, table
from proofgrid.sinks.storage import shared_folder
from proofgrid.sources import crawl


class Laid:
    """Answers from Parquet files of rows (path, place, total, item) in order of path and place; of these only the row groups that hold a page are read."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, path, params):
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, where = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", self.folder))
        at, field = params["offset"], ds.field
        wanted = (field("path") == path) & ((field("place") == 0) | (field("place") >= at) & (field("place") < at + params["limit"]))
        rows = sorted(ds.dataset(where, filesystem=store, format="parquet").to_table(filter=wanted).to_pylist(), key=lambda r: r["place"])
        body = {"total": rows[0]["total"] if rows else 0, "items": [json.loads(r["item"]) for r in rows if r["place"] >= at]}
        return crawl.Response(200, {"Content-Type": "application/json"}, json.dumps(body).encode())


def laid_out(df: DataFrame, path: str, key: str) -> str:
    """Writes the list of every path in order of key; returns the folder."""
    placed = positions(df.select(F.col(path).cast("string").alias("path"), F.col(key).alias("_key"), F.to_json(F.struct(*df.columns)).alias("item")), [F.asc("path"), F.asc("_key")])
    firsts = placed.groupBy("path").agg(F.min("position").alias("first"), F.count("*").alias("total"))
    folder = f"{shared_folder(df.sparkSession)}/laid-{uuid.uuid4().hex}"
    rows = placed.join(firsts, "path").select("path", (F.col("position") - F.col("first")).alias("place"), "total", "item")
    rows.repartitionByRange("path", "place").sortWithinPartitions("path", "place").write.option("parquet.block.size", str(1 << 20)).parquet(folder)
    return folder


def crawled_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of every nation as a paged list a nation, crawled in pages of 50 with an overlap of one."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    folder = laid_out(customers, "c_nationkey", "c_custkey")
    ship_package(spark)
    name = f"laid_{uuid.uuid4().hex}"
    spark.dataSource.register(crawl.source(Laid(folder), name))
    nations = [str(r[0]) for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]  # the lists to read, by name: few by nature
    return spark.read.format(name).option("paths", "\n".join(nations)).option("limit", 50).option("pages", 20).load()


@query(
    "crawled_items",
    "SELECT CAST(c_nationkey AS VARCHAR) AS path, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place, c_custkey, c_mktsegment FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)",
)
def crawled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = crawl.items(crawled_customers(spark, sf_dir))
    return items.select("path", "place", F.from_json("item", "c_custkey long, c_mktsegment string").alias("c")).select("path", "place", "c.c_custkey", "c.c_mktsegment")


@query(
    "crawl_verdicts",
    "SELECT CAST(n_nationkey AS VARCHAR) AS path, count(c_custkey) AS total, count(c_custkey) AS places, count(DISTINCT c_custkey) AS keys, 'stable' AS state, NULL AS reason FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL",
)
def crawl_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.verdicts(crawled_customers(spark, sf_dir), "$.c_custkey")
