"""A search index that follows a tree of Markdown files: changed files are chunked anew, files that are gone leave, and batches count once.

`sync` brings the index to what the tree holds now, by comparing paths and times of change with what it keeps: only changed files are read.
`follow` is the same as a stream: whenever files arrive, a batch syncs. A batch that was committed before its checkpoint was written, and so
comes again after a crash, finds its number in the index and does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.operators import lexical_index
from proofgrid.operators.texts import chunks
from proofgrid.sinks.publish import changed_since
from proofgrid.sinks.storage import staged
from proofgrid.sources.readers import markdown, related

#: As Spark's reader of whole files has them.
FILES = "path string, modificationTime timestamp, length long, content binary"


def sync(spark: SparkSession, root: str, folder: str, batch: int | None = None, skip: tuple[str, ...] = ("node_modules",)) -> int:
    """Brings the index in folder to the tree under root; the number of the commit that holds it.

    The index keeps chunks (id, file, line, heading, text), links (file, dst) from `related:` and files (file, mtime) beside the postings. With a
    batch number, nothing happens if the index has seen that number or a later one.
    """
    said = lexical_index.state(spark, folder)
    if batch is not None and said.get("batch") is not None and said["batch"] >= batch:
        return said["number"]
    there = staged(markdown(spark, root, skip).select(F.col("path").alias("file"), "mtime"), "there")
    stored = lexical_index.live(spark, folder, "files", said) if said["generations"] else there.limit(0)
    stored = staged(stored, "stored")
    changed = staged(changed_since(there, stored, "file", "mtime"), "changed")
    ghosts = staged(stored.select("file").join(there.select("file"), "file", "left_anti"), "ghosts")
    if changed.isEmpty() and ghosts.isEmpty():
        return said["number"]
    texts = staged(markdown(spark, root, skip).withColumnRenamed("path", "file").join(changed.select("file"), "file", "left_semi"), "texts")
    cut = chunks(texts.select(F.col("file").alias("id"), "text")).withColumnRenamed("id", "file")
    cut = staged(cut.select(F.xxhash64("file", "chunk").alias("id"), "file", "line", "heading", "text"), "chunks")
    links = texts.select("file", F.explode(related(F.col("text"))).alias("dst")).distinct()
    purge = changed.select("file").unionByName(ghosts)  # a changed file may have no chunk left
    return lexical_index.update(spark, folder, cut.select("id", "file", "text"), purge, batch, {"chunks": cut, "links": links, "files": changed.select("file", "mtime")})


def follow(spark: SparkSession, root: str, folder: str, checkpoint: str, files_per_trigger: int = 1000):
    """Starts a stream over all files that are there now and ends when they are in; a restart goes on where it ended. The query, started."""
    arrivals = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").option("maxFilesPerTrigger", files_per_trigger).load(root).select("path")
    apply = lambda _, number: sync(arrivals.sparkSession, root, folder, number)
    return arrivals.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def found(spark: SparkSession, folder: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """qid, file, line, heading, score, rank of searches in the index that is kept."""
    hits = lexical_index.search(spark, folder, queries, k)
    return hits.join(lexical_index.live(spark, folder, "chunks").select("id", "file", "line", "heading"), "id").select("qid", "file", "line", "heading", "score", "rank")
