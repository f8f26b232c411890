"""Small pieces of storage: staged tables in the shared folder, existence, one-line files through Spark's own file systems."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which the driver and all executors share; on a local master without one, a temporary folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='proofgrid-')}")
    return sc.getCheckpointDir()


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, whatever is lost later."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, uri: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, uri: str) -> bool:
    path, store = _path(spark, uri)
    return store.exists(path)


def put_text(spark: SparkSession, uri: str, text: str) -> None:
    """Writes a small file beside its place and renames it over what is there, in one step of the file system: readers see the old text or the new."""
    path, store = _path(spark, uri)
    part, _ = _path(spark, f"{uri}.{uuid.uuid4().hex}")
    out = store.create(part, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    over = sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    whole = store.makeQualified(path)
    hadoop.FileContext.getFileContext(whole.toUri(), sc._jsc.hadoopConfiguration()).rename(store.makeQualified(part), whole, over)


def get_text(spark: SparkSession, uri: str) -> str:
    return spark.read.text(uri, wholetext=True).first()[0]


def put_new(spark: SparkSession, uri: str, text: str) -> bool:
    """Writes a small file only if there is none of its name; of several writers one gets True, the others change nothing.

    The whole text stands beside its place first. A local file gets its name by a hard link, others by a rename that does not overwrite: one
    step on HDFS and on stores whose rename refuses an existing name in one step.
    """
    path, store = _path(spark, uri)
    part, _ = _path(spark, f"{uri}.{uuid.uuid4().hex}")
    out = store.create(part, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    sc = spark.sparkContext
    whole, source = store.makeQualified(path), store.makeQualified(part)
    try:
        if whole.toUri().getScheme() == "file":
            paths = sc._jvm.java.nio.file.Paths
            sc._jvm.java.nio.file.Files.createLink(paths.get(whole.toUri()), paths.get(source.toUri()))
        else:
            kinds = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
            keep = sc._gateway.new_array(kinds, 1)
            keep[0] = kinds.NONE
            sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), sc._jsc.hadoopConfiguration()).rename(source, whole, keep)
    except Py4JJavaError as e:
        if not e.java_exception.getClass().getSimpleName().startswith("FileAlreadyExists"):
            raise
        return False
    finally:
        store.delete(part, False)
    return True


def names(spark: SparkSession, uri: str) -> list[tuple[str, float]]:
    """Name and time of last change (seconds) of what is in a folder; none if there is no folder."""
    path, store = _path(spark, uri)
    return sorted((f.getPath().getName(), f.getModificationTime() / 1000) for f in store.listStatus(path)) if store.exists(path) else []


def remove(spark: SparkSession, uri: str) -> None:
    path, store = _path(spark, uri)
    store.delete(path, True)
