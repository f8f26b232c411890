"""Helpers shared by the corpus operators: shared-folder tables, range buckets, bounded memos."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from proofgrid.session import ship_package
from proofgrid.sinks.storage import shared_folder


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and returns a scan of it: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut_points(df: DataFrame, column: str, n: int, accuracy: int = 20_000) -> list:
    """At most n - 1 ascending values that cut a numeric column into runs of about equal counts (one aggregate, narrow scan)."""
    if n < 2:
        return []
    found = df.agg(F.percentile_approx(column, [i / n for i in range(1, n)], accuracy)).first()[0]
    return sorted(set(found or []))


def bucket_of(column: Column, cuts: list) -> Column:
    """Index of the run that a value falls in: how many cuts are at most the value; null goes to run 0.

    A balanced tree of comparisons, so a row costs log2(len(cuts)) of them and stays in generated code.
    """

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column >= F.lit(cuts[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(cuts)).cast("int")


def likely_members(df: DataFrame, column: str, wanted: DataFrame, wanted_column: str, bits: int = 24) -> DataFrame:
    """Rows of df whose (integer) column may be among the wanted values: all that are, and some others; nulls go.

    A bitmap of 2**bits positions of hashed values, kept as a table of 64-bit words: at most 2**(bits - 6) rows of two longs
    whatever the input's size, so it is safe to broadcast and the rows of df are not shuffled.
    """
    place = lambda c: F.xxhash64(F.col(c).cast("bigint"))
    word = lambda c: F.shiftrightunsigned(place(c), 70 - bits)
    bit = lambda c: F.pmod(place(c), F.lit(64)).cast("int")
    one = F.lit(1).cast("bigint")
    marked = wanted.where(F.col(wanted_column).isNotNull()).select(word(wanted_column).alias("_word"), F.call_function("shiftleft", one, bit(wanted_column)).alias("_bit"))
    words = marked.groupBy("_word").agg(F.bit_or("_bit").alias("_mask"))
    kept = df.where(F.col(column).isNotNull()).withColumn("_word", word(column)).join(F.broadcast(words), "_word")
    return kept.where(F.col("_mask").bitwiseAND(F.call_function("shiftleft", one, bit(column))) != 0).select(*df.columns)


#: Places where no token of a vocabulary that drops white space can span: before white space, and before a mark of full width
#: after a letter, for texts that use no spaces.
SAFE = regex.compile(r"[ \t\n\r\u3000]|(?<=\p{L})[。、，．！？；：]")


def segments(text: str, limit: int = 1 << 20) -> Iterator[str]:
    """Cuts a long text at safe places into runs of about `limit` characters; joined they give the text back."""
    start, n = 0, len(text)
    while n - start > limit:
        cut = SAFE.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


class Memo(dict):
    """A dict of at most 2 * cap entries that fills itself by `make`; entries unused for a whole generation go first.

    Values of texts longer than `longest` are made anew each time, so the memo is bounded in bytes too.
    """

    def __init__(self, make, cap: int = 200_000, longest: int = 64):
        super().__init__()
        self.make, self.cap, self.longest, self.old = make, cap, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.cap:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


#: What a Python worker keeps from task to task, by operator.
_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """The memos and models that a worker keeps for one operator."""
    return _KEPT.setdefault(owner, {})


def let_go(owner: str) -> None:
    """Frees what other operators have kept in this worker, which Spark uses again for any task that comes, and gives free memory back to the system."""
    others = [k for k in _KEPT if k != owner]
    for k in others:
        del _KEPT[k]
    if others:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trimmed = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trimmed is not None:
        trimmed(0)


def in_arrow(df: DataFrame, fn, schema: str | StructType, owner: str | None = None) -> DataFrame:
    """df.mapInArrow, with this package at hand on the executors; a task first frees what other operators keep there.

    owner names the module whose memos the function uses, if that is not its own.
    """
    ship_package(df.sparkSession)
    owner = owner or fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(owner)
        yield from fn(batches)

    return df.mapInArrow(run, schema)
