"""Sharding along a Hilbert curve through metadata dimensions, cut into shards of equal row counts.

Each dimension is quantised by its own quantiles, the curve index orders the rows so that neighbours agree in several
dimensions at once, and exact ranks cut the order into shards; within a shard, files are cut by bytes. Every file then holds
narrow ranges of all dimensions, which lets readers prune by any of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from proofgrid.llm.common import bucket_of, cut_points, in_arrow, materialize, new_path, shuffle_partitions
from proofgrid.session import ship_package

BITS = 5
#: Bytes of text of a file, and the most files there are before files grow instead: what the driver holds is one key a file.
FILE_BYTES, MOST_FILES = 32 << 20, 100_000
#: The total order of rows: the curve, the id, and what tells apart rows that agree in both.
KEY = ("_curve", "_id", "_r1", "_r2")
#: Names that sharding uses beside them; columns of docs that have one come back under it.
OWN = (*KEY, "_file", "_at", "_size")


def hilbert_index(levels: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of each row of levels (rows x dimensions, each level below 2**bits), by Skilling's transform."""
    x = levels.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    index = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | (x[i] >> b & 1)
    return index


def _ordinal(df: DataFrame, column: str) -> Column:
    """A number that orders the column's values: the value itself, or a string's first six bytes."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType):
        return F.col(column).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    return F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(column).cast("string"), "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")


def with_curve(docs: DataFrame, dimensions: list[str], bits: int = BITS) -> DataFrame:
    """Adds `_curve`, the row's place on the curve; nulls of a dimension are on its lowest level."""
    columns = [_ordinal(docs, d) for d in dimensions]
    narrow = docs.select(*[c.alias(f"_{i}") for i, c in enumerate(columns)])
    levels = [bucket_of(c, cut_points(narrow, f"_{i}", 1 << bits)) for i, c in enumerate(columns)]

    @pandas_udf("long")
    def curve(*found: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([s.to_numpy() for s in found], axis=1), bits))

    ship_package(docs.sparkSession)
    return docs.withColumn("_curve", curve(*levels) if levels else F.lit(0).cast("bigint"))


def running_bytes_in_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds pos and before: the rows and the bytes that stand before a row in its sorted partition."""
    pos = before = 0
    for batch in batches:
        sizes = batch.column("_size").to_numpy()
        ends = before + np.cumsum(sizes)
        columns = [*batch.columns, pa.array(np.arange(pos, pos + len(sizes))), pa.array(ends - sizes)]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "pos", "before"])
        pos, before = pos + len(sizes), int(ends[-1]) if len(ends) else before


def file_cuts(keys: DataFrame, n_shards: int, file_bytes: int) -> list[tuple]:
    """(rank, shard, *key) of the first row of each file: exact ranks and running bytes from one distributed sort of the keys.

    The driver sees two numbers a sort partition and one key a file, never the rows.
    """
    ordered = keys.repartitionByRange(shuffle_partitions(keys.sparkSession), *KEY).sortWithinPartitions(*KEY).withColumn("part", F.spark_partition_id())
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema)
    ranked = materialize(in_arrow(ordered, running_bytes_in_tasks, f"{fields}, pos bigint, before bigint"), "ranks")
    sizes = sorted((r.part, r.n, r.b) for r in ranked.groupBy("part").agg(F.count("*").alias("n"), F.sum("_size").alias("b")).collect())
    total, size = sum(n for _, n, _ in sizes), sum(b for _, _, b in sizes)
    if not total:
        return []
    bases, rank, begin = [], 0, 0
    for part, n, b in sizes:
        bases.append((part, rank, begin))
        rank, begin = rank + n, begin + b
    starts = [total * k // n_shards for k in range(n_shards)]
    offsets = ranked.sparkSession.createDataFrame(bases, "part int, rank0 bigint, before0 bigint")  # one row a sort partition
    placed = ranked.join(F.broadcast(offsets), "part").select(*KEY, (F.col("rank0") + F.col("pos")).alias("rank"), (F.col("before0") + F.col("before")).alias("before"))
    placed = placed.withColumn("shard", bucket_of(F.col("rank"), starts) - 1)
    firsts = placed.groupBy("shard").agg(F.min("before").alias("shard0"))  # one row a shard
    step = max(file_bytes, -(-size // MOST_FILES))
    files = placed.join(F.broadcast(firsts), "shard").groupBy("shard", F.floor((F.col("before") - F.col("shard0")) / step).alias("file")).agg(F.min(F.struct("rank", *KEY)).alias("first"))
    return sorted((r["first"]["rank"], r["shard"], *[r["first"][c] for c in KEY]) for r in files.collect())


def upto(cuts: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    """For each row the number of cuts that are not above it, both in order of several columns."""
    low, high = np.searchsorted(cuts[0], rows[0], "left"), np.searchsorted(cuts[0], rows[0], "right")
    if len(cuts) == 1:
        return high
    for cell in np.unique(rows[0][high > low]):  # values in which cuts lie: there the next column decides
        at = np.flatnonzero(rows[0] == cell)
        a, b = low[at[0]], high[at[0]]
        high[at] = a + upto([c[a:b] for c in cuts[1:]], [r[at] for r in rows[1:]])
    return high


def file_of(cuts) -> Callable:
    @pandas_udf("int")
    def find(c0: pd.Series, c1: pd.Series, c2: pd.Series, c3: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(upto(cuts.value[0], [c.to_numpy() for c in (c0, c1, c2, c3)]) - 1, 0).astype("int32"))

    return find


def place_of(cuts) -> Callable:
    @pandas_udf("struct<shard: int, slot: bigint>")
    def find(file: pd.Series, pos: pd.Series) -> pd.DataFrame:
        _, shards, begins = cuts.value
        return pd.DataFrame({"shard": shards[file.to_numpy()], "slot": begins[file.to_numpy()] + pos.to_numpy()})

    return find


def shard_documents(
    docs: DataFrame, folder: str, n_shards: int = 24, dimensions: tuple[str, ...] = ("lang", "source", "n_chars"), id_col: str = "doc_id", text_col: str = "text",
    row_key: tuple[Column, Column] | None = None, file_bytes: int = FILE_BYTES, bits: int = BITS,
) -> DataFrame:
    """Writes docs under folder as shard=<k>/ files in curve order and returns a scan of them, with `shard` and `slot`.

    The law is `rows`: shard k holds ranks N*k/n to N*(k+1)/n of the order, so counts differ by at most one whatever rows agree in:
    rows of one curve index and id are told apart by row_key, two numbers that together name a row of docs and never change, such as a
    hash of its file's path and its place there. Without row_key, docs is written once to number its rows. Null dimensions are on
    the lowest level and a null doc_id comes first; a null text has no bytes; an empty table gives no rows. Files of a shard are cut
    every file_bytes of text (one long text may exceed it). Columns of docs named shard or slot come back as given_shard and given_slot, all others under their names.
    One narrow sort of keys and sizes, then one shuffle of whole rows straight to their files.
    """
    spark = docs.sparkSession
    clashing = {c: f"given {c}" for c in docs.columns if c.lower() in OWN}
    docs, dimensions = docs.withColumnsRenamed(clashing), tuple(clashing.get(d, d) for d in dimensions)
    id_col, text_col, clashing = clashing.get(id_col, id_col), clashing.get(text_col, text_col), {v: c for c, v in clashing.items()}
    if row_key is None:
        docs = materialize(docs.withColumn("_r2", F.monotonically_increasing_id()), "numbered")
        row_key = (F.lit(0).cast("bigint"), F.col("_r2"))
    docs = docs.withColumns({"_r1": row_key[0].cast("bigint"), "_r2": row_key[1].cast("bigint")})
    for c in ("shard", "slot"):
        docs = docs.withColumnRenamed(c, f"given_{c}")
    keyed = with_curve(docs, [f"given_{d}" if d in ("shard", "slot") else d for d in dimensions if f"given_{d}" in docs.columns or d in docs.columns], bits)
    keyed = keyed.withColumn("_id", F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))))
    cuts = file_cuts(keyed.select(*KEY, (F.coalesce(F.octet_length(text_col), F.lit(0)) + 64).cast("bigint").alias("_size")), n_shards, file_bytes)
    plain = [f"`{c}`" for c in docs.columns if c not in KEY]
    if not cuts:
        return docs.select(*plain).withColumnsRenamed(clashing).limit(0).withColumn("slot", F.lit(0).cast("long")).withColumn("shard", F.lit(0))
    firsts: dict[int, int] = {}
    for rank, shard, *_ in cuts:
        firsts.setdefault(shard, rank)
    columns = [np.array([c[2 + i] for c in cuts], np.int64) for i in range(len(KEY))]
    shared = spark.sparkContext.broadcast((columns, np.array([c[1] for c in cuts], np.int32), np.array([c[0] - firsts[c[1]] for c in cuts], np.int64)))
    filed = keyed.withColumn("_file", file_of(shared)(*KEY)).repartitionById(len(cuts), "_file").sortWithinPartitions(*KEY)
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = filed.withColumn("_at", place_of(shared)("_file", position)).select(*plain, F.col("_at.slot").alias("slot"), F.col("_at.shard").alias("shard")).withColumnsRenamed(clashing)
    placed.write.partitionBy("shard").parquet(folder)
    return spark.read.schema(T.StructType([*placed.drop("shard").schema.fields, T.StructField("shard", T.IntegerType())])).parquet(folder)


def shard_digest(docs: DataFrame, n_shards: int = 24, row_key: tuple[Column, Column] | None = None) -> DataFrame:
    """Shards docs into the shared folder and tells of each document what its file holds.

    A null text counts as empty (8 bytes with the constant, CRC of no bytes); a null doc_id comes first in its curve cell; repeated
    rows each have a slot; an empty table gives no rows; columns besides doc_id, text and the dimensions are carried to the files only.
    """
    folder = new_path(docs.sparkSession, "shards")
    text = F.coalesce(F.col("text"), F.lit(""))
    return shard_documents(docs, folder, n_shards, row_key=row_key).select(
        "doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
