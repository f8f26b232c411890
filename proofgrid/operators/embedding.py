"""Vectors from texts without a model file: hashed TF-IDF under a sparse random projection, at unit length, in Arrow batches.

A feature is a word or the stem of a longer one. Its MD5 says all that a model would have to keep: which of 2^20 counters holds its number of
documents, and which four of 256 dimensions it goes to with which signs. So a model is a table of document counts of fixed size, texts of any
origin meet in one space, and two tasks agree without exchanging anything. What `embed` returns fits wherever a column of vectors is asked for;
any function from (id, text) to (id, vector) can stand in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from proofgrid.operators.retrieval import BREAKS, few_tasks, hybrid
from proofgrid.operators.texts import chunks, meta_hint
from proofgrid.session import ship_package
from proofgrid.sinks.storage import staged
from proofgrid.sources.readers import front_matter, markdown, related

SIZE, BUCKET_DIGITS, HANDS, STEM = 256, 5, 4, 5
#: Bytes of text whose words a task numbers at once; a longer text is one piece.
AT_ONCE = 8_000_000


def pieces(batch) -> Iterator:
    """An Arrow batch in slices of about AT_ONCE bytes of the column _text, of a row at least."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(batch.column("_text")).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right")))
        yield batch.slice(at, last - at)
        at = last


def counted(texts):
    """Row, feature and how often it stands there, a row of texts (an Arrow array, lower-cased) and feature each; and the features.

    A feature is a word, or a tilde and the first STEM characters of one that is longer.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.split_pattern_regex(texts, BREAKS)
    found = lists.flatten().dictionary_encode()
    words, code = found.dictionary, found.indices.to_numpy()
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    there = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[code]
    cells, n = np.unique(row[there] * max(len(words), 1) + code[there], return_counts=True)
    row, code = np.divmod(cells, max(len(words), 1))
    longer = pc.greater(pc.utf8_length(words), STEM).to_numpy(zero_copy_only=False)
    stems = pc.binary_join_element_wise("~", pc.utf8_slice_codeunits(words.filter(pa.array(longer)), 0, STEM), "").dictionary_encode()
    stem = np.full(len(words), -1)
    stem[longer] = stems.indices.to_numpy()
    has = stem[code] >= 0
    cells, at = np.unique(row[has] * max(len(stems.dictionary), 1) + stem[code[has]], return_inverse=True)
    more = np.divmod(cells, max(len(stems.dictionary), 1))
    row, code = np.concatenate([row, more[0]]), np.concatenate([code, more[1] + len(words)])
    return row, code, np.concatenate([n, np.bincount(at, n[has], len(cells)).astype(np.int64)]), pa.concat_arrays([words, stems.dictionary])


def placed(features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each feature (an Arrow array), and HANDS dimensions and signed shares: digits 0 to 4, 6 to 13 and 16 to 19 of its MD5."""
    said = b"".join(hashlib.md5(f, usedforsecurity=False).digest() for f in features.cast("binary").to_pylist())
    digest = np.frombuffer(said, np.uint8).reshape(-1, 16).astype(np.int64)
    odd = np.stack([digest[:, 8 + i // 2] >> (0 if i % 2 else 4) & 1 for i in range(HANDS)], axis=1)
    return digest[:, 0] << 12 | digest[:, 1] << 4 | digest[:, 2] >> 4, digest[:, 3 : 3 + HANDS], np.where(odd, -0.5, 0.5)


@dataclass(frozen=True)
class Weights:
    """Inverse document frequencies by bucket, of a fixed number of buckets; buckets of no document have that of none."""

    idf: np.ndarray

    @classmethod
    def fit(cls, docs: DataFrame, text_col: str = "text") -> "Weights":
        """From all documents, null texts among them; a row a bucket reaches the driver, 2^20 at most."""

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            held, n = np.zeros(16**BUCKET_DIGITS, np.int64), 0
            for batch in (piece for whole in batches for piece in pieces(whole)):
                row, code, _, features = counted(batch.column("_text"))
                met = np.sort(row << 4 * BUCKET_DIGITS | placed(features)[0][code])  # np.unique without counts would hash them, at many times the cost
                held += np.bincount(met[np.append(True, met[1:] != met[:-1])[: len(met)]] & 16**BUCKET_DIGITS - 1, minlength=len(held))
                n += batch.num_rows
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_pydict({"b": pa.array(np.append(at, -1), pa.int32()), "n": pa.array(np.append(held[at], n))})  # -1: all documents

        ship_package(docs.sparkSession)
        sums = few_tasks(docs.select(F.lower(F.coalesce(text_col, F.lit(""))).alias("_text"))).mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(16**BUCKET_DIGITS + 1, np.int64)
        counts[sums.column("b").to_numpy()] = sums.column("n").to_numpy()
        return cls(np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1)


def embed(docs: DataFrame, weights: Weights, text_col: str = "text") -> DataFrame:
    """docs with a column vector: unit length, null for texts without a word. Texts are read whole, other columns pass by."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.idf)  # 8 MB
    ready = docs.withColumn("_text", F.lower(F.coalesce(text_col, F.lit(""))))
    schema = StructType([*docs.schema.fields, StructField("vector", ArrayType(DoubleType()))])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in (piece for whole in batches for piece in pieces(whole)):
            row, code, n, features = counted(batch.column("_text"))
            bucket, dims, shares = placed(features)
            w, flat = (1 + np.log(n)) * shared.value[bucket[code]], np.zeros(batch.num_rows * SIZE)
            for hand in range(HANDS):
                flat += np.bincount(row * SIZE + dims[code, hand], w * shares[code, hand], len(flat))
            matrix = flat.reshape(batch.num_rows, SIZE)
            norms = np.linalg.norm(matrix, axis=1)
            matrix = matrix / np.maximum(norms, 1e-300)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * SIZE, pa.int32()), pa.array(matrix.reshape(-1)), mask=pa.array(norms < 1e-12))
            names = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), lists], names=[*names, "vector"])

    ship_package(docs.sparkSession)
    return ready.mapInArrow(run, schema)


def markdown_chunks(spark: SparkSession, root: str, hints: tuple[str, ...] = (), skip: tuple[str, ...] = ("node_modules",)) -> tuple[DataFrame, DataFrame]:
    """(chunks, links) of a tree of Markdown files.

    chunks: id, file, line, heading, text, embedded (the text after the hint of its front matter's listed keys); links: src, dst between files, from
    `related:`, by path or by name without ending.
    """
    files = staged(markdown(spark, root, skip).select("path", "text", front_matter(F.col("text"))["fields"].alias("fields")), "files")
    cut = chunks(files.select(F.col("path").alias("id"), "text")).withColumnRenamed("id", "file")
    hint = files.select(F.col("path").alias("file"), meta_hint(F.col("fields"), hints).alias("hint"))
    both = cut.join(hint, "file").select(F.xxhash64("file", "chunk").alias("id"), "file", "line", "heading", "text", F.concat("hint", "text").alias("embedded"))
    name = lambda c: F.regexp_replace(F.substring_index(c, "/", -1), r"\.md$", "")
    said = files.select(F.col("path").alias("src"), F.explode(related(F.col("text"))).alias("to"))
    known = files.select(F.col("path").alias("dst"), name("path").alias("name"))
    found = said.select("src", name("to").alias("name")).join(known, "name").where("src <> dst")
    return both, found.select("src", "dst").distinct()


def search_markdown(spark: SparkSession, root: str, queries: DataFrame, k: int = 10, hints: tuple[str, ...] = (), embedder=None, **options) -> DataFrame:
    """From raw Markdown to hits: qid, file, line, heading, and hybrid's ranks for queries (qid, text).

    Chunks are embedded with their hints and searched as words without them; links join files. embedder maps a table with a text column and
    that column's name to it and a vector; without one, TF-IDF of the chunks.
    """
    made, links = markdown_chunks(spark, root, hints)
    made = staged(made, "chunks")
    if embedder is None:
        weights = Weights.fit(made, "embedded")
        embedder = lambda df, column: embed(df, weights, column)
    docs = staged(embedder(made, "embedded").drop("embedded"), "embedded")
    asked = staged(embedder(queries.select("qid", "text"), "text"), "asked")
    hits = hybrid(asked, docs, links, k=k, file="file", line="line", **options)
    return hits.join(docs.select("id", "file", "line", "heading"), "id")
