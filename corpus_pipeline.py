"""A corpus pipeline over `documents`: each stage applies one operator to all its predecessor kept.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of docs. Stages decide on every row by itself,
also on rows without a doc_id and rows that repeat one: the operator filters or rewrites the row where it stands, or, in
near-dedup, a number of the row's own goes to the operator and comes back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.llm import bpe, contamination, neardup, quality, secrets
from proofgrid.llm.common import materialize, new_path

#: What stands in place of a secret.
MARK = "[SECRET]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column of a name that it lacks, a number that no two rows share; written, so that every scan sees the same ones."""
    name, known = "_row", {c.lower() for c in docs.columns}
    while name in known:
        name += "_"
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier takes for good ones; learns from the labels of the documents given.

    Every row is judged by its own text where it stands, with all its columns, however named: null and empty texts are scored like others, rows without a doc_id or with a
    repeated one too, texts of any length are measured whole; an empty table gives no rows.
    """
    return quality.good_rows(docs, _table(spark, sf_dir, "labels")).select(*[f"`{c}`" for c in docs.columns])


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near copies, one of the least doc_id; a row without doc_id only if the class has no other.

    Rows are numbered, so rows that repeat a doc_id are judged one by one; texts of any length are compared whole; columns stay, however named; null texts and texts without words are one class; an
    empty table gives no rows.
    """
    rows, row = numbered(docs)
    classes = neardup.near_duplicates(rows, id_col=row).select(F.col("doc_id").alias(row), "class_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))
    kept = rows.select(row, "doc_id").join(classes, row).groupBy("class_id").agg(first.alias("first")).select(f"first.{row}")
    return rows.join(kept, row, "left_semi").select(*[f"`{c}`" for c in docs.columns])


def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item.

    Every row is judged by its own whole text where it stands, with all its columns, however named: null and empty texts stay, rows without a doc_id or with a repeated one are
    judged like others; an empty table gives no rows.
    """
    return contamination.without_contamination(docs, _table(spark, sf_dir, "benchmark")).select(*[f"`{c}`" for c in docs.columns])


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret, plain or wrapped, by a mark, with n_chars of the new text; every document stays.

    Held back are only rows that wrap more than can be unwrapped (see secrets.find_secrets: too_large). Null texts stay null with a null
    n_chars, texts of any length are rewritten whole, columns stay, however named; rows without a doc_id or with a repeated one are rewritten like others; an empty table gives no rows.
    """
    scanned = secrets.rewrite(docs, MARK)
    return scanned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[f"`{c}`" for c in docs.columns])


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text: doc_id, source, n_tokens, ids.

    Only doc_id, source and text are read, texts of any length whole. Null and empty texts have no ids; rows without a doc_id or with a repeated one are encoded like others; an empty table gives no rows.
    """
    import public_tokenizers

    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("source",))
    return encoded.select("doc_id", "source", "n_tokens", "ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", neardup_stage),
    ("benchmark decontamination", contamination_stage),
    ("secret scans", secrets_stage),
    ("byte-level BPE", bpe_stage),
]
#: SQL can express neither the classifier nor the alignment; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
