"""Operators and stages on tables whose columns have the names that they use inside, or names that are no identifiers."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
NAMES = ("source url", "_row", "_id", "block", "shard", "slot", "rid", "_curve", "_r2", "_file", "_at", "statistics", "score", "words")


@pytest.fixture(scope="module")
def docs(spark):
    prose = lambda k: " ".join(f"word{k}x{j} and" for j in range(20))
    texts = [(k, prose(k % 12)) for k in range(24)] + [(30, None), (31, ""), (None, prose(3)), (32, "token=abcdefghijklmnop " + prose(99)), (33, "long " * 40_000), (33, "long " * 40_000)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({name: F.lit(7) for name in NAMES})


def test_every_stage_keeps_columns_of_any_name(spark, docs, tmp_path):
    import corpus_pipeline as C

    spark.createDataFrame([(k, k % 2) for k in range(24)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no such words in any of the texts that are here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in C.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r["source url"] == r["_row"] == r["_id"] == 7 for r in rows), name
        if name == "MinHash near-dedup":  # rows that share a value of `_row` are still rows of their own
            assert len(rows) == 12 + 3
        elif name == "secret scans":
            assert len(rows) == docs.count() and not [r for r in rows if r.text and "abcdefghijklmnop" in r.text]
    assert C.STAGES[4][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_shards_keep_columns_of_any_name(spark, docs, tmp_path):
    from proofgrid.llm import sharding

    out = sharding.shard_documents(docs, f"file://{tmp_path}/shards", 4)
    assert set(out.columns) == {*docs.columns, "given_shard", "given_slot"} and out.count() == docs.count()
    assert all(r["_id"] == r["_at"] == r["source url"] == r["_r2"] == 7 for r in out.collect()) and sorted(r.n for r in out.groupBy("shard").agg(F.count("*").alias("n")).collect()) == [7, 7, 8, 8]


def test_url_sample_is_bounded_by_distinct_urls(spark):
    """One URL in most rows counts once, with its weight; a share far below 2^-20 still gives rows."""
    from proofgrid.llm import urls

    rows = spark.range(30_000).select(F.when(F.col("id") < 29_000, F.lit("http://hot.example/x")).otherwise(F.concat(F.lit("http://h/"), F.col("id").cast("string"))).alias("url"), (F.col("id") % 2).cast("int").alias("label")).withColumns({f: F.lit(1.0) for f in urls.FEATURES})
    few = urls.sampled(rows, 200)
    assert 120 <= few.count() <= 300
    assert urls.sampled(rows, 5000).agg(F.sum("weight")).first()[0] == 30_000
    assert urls.sampled(rows.withColumn("url", F.concat("url", F.lit("-"), F.rand().cast("string"))), 3).count() <= 30
