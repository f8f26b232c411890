"""The registered queries of the corpus operators, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.llm import alignment, bpe, contamination, fingerprints, neardup, quality, search, secrets, sequences, sharding, tokens, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


@register
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


@register
def op3_token_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.sequence_digests(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


@register
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


@register
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@register
def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")
    return sharding.shard_digest(_table(spark, sf_dir, "documents"), row_key=place)


@register
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@register
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(_table(spark, sf_dir, "documents"))


@register
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "too_large")


@register
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return contamination.contamination_digest(found)


ORACLES["op10_decontamination"] = r"""
WITH iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM iw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0
), dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), sizes AS (SELECT DISTINCT n FROM win), places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM dw, sizes, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS u(i)
), met AS (SELECT p.doc_id, p.n, p.i, win.item FROM places p JOIN win USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM met, unnest(range(i, i + n)) AS u(k) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM met GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@register
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


ORACLES["op11_ranked_search"] = r"""
WITH items AS (
  SELECT row_number() OVER () AS k, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM benchmark
), asked AS (SELECT k, term, count(*) AS q FROM (SELECT k, unnest(t) AS term FROM items) GROUP BY k, term),
docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents
), stats AS (SELECT CAST(count(*) FILTER (len(t) > 0) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM docs),
postings AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY row, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM postings, stats GROUP BY term, n_docs),
sizes AS (SELECT row, doc_id, 25 + (75 * len(t) * n_docs) // n_terms AS m FROM docs, stats WHERE len(t) > 0),
scores AS (
  SELECT k, row, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN sizes USING (row) GROUP BY k, row
), ranked AS (
  SELECT k, doc_id, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores JOIN sizes USING (row) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN items USING (k) WHERE rank <= 10
"""


@register
def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


@register
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
