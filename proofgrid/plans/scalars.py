"""Queries of filters, orders and scalar functions that stand on their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.functions import columns as C
from proofgrid.operators import order
from proofgrid.operators.retrieval import pairwise_dot
from proofgrid.plans.metrics import SUMS_SQL, nation_brand_sums
from proofgrid.plans.registry import query
from proofgrid.session import table
from proofgrid.sources import readers


@query("visible_status", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 9 = 0 OR o_orderstatus NOT IN ('O', 'P')")
def visible_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and pending orders are hidden; every ninth order reads as one without a status and stays."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return orders.where(C.visible(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus")), ("O", "P")))


@query("eligible_samples", f"WITH {SUMS_SQL}, n AS (SELECT nation, sum(rounds) AS rounds FROM sums GROUP BY 1) SELECT nation, CAST(rounds AS BIGINT) AS rounds FROM n WHERE rounds >= 200")
def eligible_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = nation_brand_sums(spark, sf_dir).groupBy("nation").agg(F.sum("rounds").alias("rounds"))
    return rounds.where(C.eligible(F.col("rounds")))


@query("path_glob", "SELECT page_id FROM pages WHERE url GLOB 'http*://*/[a-m]*/?*'")
def path_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(C.globbed(F.col("url"), "http*://*/[a-m]*/?*")).select("page_id")


@query("alternatives", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)the\.|que|und ')")
def alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain one of three alternatives as they stand, in any case; the last one's space is trimmed, so it is put back."""
    docs = table(spark, sf_dir, "documents")
    pattern = F.replace(C.alternation(F.lit("The.|que| und")), F.lit("und"), F.lit("und "))
    return docs.where(F.rlike("text", pattern)).select("doc_id")


@query(
    "typed_sort",
    """WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 40 AS VARCHAR) ELSE p_brand END AS v FROM part)
    SELECT p_partkey, v, row_number() OVER (ORDER BY TRY_CAST(v AS DOUBLE) IS NULL, TRY_CAST(v AS DOUBLE), coalesce(v, ''), p_partkey) - 1 AS position FROM v""",
)
def typed_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of numbers and names: numbers by value, then names, ties in the order that they came in."""
    key = F.col("p_partkey")
    value = F.when(key % 5 == 0, None).when(key % 2 == 0, (key % 40).cast("string")).otherwise(F.col("p_brand"))
    return order.positions(table(spark, sf_dir, "part").select("p_partkey", value.alias("v")), [*C.typed_order(F.col("v")), F.asc("p_partkey")])


@query("result_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def result_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 25."""
    return order.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 50, 25)


@query(
    "positional_join",
    """WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS position FROM customer), b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS position FROM supplier)
    SELECT position, c_custkey, s_suppkey FROM a FULL JOIN b USING (position)""",
)
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The richest customers beside the poorest suppliers."""
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    both = order.paired(customers.select("c_custkey", "c_acctbal"), suppliers.select("s_suppkey", "s_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")], [F.asc("s_acctbal"), F.asc("s_suppkey")])
    return both.select("position", "c_custkey", "s_suppkey")


@query("signed_numbers", "SELECT s_suppkey, concat(CASE WHEN s_acctbal >= 0 THEN '+' ELSE '−' END, CAST(CAST(abs(s_acctbal) AS DECIMAL(18,2)) AS VARCHAR)) AS balance FROM supplier")
def signed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", C.signed(F.col("s_acctbal"), 2).alias("balance"))


@query(
    "timestamp_validity",
    """WITH t AS (SELECT event_id, printf('2024-%02d-%02dT%02d:%02d:00Z', event_id % 14, event_id % 33, event_id % 26, event_id % 62) AS moment FROM events)
    SELECT event_id, moment, TRY_CAST(moment[1:10] AS DATE) IS NOT NULL AND event_id % 26 < 24 AND event_id % 62 < 60 AS valid FROM t""",
)
def timestamp_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times built from the event id, of which many are no times of the calendar."""
    n = F.col("event_id")
    moment = F.format_string("2024-%02d-%02dT%02d:%02d:00Z", n % 14, n % 33, n % 26, n % 62)
    return table(spark, sf_dir, "events").select("event_id", moment.alias("moment"), C.strict_timestamp(moment).isNotNull().alias("valid"))


@query("canonical_json", """SELECT event_id, concat('{"a":[{"x":', event_id, ',"y":"', event_type, '"}],"b":', CAST(json_extract_string(props, '$.k') AS BIGINT), ',"c":null}') AS json FROM events""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys out of order at two levels, and white space."""
    text = F.format_string('{ "c": null, "b": %s, "a": [ {"y": "%s", "x": %d} ] }', F.get_json_object("props", "$.k"), "event_type", "event_id")
    return table(spark, sf_dir, "events").select("event_id", C.canonical_json(text).alias("json"))


@query("priority_dates", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END, CASE WHEN o_orderkey % 2 = 0 THEN DATE '2000-02-29' END) AS day FROM orders")
def priority_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of three candidates that is a day: the order's for every third one, none of the calendar's, a leap day."""
    key = F.col("o_orderkey")
    own = F.when(key % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.priority_date(own, F.lit("2001-02-29"), F.when(key % 2 == 0, "2000-02-29")).alias("day"))


@query("sign_conflicts", "SELECT a.s_suppkey AS a, b.s_suppkey AS b, sign(a.s_acctbal) <> sign(b.s_acctbal) AND (abs(a.s_acctbal) >= 500 OR abs(b.s_acctbal) >= 500) AS differ FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1")
def sign_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's balance against the next one's."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), F.col("s_acctbal").alias("x"))
    following = suppliers.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("x").alias("y"))
    return suppliers.join(following, "a").select("a", "b", C.signs_differ(F.col("x"), F.col("y"), 500).alias("differ"))


@query("neighbour_dots", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    pairs = vectors.join(vectors.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("x").alias("y")), "a")
    return pairwise_dot(pairs, "x", "y").select("a", "b", F.round("dot", 5).alias("dot"))


@query("rows_of_keys", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (1, 4, 7, 10, 999999999)")
def rows_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.rows_of_keys(table(spark, sf_dir, "orders"), "o_custkey", [1, 4, 7, 10, 999999999]).select("o_orderkey", "o_custkey")


@query("request_plan", "SELECT 'player' AS name, CAST(user_id AS VARCHAR) AS id, concat('/api/players/', user_id) AS path FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT 'stats', CAST(user_id AS VARCHAR), concat('/api/players/', user_id, '/stats') FROM (SELECT DISTINCT user_id FROM events)")
def request_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    return readers.request_plan(users, [("player", "/api/players/{id}"), ("stats", "/api/players/{id}/stats")])
