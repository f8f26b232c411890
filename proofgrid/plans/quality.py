"""Data-quality queries over the star schema and the event log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofgrid.functions.columns import exact, ratio, strict_date
from proofgrid.operators import quality
from proofgrid.plans.metrics import nation_brand_sums
from proofgrid.plans.registry import query
from proofgrid.session import table


@query("join_inner_fact_dim", "SELECT l_orderkey, l_linenumber, o_orderstatus, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 49")
def join_inner_fact_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").where("l_quantity >= 49")
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return quality.inner_fact_dim(items, orders, "l_orderkey", "l_orderkey", "l_linenumber", "o_orderstatus", "o_custkey")


@query(
    "coalesce_full_outer",
    """WITH i AS (SELECT c_custkey AS k, c_mktsegment AS s FROM customer), d AS (SELECT user_id AS k, max(CASE WHEN event_type = 'purchase' THEN 'buyer' END) AS s FROM events GROUP BY 1)
    SELECT coalesce(i.k, d.k) AS c_custkey, coalesce(d.s, i.s) AS state, d.k IS NOT NULL AS has_detail FROM i FULL JOIN d ON i.k = d.k""",
)
def coalesce_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as the index, all users of the event log as the details; a user without a purchase has a detail without a value."""
    index = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("state"))
    detail = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max(F.when(F.col("event_type") == "purchase", "buyer")).alias("state"))
    return quality.prefer_detail(index, detail, "c_custkey")


@query(
    "recon_full_outer",
    """WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS l_orderkey, a.n AS "left", b.n AS "right", CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'unexpected' ELSE 'different' END AS kind
    FROM a FULL JOIN b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n""",
)
def recon_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    count = lambda s: items.where(F.col("l_linestatus") == s).groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return quality.two_sided_diff(count("O"), count("F"), ["l_orderkey"], "n")


@query(
    "recon_parent_child_counts",
    """SELECT o_orderkey, CAST(o_orderkey % 8 AS BIGINT) AS declared, coalesce(n, 0) AS actual FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey % 8 <> coalesce(n, 0)""",
)
def recon_parent_child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema declares no counts, so the order key's remainder by 8 stands for one."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 8).alias("declared"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return quality.reconciled_counts(orders, items, "o_orderkey", "declared")


@query("fk_orphans", "SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey AS l_ref FROM lineitem WHERE l_partkey + l_suppkey NOT IN (SELECT p_partkey FROM part)")
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All real keys have parents, so a shifted one is checked."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") + F.col("l_suppkey")).alias("l_ref"))
    return quality.orphans(items, table(spark, sf_dir, "part"), "l_ref", "p_partkey").select("l_orderkey", "l_linenumber", "l_ref")


CUSTOMER_COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(
    "profile_table",
    "WITH c AS (SELECT c_custkey, c_name, c_nationkey, nullif(c_acctbal, 0) AS c_acctbal, CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE c_mktsegment END AS c_mktsegment FROM customer) "
    + " UNION ALL ".join(
        f"SELECT 'customer' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(CASE WHEN {c} IS NULL THEN 1 END) AS null_count, count(CASE WHEN trim(CAST({c} AS VARCHAR)) = '' THEN 1 END) AS empty_count, CAST(0 AS BIGINT) AS repeated_keys, CAST(0 AS BIGINT) AS empty_keys, {str(c == 'c_custkey').lower()} AS in_key, 'one row a c_custkey' AS grain FROM c"
        for c in CUSTOMER_COLUMNS
    ),
)
def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances of 0 read as null and every eleventh segment as blank, so that there is something to count."""
    customers = table(spark, sf_dir, "customer").withColumn("c_acctbal", F.expr("nullif(c_acctbal, 0)")).withColumn("c_mktsegment", F.when(F.col("c_custkey") % 11 == 0, " ").otherwise(F.col("c_mktsegment")))
    return quality.profile(customers, "customer", ["c_custkey"])


@query(
    "conditional_counts",
    """SELECT o_orderpriority AS priority, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS open, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS filled, count(CASE WHEN o_totalprice > 250000 THEN 1 END) AS large, count(*) AS orders FROM orders GROUP BY 1""",
)
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderstatus") == "F").alias("filled"), F.count_if(F.col("o_totalprice") > 250000).alias("large"), F.count("*").alias("orders"))


@query("pk_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def pk_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "anomaly_counts",
    """SELECT 'negative_value' AS rule, count(CASE WHEN value < 0 THEN 1 END) AS n FROM events UNION ALL SELECT 'fractional_user', count(CASE WHEN user_id <> floor(user_id) THEN 1 END) FROM events
    UNION ALL SELECT 'future', count(CASE WHEN ts > TIMESTAMP '2024-01-20 00:00:00' THEN 1 END) FROM events UNION ALL SELECT 'large_value', count(CASE WHEN value > 100 THEN 1 END) FROM events
    UNION ALL SELECT 'bad_type', count(CASE WHEN NOT regexp_matches(event_type, '^[a-z]+$') THEN 1 END) FROM events UNION ALL SELECT 'short_user_id', count(CASE WHEN length(CAST(user_id AS VARCHAR)) < 2 THEN 1 END) FROM events
    UNION ALL SELECT 'impossible_k', count(CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) >= 95 THEN 1 END) FROM events""",
)
def anomaly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "negative_value": F.col("value") < 0, "fractional_user": F.col("user_id") != F.floor("user_id"), "future": F.col("ts") > F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"), "large_value": F.col("value") > 100,
        "bad_type": ~F.col("event_type").rlike("^[a-z]+$"), "short_user_id": F.length(F.col("user_id").cast("string")) < 2, "impossible_k": F.get_json_object("props", "$.k").try_cast("bigint") >= 95,
    }
    return quality.rule_counts(table(spark, sf_dir, "events"), rules)


@query("denominator_invariant", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS broken FROM (SELECT DISTINCT s_nationkey, p_brand FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)")
def denominator_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate is null exactly where its denominator is 0."""
    rates = nation_brand_sums(spark, sf_dir).withColumn("rate", ratio("t_wins", "t_rounds"))
    return rates.agg(F.count("*").alias("rows"), F.count_if(F.col("rate").isNull() != (F.col("t_rounds") == 0)).alias("broken"))


@query(
    "quality_summary",
    """WITH c AS (SELECT 'duplicate_keys' AS name, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS n_failed
      UNION ALL SELECT 'orphans', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT 'negative', (SELECT count(*) FROM events WHERE value < 0))
    SELECT count(*) AS checks, count(CASE WHEN n_failed > 0 THEN 1 END) AS failed, CASE WHEN count(CASE WHEN n_failed > 0 THEN 1 END) = 0 THEN 'complete' ELSE 'incomplete' END AS state FROM c""",
)
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders, events = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "events"))
    found = {"duplicate_keys": quality.duplicates(items, ["l_orderkey", "l_linenumber"]), "orphans": quality.orphans(items, orders, "l_orderkey", "o_orderkey"), "negative": events.where("value < 0")}
    checks = [df.agg(F.count("*").alias("n_failed")).select(F.lit(name).alias("check"), "n_failed") for name, df in found.items()]
    return quality.roll_up(reduce(DataFrame.unionByName, checks))


@query(
    "contract_violations",
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN '' ELSE event_type END AS kind, CASE WHEN event_id % 89 = 0 THEN 'x1' ELSE CAST(user_id AS VARCHAR) END AS user_key, CASE WHEN event_id % 83 = 0 THEN NULL ELSE CAST(value AS VARCHAR) END AS amount FROM events)
    SELECT event_id, 'kind' AS rule FROM e WHERE kind = '' UNION ALL SELECT event_id, 'user_key' FROM e WHERE NOT regexp_matches(user_key, '^-?[0-9]+$') UNION ALL SELECT event_id, 'amount' FROM e WHERE amount IS NULL""",
)
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some fields are damaged first, by the event id, as the table itself keeps its contract."""
    id_ = F.col("event_id")
    events = table(spark, sf_dir, "events").select(
        "event_id", F.when(id_ % 97 == 0, "").otherwise(F.col("event_type")).alias("kind"), F.when(id_ % 89 == 0, "x1").otherwise(F.col("user_id").cast("string")).alias("user_key"), F.when(id_ % 83 != 0, F.col("value").cast("string")).alias("amount")
    )
    rules = {"kind": F.col("kind") != "", "user_key": quality.field_rule(events, "user_key", "integer"), "amount": quality.field_rule(events, "amount", "number")}
    return quality.violations(events, "event_id", rules)


@query(
    "date_validity",
    r"""WITH d AS (SELECT event_id, printf('2024-%02d-%02d', event_id % 14, event_id % 33) AS day FROM events)
    SELECT event_id, day, TRY_CAST(day AS DATE) IS NOT NULL AS valid FROM d""",
)
def date_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days built from the event id, of which many are no days of the calendar."""
    day = F.format_string("2024-%02d-%02d", F.col("event_id") % 14, F.col("event_id") % 33)
    return table(spark, sf_dir, "events").select("event_id", day.alias("day"), strict_date(day).isNotNull().alias("valid"))


@query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS valid FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query(
    "json_leaf_audit",
    """WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type, user_id FROM events), l AS (
      SELECT 'props.k' AS path, CAST(k AS VARCHAR) AS value FROM e UNION ALL SELECT 'kind', event_type FROM e UNION ALL SELECT 'seen.0', CAST(user_id AS VARCHAR) FROM e UNION ALL SELECT 'seen.1.a.b', CAST(event_id AS VARCHAR) FROM e
      UNION ALL SELECT 'seen.1.a.c.0', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END FROM e)
    SELECT path, CASE WHEN regexp_full_match(value, '-?[0-9]+') THEN 'integer' WHEN value IN ('true', 'false') THEN 'boolean' ELSE 'string' END AS type, count(*) AS n, CAST(sum(TRY_CAST(value AS BIGINT)) AS BIGINT) AS total FROM l GROUP BY ALL""",
)
def json_leaf_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event wrapped in a document five levels deep, lists among them; all leaves are counted and their numbers added up."""
    inner = F.format_string('{"kind": "%s", "props": %s, "seen": [%d, {"a": {"b": %d, "c": [%s], "d": {}}}]}', "event_type", "props", "user_id", "event_id", F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"))
    leaves = quality.json_leaves(table(spark, sf_dir, "events").select("event_id", inner.alias("j")), "event_id", "j")
    return leaves.groupBy("path", "type").agg(F.count("*").alias("n"), F.sum(F.col("value").try_cast("bigint")).alias("total"))


TYPED_SQL = """d AS (SELECT event_id, concat('{"user": "', user_id, '", "n": ', event_id, ', "x": ', event_id, '.5, "like": "[1, 2]", "none": null, "own": ', props, ', "list": [', event_id % 2 = 0, ', "true", {"id": ', user_id, '}, []], "text": "a\\u0041"}') AS j FROM events),
t AS (SELECT replace(replace(replace(fullkey, '$.', ''), '$', ''), '[', '.') AS path, type, CASE WHEN type IN ('OBJECT', 'ARRAY', 'NULL') THEN NULL ELSE json_extract_string(atom, '$') END AS value FROM d, json_tree(j))"""


@query(
    "json_typed_nodes",
    f"""WITH {TYPED_SQL} SELECT replace(path, ']', '') AS path, CASE type WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' ELSE lower(type) END AS type,
    count(*) AS n, count(DISTINCT value) AS n_values, min(value) AS least FROM t GROUP BY ALL""",
)
def json_typed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a document an event by path and by the type that is written: numbers and lists within strings are strings."""
    even = F.when(F.col("event_id") % 2 == 0, "true").otherwise("false")
    text = F.format_string('{"user": "%d", "n": %d, "x": %d.5, "like": "[1, 2]", "none": null, "own": %s, "list": [%s, "true", {"id": %d}, []], "text": "a\\u0041"}', "user_id", "event_id", "event_id", "props", even, "user_id")
    nodes = quality.json_nodes(table(spark, sf_dir, "events").select("event_id", text.alias("j")), "event_id", "j")
    return nodes.groupBy("path", "type").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"), F.min("value").alias("least"))


@query(
    "json_assertions",
    """WITH e AS (SELECT event_id, value FROM events) SELECT event_id, 5 AS fullness, CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS not_finite, CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS bad_ids FROM e""",
)
def json_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of two members, one a list of two items: five nodes besides the root's braces; some numbers overflow and some ids are short."""
    number = F.when(F.col("event_id") % 13 == 0, "1e999").otherwise(F.col("event_id").cast("string"))
    id_ = F.when(F.col("event_id") % 17 == 0, "123").otherwise("76561198000000001")
    json = F.format_string('{"list": [%s, 2], "steamid": "%s"}', number, id_)
    return quality.json_assertions(table(spark, sf_dir, "events").select("event_id", json.alias("j")), "event_id", "j", ids="steamid", form="[0-9]{17}")


@query(
    "aggregate_reconciliation",
    """WITH i AS (SELECT o_orderkey, CAST(o_orderkey % 8 AS DOUBLE) AS n_items, floor(o_totalprice) AS price FROM orders),
    d AS (SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n_items, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS price FROM lineitem GROUP BY 1)
    SELECT o_orderkey, 'n_items' AS field, i.n_items AS declared, coalesce(d.n_items, 0) AS actual FROM i LEFT JOIN d ON l_orderkey = o_orderkey WHERE i.n_items <> coalesce(d.n_items, 0)
    UNION ALL SELECT o_orderkey, 'price', i.price, coalesce(d.price, 0) FROM i LEFT JOIN d ON l_orderkey = o_orderkey WHERE i.price <> coalesce(d.price, 0)""",
)
def aggregate_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 8).alias("n_items"), F.floor("o_totalprice").alias("price"))
    detail = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return quality.aggregate_mismatches(index, detail, "o_orderkey", {"n_items": F.count("*"), "price": F.sum(exact("l_extendedprice"))})


@query(
    "page_overlap_check",
    """WITH p AS (SELECT l_suppkey AS series, l_linenumber AS page, list_sort(list_distinct(list(l_partkey))) AS ids FROM lineitem GROUP BY ALL),
    w AS (SELECT *, lag(page) OVER o AS was, lag(ids) OVER o AS had FROM p WINDOW o AS (PARTITION BY series ORDER BY page))
    SELECT series, page, CASE WHEN was IS NOT NULL THEN page <> was + 1 END AS gap, CAST(CASE WHEN was IS NOT NULL THEN len(list_intersect(ids, had)) END AS INTEGER) AS overlap FROM w""",
)
def page_overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's parts by line number stand for pages of a list."""
    pages = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("series"), F.col("l_linenumber").alias("page")).agg(F.collect_set("l_partkey").alias("ids")).withColumn("limit", F.lit(2))
    return quality.page_overlap(pages, ["series"], "page", "ids", "limit").select("series", "page", "gap", "overlap")


@query(
    "boundary_stability",
    """WITH o AS (SELECT user_id, 'start' AS role, min(event_id) AS moment, arg_min(event_type, event_id) AS d FROM events GROUP BY 1 UNION ALL SELECT user_id, 'end', max(event_id), arg_max(event_type, event_id) FROM events GROUP BY 1)
    SELECT user_id, count(CASE WHEN role = 'start' THEN 1 END) = 1 AND count(CASE WHEN role = 'end' THEN 1 END) = 1 AND coalesce(max(CASE WHEN role = 'start' THEN moment END) <= min(CASE WHEN role = 'end' THEN moment END), false) AND min(d) = max(d) AS stable FROM o GROUP BY user_id""",
)
def boundary_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's first and last event as the observations at start and end; stable if both are of one type."""
    ends = table(spark, sf_dir, "events").groupBy("user_id").agg(*[f("event_type", "event_id").alias(f"{r}_type") for r, f in (("start", F.min_by), ("end", F.max_by))], F.min("event_id").alias("start"), F.max("event_id").alias("end"))
    observed = ends.select("user_id", F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("event_id"), F.col(f"{r}_type").alias("event_type")) for r in ("start", "end")])))
    return quality.boundary_stability(observed, ["user_id"], "role", "event_id", "event_type")


@query("union_cardinality", "SELECT count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation)")
def union_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [table(spark, sf_dir, t).select(F.col(c).alias("k")).distinct() for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))]
    return reduce(DataFrame.union, keys).distinct().agg(F.count("*").alias("n"))


@query("discover_union", "SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal < 0 UNION ALL SELECT user_id FROM events)")
def discover_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "events").select(F.col("user_id").alias("k"))]
    return reduce(DataFrame.union, parts).distinct()


@query("set_difference", "SELECT c_custkey AS k, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) UNION ALL SELECT DISTINCT user_id, 'unexpected' FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders, suppliers, events = (table(spark, sf_dir, t) for t in ("customer", "orders", "supplier", "events"))
    large = orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("k"))
    missing = customers.select(F.col("c_custkey").alias("k")).join(large, "k", "left_anti").withColumn("side", F.lit("missing"))
    extra = events.select(F.col("user_id").alias("k")).distinct().join(suppliers.select(F.col("s_suppkey").alias("k")), "k", "left_anti").withColumn("side", F.lit("unexpected"))
    return missing.unionByName(extra)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.union, [table(spark, sf_dir, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n")) for t in TABLES])


@query("date_range", "SELECT o_orderstatus AS status, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_key FROM orders GROUP BY 1")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"), F.min_by("o_orderkey", at).alias("first_key"), F.max_by("o_orderkey", at).alias("last_key"))


@query(
    "dedup_prefer_fullest",
    "SELECT doc_id, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY length(text) DESC, doc_id) AS k FROM documents) WHERE k = 1",
)
def dedup_prefer_fullest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    return quality.prefer_fullest(docs, ["lang", "source"], "text", "doc_id").select("doc_id", "lang", "source", "n_chars")


@query(
    "source_priority_pick",
    "SELECT lang, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY CAST(substr(source, 4) AS INTEGER) DESC, n_chars DESC, lpad(CAST(doc_id AS VARCHAR), 20, '0')) AS k FROM documents) WHERE k = 1",
)
def source_priority_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "source", "n_chars", F.substring("source", 4, 9).cast("int").alias("priority"), F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("canonical"))
    return quality.pick_by_priority(docs, ["lang"], "priority", F.col("n_chars"), "canonical").select("lang", "doc_id", "source")


@query("deterministic_sample", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY sha256(concat('s1:', o_orderkey)), o_orderkey LIMIT 50")
def deterministic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.hash_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 50, "s1:")


@query(
    "stratified_sample",
    """WITH h AS (SELECT o_orderkey, o_orderpriority, sha256(concat('s1:', o_orderkey)) AS h FROM orders), m AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) = 1 AS mandatory FROM h)
    SELECT o_orderkey, o_orderpriority, mandatory FROM m ORDER BY mandatory DESC, h, o_orderkey LIMIT 60""",
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.stratified_sample(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority", 60, "s1:")


#: Tables of the dataset fingerprint with their columns in order of name.
FINGERPRINTED = {
    "customer": ("c_custkey", "c_mktsegment", "c_name", "c_nationkey"), "events": ("event_id", "event_type", "user_id"), "nation": ("n_name", "n_nationkey", "n_regionkey"),
    "orders": ("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"), "part": ("p_brand", "p_partkey", "p_type"), "region": ("r_name", "r_regionkey"), "supplier": ("s_nationkey", "s_suppkey"),
}


def _json_sql(columns: tuple[str, ...]) -> str:
    texts = {"c_mktsegment", "c_name", "event_type", "n_name", "o_orderpriority", "o_orderstatus", "p_brand", "p_type", "r_name"}
    return " || ',' || ".join(f"'\"{c}\":' || " + (f"to_json({c})" if c in texts else c) for c in columns)


@query(
    "table_fingerprint",
    "WITH h AS (" + " UNION ALL ".join(f"SELECT '{t}' AS t, sha256('{{' || {_json_sql(c)} || '}}') AS h FROM {t}" for t, c in FINGERPRINTED.items()) + """), l AS (SELECT t, h[1:4] AS p, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n FROM h GROUP BY ALL),
    l3 AS (SELECT t, p[1:3] AS p, sha256(string_agg(d, '' ORDER BY p)) AS d, sum(n) AS n FROM l GROUP BY ALL), l2 AS (SELECT t, l3.p[1:2] AS p, sha256(string_agg(d, '' ORDER BY p)) AS d, sum(n) AS n FROM l3 GROUP BY ALL),
    l1 AS (SELECT t, l2.p[1:1] AS p, sha256(string_agg(d, '' ORDER BY p)) AS d, sum(n) AS n FROM l2 GROUP BY ALL), one AS (SELECT t, sha256(string_agg(d, '' ORDER BY p)) AS d, sum(n) AS n FROM l1 GROUP BY t)
    SELECT t AS table_name, CAST(n AS BIGINT) AS n, d AS digest FROM one UNION ALL SELECT '*', CAST(sum(n) AS BIGINT), sha256(string_agg(t || ':' || d, '' ORDER BY t)) FROM one""",
)
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table of the dataset and the dataset as a whole, at a depth of four digits, which leaves about a thousand hashes a list up to 65 million rows."""
    parts = [quality.fingerprint(table(spark, sf_dir, t), list(c), t, depth=4) for t, c in FINGERPRINTED.items()]
    return quality.dataset_fingerprint(parts)


@query(
    "ignored_filters",
    """WITH r AS (SELECT user_id % 7 AS base, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS filter, CAST(value AS INTEGER) % 5 AS digest FROM events),
    p AS (SELECT DISTINCT base, digest FROM r WHERE filter IS NULL) SELECT base, filter, count(*) AS n FROM r JOIN p USING (base, digest) WHERE filter IS NOT NULL GROUP BY ALL""",
)
def ignored_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("base"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("filter"), (F.rint("value").cast("int") % 5).alias("digest"))
    return quality.ignored_filters(responses, "base", "filter", "digest").groupBy("base", "filter").agg(F.count("*").alias("n"))


@query(
    "last_order_rank",
    "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1",
)
def last_order_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(order).alias("k")).where("k = 1").drop("k")


@query("set_equality", "SELECT (SELECT count(*) FROM (SELECT DISTINCT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)) AS missing, (SELECT count(*) FROM (SELECT DISTINCT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer)) AS unexpected, (SELECT count(*) FROM (SELECT DISTINCT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)) + (SELECT count(*) FROM (SELECT DISTINCT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer)) = 0 AS equal")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return quality.set_difference_counts(a, b, ["k"])


@query(
    "malformed_ids",
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN CAST(user_id AS VARCHAR) ELSE concat('"', lpad(CAST(user_id AS VARCHAR), CASE WHEN event_id % 7 = 0 THEN 16 ELSE 17 END, '7'), '"') END AS value FROM events) SELECT event_id, value FROM e WHERE NOT regexp_full_match(value, '"[0-9]{17}"')""",
)
def malformed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids built from the user id: every fifth a number, every seventh a digit short."""
    value = F.when(F.col("event_id") % 5 == 0, F.col("user_id").cast("string")).otherwise(F.concat(F.lit('"'), F.call_function("lpad", F.col("user_id").cast("string"), F.when(F.col("event_id") % 7 == 0, 16).otherwise(17), F.lit("7")), F.lit('"')))
    json = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"a": {"steamid": '), value, F.lit("}}"))).otherwise(F.concat(F.lit('{"ctSteamids": ['), value, F.lit("]}")))
    return quality.malformed_ids(table(spark, sf_dir, "events").select("event_id", json.alias("j")), "event_id", "j", name="[A-Za-z]*[sS]teamids?", form="[0-9]{17}")


@query("payload_merge", "SELECT event_id, event_type AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def payload_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), F.concat(F.lit('{"kind": "lost", "n": [1], '), F.substring("props", 2, 1000)).alias("props"))
    return quality.merged_payload(events, "props", "kind string, k bigint, n array<int>", drop=["n"])


@query(
    "audit_sample",
    """WITH h AS (SELECT o_orderkey, o_orderpriority, o_orderdate, sha256(concat('a1:', o_orderkey)) AS h FROM orders), f AS (SELECT arg_min(o_orderkey, (h, o_orderkey)) AS k FROM h GROUP BY o_orderpriority),
    e AS (SELECT arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM h UNION SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) FROM h UNION SELECT arg_min(o_orderkey, (CAST(o_orderkey AS VARCHAR), o_orderkey)) FROM h UNION SELECT arg_max(o_orderkey, (CAST(o_orderkey AS VARCHAR), o_orderkey)) FROM h UNION SELECT k FROM f)
    SELECT o_orderkey, o_orderpriority, o_orderkey IN (SELECT k FROM e) AS mandatory FROM h QUALIFY row_number() OVER (ORDER BY o_orderkey IN (SELECT k FROM e) DESC, h, o_orderkey) <= (SELECT greatest(30, ceil(count(*) * 0.01)) FROM orders)""",
)
def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One in a hundred orders, with each priority's first by hash and the ends by date and by key."""
    return quality.audit_sample(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority", "o_orderdate", "a1:")


@query(
    "first_known",
    """WITH e AS (SELECT user_id, event_id, CASE WHEN event_type <> 'view' THEN event_type END AS kind, CASE WHEN value >= 100 THEN value END AS large FROM events)
    SELECT user_id, arg_min(kind, event_id) FILTER (kind IS NOT NULL) AS kind, arg_min(large, event_id) FILTER (large IS NOT NULL) AS large FROM e GROUP BY 1""",
)
def first_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user the first kind of event that is no view, and the first large value."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"), F.when(F.col("value") >= 100, F.col("value")).alias("large"))
    return quality.first_known(events, ["user_id"], ["kind", "large"], [F.col("event_id")])


@query(
    "base_health",
    """WITH d AS (SELECT concat('c', c_custkey) AS node, CASE WHEN c_custkey % 20 = 0 THEN ' ' ELSE c_name END AS title, CASE WHEN c_custkey % 3 <> 0 THEN DATE '2024-01-01' + CAST(c_custkey % 200 AS INTEGER) END AS day FROM customer),
    l AS (SELECT concat('c', o_custkey) AS src, concat('c', o_custkey * 2) AS dst FROM orders), i AS (SELECT * FROM l WHERE src <> dst AND dst IN (SELECT node FROM d))
    SELECT 'missing-field' AS rule, count(CASE WHEN trim(title) = '' THEN 1 END) + count(CASE WHEN day IS NULL THEN 1 END) AS n FROM d UNION ALL SELECT 'broken-link', count(*) FROM l WHERE dst NOT IN (SELECT node FROM d) UNION ALL SELECT 'ghost', count(DISTINCT dst) FROM l WHERE dst NOT IN (SELECT node FROM d)
    UNION ALL SELECT 'orphan', count(*) FROM d WHERE node NOT IN (SELECT src FROM i UNION SELECT dst FROM i) UNION ALL SELECT 'stale', count(*) FROM d WHERE date_diff('day', day, DATE '2024-07-01') >= 90""",
)
def base_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, each order a link from its customer to the one of twice the number."""
    key = F.col("c_custkey")
    docs = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), key).alias("node"), F.when(key % 20 == 0, " ").otherwise(F.col("c_name")).alias("title"), F.when(key % 3 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (key % 200).cast("int"))).alias("day"))
    links = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("c"), F.col("o_custkey") * 2).alias("dst"))
    return quality.base_health(docs, links, ["title", "day"], "day", "2024-07-01")
