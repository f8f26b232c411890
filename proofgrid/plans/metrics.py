"""Metric queries: entity = nation of the supplier, context = brand of the part, fact = line item, side = line status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.functions.columns import confidence, exact, ratio
from proofgrid.operators import metrics
from proofgrid.operators.order import global_rank, whole_median
from proofgrid.plans.registry import query
from proofgrid.session import table



def measures() -> dict:
    """What the sums of a nation and brand add up."""
    one, accepted, open_ = F.lit(1.0), F.col("l_returnflag") == "A", F.col("l_linestatus") == "O"
    return {
        "rating": F.col("l_quantity") / 25.5, "wins": F.when(accepted, one), "t_rounds": F.when(open_, one), "t_wins": F.when(open_ & accepted, one),
        "ct_rounds": F.when(~open_, one), "ct_wins": F.when(~open_ & accepted, one),
    }


#: The same sums in SQL.
SUMS_SQL = """sums AS (
  SELECT s_nationkey AS nation, p_brand AS brand, count(*) AS rounds,
    CAST(sum(CAST(l_quantity / 25.5 AS DECIMAL(18,4))) AS DOUBLE) AS rating,
    CAST(count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS DOUBLE) AS wins,
    CAST(count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS DOUBLE) AS t_rounds, CAST(count(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 1 END) AS DOUBLE) AS t_wins,
    CAST(count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS DOUBLE) AS ct_rounds, CAST(count(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 1 END) AS DOUBLE) AS ct_wins
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
SUPPLIER_SQL = """perf AS (
  SELECT s_suppkey, s_nationkey, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS quantity,
    CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS discount, CAST(count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS DOUBLE) / count(*) AS accepted, count(*) AS rounds
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with nation and brand; only the columns that measures need are read."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    return items.join(nations, "l_suppkey").join(brands, "l_partkey")


def nation_brand_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sums(facts(spark, sf_dir), ["nation", "brand"], measures())


def ours(spark: SparkSession, sf_dir: str) -> Column:
    """The least nation that has facts, as a scalar subquery over keys only."""
    items, suppliers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    return suppliers.join(items.select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_semi").agg(F.min("s_nationkey")).scalar()


def supplier_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a supplier: means of its line items. Sums are built before the join, by supplier, so the join is small."""
    items = table(spark, sf_dir, "lineitem")
    summed = metrics.sums(items, ["l_suppkey"], {"quantity": "l_quantity", "discount": "l_discount", "accepted": F.when(F.col("l_returnflag") == "A", 1.0)})
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = suppliers.join(summed.withColumnRenamed("l_suppkey", "s_suppkey"), "s_suppkey")
    return joined.select("s_suppkey", "s_nationkey", *[ratio(c, "rounds").alias(c) for c in ("quantity", "discount", "accepted")], "rounds")


@query(
    "ratio_of_sums_rollup",
    """SELECT n_name AS nation, o_orderpriority AS priority, count(*) AS items,
      round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE), 4) AS price_per_unit,
      round(CAST(count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS DOUBLE) / count(*), 6) AS accepted_share,
      round(CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DECIMAL(18,4)) END) AS DOUBLE) / nullif(CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS DECIMAL(18,4)) END) AS DOUBLE), 0), 6) AS returned_to_open
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
)
def ratio_of_sums_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    measures = {"price": "l_extendedprice", "quantity": "l_quantity", "accepted": F.when(F.col("l_returnflag") == "A", 1.0), "returned": F.when(F.col("l_returnflag") == "R", F.col("l_quantity")), "open": F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))}
    # sums of each order first: the joins then carry a row an order, not a row an item
    by_order = metrics.sums(items, ["l_orderkey"], measures).withColumnRenamed("l_orderkey", "o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("priority"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    joined = by_order.join(orders, "o_orderkey").join(customers, "c_custkey").join(nations, "n_nationkey")
    summed = metrics.fold(joined.drop("o_orderkey", "c_custkey", "n_nationkey"), ["nation", "priority"])
    return summed.select(
        "nation", "priority", F.col("rounds").alias("items"), F.round(ratio("price", "quantity"), 4).alias("price_per_unit"),
        F.round(ratio("accepted", "rounds"), 6).alias("accepted_share"), F.round(ratio("returned", "open"), 6).alias("returned_to_open"),
    )


@query(
    "window_recent_vs_all",
    """SELECT l_returnflag AS flag, count(*) AS all_rounds, count(CASE WHEN CAST(l_shipdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' THEN 1 END) AS recent_rounds,
      CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS all_quantity,
      CAST(coalesce(sum(CAST(l_quantity AS DECIMAL(18,4))) FILTER (CAST(l_shipdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'), 0) AS DOUBLE) AS recent_quantity
    FROM lineitem GROUP BY ALL""",
)
def window_recent_vs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag")
    return metrics.windows(items, ["flag"], F.col("l_shipdate").cast("date"), "1998-01-01", "1998-12-31", {"quantity": "l_quantity"})


@query(
    "weighted_mean",
    """SELECT l_suppkey AS supplier, round(CAST(sum(CAST(l_discount * l_quantity AS DECIMAL(18,4))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE), 6) AS mean_discount
    FROM lineitem GROUP BY ALL""",
)
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    summed = metrics.sums(items, ["l_suppkey"], {"weighted": F.col("l_discount") * F.col("l_quantity"), "weight": "l_quantity"})
    return summed.select(F.col("l_suppkey").alias("supplier"), F.round(ratio("weighted", "weight"), 6).alias("mean_discount"))


@query(
    "composite_score",
    """WITH r AS (SELECT l_suppkey AS supplier, count(*) AS n, CAST(sum(l_linenumber) AS DOUBLE) / count(*) AS k, CAST(count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS DOUBLE) / count(*) AS a,
      CAST(count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS DOUBLE) / count(*) AS d, CAST(count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS DOUBLE) / count(*) AS s, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS q FROM lineitem GROUP BY ALL)
    SELECT supplier, n AS rounds, round(0.0073 * (100 * s) + 0.3591 * k - 0.5329 * d + 0.2372 * (2.13 * k + 0.42 * a - 0.41) + 0.0032 * q + 0.1587, 6) AS rating FROM r""",
)
def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda c: F.when(c, 1.0)
    measures = {"k": F.col("l_linenumber"), "a": one(F.col("l_returnflag") == "R"), "d": one(F.col("l_returnflag") == "N"), "s": one(F.col("l_linestatus") == "O"), "q": "l_quantity"}
    summed = metrics.sums(table(spark, sf_dir, "lineitem"), ["l_suppkey"], measures)
    k, a, d, s, q = (ratio(c, "rounds") for c in measures)
    return summed.select(F.col("l_suppkey").alias("supplier"), "rounds", F.round(metrics.composite_score(k, a, d, s, q), 6).alias("rating"))


@query(
    "rollup_sums",
    """SELECT r_name AS region, n_name AS nation, count(*) AS items, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS price,
      round(CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) / count(*), 6) AS mean_discount
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""",
)
def rollup_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_supplier = metrics.sums(table(spark, sf_dir, "lineitem"), ["l_suppkey"], {"price": "l_extendedprice", "discount": "l_discount"}).withColumnRenamed("l_suppkey", "s_suppkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    nations = table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    joined = by_supplier.join(suppliers, "s_suppkey").join(nations, "n_nationkey").join(table(spark, sf_dir, "region"), "r_regionkey")
    rolled = joined.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.sum("rounds").alias("items"), F.sum(exact("price")).cast("double").alias("price"), F.sum(exact("discount")).cast("double").alias("discount"))
    return rolled.select("region", "nation", "items", "price", F.round(ratio("discount", "items"), 6).alias("mean_discount"))


@query(
    "densified_matrix",
    f"""WITH {SUMS_SQL}, n AS (SELECT n_nationkey AS nation FROM nation), b AS (SELECT DISTINCT p_brand AS brand FROM part)
    SELECT nation, brand, coalesce(rounds, 0) AS rounds, coalesce(wins, 0) AS wins, round(wins / nullif(rounds, 0), 6) AS win_rate FROM n CROSS JOIN b LEFT JOIN sums USING (nation, brand)""",
)
def densified_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"))
    full = metrics.densified(nation_brand_sums(spark, sf_dir), nations, brands)
    return full.select("nation", "brand", "rounds", "wins", F.round(ratio("wins", "rounds"), 6).alias("win_rate"))


@query(
    "league_rank",
    f"""WITH {SUPPLIER_SQL}, r AS (SELECT s_suppkey AS supplier, round(quantity, 4) AS quantity FROM perf)
    SELECT supplier, quantity, rank() OVER (ORDER BY quantity DESC) AS rank, count(quantity) OVER () AS "of" FROM r""",
)
def league_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = supplier_table(spark, sf_dir).select(F.col("s_suppkey").alias("supplier"), F.round("quantity", 4).alias("quantity"))
    return global_rank(suppliers, "quantity").select("supplier", "quantity", "rank", "of")


@query(
    "topn_per_group",
    f"""WITH {SUPPLIER_SQL}, r AS (SELECT s_nationkey AS nation, s_suppkey AS supplier, round(accepted, 6) AS accepted, row_number() OVER (PARTITION BY s_nationkey ORDER BY round(accepted, 6) DESC, s_suppkey) AS place FROM perf)
    SELECT * FROM r WHERE place <= 3""",
)
def topn_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = supplier_table(spark, sf_dir).select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("supplier"), F.round("accepted", 6).alias("accepted"))
    return metrics.top_per_group(suppliers, ["nation"], [F.desc("accepted"), F.asc("supplier")], 3)


@query(
    "exclusive_leader",
    f"""WITH {SUPPLIER_SQL}, r AS (SELECT s_nationkey AS nation, s_suppkey AS supplier, round(accepted, 6) AS a, round(discount, 6) AS d FROM perf),
    p AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY a DESC, supplier) AS pa, row_number() OVER (PARTITION BY nation ORDER BY d DESC, supplier) AS pd FROM r)
    SELECT nation, max(CASE WHEN pd = 1 AND pa > 2 THEN supplier END) AS leader FROM p GROUP BY nation""",
)
def exclusive_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = supplier_table(spark, sf_dir).select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("supplier"), F.round("accepted", 6).alias("a"), F.round("discount", 6).alias("d"))
    return metrics.exclusive_leader(suppliers, ["nation"], "supplier", "a", "d")


@query(
    "median_deviation",
    f"""WITH {SUPPLIER_SQL} SELECT s_suppkey AS supplier, s_nationkey AS nation, round(median(quantity) OVER (PARTITION BY s_nationkey), 6) AS middle,
      round(quantity - median(quantity) OVER (PARTITION BY s_nationkey), 6) AS deviation FROM perf""",
)
def median_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.median_deviation(supplier_table(spark, sf_dir), "quantity", ["s_nationkey"])
    return found.select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("nation"), F.round("middle", 6).alias("middle"), F.round("deviation", 6).alias("deviation"))


@query(
    "strengths_and_weaknesses",
    f"""WITH {SUPPLIER_SQL}, d AS (SELECT s_nationkey AS nation, s_suppkey AS supplier, round(quantity - median(quantity) OVER (), 6) AS delta FROM perf),
    r AS (SELECT *, row_number() OVER (PARTITION BY nation, delta > 0 ORDER BY abs(delta) DESC, supplier) AS place FROM d WHERE delta <> 0)
    SELECT nation, supplier, delta, CASE WHEN delta > 0 THEN 'risk' ELSE 'exploit' END AS kind, place FROM r WHERE place <= 3""",
)
def strengths_and_weaknesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = supplier_table(spark, sf_dir)
    middle = whole_median(one, "quantity")  # one row: a scalar beside the table, not a window over all of it
    deltas = one.crossJoin(middle).select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("supplier"), F.round(F.col("quantity") - F.col("middle"), 6).alias("delta")).where("delta <> 0")
    kinds = deltas.withColumn("kind", F.when(F.col("delta") > 0, "risk").otherwise("exploit"))
    return metrics.top_per_group(kinds, ["nation", "kind"], [F.abs("delta").desc(), F.asc("supplier")], 3)


@query(
    "percentile_bands",
    """WITH p AS (SELECT c_nationkey AS nation, c_acctbal AS q, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1 AS p, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
    SELECT nation, max(n) AS n, max(CASE WHEN p = floor(n * 0.2::DOUBLE) THEN q END) AS low, max(CASE WHEN p = floor(n * 0.8::DOUBLE) THEN q END) AS high FROM p WHERE n >= 5 GROUP BY nation""",
)
def percentile_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal")
    return metrics.percentile_bands(customers, "c_acctbal", ["nation"], "c_custkey")


@query(
    "column_extremes",
    f"""WITH {SUPPLIER_SQL}, r AS (SELECT round(quantity, 6) AS quantity, round(discount, 6) AS discount, round(accepted, 6) AS accepted FROM perf),
    u AS (SELECT 'quantity' AS metric, quantity AS v FROM r UNION ALL SELECT 'discount', discount FROM r UNION ALL SELECT 'accepted', accepted FROM r)
    SELECT metric, min(v) AS lowest, max(v) AS highest FROM u GROUP BY metric HAVING count(v) >= 3 AND min(v) <> max(v)""",
)
def column_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["quantity", "discount", "accepted"]
    return metrics.column_extremes(supplier_table(spark, sf_dir).select(*[F.round(c, 6).alias(c) for c in names]), names)


@query(
    "vs_field_delta",
    f"""WITH {SUMS_SQL}, r AS (SELECT nation, brand, wins / rounds AS rate FROM sums)
    SELECT nation, brand, round(rate - (sum(rate) OVER (PARTITION BY brand) - rate) / nullif(count(rate) OVER (PARTITION BY brand) - 1, 0), 6) AS delta FROM r""",
)
def vs_field_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = nation_brand_sums(spark, sf_dir).select("nation", "brand", ratio("wins", "rounds").alias("rate"))
    return metrics.field_delta(rates, "rate", ["brand"]).select("nation", "brand", F.round("delta", 6).alias("delta"))


@query(
    "edge_vs_opponents",
    f"""WITH {SUMS_SQL}, r AS (SELECT nation, brand, wins / rounds AS rate FROM sums)
    SELECT o.brand, o.nation, round(u.rate, 6) AS ours, round(o.rate, 6) AS theirs, round(u.rate - o.rate, 6) AS edge FROM r o JOIN r u ON u.brand = o.brand AND u.nation = (SELECT min(nation) FROM sums) WHERE o.nation <> (SELECT min(nation) FROM sums)""",
)
def edge_vs_opponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = nation_brand_sums(spark, sf_dir).select("nation", "brand", ratio("wins", "rounds").alias("rate"))
    found = metrics.edges(rates, "nation", ours(spark, sf_dir), ["brand"], "rate")
    return found.select("brand", "nation", *[F.round(c, 6).alias(c) for c in ("ours", "theirs", "edge")])


@query(
    "unpivot_metric_edges",
    f"""WITH {SUMS_SQL}, n AS (SELECT nation, sum(rating) / sum(rounds) AS rating, sum(wins) / sum(rounds) AS win, sum(t_wins) / sum(t_rounds) AS t_win, sum(ct_wins) / sum(ct_rounds) AS ct_win FROM sums GROUP BY nation),
    u AS (SELECT nation, 'rating' AS metric, rating AS value FROM n UNION ALL SELECT nation, 'win', win FROM n UNION ALL SELECT nation, 't_win', t_win FROM n UNION ALL SELECT nation, 'ct_win', ct_win FROM n)
    SELECT o.nation, o.metric, round(us.value - o.value, 6) AS edge FROM u o JOIN u us ON us.metric = o.metric AND us.nation = (SELECT min(nation) FROM n) WHERE o.nation <> (SELECT min(nation) FROM n)""",
)
def unpivot_metric_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_nation = metrics.fold(nation_brand_sums(spark, sf_dir), ["nation"])
    rates = by_nation.select("nation", ratio("rating", "rounds").alias("rating"), ratio("wins", "rounds").alias("win"), ratio("t_wins", "t_rounds").alias("t_win"), ratio("ct_wins", "ct_rounds").alias("ct_win"))
    long = metrics.unpivoted(rates, ["nation"], ["rating", "win", "t_win", "ct_win"])
    return metrics.edges(long, "nation", ours(spark, sf_dir), ["metric"], "value").select("nation", "metric", F.round("edge", 6).alias("edge"))


@query(
    "confirmed_lineup",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_linestatus, count(DISTINCT s_nationkey) AS m FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
    r AS (SELECT l_orderkey, l_linenumber, max(m) AS m FROM s GROUP BY ALL)
    SELECT l_orderkey AS match_id, count(*) AS rounds, count(CASE WHEN m >= 2 THEN 1 END) AS "full", CAST(count(CASE WHEN m >= 2 THEN 1 END) AS DOUBLE) / count(*) AS share FROM r GROUP BY 1 HAVING CAST(count(CASE WHEN m >= 2 THEN 1 END) AS DOUBLE) / count(*) >= 0.3""",
)
def confirmed_lineup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data's sides are small, so two members and three tenths of the rounds stand for five and eight tenths."""
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    roster = table(spark, sf_dir, "lineitem").join(nations, "l_suppkey").withColumnRenamed("l_orderkey", "match_id")
    return metrics.confirmed_share(roster, "match_id", "l_linenumber", "l_linestatus", "s_nationkey", least=2, share=0.3)


@query(
    "sample_confidence",
    f"WITH {SUMS_SQL} SELECT nation, brand, rounds, CASE WHEN rounds <= 0 THEN 'none' WHEN rounds < 90 THEN 'low' WHEN rounds >= 110 THEN 'high' ELSE 'medium' END AS confidence FROM sums",
)
def sample_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    summed = metrics.sums(facts(spark, sf_dir), ["nation", "brand"], {})
    return summed.select("nation", "brand", "rounds", confidence(F.col("rounds"), 90, 110).alias("confidence"))


@query(
    "banded_headline",
    f"""WITH {SUPPLIER_SQL}, r AS (SELECT s_suppkey AS supplier, concat_ws(', ', CASE WHEN quantity >= 26 THEN 'large orders' END, CASE WHEN accepted < 0.32 THEN 'few accepted' END, CASE WHEN discount >= 0.05 THEN 'high discounts' END) AS t FROM perf)
    SELECT supplier, concat(upper(t[1:1]), t[2:]) AS headline FROM r""",
)
def banded_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [(F.col("quantity") >= 26, "large orders"), (F.col("accepted") < 0.32, "few accepted"), (F.col("discount") >= 0.05, "high discounts")]
    return supplier_table(spark, sf_dir).select(F.col("s_suppkey").alias("supplier"), metrics.headline(parts).alias("headline"))


@query(
    "coverage_matrix",
    "SELECT s_nationkey AS nation, "
    + ", ".join(f"count(CASE WHEN p_type = '{t}' THEN 1 END) AS \"{t}\"" for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))
    + ", count(*) AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1",
)
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    types = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return metrics.pivot_counts(items.join(nations, "l_suppkey").join(types, "l_partkey"), "nation", "p_type", ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))


@query(
    "weakest_side",
    f"""WITH {SUMS_SQL}, r AS (SELECT nation, brand, t_wins / nullif(t_rounds, 0) AS t, ct_wins / nullif(ct_rounds, 0) AS ct FROM sums),
    p AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY t, brand) AS k FROM r WHERE t IS NOT NULL)
    SELECT nation, brand, round(t, 6) AS rate, round(ct - t, 6) AS gap FROM p WHERE k = 1""",
)
def weakest_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = nation_brand_sums(spark, sf_dir).select("nation", "brand", ratio("t_wins", "t_rounds").alias("t"), ratio("ct_wins", "ct_rounds").alias("ct"))
    found = metrics.weakest_side(rates, "nation", "brand", "ct", "t")
    return found.select("nation", "brand", F.round("rate", 6).alias("rate"), F.round("gap", 6).alias("gap"))


@query(
    "scouting_targets",
    f"""WITH {SUPPLIER_SQL}, r AS (SELECT s_nationkey AS nation, s_suppkey AS supplier, round(quantity, 6) AS q, round(accepted, 6) AS a, round(discount, 6) AS d FROM perf),
    p AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY q DESC, supplier) AS q1, row_number() OVER (PARTITION BY nation ORDER BY a DESC, supplier) AS a1, row_number() OVER (PARTITION BY nation ORDER BY d DESC, supplier) AS d1, row_number() OVER (PARTITION BY nation ORDER BY q, supplier) AS q2, row_number() OVER (PARTITION BY nation ORDER BY a, supplier) AS a2 FROM r)
    SELECT nation, supplier, 'focus' AS kind, 'quantity' AS reason, q1 AS place FROM p WHERE q1 <= 2 UNION ALL SELECT nation, supplier, 'focus', 'accepted', 1 FROM p WHERE a1 = 1 UNION ALL SELECT nation, supplier, 'focus', 'discount', 1 FROM p WHERE d1 = 1
    UNION ALL SELECT nation, supplier, 'soft', 'quantity', 1 FROM p WHERE q2 = 1 UNION ALL SELECT nation, supplier, 'soft', 'accepted', 1 FROM p WHERE a2 = 1""",
)
def scouting_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["quantity", "accepted", "discount"]
    suppliers = supplier_table(spark, sf_dir).select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("supplier"), *[F.round(c, 6).alias(c) for c in names])
    return metrics.targets(suppliers, ["nation"], "supplier", names[0], names[1:])


@query(
    "profile_ratios",
    """WITH s AS (SELECT l_suppkey AS supplier, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS q, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS p, CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) AS d,
      CAST(count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS DOUBLE) AS a, CAST(count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS DOUBLE) AS o, CAST(count(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 1 END) AS DOUBLE) AS oa, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT supplier, round(a / n, 6) AS accepted_share, round(p / q, 6) AS unit_price, round(d / n, 6) AS mean_discount, round(oa / nullif(o, 0), 6) AS open_accepted, round(q / n, 6) AS mean_quantity FROM s""",
)
def profile_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, open_ = F.col("l_returnflag") == "A", F.col("l_linestatus") == "O"
    measures_ = {"q": "l_quantity", "p": "l_extendedprice", "d": "l_discount", "a": F.when(accepted, 1.0), "o": F.when(open_, 1.0), "oa": F.when(open_ & accepted, 1.0)}
    summed = metrics.sums(table(spark, sf_dir, "lineitem"), ["l_suppkey"], measures_).withColumnRenamed("l_suppkey", "supplier")
    return metrics.profile_ratios(summed, "supplier", {"accepted_share": ("a", "rounds"), "unit_price": ("p", "q"), "mean_discount": ("d", "rounds"), "open_accepted": ("oa", "o"), "mean_quantity": ("q", "rounds")})


@query("catalogue", "SELECT p_type AS category, p_partkey AS item, count(*) OVER (PARTITION BY p_type) AS n, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS place FROM part")
def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every category's items in order, and how many they are; rows rather than lists, so that no list grows with the table."""
    parts = table(spark, sf_dir, "part").select(F.col("p_type").alias("category"), F.col("p_partkey").alias("item"))
    counts = parts.groupBy("category").agg(F.count("*").alias("n"))
    placed = metrics.top_per_group(parts, ["category"], [F.asc("item")], 1 << 62)
    return placed.join(counts, "category").select("category", "item", "n", "place")
