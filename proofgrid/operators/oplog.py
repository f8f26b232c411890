"""Aggregates of append-only logs: weekly rates, summaries by kind, top entries, runs and their cost, tails and ends by time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.functions.columns import half_up, iso_week, ratio


def weekly(log: DataFrame, at: str, kind: str, timing: str, passed: Column, empty: Column) -> DataFrame:
    """week, kind, n, pass_rate, empty_rate (three decimals, half up), mean_timing; rates are null where nothing was judged."""
    rows = log.select(iso_week(F.col(at).cast("date")).alias("week"), F.col(kind).alias("kind"), F.col(timing).cast("decimal(18,4)").alias("t"), passed.alias("p"), empty.alias("e"))
    found = rows.groupBy("week", "kind").agg(F.count("*").alias("n"), F.count("p").alias("judged"), F.count_if("p").alias("passed"), F.count("e").alias("searched"), F.count_if("e").alias("empty"), F.sum("t").cast("double").alias("t"), F.count("t").alias("timed"))
    return found.select("week", "kind", "n", half_up(ratio("passed", "judged"), 3).alias("pass_rate"), half_up(ratio("empty", "searched"), 3).alias("empty_rate"), F.round(ratio("t", "timed"), 9).alias("mean_timing"))


def kind_summary(log: DataFrame, kind: str, timing: str) -> DataFrame:
    """kind, n, mean_timing over rows that have one."""
    found = log.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.col(timing).cast("decimal(18,4)")).cast("double").alias("t"), F.count(timing).alias("timed"))
    return found.select("kind", "n", F.round(ratio("t", "timed"), 9).alias("mean_timing"))


def top_values(log: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The k most frequent values with their counts, ties by value: a top-k report."""
    return log.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(k)


def last_per_entity(log: DataFrame, entity: str, at: str, key: str, n: int = 20) -> DataFrame:
    """The n latest rows of each entity, ties by key, with their place from the latest."""
    order = Window.partitionBy(entity).orderBy(F.desc(at), F.desc(key))
    return log.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= n)


def ends_by(log: DataFrame, entity: str, at: str, key: str, value: str) -> DataFrame:
    """entity, first, last: the values of its earliest and latest row (ties: least and greatest key). One aggregation."""
    order = F.struct(at, key)
    return log.groupBy(entity).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))


def prefix_counts(log: DataFrame, entity: str, column: str, prefixes: Sequence[str]) -> DataFrame:
    return log.groupBy(entity).agg(*[F.count_if(F.col(column).startswith(p)).alias(f"{p}_n") for p in prefixes])


def next_or_last(log: DataFrame, entity: str, at: str, key: str, now: str) -> DataFrame:
    """entity, chosen, at: the earliest row at or after `now`, or the latest of all where there is none."""
    when, order = F.lit(now).cast("timestamp_ntz"), F.struct(at, key)
    ahead = F.col(at) >= when
    found = log.groupBy(entity).agg(F.min_by(F.struct(key, at), F.when(ahead, order)).alias("n"), F.max_by(F.struct(key, at), order).alias("l"))
    chosen = F.coalesce("n", "l")
    return found.select(entity, chosen[key].alias("chosen"), chosen[at].alias("at"))


def run_summary(traces: DataFrame, by: str) -> DataFrame:
    """A row for each value of `by` and one for all (null): total, passed, failed, errored, pass_rate (0 for none), tokens."""
    counts = traces.rollup(by).agg(F.count("*").alias("total"), F.count_if(F.col("passed") & F.col("error").isNull()).alias("passed"), F.count_if(~F.col("passed") & F.col("error").isNull()).alias("failed"), F.count("error").alias("errored"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"))
    return counts.select(by, "total", "passed", "failed", "errored", F.round(F.coalesce(ratio("passed", "total"), F.lit(0.0)), 6).alias("pass_rate"), "tokens_in", "tokens_out")


def token_cost(traces: DataFrame, prices: DataFrame, model: str) -> DataFrame:
    """Adds cost: tokens times the price per million of the longest price name that the model's name holds; null if none does.

    prices (name, price_in, price_out) is a price list: a few rows, so it becomes one map literal beside each row.
    """
    rows = sorted(((r.name, r.price_in, r.price_out) for r in prices.limit(1001).collect()), key=lambda r: (-len(r[0]), r[0]))
    if len(rows) > 1000:
        raise ValueError("a price list of more than 1000 names")
    cost = F.lit(None).cast("double")
    for name, price_in, price_out in reversed(rows):
        value = F.col("tokens_in") / 1e6 * price_in + F.col("tokens_out") / 1e6 * price_out
        cost = F.when(F.contains(F.col(model), F.lit(name)), value).otherwise(cost)
    return traces.withColumn("cost", cost)


def monthly_cost(traces: DataFrame, at: str) -> DataFrame:
    """month (YYYY-MM), runs, cost."""
    return traces.groupBy(F.date_format(at, "yyyy-MM").alias("month")).agg(F.count("*").alias("runs"), F.round(F.sum(F.col("cost").cast("decimal(24,9)")).cast("double"), 6).alias("cost"))


def reflect_candidates(traces: DataFrame, skill: str, least: int = 5) -> DataFrame:
    """Skills with `least` cases or more, not all of which passed."""
    return traces.groupBy(skill).agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed")).where((F.col("cases") >= least) & (F.col("passed") < F.col("cases")))


def size_guard(changes: DataFrame, old: str, new: str, most: float = 30.0, empty: float = 0.0) -> DataFrame:
    """Adds removed_percent (half up) and warn where more than `most` percent of the old size is gone.

    `empty` is the percentage where the old size is 0; NaN, no percentage at all, counts as more than any. Without an old size both are null.
    """
    removed = half_up(ratio(F.greatest(F.col(old) - F.col(new), F.lit(0)), F.col(old)) * 100)
    return changes.withColumn("removed_percent", F.when(F.col(old) == 0, F.lit(float(empty))).otherwise(removed)).withColumn("warn", F.col("removed_percent") > most)
