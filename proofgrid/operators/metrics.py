"""Metrics that roll up: sums first, ratios of sums last; ranks, medians, bands and gaps over the results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.functions.columns import ratio, total


def sums(facts: DataFrame, keys: Sequence[str], measures: dict[str, Column | str], rounds: str = "rounds") -> DataFrame:
    """One row for each value of the keys: the number of facts and the sum of each measure, missing ones as 0.

    Partial sums are built before the shuffle, so what travels is a row for each key and task.
    """
    return facts.groupBy(*keys).agg(F.count("*").alias(rounds), *[total(c).alias(name) for name, c in measures.items()])


def fold(summed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds rows of sums to coarser keys; every column that is no key must be a sum."""
    return summed.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in summed.columns if c not in keys and dict(summed.dtypes)[c] in ("bigint", "double")])


def windows(facts: DataFrame, keys: Sequence[str], day: Column, first: str, last: str, measures: dict[str, Column | str]) -> DataFrame:
    """Sums over all facts and over those of days from first to last, both inclusive, in one pass: columns all_* and recent_*."""
    recent = day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    columns = [F.count("*").alias("all_rounds"), F.count_if(recent).alias("recent_rounds")]
    for name, c in measures.items():
        c = F.col(c) if isinstance(c, str) else c
        columns += [total(c).alias(f"all_{name}"), total(F.when(recent, c)).alias(f"recent_{name}")]
    return facts.groupBy(*keys).agg(*columns)


def composite_score(kills: Column, assists: Column, deaths: Column, kast: Column, damage: Column) -> Column:
    """Rating of per-round rates; kast is a share of 0 to 1."""
    impact = 2.13 * kills + 0.42 * assists - 0.41
    return 0.0073 * (100 * kast) + 0.3591 * kills - 0.5329 * deaths + 0.2372 * impact + 0.0032 * damage + 0.1587


def densified(summed: DataFrame, entities: DataFrame, contexts: DataFrame) -> DataFrame:
    """Every pair of an entity and a context, with zeros where there are no facts.

    The two lists are dimensions; the pairs are the result itself, so their product is no detour.
    """
    keys = [*entities.columns, *contexts.columns]
    numbers = [c for c in summed.columns if c not in keys]
    return entities.distinct().crossJoin(contexts.distinct()).join(summed, keys, "left").fillna(0, numbers)


def top_per_group(table: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group in an order that the caller makes total; adds place (from 1)."""
    return table.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col("place") <= n)


def exclusive_leader(table: DataFrame, group: Sequence[str], key: str, first: str, second: str, n: int = 2) -> DataFrame:
    """For each group the leader by `second`, or null where it is already among the first n by `first`; ties by key."""
    leads = table.groupBy(*group).agg(F.max_by(F.col(key), F.struct(F.col(second), -F.col(key))).alias("leader"))
    top = top_per_group(table, group, [F.desc_nulls_last(first), F.asc(key)], n).select(*group, F.col(key).alias("leader"), F.lit(True).alias("taken"))
    return leads.join(top, [*group, "leader"], "left").select(*group, F.when(F.col("taken").isNull(), F.col("leader")).alias("leader"))


def median_deviation(table: DataFrame, metric: str, within: Sequence[str]) -> DataFrame:
    """Adds middle (the exact median of the group, nulls left out) and deviation from it."""
    whole = Window.partitionBy(*within)
    return table.withColumn("middle", F.median(metric).over(whole)).withColumn("deviation", F.col(metric) - F.col("middle"))


def percentile_bands(table: DataFrame, metric: str, within: Sequence[str], key: str, low: float = 0.2, high: float = 0.8, least: int = 5) -> DataFrame:
    """For each group of `least` values or more: the values at sorted positions floor(n * low) and floor(n * high), from 0."""
    whole = Window.partitionBy(*within)
    placed = table.where(F.col(metric).isNotNull()).withColumns({"_at": F.row_number().over(whole.orderBy(metric, key)) - 1, "_n": F.count("*").over(whole)})
    at = lambda share: F.max(F.when(F.col("_at") == F.floor(F.col("_n") * share), F.col(metric)))
    return placed.where(F.col("_n") >= least).groupBy(*within).agg(F.max("_n").alias("n"), at(low).alias("low"), at(high).alias("high"))


def column_extremes(table: DataFrame, metrics: Sequence[str], least: int = 3) -> DataFrame:
    """metric, lowest, highest for each column with `least` values or more that are not all equal; one pass over the table."""
    one = table.agg(*[f(m).alias(f"{m}_{name}") for m in metrics for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max))])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_n").alias("n"), F.col(f"{m}_lo").cast("double").alias("lowest"), F.col(f"{m}_hi").cast("double").alias("highest")) for m in metrics])
    return one.select(F.inline(rows)).where((F.col("n") >= least) & (F.col("highest") != F.col("lowest"))).drop("n")


def field_delta(table: DataFrame, metric: str, context: Sequence[str]) -> DataFrame:
    """Adds delta: own value minus the mean of all the others' in the same context; null with no others."""
    whole = Window.partitionBy(*context)
    others = ratio(F.sum(metric).over(whole) - F.col(metric), F.count(metric).over(whole) - 1)
    return table.withColumn("delta", F.when(F.col(metric).isNotNull(), F.col(metric) - others))


def edges(table: DataFrame, entity: str, ours, context: Sequence[str], metric: str) -> DataFrame:
    """Our value minus each other entity's, in each context where both have a row; one entity's rows are a dimension of the contexts."""
    us = table.where(F.col(entity) == ours).select(*context, F.col(metric).alias("ours"))
    return table.where(F.col(entity) != ours).join(us, list(context)).select(*context, entity, "ours", F.col(metric).alias("theirs"), (F.col("ours") - F.col(metric)).alias("edge"))


def unpivoted(table: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """keys, metric, value: a row for each metric that is not null."""
    return table.unpivot(list(keys), list(metrics), "metric", "value").where(F.col("value").isNotNull())


def confirmed_share(roster: DataFrame, match: str, round_: str, side: str, member: str, least: int = 5, share: float = 0.8) -> DataFrame:
    """Matches in which the larger side has `least` distinct members or more in at least `share` of the rounds.

    Distinct members of a side, then the larger side of a round, then the share of a match: each step has far fewer rows.
    """
    sides = roster.groupBy(match, round_, side).agg(F.countDistinct(member).alias("members"))
    rounds = sides.groupBy(match, round_).agg(F.max("members").alias("members"))
    shares = rounds.groupBy(match).agg(F.count("*").alias("rounds"), F.count_if(F.col("members") >= least).alias("full"))
    return shares.withColumn("share", ratio("full", "rounds")).where(F.col("share") >= share)


def pivot_counts(facts: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts of each row key by the stated column values, and `total`; no facts are 0. The values are given, so no extra job finds them."""
    counts = [F.count_if(F.col(column).eqNullSafe(v)).alias(str(v)) for v in values]
    return facts.groupBy(row).agg(*counts, F.count("*").alias("total"))


def weakest_side(table: DataFrame, entity: str, context: str, first: str, second: str) -> DataFrame:
    """For each entity the context with the least rate of the second side (ties: least name), and the gap of the sides there."""
    seen = table.where(F.col(second).isNotNull())
    row = F.min_by(F.struct(F.col(context).alias("c"), F.col(first).alias("f"), F.col(second).alias("s")), F.struct(F.col(second), F.col(context)))
    return seen.groupBy(entity).agg(row.alias("w")).select(entity, F.col("w.c").alias(context), F.col("w.s").alias("rate"), (F.col("w.f") - F.col("w.s")).alias("gap"))


def headline(parts: Sequence[tuple[Column, str]]) -> Column:
    """The texts of all conditions that hold, comma-joined, with a capital first letter; empty if none does."""
    joined = F.concat_ws(", ", *[F.when(condition, F.lit(text)) for condition, text in parts])
    return F.concat(F.upper(F.substring(joined, 1, 1)), F.substring(joined, 2, 1 << 20))


def mean_across(ranking: DataFrame, context: str, score: str = "score") -> DataFrame:
    """context, mean (over the opponents that have a score), place: the best mean first, contexts without any score last, ties by name.

    A row a context, so the places are of a short list.
    """
    means = ranking.groupBy(context).agg(F.round(F.avg(score), 6).alias("mean"))
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("mean"), context)).cast("long"))


def targets(table: DataFrame, group: Sequence[str], key: str, main: str, others: Sequence[str]) -> DataFrame:
    """group, key, kind (focus or soft), reason, place: whom an opponent would aim at.

    Focus: the two best by `main` and the best by each of the others; soft: the last by `main` and by the first of the others. One member
    may be named for several reasons. Ties by key.
    """
    picks = [("focus", main, 2, False), *[("focus", m, 1, False) for m in others], ("soft", main, 1, True), *[("soft", m, 1, True) for m in others[:1]]]
    placed = table
    for m in (main, *others):
        for last, order in ((False, F.desc_nulls_last(m)), (True, F.asc_nulls_last(m))):
            placed = placed.withColumn(f"_{m}_{last}", F.row_number().over(Window.partitionBy(*group).orderBy(order, F.asc(key))))
    rows = F.array_compact(F.array(*[F.when(F.col(f"_{m}_{last}") <= n, F.struct(F.lit(kind).alias("kind"), F.lit(m).alias("reason"), F.col(f"_{m}_{last}").cast("long").alias("place"))) for kind, m, n, last in picks]))
    return placed.select(*group, key, F.inline(rows))


def profile_ratios(df: DataFrame, key: str, parts: dict[str, tuple[str, str]], digits: int = 6) -> DataFrame:
    """key and a null-safe ratio of two columns for each name."""
    return df.select(key, *[F.round(ratio(n, d), digits).alias(name) for name, (n, d) in parts.items()])
