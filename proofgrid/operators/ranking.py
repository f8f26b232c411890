"""Sample-size shrinkage, signal edges, scores in bands, and pick and ban verdicts with their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.functions.columns import ratio, shrink

PRIOR = 250
#: Noise floors of the three signals, and their weights in a score.
FLOORS = {"rating": 0.03, "win": 0.05, "side": 0.05}
WEIGHTS = {"rating": 0.5, "win": 0.3, "side": 0.2}
PICK, BAN = 1.0, -1.0


def side_rate(wins: Column, rounds: Column, overall: Column, prior: float = PRIOR) -> Column:
    return shrink(F.coalesce(ratio(wins, rounds), F.lit(0.0)), rounds, overall, prior)


def adjusted(summed: DataFrame, entity: str, context: str, prior: float = PRIOR) -> DataFrame:
    """Shrinks each (entity, context) row towards its entity's own rates over all contexts.

    Needs sums: rounds, rating, wins, t_rounds, t_wins, ct_rounds, ct_wins. Adds adj_rating, adj_win, adj_t, adj_ct.
    """
    whole = Window.partitionBy(entity)
    over = lambda n, d: ratio(F.sum(n).over(whole), F.sum(d).over(whole))
    with_overall = summed.withColumns({"o_rating": over("rating", "rounds"), "o_win": over("wins", "rounds"), "o_t": over("t_wins", "t_rounds"), "o_ct": over("ct_wins", "ct_rounds")})
    n = F.col("rounds")
    return with_overall.select(
        entity, context, "rounds",
        shrink(F.coalesce(ratio("rating", "rounds"), F.lit(0.0)), n, F.col("o_rating"), prior).alias("adj_rating"),
        shrink(F.coalesce(ratio("wins", "rounds"), F.lit(0.0)), n, F.col("o_win"), prior).alias("adj_win"),
        side_rate(F.col("t_wins"), F.col("t_rounds"), F.col("o_t"), prior).alias("adj_t"),
        side_rate(F.col("ct_wins"), F.col("ct_rounds"), F.col("o_ct"), prior).alias("adj_ct"),
    )


def paired_edges(us: DataFrame, them: DataFrame, entity: str, context: str) -> DataFrame:
    """Signals of every row of us (as `side`) against every row of them (as `opponent`) in the same context; null where either has no rounds.

    The side edge is the mean of what we expect on either side against what they hold on the other, less a half.
    """
    us = us.select(context, F.col(entity).alias("side"), *[F.col(c).alias(f"us_{c}") for c in ("rounds", "adj_rating", "adj_win", "adj_t", "adj_ct")])
    both = them.join(us, context)
    known = (F.col("rounds") > 0) & (F.col("us_rounds") > 0)
    expected_t = (F.col("us_adj_t") + 1 - F.col("adj_ct")) / 2
    expected_ct = (F.col("us_adj_ct") + 1 - F.col("adj_t")) / 2
    return both.select(
        "side", F.col(entity).alias("opponent"), context, "us_rounds", F.col("rounds").alias("opp_rounds"),
        F.when(known, F.col("us_adj_rating") - F.col("adj_rating")).alias("rating_edge"),
        F.when(known, F.col("us_adj_win") - F.col("adj_win")).alias("win_edge"),
        F.when(known, (expected_t + expected_ct) / 2 - 0.5).alias("side_edge"),
    )


def signal_edges(table: DataFrame, entity: str, context: str, ours) -> DataFrame:
    """Our signals against each opponent's in each context; ours is one entity, a value or a scalar subquery."""
    return paired_edges(table.where(F.col(entity) == ours), table.where(F.col(entity) != ours), entity, context).drop("side")


def asymmetries(table: DataFrame, entity: str, context: str, ours, tolerance: float = 1e-9) -> DataFrame:
    """One row, pairs and broken: the ranking is done once more with each opponent as us; where the scores do not add up to 0, a pair is broken."""
    mine, theirs = table.where(F.col(entity) == ours), table.where(F.col(entity) != ours)
    forth = scored(paired_edges(mine, theirs, entity, context)).select("opponent", context, F.col("score").alias("ours"))
    back = scored(paired_edges(theirs, mine, entity, context)).select(F.col("side").alias("opponent"), context, F.col("score").alias("theirs"))
    agree = F.coalesce(F.abs(F.col("ours") + F.col("theirs")) <= tolerance, F.col("ours").isNull() & F.col("theirs").isNull())
    return forth.join(back, ["opponent", context], "full").agg(F.count("*").alias("pairs"), F.count_if(~agree).alias("broken"))


def scored(edges: DataFrame, prior: float = PRIOR) -> DataFrame:
    """Adds score and band: the weighted edges over their noise floors, damped by the smaller sample."""
    least = F.least("us_rounds", "opp_rounds")
    weight = least / (least + F.lit(prior))
    score = weight * sum(WEIGHTS[k] * F.col(f"{k}_edge") / FLOORS[k] for k in ("rating", "win", "side"))
    band = F.when(F.col("score").isNull(), "no-data").when(F.col("score") >= PICK, "pick").when(F.col("score") <= BAN, "ban").otherwise("neutral")
    return edges.withColumn("score", score).withColumn("band", band)


def signal(edge: Column, floor: float = FLOORS["rating"]) -> Column:
    return F.when(edge.isNull(), "no-data").when(F.abs(edge) < floor, "noise").when(edge > 0, "edge-us").otherwise("edge-them")


def heat(score: Column) -> Column:
    return F.when(score.isNull(), "none").when(score >= 2, "strong-pick").when(score >= PICK, "pick").when(score <= -2, "strong-ban").when(score <= BAN, "ban").otherwise("neutral")


def verdicts(ranking: DataFrame, context: str) -> DataFrame:
    """A row an opponent: pick (best score), ban (worst of the rest; ties by the opponent's larger sample, then name), two in reserve.

    Contexts without a score stand last by name; if only such remain, the first of them is banned. Each opponent has as many rows as
    there are contexts, so its order is one array, and all four choices come out of one aggregation.
    """
    # negated scores order the best first; contexts without a score stand last, by name
    item = F.struct(F.col("score").isNull().alias("unknown"), (-F.col("score")).alias("low"), F.col(context).alias("name"), F.col("score"), (-F.col("opp_rounds")).alias("few"))
    lists = ranking.groupBy("opponent").agg(F.array_sort(F.collect_list(item)).alias("all"))
    rest = lists.withColumn("rest", F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(0))))
    worst = F.array_sort(F.transform(F.filter("rest", lambda r: ~r["unknown"]), lambda r: F.struct(r["score"].alias("score"), r["few"].alias("few"), r["name"].alias("name"))))
    ban = F.coalesce(F.get(worst, F.lit(0))["name"], F.get("rest", F.lit(0))["name"])
    left = F.filter("rest", lambda r: ~r["name"].eqNullSafe(F.col("ban")))
    chosen = rest.withColumn("ban", ban).withColumn("left", left)
    return chosen.select("opponent", F.get("all", F.lit(0))["name"].alias("pick"), "ban", F.get("left", F.lit(0))["name"].alias("reserve_1"), F.get("left", F.lit(1))["name"].alias("reserve_2"))


def best_responses(ranking: DataFrame, verdict: DataFrame, context: str) -> DataFrame:
    """For each context that we do not ban, as the opponent's choice: our best scored context among the rest.

    The answer is the best of all, or the second where the best is taken, so two windows' worth of rows serve every choice and
    no choice is paired with all answers.
    """
    open_ = ranking.join(verdict.select("opponent", "ban"), "opponent").where(~F.col(context).eqNullSafe(F.col("ban")))
    order = Window.partitionBy("opponent").orderBy(F.desc_nulls_last("score"), F.asc(context))
    placed = open_.withColumn("place", F.row_number().over(order))
    two = placed.where("place <= 2").groupBy("opponent").agg(*[F.max(F.when(F.col("place") == k, F.struct(F.col(context).alias("name"), F.col("score").alias("score")))).alias(f"b{k}") for k in (1, 2)])
    answer = F.when(F.col("place") == 1, F.col("b2")).otherwise(F.col("b1"))
    return placed.join(two, "opponent").select("opponent", F.col(context).alias("choice"), answer["name"].alias("response"), answer["score"].alias("response_score"))


def mirrored(ranking: DataFrame, context: str) -> DataFrame:
    """The ranking as the opponent sees it: scores negated, bands swapped, places by the new scores."""
    band = F.when(F.col("band") == "pick", "ban").when(F.col("band") == "ban", "pick").otherwise(F.col("band"))
    order = Window.partitionBy("opponent").orderBy(F.asc_nulls_last("score"), F.asc(context))
    return ranking.withColumn("place", F.row_number().over(order).cast("long")).withColumn("band", band).withColumn("score", -F.col("score"))


def clashes(verdict: DataFrame, mirror: DataFrame, context: str) -> DataFrame:
    """Whether the opponent's likely ban is our pick and its likely pick our ban."""
    theirs = mirror.groupBy("opponent").agg(F.min_by(context, "place").alias("likely_pick"), F.max_by(context, F.when(F.col("band") == "ban", F.col("place"))).alias("likely_ban"))
    return verdict.join(theirs, "opponent").select("opponent", "likely_pick", "likely_ban", F.col("likely_ban").eqNullSafe(F.col("pick")).alias("pick_contested"), F.col("likely_pick").eqNullSafe(F.col("ban")).alias("ban_wanted"))


def unreferenced(references: DataFrame, evidence: DataFrame, key: str = "id") -> DataFrame:
    """References that no evidence row backs; empty for a closed set."""
    return references.join(evidence.select(key), key, "left_anti")
