"""Hand-computed cases of shrinkage, scores and choices."""

import pytest
from pyspark.sql import functions as F

from proofgrid.functions import columns as C
from proofgrid.operators import ranking

RANK = "opponent int, map string, us_rounds long, opp_rounds long, score double, band string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_shrink_halves_the_distance_at_the_prior(spark):
    assert one(spark, C.shrink(F.lit(1.4), F.lit(250), F.lit(1.0), 250)) == pytest.approx(1.2, abs=1e-9)
    assert one(spark, ranking.side_rate(F.lit(0), F.lit(0), F.lit(0.5))) == pytest.approx(0.5)


def test_score_weighs_edges_over_their_floors(spark):
    row = spark.createDataFrame([(250, 400, 0.3, 0.1, 0.05), (0, 400, None, None, None)], "us_rounds long, opp_rounds long, rating_edge double, win_edge double, side_edge double")
    found = ranking.scored(row).orderBy("us_rounds").collect()
    assert found[1].score == pytest.approx(0.5 * (0.5 * 10 + 0.3 * 2 + 0.2 * 1), abs=1e-9) and found[1].band == "pick"
    assert found[0].score is None and found[0].band == "no-data"


def test_edges_are_null_without_rounds_and_cancel_for_equals(spark):
    t = spark.createDataFrame([(0, "m", 10, 1.0, 0.5, 0.6, 0.4), (1, "m", 10, 1.0, 0.5, 0.6, 0.4), (2, "m", 0, 1.0, 0.5, 0.5, 0.5)], "team int, map string, rounds long, adj_rating double, adj_win double, adj_t double, adj_ct double")
    found = {r.opponent: r for r in ranking.signal_edges(t, "team", "map", 0).collect()}
    assert found[1].rating_edge == 0 and found[1].side_edge == pytest.approx(0) and found[2].rating_edge is None


def test_verdict_breaks_ban_ties_by_the_larger_opponent_sample_then_name(spark):
    ranks = spark.createDataFrame([(1, "a", 9, 10, 2.0, "pick"), (1, "b", 9, 10, -1.0, "ban"), (1, "c", 9, 30, -1.0, "ban"), (1, "d", 9, 30, -1.0, "ban"), (1, "e", 9, 0, None, "no-data")], RANK)
    v = ranking.verdicts(ranks, "map").first()
    assert (v.pick, v.ban, v.reserve_1, v.reserve_2) == ("a", "c", "b", "d")


def test_verdict_without_scores_and_with_one_context(spark):
    v = ranking.verdicts(spark.createDataFrame([(1, "y", 0, 0, None, "no-data"), (1, "x", 0, 0, None, "no-data")], RANK), "map").first()
    assert (v.pick, v.ban, v.reserve_1) == ("x", "y", None)
    v = ranking.verdicts(spark.createDataFrame([(1, "x", 0, 0, 1.0, "pick")], RANK), "map").first()
    assert (v.pick, v.ban, v.reserve_1, v.reserve_2) == ("x", None, None, None)


def test_best_response_is_never_the_choice_itself(spark):
    ranks = spark.createDataFrame([(1, "a", 9, 9, 2.0, "pick"), (1, "b", 9, 9, 1.0, "pick"), (1, "c", 9, 9, -1.0, "ban")], RANK)
    found = {r.choice: r.response for r in ranking.best_responses(ranks, ranking.verdicts(ranks, "map"), "map").collect()}
    assert found == {"a": "b", "b": "a"}


def test_mirror_negates_and_swaps(spark):
    ranks = spark.createDataFrame([(1, "a", 9, 9, 2.0, "pick"), (1, "b", 9, 9, -3.0, "ban")], RANK)
    found = ranking.mirrored(ranks, "map").orderBy("place").collect()
    assert [(r.map, r.score, r.band) for r in found] == [("b", 3.0, "pick"), ("a", -2.0, "ban")]


def test_signals_and_heat(spark):
    assert [one(spark, ranking.signal(F.lit(x).cast("double"))) for x in (None, 0.01, 0.03, -0.2)] == ["no-data", "noise", "edge-us", "edge-them"]
    assert [one(spark, ranking.heat(F.lit(x).cast("double"))) for x in (None, 2.5, 1.0, 0.0, -1.5, -2.0)] == ["none", "strong-pick", "pick", "neutral", "ban", "strong-ban"]
