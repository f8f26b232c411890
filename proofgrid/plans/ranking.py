"""Ranking queries: the least nation with facts is us, every other one an opponent, brands are the contexts to pick and ban."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.operators import metrics, ranking
from proofgrid.plans.metrics import SUMS_SQL, nation_brand_sums, ours
from proofgrid.plans.registry import query
from proofgrid.session import table

#: SQL of a score from two samples and three edges.
SCORE_SQL = "least({us}, {opp}) / (least({us}, {opp}) + 250.0::DOUBLE) * (0.5::DOUBLE * {rating} / 0.03::DOUBLE + 0.3::DOUBLE * {win} / 0.05::DOUBLE + 0.2::DOUBLE * {side} / 0.05::DOUBLE)"
#: SQL of the rounded ranking that the later choices build on, so both sides order the same values.
RANKING_SQL = f"""{SUMS_SQL}, o AS (
  SELECT nation, sum(rating) / sum(rounds) AS r, sum(wins) / sum(rounds) AS w, sum(t_wins) / sum(t_rounds) AS t, sum(ct_wins) / sum(ct_rounds) AS ct FROM sums GROUP BY nation
), adj AS (
  SELECT nation, brand, rounds, (rating / rounds * rounds + r * 250) / (rounds + 250) AS ar, (wins / rounds * rounds + w * 250) / (rounds + 250) AS aw,
    (coalesce(t_wins / nullif(t_rounds, 0), 0) * t_rounds + t * 250) / (t_rounds + 250) AS at, (coalesce(ct_wins / nullif(ct_rounds, 0), 0) * ct_rounds + ct * 250) / (ct_rounds + 250) AS act
  FROM sums JOIN o USING (nation)
), edges AS (
  SELECT b.nation AS opponent, brand, a.rounds AS us_rounds, b.rounds AS opp_rounds, a.ar - b.ar AS rating_edge, a.aw - b.aw AS win_edge,
    ((a.at + 1 - b.act) / 2 + (a.act + 1 - b.at) / 2) / 2 - 0.5 AS side_edge
  FROM adj b JOIN adj a USING (brand) WHERE a.nation = (SELECT min(nation) FROM sums) AND b.nation <> (SELECT min(nation) FROM sums)
), ranked AS (
  SELECT opponent, brand, us_rounds, opp_rounds, round(score, 6) AS score, CASE WHEN score IS NULL THEN 'no-data' WHEN score >= 0.1 THEN 'pick' WHEN score <= -0.1 THEN 'ban' ELSE 'neutral' END AS band
  FROM (SELECT *, {SCORE_SQL.format(us='us_rounds', opp='opp_rounds', rating='rating_edge', win='win_edge', side='side_edge')} AS score FROM edges)
)"""
VERDICT_SQL = f"""{RANKING_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY opponent ORDER BY score DESC NULLS LAST, brand) AS k FROM ranked),
picks AS (SELECT opponent, brand AS pick FROM p WHERE k = 1), rest AS (SELECT * FROM p WHERE k > 1),
bans AS (SELECT opponent, brand AS ban FROM (SELECT *, row_number() OVER (PARTITION BY opponent ORDER BY score ASC NULLS LAST, CASE WHEN score IS NULL THEN 0 ELSE -opp_rounds END, brand) AS b FROM rest) WHERE b = 1),
left_ AS (SELECT rest.*, row_number() OVER (PARTITION BY opponent ORDER BY k) AS r FROM rest JOIN bans USING (opponent) WHERE brand <> ban),
verdict AS (SELECT opponent, pick, ban, (SELECT brand FROM left_ l WHERE l.opponent = picks.opponent AND r = 1) AS reserve_1, (SELECT brand FROM left_ l WHERE l.opponent = picks.opponent AND r = 2) AS reserve_2 FROM picks JOIN bans USING (opponent))"""


def signal_edges(spark: SparkSession, sf_dir: str, us: Column | None = None) -> DataFrame:
    """The nation x brand table has as many rows as nations times brands, whatever the number of facts."""
    sums = nation_brand_sums(spark, sf_dir)
    return ranking.signal_edges(ranking.adjusted(sums, "nation", "brand"), "nation", "brand", ours(spark, sf_dir) if us is None else us)


def rounded_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to six decimals; bands at 0.1, as differences are small in these data."""
    found = ranking.scored(signal_edges(spark, sf_dir))
    band = F.when(F.col("score").isNull(), "no-data").when(F.col("score") >= 0.1, "pick").when(F.col("score") <= -0.1, "ban").otherwise("neutral")
    return found.select("opponent", "brand", "us_rounds", "opp_rounds", F.round("score", 6).alias("score"), band.alias("band"))


@query(
    "shrunk_edges",
    f"WITH {RANKING_SQL} SELECT opponent, brand, us_rounds, opp_rounds, round(rating_edge, 6) AS rating_edge, round(win_edge, 6) AS win_edge, round(side_edge, 6) AS side_edge FROM edges",
)
def shrunk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signal_edges(spark, sf_dir)
    return found.select("opponent", "brand", "us_rounds", "opp_rounds", *[F.round(c, 6).alias(c) for c in ("rating_edge", "win_edge", "side_edge")])


@query("score_bands", f"WITH {RANKING_SQL} SELECT * FROM ranked")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_ranking(spark, sf_dir)


@query("pick_ban_verdict", f"WITH {VERDICT_SQL} SELECT * FROM verdict")
def pick_ban_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.verdicts(rounded_ranking(spark, sf_dir), "brand")


@query(
    "contingency_best_response",
    f"""WITH {VERDICT_SQL}, c AS (SELECT ranked.* FROM ranked JOIN verdict USING (opponent) WHERE brand <> ban)
    SELECT opponent, choice, response, response_score FROM (SELECT a.opponent, a.brand AS choice, b.brand AS response, b.score AS response_score,
      row_number() OVER (PARTITION BY a.opponent, a.brand ORDER BY b.score DESC NULLS LAST, b.brand) AS k FROM c a LEFT JOIN c b ON a.opponent = b.opponent AND a.brand <> b.brand) WHERE k = 1""",
)
def contingency_best_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = rounded_ranking(spark, sf_dir)
    return ranking.best_responses(rank, ranking.verdicts(rank, "brand"), "brand")


@query(
    "mirror_ranking",
    f"""WITH {RANKING_SQL} SELECT opponent, brand, us_rounds, opp_rounds, -score AS score, CASE band WHEN 'pick' THEN 'ban' WHEN 'ban' THEN 'pick' ELSE band END AS band,
      row_number() OVER (PARTITION BY opponent ORDER BY score ASC NULLS LAST, brand) AS place FROM ranked""",
)
def mirror_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.mirrored(rounded_ranking(spark, sf_dir), "brand")


@query(
    "clash_flags",
    f"""WITH {VERDICT_SQL}, m AS (SELECT opponent, brand, CASE band WHEN 'pick' THEN 'ban' WHEN 'ban' THEN 'pick' ELSE band END AS band, row_number() OVER (PARTITION BY opponent ORDER BY score ASC NULLS LAST, brand) AS place FROM ranked),
    t AS (SELECT opponent, arg_min(brand, place) AS likely_pick, arg_max(brand, CASE WHEN band = 'ban' THEN place END) AS likely_ban FROM m GROUP BY opponent)
    SELECT opponent, likely_pick, likely_ban, likely_ban IS NOT DISTINCT FROM pick AS pick_contested, likely_pick IS NOT DISTINCT FROM ban AS ban_wanted FROM verdict JOIN t USING (opponent)""",
)
def clash_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = rounded_ranking(spark, sf_dir)
    return ranking.clashes(ranking.verdicts(rank, "brand"), ranking.mirrored(rank, "brand"), "brand")


FORTH = SCORE_SQL.format(us="us_rounds", opp="opp_rounds", rating="rating_edge", win="win_edge", side="side_edge")
BACK = SCORE_SQL.format(us="b.rounds", opp="a.rounds", rating="(b.ar - a.ar)", win="(b.aw - a.aw)", side="(((b.at + 1 - a.act) / 2 + (b.act + 1 - a.at) / 2) / 2 - 0.5)")


@query(
    "antisymmetry_check",
    f"""WITH {RANKING_SQL}, forth AS (SELECT opponent, brand, {FORTH} AS score FROM edges),
    back AS (SELECT b.nation AS opponent, brand, {BACK} AS score FROM adj b JOIN adj a USING (brand) WHERE a.nation = (SELECT min(nation) FROM sums) AND b.nation <> (SELECT min(nation) FROM sums))
    SELECT count(*) AS pairs, count(CASE WHEN NOT coalesce(abs(f.score + b.score) <= 1e-9, f.score IS NULL AND b.score IS NULL) THEN 1 END) AS broken FROM forth f FULL JOIN back b ON f.opponent = b.opponent AND f.brand = b.brand""",
)
def antisymmetry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every opponent ranked once more as us, against us: its scores must be the negated ones."""
    table_ = ranking.adjusted(nation_brand_sums(spark, sf_dir), "nation", "brand")
    return ranking.asymmetries(table_, "nation", "brand", ours(spark, sf_dir))


@query("mean_across", f"WITH {RANKING_SQL}, m AS (SELECT brand, round(avg(score), 6) AS mean FROM ranked GROUP BY 1) SELECT brand, mean, row_number() OVER (ORDER BY mean DESC NULLS LAST, brand) AS place FROM m")
def mean_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mean_across(rounded_ranking(spark, sf_dir), "brand")


EVIDENCE_SQL = f"""{RANKING_SQL}, evidence AS (
  SELECT concat('edge:', opponent, ':', brand) AS id, 'edge' AS kind, score AS value, NULL AS label FROM ranked WHERE band <> 'neutral'
  UNION ALL SELECT concat('nation:', n_nationkey), 'nation', NULL, n_name FROM nation)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of several kinds under one id space; columns that a kind lacks are null."""
    edges = rounded_ranking(spark, sf_dir).where("band <> 'neutral'").select(F.concat(F.lit("edge:"), "opponent", F.lit(":"), "brand").alias("id"), F.lit("edge").alias("kind"), F.col("score").alias("value"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.lit("nation").alias("kind"), F.col("n_name").alias("label"))
    return edges.unionByName(nations, allowMissingColumns=True)


@query("evidence_union", f"WITH {EVIDENCE_SQL} SELECT * FROM evidence")
def evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir)


@query(
    "evidence_closure",
    f"WITH {EVIDENCE_SQL}, refs AS (SELECT concat('edge:', opponent, ':', brand) AS id FROM ranked) SELECT id FROM refs WHERE id NOT IN (SELECT id FROM evidence)",
)
def evidence_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without evidence: here the neutral pairs, which give none."""
    refs = rounded_ranking(spark, sf_dir).select(F.concat(F.lit("edge:"), "opponent", F.lit(":"), "brand").alias("id"))
    return ranking.unreferenced(refs, evidence(spark, sf_dir))
