"""A reranker learned from probes: pairwise logistic regression on features of query and passage, applied as a column expression.

A pair is two hits of one query's head of which one is graded higher. The head bounds the pairs of a query, so they are formed where the head
stands and only sums leave a task: a gradient and a Hessian of fixed size, whatever the number of probes. The learned score is a sum of built-in
functions, so it runs in the JVM wherever `retrieval.reranked` puts it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.functions.columns import let
from proofgrid.session import ship_package
from proofgrid.sinks.storage import staged

FEATURES = ("share_of_words", "share_of_letters", "share_of_pairs", "hits_a_word", "words", "letters_a_word", "distinct", "digits", "marks", "capitals")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def features(query: Column, passage: Column) -> Column:
    """An array of FEATURES: how much of the query the passage holds, and what the passage is like. Null texts count as empty, shares of nothing as 0."""
    text = F.coalesce(passage, F.lit(""))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0).cast("double")
    letters = lambda ws: F.aggregate(ws, F.lit(0), lambda n, w: n + F.length(w))
    pairs = lambda ws: F.array_distinct(F.zip_with(ws, F.slice(ws, F.lit(2), F.greatest(F.size(ws), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)))
    count = lambda p: F.length(text) - F.length(F.regexp_replace(text, p, ""))

    def of(q: Column, p: Column) -> Column:
        asked = F.array_distinct(q)
        met = F.array_intersect(asked, p)
        hits = F.size(F.filter(p, lambda w: F.array_contains(asked, w)))
        return F.array(
            share(F.size(met), F.size(asked)), share(letters(met), letters(asked)), share(F.size(F.array_intersect(pairs(q), pairs(p))), F.size(pairs(q))), share(hits, F.size(p)),
            F.log1p(F.size(p).cast("double")), share(letters(p), F.size(p)), share(F.size(F.array_distinct(p)), F.size(p)),
            share(count(r"[0-9]"), F.length(text)), share(count(r"[^\p{L}\p{N}\s]"), F.length(text)), share(count(r"\p{Lu}"), F.length(text)),
        )

    return let(words_of(query), lambda q: let(words_of(text), lambda p: of(q, p)))


@dataclass(frozen=True)
class Ranker:
    """score(query, passage) for `retrieval.reranked`: the weighted sum of the features, each less its mean and over its deviation."""

    weights: tuple[float, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    pairs: int = 0

    def __call__(self, query: Column, passage: Column) -> Column:
        slopes = [w / d for w, d in zip(self.weights, self.deviations)]
        shift = sum(s * m for s, m in zip(slopes, self.means))
        scored = let(features(query, passage), lambda f: F.aggregate(F.zip_with(f, F.array(*map(F.lit, slopes)), lambda x, s: x * s), F.lit(0.0), lambda a, b: a + b))
        return F.round(scored - F.lit(float(shift)), 9)


def pair_sums(heads: Iterator[pd.DataFrame], weights: np.ndarray) -> Iterator[pd.DataFrame]:
    """One row: loss, number of pairs, gradient and Hessian of the pairwise logistic loss over all heads of the task."""
    d = len(weights)
    total = np.zeros(2 + d + d * d)
    for batch in heads:
        for f, grade in zip(batch["f"], batch["grade"]):
            x, g = np.stack([np.asarray(row, float) for row in f]), np.asarray(grade, float)
            better, worse = np.nonzero(g[:, None] > g[None, :])
            if len(better):
                gap = x[better] - x[worse]
                margin = gap @ weights
                miss = 1 / (1 + np.exp(np.clip(margin, -500, 500)))  # how likely the model puts the worse one first
                each = 1 / len(better)  # every query counts as one
                total[0] += each * np.logaddexp(0, -margin).sum()
                total[1] += len(better)
                total[2 : 2 + d] += each * (gap.T @ miss)
                total[2 + d :] += each * ((gap * (miss * (1 - miss))[:, None]).T @ gap).ravel()
    yield pd.DataFrame({"sums": [total.tolist()]})


def graded_heads(hits: DataFrame, queries: DataFrame, docs: DataFrame, grades: DataFrame, head: int, passage: int) -> DataFrame:
    """qid, f (features of each graded hit of the head), grade. hits: qid, id, rank; queries: qid, text; docs: id, text; grades: qid, id, grade."""
    best = hits.where(F.col("rank") <= head).select("qid", "id").join(grades.where("grade IS NOT NULL").select("qid", "id", "grade"), ["qid", "id"])
    texts = best.join(queries.select("qid", F.col("text").alias("_q")), "qid").join(docs.select("id", F.substring("text", 1, passage).alias("_p")), "id")
    each = texts.select("qid", "id", features(F.col("_q"), F.col("_p")).alias("f"), F.col("grade").cast("double").alias("grade"))
    both = each.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("id", "f", "grade"))).alias("h"))  # no more than `head` each
    return both.select("qid", F.col("h.f").alias("f"), F.col("h.grade").alias("grade"))


def fit(hits: DataFrame, queries: DataFrame, docs: DataFrame, grades: DataFrame, head: int = 20, passage: int = 512, ridge: float = 0.1, rounds: int = 25) -> Ranker | None:
    """The ranker whose scores best put higher graded hits of each query's head before lower graded ones; None if no head holds a pair.

    Newton steps on the ridge-penalised mean loss until none moves a weight by 1e-6; each reads the heads once. Hits without a grade say nothing,
    null texts are empty ones, repeated (qid, id) count as often as they stand.
    """
    ship_package(hits.sparkSession)
    heads = staged(graded_heads(hits, queries, docs, grades, head, passage), "heads")
    d = len(FEATURES)
    flat = heads.select(F.explode("f").alias("f"))
    moments = flat.agg(*[F.avg(F.col("f")[i]).alias(f"m{i}") for i in range(d)], *[F.stddev_pop(F.col("f")[i]).alias(f"s{i}") for i in range(d)]).first()
    if moments["m0"] is None:
        return None
    means, spreads = np.array([moments[f"m{i}"] for i in range(d)]), np.array([moments[f"s{i}"] for i in range(d)])
    spreads[spreads < 1e-12] = 1.0
    weights, n = np.zeros(d), heads.count()
    for _ in range(rounds):
        at = weights / spreads  # gaps of features need no mean taken off
        sums = heads.select("f", "grade").mapInPandas(lambda it, at=at: pair_sums(it, at), "sums array<double>")
        total = np.array(sums.agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(2 + d + d * d)]).alias("s")).first()["s"])
        if not total[1]:
            return None
        gradient = total[2 : 2 + d] / spreads / n - ridge * weights
        hessian = total[2 + d :].reshape(d, d) / np.outer(spreads, spreads) / n + ridge * np.eye(d)
        step = np.linalg.solve(hessian, gradient)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    return Ranker(tuple(np.round(weights, 9).tolist()), tuple(means.tolist()), tuple(spreads.tolist()), int(total[1]))
