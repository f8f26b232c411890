"""The learned reranker: features against plain Python, the fit against a plain minimiser, and better places on held-out probes."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from proofgrid.operators import reranking, retrieval

WORDS = [a + b for a in "ba de fi go lu mi no pe ra su ti vo".split() for b in "kan lor mes tiv nud".split()]


def plain(q, p):
    q, p = q or "", p or ""
    ws = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    a, b = ws(q), ws(p)
    share = lambda x, y: x / y if y else 0.0
    asked, met, two = set(a), set(a) & set(b), lambda x: set(zip(x, [*x[1:], None])) if x else set()
    letters = lambda x: sum(map(len, x))
    return [
        share(len(met), len(asked)), share(letters(met), letters(asked)), share(len(two(a) & two(b)), len(two(a))), share(sum(w in asked for w in b), len(b)), np.log1p(len(b)), share(letters(b), len(b)),
        share(len(set(b)), len(b)), share(sum(c in "0123456789" for c in p), len(p)), share(sum(not c.isalnum() and not c.isspace() for c in p), len(p)), share(sum(c.isupper() for c in p), len(p)),
    ]


def test_features_equal_plain_python(spark):
    rows = [("One two three", "two Three, four two!"), ("a b", None), (None, "x 1 22"), ("", ""), ("Ärger über", "über ÄRGER 7"), ("same", "same same same"), ("q " * 300, "long " * 5000)]
    got = [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, p string").orderBy("i").select(reranking.features(F.col("q"), F.col("p"))).collect()]
    for (q, p), f in zip(rows, got):
        assert np.allclose(f, plain(q, p)), (q, p)


def corpus(spark, queries=60, seed=3):
    """Ten hits a query, of which the relevant one holds a run of its words in order; the first stage puts hits in chance order."""
    rng = random.Random(seed)
    asked, docs, hits, grades = [], [], [], []
    for q in range(queries):
        words = rng.sample(WORDS, 6)
        asked.append((q, " ".join(words)))
        good, places = rng.randrange(10), rng.sample(range(1, 11), 10)
        for k in range(10):
            i = q * 10 + k
            rest = [rng.choice(WORDS) for _ in range(rng.randint(10, 40))]
            body = rest[:5] + (words[1:5] if k == good else rng.sample(words, 3)) + rest[5:]
            docs.append((i, " ".join(body)))
            hits.append((q, i, places[k]))
            grades.append((q, i, int(k == good) if k != (good + 1) % 10 else None))
    make = spark.createDataFrame
    return make(hits, "qid long, id long, rank long"), make(asked, "qid long, text string"), make(docs, "id long, text string"), make(grades, "qid long, id long, grade int")


def test_fit_equals_a_plain_minimiser_and_helps_held_out_probes(spark):
    hits, asked, docs, grades = corpus(spark)
    seen = lambda df: df.where("qid % 3 <> 0")
    ranker = reranking.fit(seen(hits), asked, docs, grades, ridge=0.1)

    texts, q = dict(docs.collect()), dict(asked.collect())
    grade = {(r.qid, r.id): r.grade for r in grades.collect()}
    heads = {}
    for r in hits.collect():
        if r.qid % 3 and grade[r.qid, r.id] is not None:
            heads.setdefault(r.qid, []).append((plain(q[r.qid], texts[r.id][:512]), grade[r.qid, r.id]))
    every = np.array([f for h in heads.values() for f, _ in h])
    mean, spread = every.mean(0), every.std(0)
    spread[spread < 1e-12] = 1
    gaps = [(np.array([(np.array(a) - np.array(b)) / spread for a, x in h for b, y in h if x > y])) for h in heads.values()]
    w = np.zeros(len(mean))
    for _ in range(3000):  # plain descent on the same loss
        w += 0.5 * (sum((g.T @ (1 / (1 + np.exp(g @ w)))) / len(g) for g in gaps) / len(gaps) - 0.1 * w)
    assert np.allclose(ranker.weights, w, atol=1e-4) and np.allclose(ranker.means, mean) and ranker.pairs == sum(map(len, gaps))

    held = hits.where("qid % 3 = 0")
    again = retrieval.reranked(held, asked, docs, ranker)
    mrr = lambda h: retrieval.evaluate(h.select("qid", F.col("id").alias("file"), F.col("rank").alias("place")), grades.where("grade = 1").select("qid", F.col("id").alias("file")), asked.where("qid % 3 = 0").select("qid", F.lit("all").alias("category"))).where("category = 'overall'").first()["mrr"]  # noqa: E731, E501
    before, after = mrr(held), mrr(again)
    assert after > 0.9 > 0.5 > before
    assert {(r.qid, r.id) for r in again.collect()} == {(r.qid, r.id) for r in held.collect()}


def test_nothing_to_learn_from(spark):
    hits, asked, docs, grades = corpus(spark, 2)
    assert reranking.fit(hits.limit(0), asked, docs, grades) is None
    assert reranking.fit(hits, asked, docs, grades.withColumn("grade", F.lit(1))) is None
    assert retrieval.reranked(hits, asked, docs, None) is hits
