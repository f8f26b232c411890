"""Hyperplane buckets against the comparison of all pairs: recall, no invented pairs, each pair once, crowded buckets."""

import numpy as np
import pytest

from proofgrid.operators import neighbours as N
from proofgrid.operators import retrieval as R

AT = 0.9


def frame(spark, v, start=0, name="id"):
    return spark.createDataFrame([(start + i, x.tolist()) for i, x in enumerate(v)], f"{name} long, vector array<double>").repartition(4)


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.fixture(scope="module")
def copied():
    """1500 random directions and one copy of each at a cosine of 0.9 to 0.97."""
    draw = np.random.default_rng(6)
    base = unit(draw.normal(size=(1500, 32)))
    side = draw.normal(size=base.shape)
    side = unit(side - (side * base).sum(1)[:, None] * base)
    t = draw.uniform(0.9, 0.97, 1500)[:, None]
    return base, t * base + np.sqrt(1 - t**2) * side


def exact(v, at):
    c = np.round(v @ v.T, 6)
    return {(i, j) for i, j in zip(*np.nonzero(c >= at)) if i < j}


@pytest.mark.parametrize("rows", [10_000, 1_000_000])
def test_pairs_are_met_as_often_as_planned(spark, copied, rows):
    """The plans of larger tables, whose codes are longer and tables more, on a table that can be compared in full."""
    v = np.concatenate(copied)
    want, way = exact(v, AT), N.plan(rows, AT, 0.95)
    found = [(r.a, r.b) for r in N.near_pairs(frame(spark, v), AT, way=way).collect()]
    assert way.bits > 3 and way.tables > 3 and len(found) == len(set(found)) and set(found) <= want
    assert len(found) >= 0.95 * len(want)  # more than planned for pairs at the threshold, as most are closer


def test_the_exact_way_and_small_tables_lose_nothing(spark, copied):
    v = np.concatenate([x[:300] for x in copied])
    for options in ({"recall": 1.0}, {"recall": 0.95}):
        assert N.plan(len(v), AT, **options).bits == 0
        assert {(r.a, r.b) for r in N.near_pairs(frame(spark, v), AT, block=64, **options).collect()} == exact(v, AT)


def test_pairs_between_two_sets(spark, copied):
    one, two = (x[:400] for x in copied)
    c = np.round(one @ two.T, 6)
    want = {(i, 1000 + j) for i, j in zip(*np.nonzero(c >= AT))}
    for way in (N.plan(1, AT, 1.0), N.Plan(6, 12, 0, 0.95, 1.0)):
        found = [(r.a, r.b) for r in N.near_pairs(frame(spark, one), AT, others=frame(spark, two, 1000), way=way, block=100).collect()]
        assert len(found) == len(set(found)) and set(found) <= want and len(found) >= 0.95 * len(want)


def test_a_crowded_bucket_is_dealt_into_blocks(spark, copied):
    """A third of all rows are one vector: they share every bucket, and still meet in blocks."""
    v = np.concatenate([copied[0][:200], np.repeat(copied[0][:1], 100, axis=0)])
    way = N.Plan(8, 6, 0, 0.9, 1.0)
    found = [(r.a, r.b) for r in N.near_pairs(frame(spark, v), AT, way=way, block=16).collect()]
    assert len(found) == len(set(found)) == 101 * 100 / 2


def test_no_rows_and_null_vectors(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    assert N.near_pairs(none, 0.9).count() == 0 and N.near_neighbours(none.withColumnRenamed("id", "qid"), none).count() == 0
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0])], "id long, vector array<double>")
    assert [(r.a, r.b) for r in N.near_pairs(some, 0.9).collect()] == [(1, 3)]


@pytest.mark.parametrize("probes", [0, 4])
def test_neighbours_of_many_queries(spark, copied, probes):
    """Recall of the nearest against the exact search, with fewer tables if queries look into further buckets."""
    base, near = copied
    way = N.plan(1_000_000, 0.93, 0.95, probes)
    found = N.near_neighbours(frame(spark, near[:500], name="qid"), frame(spark, base), 1, way=way).collect()
    assert sum(r.id == r.qid for r in found) >= 0.9 * 500 and len({r.qid for r in found}) == len(found)
    assert N.plan(1_000_000, 0.93, 0.95, 4).tables < N.plan(1_000_000, 0.93, 0.95, 0).tables


def test_neighbours_planned_from_a_sample_are_those_of_the_exact_search(spark, copied, rows):
    base, near = copied
    asked, known = frame(spark, near[:50], name="qid"), frame(spark, base[:300])
    assert rows(N.near_neighbours(asked, known, 5).select("qid", "id", "rank")) == rows(R.knn(asked, known, 5).select("qid", "id", "rank"))
    assert N.kth_cosine(asked, known, 1) == pytest.approx(0.91, abs=0.02)


def test_work_grows_slower_than_the_square():
    """Comparisons a row at a thousand times the rows: a hundred times fewer than all of them at 0.9, and ever fewer in proportion."""
    small, large = N.plan(10**6, AT, 0.95), N.plan(10**9, AT, 0.95)
    assert large.compared < 10 * small.compared and large.tables < 200 and min(small.recall, large.recall) >= 0.95


def test_projections_follow_the_law(spark):
    draw = np.random.default_rng(1)
    x = unit(draw.normal(size=(3000, 24)))
    side = draw.normal(size=x.shape)
    side = unit(side - (side * x).sum(1)[:, None] * x)
    y = 0.8 * x + 0.6 * side
    way = N.Plan(6, 1, 3, 0.0, 0.0)
    looked, own = N.looked_into(x, way)[:, 0], N.codes(y, way)[0]
    assert (looked == own).any(axis=1).mean() == pytest.approx(N.met(6, 3, 0.8), abs=0.1)


def test_pairs_within_families_are_all_of_them(spark):
    """A family of many blocks beside small ones and rows of none; one table with itself and two with each other."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(3, 8))[rng.integers(0, 3, 400)] + 0.1 * rng.normal(size=(400, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    family = [None if i % 40 == 0 else "hot" if i % 2 else str(i // 6) for i in range(400)]
    rows = spark.createDataFrame([(i, v[i].tolist(), family[i]) for i in range(400)] + [(900, None, "hot")], "id long, vector array<double>, family string")
    near = np.round(v @ v.T, 6) >= 0.9
    want = {(a, b) for a in range(400) for b in range(400) if near[a, b] and family[a] == family[b]}
    for block in (16, 4096):
        found = [(r.a, r.b) for r in N.near_pairs_within(rows, 0.9, block=block).collect()]
        assert len(found) == len(set(found)) and set(found) == {(a, b) for a, b in want if a < b}
        found = [(r.a, r.b) for r in N.near_pairs_within(rows.where("id % 3 = 0"), 0.9, others=rows.where("id % 3 > 0"), block=block).collect()]
        assert len(found) == len(set(found)) and set(found) == {(a, b) for a, b in want if a % 3 == 0 and b % 3 > 0}
    assert N.near_pairs_within(rows.limit(0), 0.9).count() == 0
