"""The kept index against BM25 over the texts: built, updated by file, purged, compacted, pruned by its maxima, by two writers."""

import random

import pytest
from pyspark.sql import functions as F

from proofgrid.operators import lexical_index as L
from proofgrid.operators import retrieval as R
from proofgrid.sinks.dataset import StaleWrite
from proofgrid.sinks.storage import names


def texts(n, seed, words=300):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    return [" ".join(draw.choices(vocabulary, [1 / (1 + k) for k in range(words)], k=draw.randint(0, 40))) for _ in range(n)]


def frame(spark, found):
    return spark.createDataFrame(sorted((i, f, t) for i, (f, t) in found.items()), "id long, file string, text string").repartition(3)


@pytest.fixture
def folder(tmp_path, monkeypatch):
    monkeypatch.setattr(L, "SLOTS", 4)
    return f"file://{tmp_path}/index"


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate([*texts(12, 1), "w299", "nowhere", "", "W1 w1 w2, w3"])], "qid long, text string")


def same(spark, rows, folder, asked, held, k=5):
    """The index and a scan of the texts it should hold give the same hits."""
    want = R.bm25(asked, frame(spark, held).select("id", "text"), k, phrases=False)
    assert rows(L.search(spark, folder, asked, k).select("qid", "id", "score", "rank")) == rows(want.select("qid", "id", "score", "rank"))


def test_an_index_that_is_kept_gives_what_a_scan_gives(spark, rows, folder, asked, monkeypatch):
    monkeypatch.setattr(L, "WIDTH", 16)
    held = {i: (f"f{i // 4}", t) for i, t in enumerate(texts(200, 2))}
    held |= {900: ("odd", None), 901: ("odd", "")}
    assert L.update(spark, folder, frame(spark, held)) == 1
    same(spark, rows, folder, asked, held)
    # files change, come and go: fewer documents than before, other texts, a new file, a purge
    new = {0: ("f0", "w1 w1 w1"), 5: ("f1", "w299 w298"), 6: ("f1", "w2"), 1000: ("fresh", "w5 w299")}
    L.update(spark, folder, frame(spark, new), purge=spark.createDataFrame([("f7",), ("unknown",)], "file string"))
    held = {i: x for i, x in held.items() if x[0] not in ("f0", "f1", "f7")} | new
    same(spark, rows, folder, asked, held)
    L.update(spark, folder, frame(spark, {0: ("f0", "w1"), 28: ("f7", "back w7")}))
    held = {i: x for i, x in held.items() if x[0] != "f0"} | {0: ("f0", "w1"), 28: ("f7", "back w7")}
    assert L.live_docs(spark, folder).count() == len(held) == L.state(spark, folder)["n_docs"]
    before = L.sweep(spark, folder, grace=0)
    same(spark, rows, folder, asked, held)
    L.compact(spark, folder)
    assert before == [] and len(L.sweep(spark, folder, keep=1, grace=0)) == 15 and len(names(spark, f"{folder}/docs")) == 1
    same(spark, rows, folder, asked, held)
    assert {r.id for r in L.search(spark, folder, asked, 5, keep=spark.range(0, 50).toDF("id")).collect()} <= set(range(50))


def test_ranges_that_cannot_matter_are_not_read(spark, rows, folder, monkeypatch):
    """A rare word stands in a few files: once ten documents with it are known, no range without it is read."""
    monkeypatch.setattr(L, "WIDTH", 20)
    held = {i: (f"f{i // 10:03d}", "common word" + (" rare" * 3 if i // 20 in (7, 8) else "") + " pad" * (i % 5)) for i in range(1000)}
    L.update(spark, folder, frame(spark, held))
    found = L.Search(spark, folder, spark.createDataFrame([(1, "rare common")], "qid long, text string"), 10)
    hits = found.run()
    assert found.ranges().count() == 50 and found.rest.count() == 0 and all(r.id // 20 in (7, 8) for r in hits.collect())
    assert rows(hits.select("qid", "id", "score")) == rows(R.bm25(spark.createDataFrame([(1, "rare common")], "qid long, text string"), frame(spark, held).select("id", "text"), 10, phrases=False).select("qid", "id", "score"))


def test_only_the_slots_and_terms_asked_for_are_scanned(spark, folder):
    L.update(spark, folder, frame(spark, {i: ("f", t) for i, t in enumerate(texts(60, 3))}))
    found = L.Search(spark, folder, spark.createDataFrame([(1, "w1 w2")], "qid long, text string"), 10)
    plan = found.scored(found.ranges())._jdf.queryExecution().executedPlan().toString()
    assert len(found.slots) <= 2 and "PartitionFilters: [isnotnull(slot" in plan or "slot#" in plan.split("PartitionFilters")[1][:200]
    assert "PushedFilters: [In(term, [w1,w2])" in plan or "In(term, [w2,w1])" in plan


def test_of_two_updates_from_one_state_the_later_is_refused(spark, rows, folder, asked, monkeypatch):
    held = {i: (f"f{i}", t) for i, t in enumerate(texts(20, 4))}
    L.update(spark, folder, frame(spark, held))
    old = L.state(spark, folder)
    L.update(spark, folder, frame(spark, {3: ("f3", "w9 w9")}))
    monkeypatch.setattr(L, "state", lambda s, f, n=None: old)
    with pytest.raises(StaleWrite):
        L.update(spark, folder, frame(spark, {4: ("f4", "w9")}))
    monkeypatch.undo()
    same(spark, rows, folder, asked, held | {3: ("f3", "w9 w9")})


def test_an_empty_index_and_empty_updates(spark, folder, asked):
    assert L.search(spark, folder, asked).count() == 0
    L.update(spark, folder, frame(spark, {1: ("a", "w1")}).limit(0))
    assert L.search(spark, folder, asked).count() == 0
    L.update(spark, folder, frame(spark, {1: ("a", "w1")}))
    L.update(spark, folder, frame(spark, {2: ("b", None)}), purge=spark.createDataFrame([("a",)], "file string"))
    assert L.search(spark, folder, asked).count() == 0 and L.state(spark, folder)["n_docs"] == 1


def test_ranges_are_scored_in_one_task_each(spark, rows, folder, monkeypatch):
    monkeypatch.setattr(L, "WIDTH", 16)
    docs = spark.createDataFrame([(i, i // 3, None if i % 11 == 0 else " ".join(f"w{(i * j) % 13}" for j in range(i % 9))) for i in range(90)] + [(5, 1, "w1 w1 w2 w3 w4"), (5, 1, "w1 w1 w2 w3 w4")], "id long, file long, text string")  # an id comes three times
    L.update(spark, folder, docs)
    L.update(spark, folder, docs.where("file % 4 = 1 AND id <> 5").withColumn("text", F.lit("w1 w2 new")), purge=spark.createDataFrame([(7,)], "file long"))
    asked = spark.createDataFrame([(q, f"w{q} w{q + 1} w{q + 1} new") for q in range(6)], "qid long, text string")
    found = L.Search(spark, folder, asked, 4, keep=docs.where("id % 5 > 0").select("id"))
    best = found.best(found.ranges())
    assert "FlatMapGroups" in best._jdf.queryExecution().toString()
    assert rows(L.top_k(best, "score", 4)) == rows(L.top_k(found.scored(found.ranges()), "score", 4)) == rows(found.run()) != []
