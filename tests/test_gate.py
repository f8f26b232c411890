"""The gated append: rules one by one, near copies in the store and in the batch, two writers, repeated batches."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofgrid.sinks import dataset, gate

RULES = gate.Rules(layers=("raw", "corpus", "sources", "synthesis"), home="synthesis", barred=("corpus",), recall=1.0)
CARDS = "question string, answer string, vector array<double>"


def unit(*x):
    v = np.array([*x, *[0.0] * (8 - len(x))])
    return [float(y) for y in v / np.linalg.norm(v)]


@pytest.fixture
def files(spark):
    rows = [("raw/a.md", "raw", 3), ("corpus/x.md", "corpus", 9), ("sources/s.md", "sources", 5), ("synthesis/t.md", "synthesis", 5)]
    return spark.createDataFrame(rows, "target string, layer string, n_lines int")


def reasons(offered, refused):
    both = offered.join(refused, "card", "left").select("question", "reason", "detail")
    return {(r["question"], r["reason"]) for r in both.collect()}


def test_each_rule_has_its_reason(spark, files, tmp_path):
    cards = spark.createDataFrame(
        [
            ("good", "Yes [source: /raw/a.md:2] and [source: /sources/s.md]", unit(1)),
            ("bare", "No source, `[source: /raw/a.md]` is code", unit(0, 1)),
            ("lost", "[source: /raw/none.md]", unit(0, 0, 1)),
            ("line", "[source: /raw/a.md:7]", unit(0, 0, 0, 1)),
            ("barred", "[source: /corpus/x.md]", unit(0, 0, 0, 0, 1)),
            ("level", "[source: /synthesis/t.md]", unit(0, 0, 0, 0, 0, 1)),
            ("wordless", "[source: /raw/a.md]", None),
            (None, None, None),
        ],
        CARDS,
    )
    folder = f"file://{tmp_path}/store"
    offered, refused, number = gate.append(spark, cards, folder, files, RULES, "2024-05-01")
    assert reasons(offered, refused) == {
        ("good", None), ("wordless", None), ("bare", "no-citation"), ("", "no-citation"), ("lost", "missing-file"), ("line", "line-empty-or-out-of-range"), ("barred", "layer-not-allowed"), ("level", "layer-not-lower"),
    }
    stored = {r["question"]: r for r in gate.stored_cards(spark, folder, number).collect()}
    assert number == 1 and set(stored) == {"good", "wordless"}
    assert stored["good"]["sources"] == ["raw/a.md", "sources/s.md"] and stored["good"]["path"].startswith("synthesis/_answers/2024-05-01-good-")
    assert stored["good"]["markdown"] == "---\ntype: answer\nquestion: \"good\"\nverified: true\nverified_at: 2024-05-01\nstatus: verified\nrelated:\n  - raw/a.md\n  - sources/s.md\n---\n\n# good\n\nYes [source: /raw/a.md:2] and [source: /sources/s.md]\n"
    again = gate.append(spark, cards, folder, files, RULES, "2024-05-02")
    assert again[2] == 1 and {("good", "already-stored"), ("wordless", "already-stored")} <= reasons(*again[:2])


def test_near_copies_stay_out_of_store_and_batch(spark, files, tmp_path):
    folder, text = f"file://{tmp_path}/store", "[source: /raw/a.md]"
    first = spark.createDataFrame([("one", text, unit(1, 0))], CARDS)
    gate.append(spark, first, folder, files, RULES, "2024-05-01")
    second = spark.createDataFrame([("two", text, unit(1, 0.1)), ("three", text, unit(0, 1)), ("four", text, unit(0.1, 1)), ("bad", "none", unit(0, 0, 1)), ("fits", text, unit(0, 0, 1, 0.1))], CARDS)
    offered, refused, number = gate.append(spark, second, folder, files, RULES, "2024-05-01")
    got = reasons(offered, refused)
    assert ("two", "near-copy") in got and ("fits", None) in got and ("bad", "no-citation") in got
    assert {("three", "near-copy"), ("four", "near-copy")} & got and {("three", None), ("four", None)} & got
    assert number == 2 and gate.stored_cards(spark, folder, 2).count() == 3


def test_a_batch_is_judged_as_if_one_by_one(spark):
    """Chains and clusters against a loop over the rows in order."""
    rng = random.Random(5)
    for n, share in ((24, 0.1),):
        pairs = [(a, b, round(rng.uniform(0.9, 1), 3)) for a in range(n) for b in range(a + 1, n) if rng.random() < share or b == a + 1]
        entered, want = [], {}
        for b in range(n):
            near = sorted((-c, a) for a, x, c in pairs if x == b and a in entered)
            if not near:
                entered.append(b)
            want[b] = near
        got = {r["b"]: (r["a"], r["cosine"]) for r in gate.first_of_near(spark.createDataFrame(pairs, "a long, b long, cosine double")).collect()}
        assert set(got) == set(range(n)) - set(entered)
        assert all(got[b][0] in entered and (-got[b][1], got[b][0]) in want[b] for b in got)


def test_who_comes_second_judges_again(spark, files, tmp_path, monkeypatch):
    """Another writer commits a near copy between the judgement and the commit."""
    folder, text, calls = f"file://{tmp_path}/store", "[source: /raw/a.md]", []
    mine = spark.createDataFrame([("mine", text, unit(1, 0.1)), ("other", text, unit(0, 1))], CARDS)
    theirs = spark.createDataFrame([("theirs", text, unit(1))], CARDS)
    commit = dataset.publish_tables

    def late(*args, **kwargs):
        if not calls:
            calls.append(1)
            gate.append(spark, theirs, folder, files, RULES, "2024-05-01")
        return commit(*args, **kwargs)

    monkeypatch.setattr(dataset, "publish_tables", late)
    offered, refused, number = gate.append(spark, mine, folder, files, RULES, "2024-05-01")
    assert reasons(offered, refused) == {("mine", "near-copy"), ("other", None)}
    assert number == 2 and {r["question"] for r in gate.stored_cards(spark, folder, 2).collect()} == {"theirs", "other"}
    calls.clear()
    with pytest.raises(dataset.StaleWrite):
        theirs = spark.createDataFrame([("more", text, unit(0, 0, 1))], CARDS)
        gate.append(spark, spark.createDataFrame([("late", text, unit(0, 0, 0, 1))], CARDS), folder, files, RULES, "2024-05-01", tries=1)


def test_empty_batch_and_repeated_cards(spark, files, tmp_path):
    folder = f"file://{tmp_path}/store"
    assert gate.append(spark, spark.createDataFrame([], CARDS), folder, files, RULES, "2024-05-01")[2] == 0
    twice = spark.createDataFrame([("q", "[source: /raw/a.md]", unit(1)), ("q", "[source: /raw/a.md]", None)], CARDS).withColumn("path", F.lit("x"))
    offered, refused, number = gate.append(spark, twice, folder, files, replace(RULES, near=0.95), "2024-05-01")
    assert offered.count() == 1 and refused.isEmpty() and number == 1


def test_the_gate_looks_at_every_pair_unless_told_otherwise():
    assert gate.Rules(("low", "high"), "high").recall == 1


def test_a_family_keeps_only_its_own_near_copies_out(spark, files, tmp_path):
    folder, text = f"file://{tmp_path}/store", "[source: /raw/a.md]"
    rules = replace(RULES, family="substring_index(question, ' ', 1)")
    gate.append(spark, spark.createDataFrame([("a one", text, unit(1)), ("b one", text, unit(1, 0.1))], CARDS), folder, files, rules, "2024-05-01")
    batch = [("a two", text, unit(1, 0.1)), ("a far", text, unit(0, 1)), ("c one", text, unit(1)), ("c two", text, unit(1, 0.1)), ("d", text, unit(0, 1, 0.1)), ("d none", text, None)]
    offered, refused, number = gate.append(spark, spark.createDataFrame(batch, CARDS), folder, files, rules, "2024-05-02")
    got = reasons(offered, refused)
    assert {("a two", "near-copy"), ("a far", None), ("d", None), ("d none", None)} <= got
    assert len(got & {("c one", "near-copy"), ("c two", "near-copy")}) == len(got & {("c one", None), ("c two", None)}) == 1
    assert number == 2 and gate.stored_cards(spark, folder, 2).count() == 6


def test_query_equals_its_sql_where_originals_are_near_each_other(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    rng = np.random.default_rng(3)
    base = rng.normal(size=(3, 64))
    vectors = [(v / np.linalg.norm(v)).tolist() for v in (base[i % 3] + 0.01 * rng.normal(size=64) for i in range(24))]
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = [(r["vec_id"], r["verdict"], r["cards"]) for r in entry.queries()["gated_append"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.execute(entry.oracle_sql()["gated_append"]).fetchall())
