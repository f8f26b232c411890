"""Data-quality operators on fixtures with one fault each."""

import pytest
from pyspark.sql import functions as F

from proofgrid.operators import order, quality


def test_two_sided_diff_sees_missing_unexpected_different_and_null_values(spark, rows):
    left = spark.createDataFrame([(1, 5), (2, 6), (3, None), (5, 1)], "k int, v int")
    right = spark.createDataFrame([(1, 5), (2, 7), (4, 1), (5, None)], "k int, v int")
    assert rows(quality.two_sided_diff(left, right, ["k"], "v")) == [(2, 6, 7, "different"), (3, None, None, "missing"), (4, None, 1, "unexpected"), (5, 1, None, "different")]


def test_contract_rules(spark):
    df = spark.createDataFrame([(1, "12345678901234567", "1.5", "2024-02-30"), (2, "123", "NaN", "2024-02-29"), (3, None, "x", None)], "id int, steam string, n string, d string")
    rules = {"steam": quality.field_rule(df, "steam", "digits17|null"), "n": quality.field_rule(df, "n", "number"), "d": quality.field_rule(df, "d", "date|null"), "gone": quality.field_rule(df, "gone", "string", required=False), "must": quality.field_rule(df, "must", "string")}
    found = {(r.id, r.rule) for r in quality.violations(df, "id", rules).collect()}
    assert found == {(2, "steam"), (2, "n"), (3, "n"), (1, "d"), (1, "must"), (2, "must"), (3, "must")}


def test_page_gaps_and_overlaps(spark):
    pages = spark.createDataFrame([("s", 0, [1, 2, 3], 3), ("s", 2, [3, 4, 5], 3), ("s", 5, [6], 3)], "s string, o int, ids array<int>, l int")
    found = quality.page_overlap(pages, ["s"], "o", "ids", "l").orderBy("o").collect()
    assert [(r.gap, r.overlap) for r in found] == [(None, None), (False, 1), (True, 0)]


def test_boundaries(spark):
    seen = spark.createDataFrame([("a", "start", 1, "h"), ("a", "end", 2, "h"), ("b", "start", 1, "h"), ("b", "end", 2, "i"), ("c", "start", 1, "h"), ("d", "start", 3, "h"), ("d", "end", 2, "h")], "k string, role string, at int, h string")
    assert {r.k: r.stable for r in quality.boundary_stability(seen, ["k"], "role", "at", "h").collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_fingerprints_ignore_order_and_see_every_value(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).cast("string").alias("v"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("n"))
    digest = lambda d, depth=None: quality.fingerprint(d, ["id", "v", "n"], "t", depth).first().digest
    assert digest(df) == digest(df.repartition(7).orderBy(F.desc("id"))) and digest(df, 0) != digest(df, 1)
    assert digest(df) != digest(df.withColumn("n", F.when(F.col("id") != 1501, F.col("n"))))


def test_positions_and_ranks_over_a_whole_table(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 50).cast("double").alias("m")).repartition(6)
    placed = order.positions(df, ["k"]).collect()
    assert all(r.k == r.position for r in placed)
    ranks = {(r.m, r.rank, r.of) for r in order.global_rank(df, "m").collect()}
    assert ranks == {(float(m), 1 + 100 * (49 - m), 5000) for m in range(50)}
    empty = order.global_rank(df.limit(0), "m")
    assert empty.count() == 0 and order.global_rank(spark.createDataFrame([(1, None)], "k int, m double"), "m").first()["rank"] is None


def test_chain_digest_of_groups_of_groups(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = [sha(str(i)) for i in range(10)]
    df = spark.createDataFrame(list(enumerate(digests)), "i long, d string")
    level = [sha("".join(digests[i : i + 4])) for i in range(0, 10, 4)]
    assert order.chain_digest(df, "i", "d", fan=4).first().digest == sha("".join(level))


def test_fullest_and_priority_choices_break_ties(spark):
    df = spark.createDataFrame([(1, "a", "xx", 1, 2), (2, "a", "yy", 1, 2), (3, "a", "z", 9, 1)], "seq int, k string, p string, pr int, n int")
    assert quality.prefer_fullest(df, ["k"], "p", "seq").first().seq == 1
    assert quality.pick_by_priority(df, ["k"], "pr", F.col("n"), "p").first().seq == 3


def test_samples_do_not_depend_on_partitions(spark, rows):
    df = spark.range(500).select("id", (F.col("id") % 9).alias("s"))
    assert rows(quality.hash_sample(df, "id", 20, "x")) == rows(quality.hash_sample(df.repartition(9), "id", 20, "x"))
    found = quality.stratified_sample(df, "id", "s", 30)
    assert found.count() == 30 and found.where("mandatory").count() == 9


def test_nested_json_leaves(spark, rows):
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"c": true, "d": {"e": "x"}}, "f": null}'), (2, "no json"), (3, None)], "id int, j string")
    assert rows(quality.json_leaves(df, "id", "j")) == [(1, "a", "integer", "1"), (1, "b.c", "boolean", "true"), (1, "b.d.e", "string", "x"), (1, "f", "null", None)]


def test_json_leaves_of_any_depth_and_in_arrays(spark, rows):
    df = spark.createDataFrame([(1, '{"a": {"b": {"c": {"d": {"e": 5}}}}, "l": [1, {"x": [true]}], "s": "[no list", "o": {}}')], "id int, j string")
    assert rows(quality.json_leaves(df, "id", "j")) == [(1, "a.b.c.d.e", "integer", "5"), (1, "l.0", "integer", "1"), (1, "l.1.x.0", "boolean", "true"), (1, "s", "string", "[no list")]


def test_roll_up(spark):
    assert tuple(quality.roll_up(spark.createDataFrame([("a", 0), ("b", 2)], "check string, n_failed int")).first()) == (2, 1, "incomplete")


@pytest.mark.parametrize("n", [0, 1])
def test_empty_tables(spark, n):
    df = spark.createDataFrame([(1, "a")][:n], "k int, v string")
    assert quality.duplicates(df, ["k"]).count() == 0 and quality.fingerprint(df, ["k", "v"], "t").count() == n
    assert quality.profile(df, "t", ["k"]).first().row_count == n


def test_json_types_are_those_written(spark, rows):
    """Strings that look like numbers, lists or constants are strings; an id that is a number is malformed."""
    found = [(1, '{"a": "123", "c": "true", "d": "[1]", "e": "NaN", "n": 1e3, "m": -7, "z": null, "dup": 1, "dup": "2"}'), (2, '{"id": 7656, "ids": ["76", 5, "x6"], "f": "1e999", "g": 1e999, "h": NaN}'), (3, "7"), (4, "[" * 100_000), (5, "{"), (6, None), (7, "[]")]
    df = spark.createDataFrame(found, "id int, j string").withColumn("path", F.lit("clash")).withColumn("type", F.lit("clash"))
    leaves = rows(quality.json_leaves(df, "id", "j"))
    want = [("a", "string", "123"), ("c", "string", "true"), ("d", "string", "[1]"), ("dup", "integer", "1"), ("dup", "string", "2"), ("e", "string", "NaN"), ("m", "integer", "-7"), ("n", "number", "1e3"), ("z", "null", None)]
    assert sorted((r[1:] for r in leaves if r[0] == 1), key=str) == sorted(want, key=str)
    assert [r[1:] for r in leaves if r[0] in (3, 4)] == [("", "integer", "7"), ("", "too-deep", None)]
    assert rows(quality.json_assertions(df, "id", "j", "ids?", "[0-9]{2}")) == [(1, 10, 0, 0), (2, 9, 2, 3), (3, 1, 0, 0), (4, 1, 0, 0), (5, 1, 0, 0), (6, 1, 0, 0), (7, 1, 0, 0)]
    assert quality.json_nodes(df.limit(0), "id", "j").count() == 0
