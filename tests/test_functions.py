"""Scalar functions against hand-made cases and small loops."""

import posixpath

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofgrid.functions import columns as C
from proofgrid.sources import readers


def over(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_ratio_is_null_not_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (1.0, 4.0)], "n double, d double")
    assert [r.x for r in df.select(C.ratio("n", "d").alias("x")).collect()] == [None, None, 0.25]


def test_half_up_rounds_towards_plus_infinity(spark):
    assert over(spark, [-2.5, 2.5, 0.125, None], lambda c: C.half_up(c), "double") == [-2.0, 3.0, 0.0, None]


def test_decay_and_reciprocal_rank(spark):
    assert over(spark, [0, 180, -5], lambda c: C.decay(c, 180.0), "int") == [1.0, 0.5, 1.0]
    assert over(spark, [1, None], lambda c: C.reciprocal_rank(c), "int") == [pytest.approx(1 / 61), 0.0]


def test_names_and_paths(spark):
    assert over(spark, ["  Ёлка & Map--1 ", "", None], C.slug) == ["ёлка-map-1", "", None]
    assert over(spark, ["roundsPlayed", "kebab-Case", "ID"], C.snake) == ["rounds_played", "kebab_case", "id"]
    assert over(spark, ["$.a[0].b", "$.a[3]", "$"], C.last_path_name) == ["b", "a", None]
    assert over(spark, ["./x/y.md:12", "/z.md", "w.md:3-9"], C.citation_target) == ["x/y.md", "z.md", "w.md"]
    assert over(spark, ["x:12", "x", "w.md:3-9"], C.citation_line) == [12, None, 3]
    assert over(spark, ["de_Dust-2", "Mirage"], C.context_key) == ["dust2", "mirage"]


def test_sentences_and_snippets(spark):
    assert over(spark, ["One. Two.", "v1.2 is out! Yes", "no end", "", "x" * 300], C.first_sentence) == ["One.", "v1.2 is out!", "no end", "", "x" * 200 + "…"]
    assert over(spark, ["a \n b", "y" * 250], C.snippet) == ["a b", "y" * 240 + "…"]


def test_dates(spark):
    assert [str(x) for x in over(spark, ["2026-02-30", "2024-02-29", "2024-2-1", None], C.strict_date)] == ["None", "2024-02-29", "None", "None"]
    assert over(spark, ["2027-01-01", "2024-01-01"], lambda c: C.iso_week(c.cast("date"))) == ["2026-W53", "2024-W01"]


def test_request_key_sorts_encodes_and_drops_nulls(spark):
    df = spark.createDataFrame([({"b": "x y", "a": "1", "n": None},), ({},)], "m map<string,string>")
    assert [r.x for r in df.select(C.request_key(F.lit("/p"), F.col("m")).alias("x")).collect()] == ["/p?a=1&b=x+y", "/p"]


def test_patch_sets_removes_and_cuts(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "", "c": "z" * 30})], "o map<string,string>, p map<string,string>")
    assert df.select(C.patched(F.col("o"), F.col("p"), 20).alias("x")).first().x == {"a": "1", "c": "z" * 20}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "..", ".", ""]), max_size=6), min_size=1, max_size=8))
def test_paths_resolve_like_a_loop(spark, cases):
    texts = ["/".join(c) for c in cases]

    def loop(path):
        at, out = [], False
        for s in path.split("/"):
            if s == "..":
                out |= not at
                at = at[:-1]
            elif s not in ("", "."):
                at.append(s)
        return "/".join(at), ".." in path.split("/"), out

    assert [tuple(r) for r in over(spark, texts, C.resolved)] == [loop(t) for t in texts]
    assert all(posixpath.normpath("/" + t).lstrip("/") == loop(t)[0] for t in texts)


def test_front_matter_and_related(spark):
    text = "---\ntitle: 'A b'\nrelated: [x.md, 'y.md']\ntitle: C\n---\n# Body\n"
    block = "---\nrelated:\n  - x.md\n  - y.md\n  - x.md\n---\nBody"
    m = over(spark, [text, "no front", ""], readers.front_matter)
    assert m[0].fields["title"] == "C" and m[0].body == "# Body\n" and m[1].body == "no front" and m[1].fields == {} and m[2].body == ""
    assert over(spark, [text, block, "none"], readers.related) == [["x.md", "y.md"], ["x.md", "y.md"], []]


def test_normal_form(spark):
    assert over(spark, ["ＡＢ１", None], C.normal_form) == ["AB1", None]
