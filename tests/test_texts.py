"""Chunks, citations, HTML and graders on hand-made texts."""

import pytest
from pyspark.sql import functions as F

from proofgrid.operators import oplog, texts


def test_sections_and_lines():
    text = "---\na: b\n---\nintro\n# One\nbody\n## Two\nmore\n#### not a cut\n"
    assert [(h, line) for h, line, _ in texts.markdown_sections(text)] == [("(preamble)", 4), ("One", 6), ("Two", 8)]
    assert texts.markdown_sections("x\ny")[0] == ("(no-heading)", 1, "x\ny")


def test_long_sections_are_cut_at_blank_lines_then_lines_then_slices():
    paragraph, line = "p" * 100, "l" * 130
    body = f"{paragraph}\n\n{paragraph}\n\n" + "\n".join([line] * 3) + "\n\n" + "s" * 500 + "\n\ntiny"
    found = list(texts.markdown_chunks("# H\n" + body, most=200, least=80))
    assert [len(t) for _, _, t in found] == [100, 100, 130, 130, 130, 200, 200, 100]
    assert [line for _, line, _ in found] == [2, 4, 6, 7, 8, 10, 10, 10] and {h for h, _, _ in found} == {"H"}


def test_chunks_in_spark(spark):
    docs = spark.createDataFrame([(1, "# A\n" + "x" * 90), (2, None), (3, "short")], "id long, text string")
    assert [tuple(r) for r in texts.chunks(docs).collect()] == [(1, 0, "A", 2, "x" * 90)]


def test_citations_are_masked_and_parsed(spark, rows):
    text = "FACT one [source: /a/b.md:3] `[source: no.md]` <!-- [source: no2.md] -->\n```\n[source: no3.md]\n```\n[Source: ../c.md]"
    docs = spark.createDataFrame([(1, text), (2, None)], "id int, text string")
    cited = texts.citations(docs)
    assert rows(cited, "id", "place", "target", "line") == [(1, 0, "a/b.md", 3), (1, 1, "../c.md", None)]
    files = spark.createDataFrame([("a/b.md", "raw", 2)], "target string, layer string, n_lines int")
    assert {r.target: r.reason for r in texts.gated(cited, files, ["raw"]).collect()} == {"a/b.md": "line-empty-or-out-of-range", "../c.md": "path-traversal"}


def test_claims_need_a_citation_in_their_paragraph(spark):
    docs = spark.createDataFrame([(1, "FACT a\nDECISION b [source: x]\n\nFACT c"), (2, None)], "id int, text string")
    assert {r.id: (r.claims, r.covered) for r in texts.claim_coverage(docs).collect()} == {1: (3, 2), 2: (0, 0)}


def test_html(spark):
    html = '<h1>T</h1><script>x()</script><!-- c --><p>A <b>b</b> <a href="/u">l</a> &lt;&amp;lt;</p><ul><li>i</li></ul>'
    got = spark.createDataFrame([(html,), (None,)], "h string").select(texts.html_text(F.col("h")).alias("t"), texts.plain_text(F.col("h")).alias("p")).collect()
    assert got[0].t == "# T\nA **b** [l](/u) <&lt;\n- i" and got[1].t is None and got[1].p == ""


def test_html_with_attributes_lists_code_and_entities(spark):
    html = '<h4 class="x">T</h4><ol><li>a</li><li>b</li></ol><ul><li>c</li></ul><pre>x\n y</pre><strong id="1">s</strong> <A class=q HREF=\'/u\'>l</A> &mdash;&#33;&#8212;<blockquote>q</blockquote>'
    got = spark.createDataFrame([(html,)], "h string").select(texts.html_text(F.col("h")).alias("t")).first().t
    assert got == "#### T\n1. a\n1. b\n- c\n```\nx\n y\n```\n**s** [l](/u) \u2014!&#8212;\n> q"


def test_masks_keep_places_and_spans_lead_to_claims(spark):
    text = "FACT: a `[source: no]` b [source: x.md:3] and\nINFERENCE: c [source: y.md]"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    masked = {r.id: r.m for r in docs.select("id", texts.masked(F.col("text")).alias("m")).collect()}
    assert len(masked[1]) == len(text) and "no" not in masked[1] and masked[2] is None and masked[3] == ""
    found = [tuple(r) for r in texts.citation_spans(docs).orderBy("place").collect()]
    at = [text.index("[source: x"), text.index("[source: y")]
    assert found == [(1, 0, "x.md:3", at[0], at[0] + len("[source: x.md:3]"), "FACT", "a `[source: no]` b"), (1, 1, "y.md", at[1], len(text), "INFERENCE", "c")]


def test_critique_and_scan(spark, rows):
    judged = spark.createDataFrame([(1, "a", "missing-file", "FACT", None), (1, "b", None, "FACT", "weak"), (2, "c", None, "FACT", "strong"), (3, "d", None, None, "none")], "id int, citation string, reason string, label string, band string")
    uncovered = spark.createDataFrame([(2, 1), (3, 0)], "id int, n int")
    items = texts.critique(judged, uncovered)
    assert rows(items, "id", "severity", "reason", "action") == [(1, "error", "missing-file", "fix-path"), (1, "warn", "weak-support-weak", "downgrade-or-recite"), (2, "error", "uncited-claim", "add-citation")]
    docs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    assert texts.corpus_scan(docs, items, F.col("id") == 2).first().asDict() == {"files": 3, "failed": 1, "errors": 1, "warns": 1, "exempt": 1}


def test_graders(spark):
    cases = spark.createDataFrame([(1, "the CAUSE and FIX"), (2, None)], "id int, o string")
    assert [r.passed for r in texts.grade_contains(cases, "o", ["CAUSE"], ["nope"]).orderBy("id").collect()] == [True, False]
    assert [r.passed for r in texts.grade_contains(cases, "o").collect()] == [False, False]
    found = texts.grade_labels(cases, "o", ["CAUSE", "FIX", "RISK"], required=["FIX"], least=2).orderBy("id").collect()
    assert found[0].found == ["CAUSE", "FIX"] and found[0].passed and not found[1].passed


@pytest.mark.parametrize(
    "value, faults",
    [({"k": 1}, []), ({}, ["$.k: required"]), ({"k": True}, ["$.k: type"]), ({"k": 99}, ["$.k: maximum"]), ({"k": 1, "l": ["a", ""]}, ["$.l[1]: minLength"]), ({"k": 1, "e": "z"}, ["$.e: enum"]), ([], ["$: type"])],
)
def test_json_schema(value, faults):
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 9}, "l": {"type": "array", "items": {"type": "string", "minLength": 1}}, "e": {"enum": ["a"]}}}
    assert texts.schema_faults(value, schema) == faults


def test_next_or_last_and_run_summary(spark):
    log = spark.sql("select 1 u, timestamp_ntz'2024-01-01' t, 10 k union all select 1, timestamp_ntz'2024-03-01', 11 union all select 2, timestamp_ntz'2024-01-05', 12")
    assert {r.u: r.chosen for r in oplog.next_or_last(log, "u", "t", "k", "2024-02-01").collect()} == {1: 11, 2: 12}
    runs = spark.createDataFrame([("a", True, None, 1, 1), ("a", False, None, 1, 1), ("b", False, "x", None, 2)], "s string, passed boolean, error string, tokens_in long, tokens_out long")
    found = {r.s: (r.total, r.passed, r.failed, r.errored, r.pass_rate, r.tokens_in) for r in oplog.run_summary(runs, "s").collect()}
    assert found == {"a": (2, 1, 1, 0, 0.5, 2), "b": (1, 0, 0, 1, 0.0, 0), None: (3, 1, 1, 1, pytest.approx(0.333333), 2)}


def test_entities_and_nested_lists(spark):
    pages = {
        "&#1078; &#8212; x": "ж — x",
        "&#x436;&#X1F600; &#128512;": "ж😀 😀",
        "&#55296; &#7; &#9999999; &#38;lt; &amp;#65; &#1": "&#55296; &#7; &#9999999; &lt; &#65; &#1",
        "<ol><li>a<ul><li>b</li></ul></li><li>c</li></ol><ul><li>d<OL type=a><li>e</OL><li>f</ul>": "1. a\n- b\n1. c\n- d\n1. e\n- f",
        "</ul><li>x<ol><li>y": "- x\n1. y",
    }
    df = spark.createDataFrame([(h,) for h in pages], "h string")
    assert {r[0]: r[1] for r in df.select("h", texts.html_text(F.col("h"), every_entity=True)).collect()} == pages


def test_a_critique_of_citations_reads_the_texts_once(spark):
    from proofgrid.plans.texts import critique_items

    plan = critique_items(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 1
