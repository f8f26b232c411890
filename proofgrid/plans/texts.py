"""Text queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.functions.columns import citation_line, citation_target, first_sentence, slug, snippet
from proofgrid.operators import texts
from proofgrid.operators.order import positions
from proofgrid.plans.registry import query
from proofgrid.session import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


@query(
    "chunk_documents",
    """WITH p AS (SELECT doc_id AS id, CASE WHEN length(text) <= 1200 THEN [text] ELSE flatten(list_transform(string_split(text, chr(10)), lambda l: list_transform(range(0, (greatest(length(l), 1) - 1) // 1200 + 1), lambda i: substring(l, i * 1200 + 1, 1200)))) END AS parts FROM documents WHERE text IS NOT NULL),
    k AS (SELECT id, list_filter(parts, lambda t: length(trim(t, ' ')) >= 80) AS parts FROM p)
    SELECT id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS chunk, unnest(parts) AS text FROM k""",
)
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts have neither headings nor blank lines, so lines and slices are all that cuts them."""
    return texts.line_chunks(documents(spark, sf_dir))


@query("chunk_markdown")
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full chunker over the same texts with headings put before every tenth line; tested on fixtures."""
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda line, i: F.when(i % 10 == 5, F.concat(F.lit("## "), F.substring(line, 1, 30), F.lit("\n\n"), line)).otherwise(line)), "\n")
    return texts.chunks(documents(spark, sf_dir).select("id", marked.alias("text")))


HREFS_SQL = "h AS (SELECT page_id AS id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS t FROM pages)"


@query("extract_citations", f"WITH {HREFS_SQL} SELECT id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS place, unnest(t) AS target FROM h")
def extract_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data has no bracketed citations; hrefs stand for them."""
    return texts.hrefs(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "html"))


@query(
    "layer_order_violations",
    f"""WITH {HREFS_SQL}, c AS (SELECT DISTINCT id AS src, unnest(t) AS dst FROM h), r AS (SELECT dst, length(dst) % 7 AS k FROM (SELECT DISTINCT dst FROM c))
    SELECT src, c.dst, CAST(src % 7 AS BIGINT) AS src_rank, CAST(k AS BIGINT) AS dst_rank FROM c JOIN r ON r.dst = c.dst WHERE k >= src % 7""",
)
def layer_order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ids by 7 are the layers of pages, lengths by 7 those of targets."""
    cited = texts.hrefs(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "html")).select(F.concat(F.lit("page:"), "id").alias("src"), F.col("target").alias("dst")).distinct()
    layers = table(spark, sf_dir, "pages").select(F.concat(F.lit("page:"), "page_id").alias("node"), (F.col("page_id") % 7).alias("rank"))
    targets = cited.select(F.col("dst").alias("node")).distinct().withColumn("rank", (F.length("node") % 7).cast("long"))
    found = texts.layer_violations(cited, layers.unionByName(targets))
    return found.withColumn("src", F.substring("src", 6, 20).cast("long"))


ROLES = ("system", "user", "assistant")


@query(
    "grader_contains",
    """WITH c AS (SELECT conv_id, turn, (CAST(contains(text, 'e') AS INTEGER) + CAST(NOT contains(text, 'zz') AS INTEGER) + CAST(regexp_matches(text, '[.]$') AS INTEGER)) AS held FROM conversations)
    SELECT conv_id, turn, round(held / 3.0::DOUBLE, 6) AS score, held = 3 AS passed FROM c""",
)
def grader_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = texts.graded(table(spark, sf_dir, "conversations"), "contains", "text", must=["e"], must_not=["zz"], patterns=["[.]$"])
    return cases.select("conv_id", "turn", F.round("score", 6).alias("score"), "passed")


@query(
    "grader_labels",
    r"""WITH f AS (SELECT conv_id, turn, list_sort(list_distinct(list_filter(string_split_regex(coalesce(text, ''), '[^\p{L}\p{N}_]+'), lambda w: w IN ('the', 'and', 'que', 'der', 'les')))) AS found FROM conversations)
    SELECT conv_id, turn, array_to_string(found, ',') AS found, len(found) >= 1 AND NOT list_contains(found, 'der') AS passed FROM f""",
)
def grader_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = texts.graded(table(spark, sf_dir, "conversations"), "labels", "text", labels=["the", "and", "que", "der", "les"], forbidden=["der"], least=1)
    return cases.select("conv_id", "turn", F.array_join("found", ",").alias("found"), "passed")


@query("grader_schema", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) <= 90 AS passed FROM events")
def grader_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 90}}}
    return texts.graded(table(spark, sf_dir, "events"), "schema", "props", schema=schema).select("event_id", "passed")


@query("html_to_text", r"SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'), ' ') AS text FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", texts.plain_text(F.col("html")).alias("text"))


@query("html_to_markdown")
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewrites with look-behind of groups; tested on fixtures."""
    return table(spark, sf_dir, "pages").select("page_id", texts.html_text(F.col("html")).alias("text"))


@query(
    "rule_categorize",
    """SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'DROP' WHEN p_type = 'LARGE' THEN 'big' WHEN starts_with(p_type, 'S') THEN 's-types' WHEN starts_with(p_type, 'E') THEN 'economy' ELSE 'DROP' END AS category FROM part""",
)
def rule_categorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.categorized(table(spark, sf_dir, "part"), "p_type", ["PROMO"], {"LARGE": "big"}, [("S", "s-types"), ("E", "economy")]).select("p_partkey", "category")


@query(
    "first_sentence",
    r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' ') AS t FROM documents), s AS (SELECT doc_id, t, regexp_extract(t, '^([^.!?]*(?:[.!?]+[^ .!?][^.!?]*)*[.!?]+)(?: |$)', 1) AS s FROM f),
    w AS (SELECT doc_id, CASE WHEN s = '' THEN t ELSE s END AS s FROM s) SELECT doc_id, CASE WHEN length(s) > 200 THEN concat(rtrim(substring(s, 1, 200), ' '), '…') ELSE s END AS sentence FROM w""",
)
def first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", first_sentence(F.col("text")).alias("sentence"))


@query(
    "snippets_and_slugs",
    r"""WITH f AS (SELECT doc_id, source, lang, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' ') AS t FROM documents)
    SELECT doc_id, CASE WHEN length(t) > 240 THEN concat(substring(t, 1, 240), '…') ELSE t END AS snippet, concat(source, '-', lang) AS slug FROM f""",
)
def snippets_and_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", snippet(F.col("text")).alias("snippet"), slug(F.concat_ws(" / ", F.initcap("source"), "lang")).alias("slug"))


@query(
    "dashboard_filter_sort",
    """SELECT s_suppkey, s_name, s_acctbal, row_number() OVER (ORDER BY s_acctbal ASC NULLS LAST, s_suppkey) AS place FROM supplier WHERE contains(lower(s_name), '7')""",
)
def dashboard_filter_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive substring filter, then places by a column where lower is better."""
    kept = table(spark, sf_dir, "supplier").where(F.contains(F.lower("s_name"), F.lit("7"))).select("s_suppkey", "s_name", "s_acctbal")
    return positions(kept, [F.asc_nulls_last("s_acctbal"), F.asc("s_suppkey")]).select("s_suppkey", "s_name", "s_acctbal", (F.col("position") + 1).alias("place"))


@query(
    "claim_coverage",
    r"""WITH p AS (SELECT doc_id AS id, unnest(string_split(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), chr(10) || chr(10))) AS p FROM documents), n AS (SELECT id, CAST(contains(p, 'The') AS INTEGER) AS n, regexp_matches(p, 'and') AS c FROM p)
    SELECT id, CAST(sum(n) AS BIGINT) AS claims, CAST(sum(CASE WHEN c THEN n ELSE 0 END) AS BIGINT) AS covered FROM n GROUP BY id""",
)
def claim_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with 'The' read as claims and 'and' as citations, as the texts have neither; each line is a paragraph."""
    line = F.transform(F.split("text", "\n"), lambda s: F.concat(F.when(F.contains(s, F.lit("The")), "FACT").otherwise(""), F.when(F.contains(s, F.lit("and")), " [source: x]").otherwise("")))
    return texts.claim_coverage(documents(spark, sf_dir).select("id", F.array_join(line, "\n\n").alias("text")))


@query(
    "page_edges",
    """WITH r AS (SELECT page_id, 'href' AS kind, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages UNION ALL SELECT page_id, 'src', unnest(regexp_extract_all(html, 'src="([^"]*)"', 1)) FROM pages)
    SELECT * FROM r WHERE NOT regexp_matches(target, '^([a-zA-Z][a-zA-Z0-9+.-]*:|//)')""",
)
def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No page has import statements, so the SQL has no branch for them."""
    return texts.page_edges(table(spark, sf_dir, "pages"), "page_id")


@query("meta_hints", "SELECT doc_id, concat('[meta: lang=', lang, CASE WHEN n_chars > 1000 THEN concat('; size=', n_chars) ELSE '' END, '] ') AS hint FROM documents WHERE lang IS NOT NULL")
def meta_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    fields = F.map_filter(F.create_map(F.lit("size"), F.when(F.col("n_chars") > 1000, F.col("n_chars").cast("string")), F.lit("other"), F.lit("x"), F.lit("lang"), F.col("lang")), lambda k, v: v.isNotNull())
    return docs.select("doc_id", texts.meta_hint(fields, ["lang", "date", "size"]).alias("hint"))


#: The lines of the documents as cited claims: a label by the line's number, the line without marks, a citation, and an example that is none.
CITED_SQL = """l AS (SELECT doc_id AS id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS place, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
cited AS (SELECT id, place, concat('layer', place % 3, '/f', place % 5, '.md') AS target, place % 4 AS line_no, CASE place % 4 WHEN 0 THEN 'FACT' WHEN 1 THEN 'INFERENCE' WHEN 3 THEN 'DECISION' END AS label,
  trim(translate(line, '`<>~[]:' || chr(9) || chr(13), '         '), ' ') AS claim FROM l),
gate AS (SELECT *, CASE WHEN place % 3 = 2 OR place % 3 = 1 AND place % 5 = 4 THEN 'missing-file' WHEN place % 3 = 1 THEN 'layer-not-allowed' WHEN line_no IN (0, 3) THEN 'line-empty-or-out-of-range' END AS reason FROM cited)"""


def cited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = lambda i, n: (i % n).cast("string")
    label = lambda i: F.when(i % 4 == 0, "FACT: ").when(i % 4 == 1, "INFERENCE: ").when(i % 4 == 3, "DECISION: ").otherwise("")
    plain = lambda line: F.translate(line, "`<>~[]:\t\r", "         ")
    cited = lambda line, i: F.concat(label(i), F.lit("`[source: an/example.md]` "), plain(line), F.lit(" [source: /layer"), remainder(i, 3), F.lit("/f"), remainder(i, 5), F.lit(".md:"), remainder(i, 4), F.lit("]"))
    return documents(spark, sf_dir).where("text IS NOT NULL").select("id", F.array_join(F.transform(F.split("text", "\n"), cited), "\n").alias("text"))


def cited_files(spark: SparkSession) -> DataFrame:
    """Nine files of two layers, two lines each."""
    rows = [(f"layer{a}/f{b}.md", f"layer{a}", 2) for a in (0, 1) for b in range(5) if (a, b) != (1, 4)]
    return spark.createDataFrame(rows, "target string, layer string, n_lines int")


def gated_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.gated(texts.citations(cited_documents(spark, sf_dir)), cited_files(spark), ["layer0"])


@query("citations_gate", f"WITH {CITED_SQL} SELECT id, place, target, line_no AS line, reason FROM gate")
def citations_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated_citations(spark, sf_dir).select("id", "place", "target", "line", "reason")


@query("citation_claims", f"WITH {CITED_SQL} SELECT id, place, label, ltrim(rtrim(substring(concat('`[source: an/example.md]` ', claim), 1, 200), ' '), ' ') AS claim FROM cited")
def citation_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before each citation; examples in code do not count as citations but stay in the claim."""
    found = texts.citation_spans(cited_documents(spark, sf_dir))
    return found.select("id", "place", "label", F.trim(F.regexp_replace("claim", "` +", "` ")).alias("claim"))


@query(
    "citation_critique",
    f"""WITH {CITED_SQL}, b AS (SELECT *, CASE place % 3 WHEN 0 THEN CASE WHEN id % 2 = 0 THEN 'weak' ELSE 'strong' END END AS band FROM gate)
    SELECT id, place, 'error' AS severity, reason, CASE reason WHEN 'missing-file' THEN 'fix-path' WHEN 'layer-not-allowed' THEN 're-cite' ELSE 'fix-line' END AS action FROM b WHERE reason IS NOT NULL
    UNION ALL SELECT id, place, 'warn', 'weak-support-weak', 'downgrade-or-recite' FROM b WHERE reason IS NULL AND label = 'FACT' AND band = 'weak'""",
)
def citation_critique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return critique_items(spark, sf_dir).select("id", F.col("citation").cast("int").alias("place"), "severity", "reason", "action")


def critique_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critique of all citations, each named by its place; even ids read as weakly supported."""
    spans = texts.citation_spans(cited_documents(spark, sf_dir)).select("id", "place", "label", "citation")
    cited = spans.withColumns({"target": citation_target(F.col("citation")), "line": citation_line(F.col("citation"))})
    judged = texts.gated(cited, cited_files(spark), ["layer0"]).withColumn("band", F.when(F.col("id") % 2 == 0, "weak").otherwise("strong"))
    return texts.critique(judged.withColumn("citation", F.col("place").cast("string")))


@query(
    "corpus_scan",
    f"""WITH {CITED_SQL}, c AS (SELECT id, count(CASE WHEN reason IS NOT NULL THEN 1 END) AS e, count(CASE WHEN reason IS NULL AND label = 'FACT' AND id % 2 = 0 THEN 1 END) AS w FROM gate GROUP BY id),
    d AS (SELECT doc_id AS id, doc_id % 10 = 3 AS x FROM documents WHERE text IS NOT NULL)
    SELECT count(CASE WHEN NOT x THEN 1 END) AS files, count(CASE WHEN NOT x AND e > 0 THEN 1 END) AS failed, CAST(coalesce(sum(CASE WHEN NOT x THEN e END), 0) AS BIGINT) AS errors, CAST(coalesce(sum(CASE WHEN NOT x THEN w END), 0) AS BIGINT) AS warns, count(CASE WHEN x THEN 1 END) AS exempt FROM d LEFT JOIN c USING (id)""",
)
def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents but those whose id ends in 3, which are exempt."""
    docs = documents(spark, sf_dir).where("text IS NOT NULL").select("id")
    return texts.corpus_scan(docs, critique_items(spark, sf_dir), F.col("id") % 10 == 3)
