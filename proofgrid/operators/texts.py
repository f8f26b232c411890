"""Text operators: chunks, citations and their checks, HTML to text, categories, graders of outputs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from proofgrid.functions.columns import citation_line, citation_target, let, ratio
from proofgrid.session import ship_package

MOST, LEAST = 1200, 80
CITATION = r"(?i)\[source:\s*([^\]]+)\]"


def line_chunks(docs: DataFrame, most: int = MOST, least: int = LEAST) -> DataFrame:
    """id, chunk, text: texts without headings or blank lines in JVM functions only.

    A text of at most `most` characters is one chunk; others are cut at line ends, and longer lines in slices of `most`;
    chunks of under `least` characters go.
    """
    whole = F.length("text") <= most
    slices = lambda line: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(line), F.lit(1)) - 1) / most).cast("int")), lambda i: F.substring(line, i * most + 1, F.lit(most)))
    parts = F.when(whole, F.array("text")).otherwise(F.flatten(F.transform(F.split("text", "\n"), slices)))
    kept = F.filter(parts, lambda p: F.length(F.trim(p)) >= least)
    return docs.where("text IS NOT NULL").select("id", F.posexplode(kept).alias("chunk", "text"))


def markdown_sections(text: str) -> list[tuple[str, int, str]]:
    """(heading, first line from 1, body) of the parts of a Markdown text that headings of levels 1 to 3 start.

    Front matter is skipped; what stands before the first heading is (preamble), or (no-heading) without any.
    """
    lines = text.split("\n")
    first = 0
    if lines and lines[0].strip() == "---":
        end = next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), None)
        first = end + 1 if end is not None else 0
    marks = [i for i in range(first, len(lines)) if re.match(r"#{1,3}\s+\S", lines[i])]
    before = "(preamble)" if marks else "(no-heading)"
    starts = [(before, first, first)] + [(lines[i].lstrip("#").strip(), i, i + 1) for i in marks]
    ends = [*marks, len(lines)]
    return [(heading, body + 1, "\n".join(lines[body:end])) for (heading, _, body), end in zip(starts, ends)]


def markdown_chunks(text: str, most: int = MOST, least: int = LEAST) -> Iterator[tuple[str, int, str]]:
    """(heading, line, text): sections; those over `most` are cut at blank lines, then at line ends, then in slices."""
    for heading, line, body in markdown_sections(text):
        pieces = [(line, body)]
        for cut in ("\n\n", "\n"):
            smaller = []
            for at, piece in pieces:
                if len(piece) <= most:
                    smaller.append((at, piece))
                    continue
                for part in piece.split(cut):
                    smaller.append((at, part))
                    at += part.count("\n") + len(cut)
            pieces = smaller
        for at, piece in pieces:
            for i in range(0, max(len(piece), 1), most):
                part = piece[i : i + most]
                if len(part.strip()) >= least:
                    yield heading, at + piece.count("\n", 0, i), part


def chunks(docs: DataFrame, most: int = MOST, least: int = LEAST) -> DataFrame:
    """id, chunk, heading, line, text of Markdown documents (id, text), in Arrow batches."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                rows += [(id_, k, *c) for k, c in enumerate(markdown_chunks(text or "", most, least))]
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = [batch.schema.field("id").type, pa.int32(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "chunk", "heading", "line", "text"])

    ship_package(docs.sparkSession)
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, chunk int, heading string, line int, text string")


def blanked(text: Column, pattern: str) -> Column:
    """Text with every match of a pattern replaced by spaces, line breaks kept, so that all places stay what they were."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    blank = F.transform(F.concat(matches, F.array(F.lit(""))), lambda m: F.regexp_replace(m, r"[^\n]", " "))
    return F.array_join(F.zip_with(gaps, blank, lambda gap, m: F.concat(gap, m)), "")


def masked(text: Column) -> Column:
    """Text whose HTML comments, code fences and inline code are blank, so that citations in them do not count and all others keep their places."""
    out = text
    for pattern in (r"(?s)<!--.*?-->", r"(?s)```.*?```", r"(?s)~~~.*?~~~", r"`[^`\n]+`"):
        out = let(out, lambda t: F.when(t.rlike(pattern), blanked(t, pattern)).otherwise(t))  # noqa: B023
    return out


def citations(docs: DataFrame, pattern: str = CITATION, group: int = 1) -> DataFrame:
    """id, place, citation, target, line of every citation in documents (id, text), in order."""
    found = F.regexp_extract_all(masked(F.col("text")), F.lit(pattern), group)
    each = docs.select("id", F.posexplode(found).alias("place", "citation"))
    return each.select("id", "place", "citation", citation_target(F.col("citation")).alias("target"), citation_line(F.trim("citation")).alias("line"))


LABELS = ("FACT", "INFERENCE", "ASSUMPTION", "DECISION")


def citation_spans(docs: DataFrame, pattern: str = CITATION, labels: Sequence[str] = LABELS) -> DataFrame:
    """id, place, citation, start, end, label, claim of every citation: offsets from 0 and what stands before it, after the citation before.

    label is the last `NAME:` there; claim is its last line without a leading label, at most 200 characters.
    """
    text = docs.select("id", "text", masked(F.col("text")).alias("m"))
    found = text.select("id", "text", F.regexp_extract_all("m", F.lit(pattern), 0).alias("whole"), F.regexp_extract_all("m", F.lit(pattern), 1).alias("inner"), F.split("m", pattern, -1).alias("gaps"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    last = lambda spans: F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0))
    both = F.zip_with(F.slice("gaps", F.lit(1), F.size("whole")), F.col("whole"), lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    spans = F.aggregate(both, none, lambda done, x: F.concat(done, F.array(F.struct((last(done) + x["g"]).alias("start"), (last(done) + x["g"] + x["m"]).alias("end")))))
    placed = found.where(F.size("whole") > 0).withColumn("spans", spans)
    each = placed.select("id", "text", "spans", F.posexplode("inner").alias("place", "citation"))
    at = F.get("spans", F.col("place"))
    before = F.coalesce(F.get("spans", F.col("place") - 1)["end"], F.lit(0))
    each = each.select("id", "place", "citation", at["start"].alias("start"), at["end"].alias("end"), F.substring(F.col("text"), before + 1, at["start"] - before).alias("span"))
    names = "|".join(labels)
    label = F.try_element_at(F.regexp_extract_all("span", F.lit(rf"\b({names})\s*:"), 1), F.lit(-1))
    claim = F.trim(F.regexp_replace(F.substring_index("span", "\n", -1), rf"(?i)^\s*({names})\s*:\s*", ""))
    return each.select("id", "place", F.trim("citation").alias("citation"), "start", "end", label.alias("label"), F.substring(claim, 1, 200).alias("claim"))


def gated(cited: DataFrame, files: DataFrame, layers: Sequence[str], external: Sequence[str] = ()) -> DataFrame:
    """Adds reason: the first rule that a citation breaks, or null. files: target, layer, n_lines, and, if known, blank_lines (numbers)."""
    both = cited.join(files, "target", "left")
    reason = (
        F.when(F.array_contains(F.split("target", "/"), "..") | F.col("citation").startswith(".."), "path-traversal")
        .when(F.col("layer").isNull(), "missing-file")
        .when(F.col("layer").isin(*external), "external-corpus-not-citable")
        .when(~F.col("layer").isin(*layers), "layer-not-allowed")
        .when((F.col("line") < 1) | (F.col("line") > F.col("n_lines")) | (F.array_contains("blank_lines", F.col("line")) if "blank_lines" in files.columns else F.lit(False)), "line-empty-or-out-of-range")
    )
    return both.withColumn("reason", reason).select(*cited.columns, "layer", "reason")


def claim_coverage(docs: DataFrame) -> DataFrame:
    """id, claims, covered: lines that state a FACT or DECISION, and how many of them stand in a paragraph with a citation."""
    paragraphs = docs.select("id", F.explode(F.split(F.coalesce("text", F.lit("")), r"\n[ \t]*\n")).alias("p"))
    claims = F.size(F.regexp_extract_all("p", F.lit(r"(?m)^.*\b(FACT|DECISION)\b.*$"), 0))
    counted = paragraphs.select("id", claims.alias("n"), F.col("p").rlike(CITATION).alias("c"))
    return counted.groupBy("id").agg(F.sum("n").alias("claims"), F.sum(F.when(F.col("c"), F.col("n")).otherwise(0)).alias("covered"))


def support(pairs: DataFrame, strong: float = 0.82, weak: float = 0.74) -> DataFrame:
    """claim, file, best, band over (claim, file, similarity): the best chunk of the cited file decides."""
    best = pairs.groupBy("claim", "file").agg(F.max("similarity").alias("best"))
    return best.withColumn("band", F.when(F.col("best") >= strong, "strong").when(F.col("best") >= weak, "weak").otherwise("none"))


#: What to do about a reason.
ACTIONS = {"path-traversal": "fix-path", "missing-file": "fix-path", "layer-not-allowed": "re-cite", "external-corpus-not-citable": "re-cite", "line-empty-or-out-of-range": "fix-line"}


def critique(judged: DataFrame, uncovered: DataFrame | None = None) -> DataFrame:
    """id, severity, reason, action, citation of all that is to be mended.

    judged: id, citation, reason (of gated) and, where known, label and band (of support): a broken citation is an error, a FACT with weak or
    no support a warning. uncovered: id, n of claims without a citation: one error a document.
    """
    reason = F.col("reason")
    action = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv]), reason), F.lit("re-cite"))
    weak = reason.isNull() & (F.col("label") == "FACT") & F.col("band").isin("weak", "none") if {"label", "band"} <= set(judged.columns) else F.lit(False)
    said = lambda broken, feeble: F.when(reason.isNotNull(), broken).when(weak, feeble)
    faults = judged.where(reason.isNotNull() | F.coalesce(weak, F.lit(False)))  # a row is one or the other, so judged is computed once
    feeble = F.concat(F.lit("weak-support-"), "band") if "band" in judged.columns else F.lit(None).cast("string")
    out = faults.select("id", said(F.lit("error"), F.lit("warn")).alias("severity"), said(reason, feeble).alias("reason"), said(action, F.lit("downgrade-or-recite")).alias("action"), "citation")
    if uncovered is not None:
        out = out.unionByName(uncovered.where("n > 0").select("id", F.lit("error").alias("severity"), F.lit("uncited-claim").alias("reason"), F.lit("add-citation").alias("action"), F.lit(None).cast("string").alias("citation")))
    return out


def corpus_scan(docs: DataFrame, items: DataFrame, exempt: Column) -> DataFrame:
    """One row: files, failed (with errors), errors, warns, exempt. docs: id; items: of critique; exempt: which documents are not judged."""
    counts = items.groupBy("id").agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warn").alias("w"))
    both = docs.withColumn("_x", F.coalesce(exempt, F.lit(False))).join(counts, "id", "left")
    seen = ~F.col("_x")
    zero = F.lit(0).cast("bigint")
    total = lambda c: F.coalesce(F.sum(F.when(seen, F.col(c))), zero)
    return both.agg(F.count_if(seen).alias("files"), F.count_if(seen & (F.col("e") > 0)).alias("failed"), total("e").alias("errors"), total("w").alias("warns"), F.count_if(F.col("_x")).alias("exempt"))


def layer_violations(cited: DataFrame, ranks: DataFrame) -> DataFrame:
    """src, dst, src_rank, dst_rank where a document cites one whose layer is not strictly lower. cited: src, dst; ranks: node, rank."""
    a, b = ranks.select(F.col("node").alias("src"), F.col("rank").alias("src_rank")), ranks.select(F.col("node").alias("dst"), F.col("rank").alias("dst_rank"))
    return cited.join(a, "src").join(b, "dst").where(F.col("dst_rank") >= F.col("src_rank")).select("src", "dst", "src_rank", "dst_rank")


#: Inline tags and the mark that stands on both sides of their text; block tags and what stands before their text.
INLINE = {"**": "strong|b", "*": "em|i", "`": "code|tt|kbd"}
BLOCKS = {**{f"\n{'#' * k} ": f"h{k}" for k in range(1, 7)}, "\n- ": "li", "\n> ": "blockquote"}
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "\u2014", "ndash": "\u2013", "hellip": "\u2026", "laquo": "\u00ab", "raquo": "\u00bb", "copy": "\u00a9"}


def character(entity: Column) -> Column:
    """The character that &#38; or &#x26; names; what names none (controls, halves of pairs, beyond Unicode) stays as it is."""
    digits = F.regexp_extract(entity, "(?i)^&#x?([0-9a-f]+);$", 1)
    point = F.when(entity.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
    real = point.isin(9, 10, 13) | point.between(32, 126) | point.between(160, 0xD7FF) | point.between(0xE000, 0x10FFFF)
    return let(point, lambda p: F.when(real, F.decode(F.unhex(F.lpad(F.hex(p), 8, "0")), "UTF-32")).otherwise(entity))


def numbered_items(html: Column, item: str) -> Column:
    """HTML whose list items stand as `1. ` where the innermost open list is ordered; other items stay. item: pattern of the tag."""
    pieces = F.split(html, r"(?is)(?=</?[ou]l[\s>])", -1)
    opened = lambda s, p: F.when(p.rlike(r"(?i)^<ol"), F.concat(s, F.lit("o"))).when(p.rlike(r"(?i)^<ul"), F.concat(s, F.lit("u"))).when(p.rlike(r"(?i)^</[ou]l"), F.left(s, F.length(s) - 1)).otherwise(s)
    step = lambda at, p: let(opened(at["open"], p), lambda s: F.struct(s.alias("open"), F.array_append(at["lists"], F.right(s, F.lit(1))).alias("lists")))
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("lists"))
    kinds = F.aggregate(pieces, start, step, lambda at: at["lists"])
    return F.array_join(F.zip_with(pieces, kinds, lambda p, k: F.when(k == "o", F.regexp_replace(p, item, "\n1. ")).otherwise(p)), "")


def html_text(html: Column, every_entity: bool = False) -> Column:
    """Readable text of HTML as Markdown: marks for emphasis, code, links, headings, items and quotes, tags stripped, entities decoded.

    Tags may have attributes and any case; items whose innermost list is ordered are numbered 1. as Markdown counts them; code blocks keep their lines.
    Numeric entities are decoded within ASCII if decimal; with every_entity, all that name a character are, hexadecimal ones too.
    """
    tag = lambda names: rf"(?is)<(?:{names})(?:\s[^>]*)?>"
    end = lambda names: rf"(?is)</(?:{names})\s*>"
    out = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|noscript)\b[^>]*>.*?</\1\s*>", "")
    out = F.regexp_replace(F.regexp_replace(out, tag("pre"), "\n```\n"), end("pre"), "\n```\n")
    out = F.when(out.rlike(r"(?i)<ol[\s>]"), numbered_items(out, tag("li"))).otherwise(out)
    out = F.regexp_replace(out, r"""(?is)<a\b[^>]*?\shref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>""", "[$2]($1)")
    for mark, names in INLINE.items():
        out = F.regexp_replace(F.regexp_replace(out, tag(names), mark), end(names), mark)
    for mark, names in BLOCKS.items():
        out = F.regexp_replace(F.regexp_replace(out, tag(names), mark), end(names), "\n")
    out = F.regexp_replace(F.regexp_replace(out, tag("br|hr"), "\n"), end("p|div|tr|ul|ol|table|section"), "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", "")
    for name, to in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(to))
    entity = "&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});" if every_entity else "&#0{0,4}(?:3[2-9]|[4-9][0-9]|1[01][0-9]|12[0-6]);"
    found = lambda t: F.concat(F.transform(F.regexp_extract_all(t, F.lit(f"({entity})"), 1), character), F.array(F.lit("")))
    out = let(out, lambda t: F.array_join(F.zip_with(F.split(t, entity, -1), found(t), lambda gap, c: F.concat(gap, c)), ""))
    out = F.replace(out, F.lit("&amp;"), F.lit("&"))
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n\s*\n+", "\n"), F.lit(" \n"))


def plain_text(html: Column) -> Column:
    """Tags replaced by a space, white space collapsed: the plainest text for search."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]*>", " "), r"[ \t\r\n]+", " "))


def hrefs(pages: DataFrame) -> DataFrame:
    """id, place, target of every href in pages (id, html)."""
    found = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)
    return pages.select("id", F.posexplode(F.coalesce(found, F.array().cast("array<string>"))).alias("place", "target"))


def page_edges(pages: DataFrame, id_col: str = "id") -> DataFrame:
    """id, kind (href, src, import), target of every reference in HTML or scripts; other sites' (with a scheme) are left out."""
    patterns = {"href": r'href="([^"]*)"', "src": r'src="([^"]*)"', "import": r"import\s*(?:\(|[^'\"();]*from)?\s*['\"]([^'\"]+)['\"]"}
    none = F.array().cast("array<string>")
    found = F.array(*[F.struct(F.lit(kind).alias("kind"), F.coalesce(F.regexp_extract_all("html", F.lit(p), 1), none).alias("targets")) for kind, p in patterns.items()])
    each = pages.select(id_col, F.inline(found)).select(id_col, "kind", F.explode("targets").alias("target"))
    return each.where(~F.col("target").rlike("^([a-zA-Z][a-zA-Z0-9+.-]*:|//)"))


def meta_hint(fields: Column, keys: Sequence[str]) -> Column:
    """[meta: k=v; ...] of the listed keys that a map has, in the list's order; empty if it has none. It goes into what is embedded, not into what is stored."""
    parts = F.concat_ws("; ", *[F.when(F.try_element_at(fields, F.lit(k)).isNotNull(), F.concat(F.lit(f"{k}="), F.try_element_at(fields, F.lit(k)))) for k in keys])
    return F.when(parts == "", "").otherwise(F.concat(F.lit("[meta: "), parts, F.lit("] ")))


def categorized(df: DataFrame, column: str, drops: Sequence[str], exact: dict[str, str], prefixes: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds category: DROP for dropped names, then the exact map, then the first prefix that fits, else DROP."""
    c = F.col(column)
    rule = F.when(c.isin(*drops), "DROP") if drops else F.when(F.lit(False), "DROP")
    for name, category in exact.items():
        rule = rule.when(c == name, category)
    for prefix, category in prefixes:
        rule = rule.when(c.startswith(prefix), category)
    return df.withColumn("category", rule.otherwise("DROP"))


def grade_contains(cases: DataFrame, output: str, must: Sequence[str] = (), must_not: Sequence[str] = (), patterns: Sequence[str] = ()) -> DataFrame:
    """Adds score (share of checks that hold) and passed (all hold); no checks fail."""
    c = F.coalesce(F.col(output), F.lit(""))
    checks = [F.contains(c, F.lit(m)) for m in must] + [~F.contains(c, F.lit(m)) for m in must_not] + [c.rlike(p) for p in patterns]
    if not checks:
        return cases.withColumns({"score": F.lit(0.0), "passed": F.lit(False)})
    held = sum(x.cast("int") for x in checks)
    return cases.withColumn("score", held / F.lit(float(len(checks)))).withColumn("passed", F.col("score") == 1.0)


def grade_labels(cases: DataFrame, output: str, labels: Sequence[str], required: Sequence[str] = (), forbidden: Sequence[str] = (), least: int = 0) -> DataFrame:
    """Adds found (distinct labels in the output, sorted) and passed: all required, none forbidden, `least` distinct ones or more."""
    words = F.split(F.coalesce(F.col(output), F.lit("")), r"[^\p{L}\p{N}_]+")  # not \b, which knows accents in some engines only
    found = F.array_sort(F.array_distinct(F.filter(words, lambda w: w.isin(*labels))))
    ok = F.size("found") >= least
    for r in required:
        ok = ok & F.array_contains("found", r)
    for f in forbidden:
        ok = ok & ~F.array_contains("found", f)
    return cases.withColumn("found", found).withColumn("passed", ok)


def schema_faults(value, schema: dict, at: str = "$") -> list[str]:
    """Where a JSON value breaks a schema of type, required, properties, items, enum, lengths and ranges."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    want = schema.get("type")
    if want in ("number", "integer"):
        fits = not isinstance(value, bool) and isinstance(value, (int, float) if want == "number" else int)
    else:
        fits = want is None or isinstance(value, kinds[want])
    if not fits:
        return [f"{at}: type"]
    found = [f"{at}: enum"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        found += [f"{at}.{k}: required" for k in schema.get("required", []) if k not in value]
        for k, sub in schema.get("properties", {}).items():
            if k in value:
                found += schema_faults(value[k], sub, f"{at}.{k}")
    sized = {list: ("minItems", "maxItems"), str: ("minLength", "maxLength")}.get(type(value))
    if sized:
        found += [f"{at}: {sized[0]}"] * (len(value) < schema.get(sized[0], 0)) + [f"{at}: {sized[1]}"] * (len(value) > schema.get(sized[1], len(value)))
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += schema_faults(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        found += [f"{at}: minimum"] * (value < schema.get("minimum", value)) + [f"{at}: maximum"] * (value > schema.get("maximum", value))
    return found


def grade_schema(cases: DataFrame, output: str, schema: dict) -> DataFrame:
    """Adds faults (array) and passed: whether the output is JSON that fits the schema. Arrow batches."""
    ship_package(cases.sparkSession)

    @pandas_udf("array<string>")
    def faults(outputs: pd.Series) -> pd.Series:
        def one(text):
            try:
                return schema_faults(json.loads(text), schema)
            except (TypeError, ValueError):
                return ["$: not JSON"]

        return outputs.map(one)

    return cases.withColumn("faults", faults(F.col(output))).withColumn("passed", F.size("faults") == 0)


#: Graders by name: (cases, output column, parameters) -> cases with `passed`.
GRADERS = {"contains": grade_contains, "labels": grade_labels, "schema": grade_schema}


def graded(cases: DataFrame, grader: str, output: str, **parameters) -> DataFrame:
    return GRADERS[grader](cases, output, **parameters)


def share_passed(graded_: DataFrame, by: str) -> DataFrame:
    return graded_.groupBy(by).agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed")).withColumn("share", F.round(ratio("passed", "cases"), 6))
