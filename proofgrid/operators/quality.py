"""Data quality: contracts, profiles, anomalies, reconciliation, pagination, samples and fingerprints of tables.

Rules are columns of one scan: however many are asked for, a table is read once.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from proofgrid.functions.columns import row_hash, strict_date
from proofgrid.operators.order import hash_tree
from proofgrid.session import ship_package


def inner_fact_dim(facts: DataFrame, dimension: DataFrame, key: str, *keep: str) -> DataFrame:
    return facts.join(dimension, key).select(*keep)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key is not null and has no parent."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.where(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def reconciled_counts(parent: DataFrame, child: DataFrame, key: str, declared: str) -> DataFrame:
    """key, declared, actual where the count that a parent declares is not that of its children; no children count 0."""
    counts = child.groupBy(key).agg(F.count("*").alias("actual"))
    both = parent.select(key, declared).join(counts, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return both.where(~F.col(declared).eqNullSafe(F.col("actual"))).select(key, F.col(declared).alias("declared"), "actual")


def two_sided_diff(left: DataFrame, right: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """key, left, right, kind (missing, unexpected or different) for keys whose values do not agree.

    One shuffle and one row a key on either side: tagged rows are grouped rather than joined twice.
    """
    tagged = left.select(*key, F.col(value).alias("left"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*key, F.col(value).alias("right"), F.lit(0).alias("l"), F.lit(1).alias("r")), allowMissingColumns=True
    )
    both = tagged.groupBy(*key).agg(F.max("left").alias("left"), F.max("right").alias("right"), F.max("l").alias("l"), F.max("r").alias("r"))
    kind = F.when(F.col("r") == 0, "missing").when(F.col("l") == 0, "unexpected").otherwise("different")
    return both.where(~F.col("left").eqNullSafe(F.col("right")) | (F.col("l") != F.col("r"))).select(*key, "left", "right", kind.alias("kind"))


def prefer_detail(index: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """A row a key of either table: the detail's value where it has one, else the index's; has_detail tells which exist."""
    shared = [c for c in index.columns if c != key]
    i = index.select(key, *[F.col(c).alias(f"i_{c}") for c in shared])
    d = detail.select(key, *[F.col(c).alias(f"d_{c}") for c in shared], F.lit(True).alias("has_detail"))
    joined = i.join(d, key, "full")
    return joined.select(key, *[F.coalesce(f"d_{c}", f"i_{c}").alias(c) for c in shared], F.coalesce("has_detail", F.lit(False)).alias("has_detail"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n for keys that stand on more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def profile(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """A row for each column: rows, nulls, empty texts, whether it is of the key, and how many rows repeat a key or lack a part of it.

    grain says what a row stands for.
    """
    texts = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    counts = df.agg(
        F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_null") for c in df.columns],
        *[F.count_if(F.trim(c) == "").alias(f"{c}_empty") for c in df.columns if c in texts],
    )
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "") for k in keys])
    repeated = df.groupBy(*keys).agg(F.count("*").alias("_k"), F.count_if(no_key).alias("_e")).agg(F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).alias("repeated"), F.coalesce(F.sum("_e"), F.lit(0)).alias("keyless"))
    rows = F.array(*[F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.col("n").alias("row_count"), F.col(f"{c}_null").alias("null_count"), (F.col(f"{c}_empty") if c in texts else F.lit(0).cast("long")).alias("empty_count"), F.col("repeated").alias("repeated_keys"), F.col("keyless").alias("empty_keys"), F.lit(c in keys).alias("in_key"), F.lit(f"one row a {', '.join(keys)}").alias("grain")) for c in df.columns])
    return counts.crossJoin(repeated).select(F.inline(rows))  # two rows of totals


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n: on how many rows each condition holds; one pass, whatever the number of rules."""
    counts = df.agg(*[F.count_if(c).alias(f"r{i}") for i, c in enumerate(rules.values())])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("n")) for i, name in enumerate(rules)])))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule: a row for each condition that a row breaks; a condition that is null is broken."""
    broken = F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()])
    return df.select(key, F.explode(F.array_compact(broken)).alias("rule"))


def field_rule(df: DataFrame, column: str, kinds: str, required: bool = True) -> Column:
    """Contract of one field of texts: kinds such as 'string', 'integer|null', 'number', 'date', 'digits17'."""
    c = F.col(column)
    if column not in df.columns:
        return F.lit(not required)
    tests = {
        "string": c.isNotNull(), "null": c.isNull(), "integer": c.cast("string").rlike("^-?[0-9]+$"), "digits17": c.cast("string").rlike("^[0-9]{17}$"),
        "number": ~F.isnan(c.try_cast("double")) & (F.abs(c.try_cast("double")) < float("inf")), "date": strict_date(c.cast("string")).isNotNull(), "boolean": c.try_cast("boolean").isNotNull(),
    }
    found = F.lit(False)
    for kind in kinds.split("|"):
        found = found | F.coalesce(tests[kind], F.lit(False))
    return found


def boundary_stability(observations: DataFrame, key: Sequence[str], role: str, at: str, digest: str) -> DataFrame:
    """key, stable: exactly one start and one end, in this order, with one digest."""
    starts, ends = F.col(role) == "start", F.col(role) == "end"
    found = observations.groupBy(*key).agg(F.count_if(starts).alias("s"), F.count_if(ends).alias("e"), F.max(F.when(starts, F.col(at))).alias("a"), F.min(F.when(ends, F.col(at))).alias("b"), F.min(digest).alias("lo"), F.max(digest).alias("hi"))
    return found.select(*key, F.coalesce((F.col("s") == 1) & (F.col("e") == 1) & (F.col("a") <= F.col("b")) & (F.col("lo") == F.col("hi")), F.lit(False)).alias("stable"))


def page_overlap(pages: DataFrame, series: Sequence[str], offset: str, ids: str, limit: str) -> DataFrame:
    """Adds gap (offset is not that of the page before plus limit - 1) and overlap (ids shared with that page); null on first pages."""
    order = Window.partitionBy(*series).orderBy(offset)
    before, had = F.lag(offset).over(order), F.lag(ids).over(order)
    stride = F.greatest(F.col(limit) - 1, F.lit(1))
    return pages.withColumns({"gap": F.when(before.isNotNull(), F.col(offset) != before + stride), "overlap": F.when(had.isNotNull(), F.size(F.array_intersect(F.col(ids), had)))})


def aggregate_mismatches(index: DataFrame, detail: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """key, field, declared, actual where a field of the index is not what the detail adds up to.

    checks: field of the index -> aggregate over the detail.
    """
    actual = detail.groupBy(key).agg(*[c.alias(f"_{name}") for name, c in checks.items()])
    both = index.select(key, *checks).join(actual, key, "left")
    rows = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("double").alias("declared"), F.coalesce(F.col(f"_{n}").cast("double"), F.lit(0.0)).alias("actual")) for n in checks])
    return both.select(key, F.inline(rows)).where(~F.col("declared").eqNullSafe(F.col("actual")))


def ignored_filters(responses: DataFrame, base_key: str, filter_col: str, digest: str) -> DataFrame:
    """Filtered responses whose payload is that of the unfiltered request: the filter had no effect."""
    plain = responses.where(F.col(filter_col).isNull()).select(base_key, F.col(digest).alias("plain")).distinct()
    return responses.where(F.col(filter_col).isNotNull()).join(plain, base_key).where(F.col(digest) == F.col("plain")).select(base_key, filter_col)


def distinct_events(events: DataFrame, code: str, location: str, message: str) -> DataFrame:
    """Events without repeats once indexes in their location are erased, sorted by code, location and message."""
    erased = events.withColumn(location, F.regexp_replace(location, r"\[[0-9]+\]", "[]"))
    return erased.dropDuplicates([code, location, message]).orderBy(code, location, message)


def prefer_fullest(df: DataFrame, key: Sequence[str], payload: str, order: str) -> DataFrame:
    """Of each key the row with the longest payload; ties go to the earlier row. One aggregation, no sort of groups."""
    best = F.max_by(F.struct(*df.columns), F.struct(F.length(payload), -F.col(order)))
    return df.groupBy(*key).agg(best.alias("_best")).select("_best.*")


def pick_by_priority(df: DataFrame, key: Sequence[str], priority: str, fullness: Column, canonical: str) -> DataFrame:
    """Of each key the row of the highest priority, then the fullest, then the least canonical text."""
    best = F.min_by(F.struct(*df.columns), F.struct(-F.col(priority), -fullness, F.col(canonical)))
    return df.groupBy(*key).agg(best.alias("_best")).select("_best.*")


def hash_sample(df: DataFrame, key: str, n: int, seed: str = "") -> DataFrame:
    """The n rows of the least SHA-256 of seed and key: the same rows wherever and however the table is stored."""
    return df.withColumn("_h", F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)).orderBy("_h", key).limit(n).drop("_h")


def stratified_sample(df: DataFrame, key: str, stratum: str, n: int, seed: str = "") -> DataFrame:
    """The row of the least hash of every stratum, then rows by hash up to n in all: keys with `mandatory`."""
    hashed = df.select(key, stratum, F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256).alias("_h"))
    firsts = hashed.groupBy(stratum).agg(F.min(F.struct("_h", key)).alias("f")).select(F.col(f"f.{key}").alias(key), F.lit(True).alias("mandatory"))
    marked = hashed.join(firsts, key, "left").withColumn("mandatory", F.coalesce("mandatory", F.lit(False)))
    return marked.orderBy(F.desc("mandatory"), "_h", key).limit(n).select(key, stratum, "mandatory")


def audit_sample(df: DataFrame, key: str, stratum: str, day: str, seed: str = "", least: int = 30, share: float = 0.01) -> DataFrame:
    """key, stratum, mandatory: max(least, share of the rows) rows by hash, among them the least hash of each stratum and both ends by day and by key."""
    n = max(least, -(-df.count() * round(share * 10_000) // 10_000))
    hashed = df.select(key, stratum, day, F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256).alias("_h"))
    firsts = hashed.groupBy(stratum).agg(F.min(F.struct("_h", key))[key].alias(key)).select(key)
    text = F.col(key).cast("string")
    ends = hashed.agg(F.min_by(key, F.struct(day, key)).alias("a"), F.max_by(key, F.struct(day, key)).alias("b"), F.min_by(key, F.struct(text, key)).alias("c"), F.max_by(key, F.struct(text, key)).alias("d"))
    chosen = firsts.unionByName(ends.select(F.explode(F.array("a", "b", "c", "d")).alias(key))).distinct().withColumn("mandatory", F.lit(True))
    marked = hashed.join(chosen, key, "left").withColumn("mandatory", F.coalesce("mandatory", F.lit(False)))
    return marked.orderBy(F.desc("mandatory"), "_h", key).limit(n).select(key, stratum, "mandatory")


def first_known(df: DataFrame, key: Sequence[str], columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of each key the first value of each column that is not null, in an order that the caller makes total."""
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return df.groupBy(*key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def base_health(docs: DataFrame, links: DataFrame, required: Sequence[str], day: str, asof: str, stale: int = 90) -> DataFrame:
    """rule, n over a linked set of documents (node and fields): missing-field, broken-link, orphan, stale, ghost.

    A ghost is an unknown node that links point to; a broken link is a link to one.
    """
    known = docs.select("node").distinct()
    missing = reduce(lambda a, b: a + b, [F.coalesce((F.trim(F.col(c).cast("string")) == "").cast("int"), F.lit(1)) for c in required])
    old = F.datediff(F.lit(asof).cast("date"), F.col(day)) >= stale
    own = docs.agg(F.coalesce(F.sum(missing), F.lit(0)).alias("missing-field"), F.count_if(old).alias("stale"))
    broken = links.join(known.withColumnRenamed("node", "dst"), "dst", "left_anti")
    lost = broken.agg(F.count("*").alias("broken-link"), F.countDistinct("dst").alias("ghost"))
    inside = links.where("src <> dst").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    ends = inside.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    alone = known.join(ends, "node", "left_anti").agg(F.count("*").alias("orphan"))
    totals = own.crossJoin(lost).crossJoin(alone)  # a row each
    return totals.select(F.inline(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").cast("long").alias("n")) for c in ("missing-field", "broken-link", "orphan", "stale", "ghost")])))


def fingerprint(df: DataFrame, columns: Sequence[str], name: str, depth: int | None = None) -> DataFrame:
    """table_name, n, digest of a whole table, the same for any partitioning and row order."""
    found = hash_tree(df.select(row_hash(*columns).alias("h")), "h", depth)
    return found.select(F.lit(name).alias("table_name"), "n", "digest")


def dataset_fingerprint(fingerprints: Sequence[DataFrame]) -> DataFrame:
    """The fingerprints of tables and one row more, `*`: the sum of the rows and a digest over the tables in order of name, a row a table."""
    each = reduce(DataFrame.unionByName, fingerprints)
    listed = F.array_sort(F.collect_list(F.concat("table_name", F.lit(":"), "digest")))
    return each.unionByName(each.agg(F.lit("*").alias("table_name"), F.sum("n").alias("n"), F.sha2(F.array_join(listed, ""), 256).alias("digest")))


def roll_up(checks: DataFrame) -> DataFrame:
    """checks (check, n_failed) to one row: checks, failed, state (complete or incomplete)."""
    return checks.agg(F.count("*").alias("checks"), F.count_if(F.col("n_failed") > 0).alias("failed"), F.when(F.count_if(F.col("n_failed") > 0) == 0, "complete").otherwise("incomplete").alias("state"))


def set_difference_counts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: missing (keys of left only), unexpected (of right only), equal (neither). Both sides are grouped together once."""
    tagged = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    both = tagged.groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    found = both.agg(F.count_if(F.col("r") == 0).alias("missing"), F.count_if(F.col("l") == 0).alias("unexpected"))
    return found.withColumn("equal", (F.col("missing") == 0) & (F.col("unexpected") == 0))


def malformed_ids(df: DataFrame, key: str, json: str, name: str, form: str) -> DataFrame:
    """key, value of every id in a JSON text, at any depth, alone or in a list, that has not the form; numbers never have it."""
    single = F.regexp_extract_all(json, F.lit(rf'"{name}"\s*:\s*("[^"]*"|-?[0-9.eE+]+|true|false)'), 1)
    lists = F.regexp_extract_all(json, F.lit(rf'"{name}"\s*:\s*\[([^\]]*)\]'), 1)
    each = F.flatten(F.transform(lists, lambda s: F.regexp_extract_all(s, F.lit(r'("[^"]*"|[^,\s"]+)'), 1)))
    values = df.where(F.col(json).isNotNull()).select(key, F.explode(F.concat(single, each)).alias("value"))
    return values.where(~F.col("value").rlike(f'^"{form}"$'))


def merged_payload(df: DataFrame, payload: str, schema: str, drop: Sequence[str] = ()) -> DataFrame:
    """The fields of a JSON column beside the table's own, which win; the payload column and dropped fields go."""
    parsed = df.withColumn("_p", F.from_json(payload, schema))
    own = [c for c in df.columns if c != payload]
    extra = [f for f in parsed.schema["_p"].dataType.names if f not in own and f not in drop]
    return parsed.select(*own, *[F.col(f"_p.{f}").alias(f) for f in extra])


class Number(str):
    """A JSON number as it is written."""


class Members(list):
    """The members of a JSON object, repeated names among them."""


def json_walk(text: str) -> list[tuple[str, str, str | None]]:
    """(path, type, value) of every node of a JSON text, the root under an empty path; none if the text is not JSON.

    Types are those that are written: object, array, string, integer, number, boolean, null. A string is a string whatever stands in it. Numbers keep
    their spelling; objects and arrays have no value. A text nested beyond what the parser can follow is one node of type too-deep.
    """
    try:
        root = json.loads(text, object_pairs_hook=Members, parse_int=Number, parse_float=Number, parse_constant=Number)
    except RecursionError:
        return [("", "too-deep", None)]
    except ValueError:
        return []
    out, todo = [], [("", root)]
    while todo:
        path, x = todo.pop()
        if isinstance(x, list):
            members = x if isinstance(x, Members) else enumerate(x)
            out.append((path, "object" if isinstance(x, Members) else "array", None))
            todo += [(f"{path}.{name}" if path else str(name), v) for name, v in members]
        elif isinstance(x, Number):
            out.append((path, "integer" if x.lstrip("-").isdigit() else "number", str(x)))
        elif isinstance(x, str):
            out.append((path, "string", x.encode("utf-8", "replace").decode()))
        else:
            out.append((path, "null", None) if x is None else (path, "boolean", str(x).lower()))
    return out


def json_nodes(df: DataFrame, key: str, json: str) -> DataFrame:
    """key, path, type, value of every node of JSON texts at any depth, the root under an empty path; texts that are null or no JSON have none.

    Each text is parsed and walked once, in Arrow batches; an array's items have their index from 0 as name.
    """
    ship_package(df.sparkSession)
    schema = StructType([StructField(key, df.schema[key].dataType), StructField("path", StringType()), StructField("type", StringType()), StructField("value", StringType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                nodes = json_walk(text)
                rows += [row] * len(nodes)
                found += nodes
            columns = [pa.array([n[k] for n in found], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], names=schema.names)

    return df.where(F.col(json).isNotNull()).select(F.col(key), F.col(json).alias("_json")).mapInArrow(run, schema)


def json_leaves(df: DataFrame, key: str, json: str) -> DataFrame:
    """key, path, type, value of every leaf of JSON texts at any depth; empty objects and arrays have none."""
    return json_nodes(df, key, json).where("type NOT IN ('object', 'array')")


def json_assertions(df: DataFrame, key: str, json: str, ids: str, form: str) -> DataFrame:
    """key, fullness, not_finite, bad_ids of every row: nodes with the root, numbers beyond a double, ids that are no string of the form.

    An id is a leaf under a member whose name matches `ids`, or an item of a list under it; a number never is one, however it looks.
    A text that is null or no JSON counts as a root alone.
    """
    nodes, value = json_nodes(df, key, json), F.col("value")
    number = F.col("type").isin("integer", "number")
    is_id = ~F.col("type").isin("object", "array") & F.col("path").rlike(rf"(^|\.)({ids})(\.[0-9]+)?$")
    double = value.try_cast("double")
    bad_number = number & (double.isNull() | F.isnan(double) | (F.abs(double) == float("inf")))
    counts = nodes.groupBy(key).agg(F.count("*").alias("n"), F.count_if(bad_number).alias("not_finite"), F.count_if(is_id & ~((F.col("type") == "string") & value.rlike(f"^{form}$"))).alias("bad_ids"))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    return df.select(key).join(counts, key, "left").select(key, F.coalesce("n", one).alias("fullness"), F.coalesce("not_finite", zero).alias("not_finite"), F.coalesce("bad_ids", zero).alias("bad_ids"))
