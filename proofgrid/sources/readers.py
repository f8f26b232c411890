"""Readers: parquet, JSON-lines logs, Markdown trees with front matter, content-addressed blobs, published datasets, eval cases."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRONT = r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)"


def rows_of_keys(df: DataFrame, key: str, keys: Sequence) -> DataFrame:
    """Rows whose key is in a given list; the list is part of the scan's filter."""
    return df.where(F.col(key).isin(list(keys)))


def journal(spark: SparkSession, path: str, schema: str, kind: str | None = None, since: str | None = None, newest: int | None = None, at: str = "written_at") -> DataFrame:
    """JSON lines with a stated schema; malformed lines are left out. newest asks for a top-k by time."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.where("_bad IS NULL").drop("_bad")
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    if since is not None:
        rows = rows.where(F.col(at) >= F.lit(since))
    return rows if newest is None else rows.orderBy(F.desc(at)).limit(newest)


def markdown(spark: SparkSession, root: str, skip: Sequence[str] = ("node_modules",)) -> DataFrame:
    """path (below root), layer (its first folder, or 'root'), mtime, text of every .md file; dot-folders and skipped ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    clean = root.rstrip("/").split(":", 1)[-1]
    below = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), r"^/*" + clean.lstrip("/").replace(".", r"\."), "")
    kept = files.withColumn("rel", F.regexp_replace(below, "^/+", "")).where(~F.col("rel").rlike(r"(^|/)\."))
    for name in skip:
        kept = kept.where(~F.concat(F.lit("/"), "rel").contains(f"/{name}/"))
    layer = F.when(F.contains("rel", F.lit("/")), F.substring_index("rel", "/", 1)).otherwise("root")
    return kept.select(F.col("rel").alias("path"), layer.alias("layer"), F.col("modificationTime").alias("mtime"), F.decode("content", "utf-8").alias("text"))


def front_matter(text: Column) -> Column:
    """Struct (fields, body): the flat `key: value` lines before the text as a map, quotes stripped; later keys win."""
    raw = F.regexp_extract(text, FRONT, 1)
    lines = F.filter(F.split(raw, r"\r?\n"), lambda s: s.rlike(r"^[A-Za-z_][\w-]*:"))
    value = lambda s: F.regexp_replace(F.trim(F.regexp_replace(s, r"^[\w-]+:[ \t]*", "")), r"^(['\"])(.*)\1$", "$2")
    entries = F.transform(lines, lambda s: F.struct(F.regexp_extract(s, r"^([\w-]+):", 1).alias("key"), value(s).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.transform(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda x: x["key"]), lambda k: k == e["key"]))
    return F.struct(F.map_from_entries(last).alias("fields"), F.regexp_replace(text, FRONT, "").alias("body"))


def related(text: Column) -> Column:
    """The entries of `related:`, inline [a, b] or one `- a` a line, each once, in order."""
    raw = F.regexp_extract(text, FRONT, 1)
    inline = F.split(F.regexp_extract(raw, r"(?m)^related:[ \t]*\[([^\]]*)\]", 1), ",")
    block = F.regexp_extract_all(F.regexp_extract(raw, r"(?m)^related:[ \t]*\r?\n((?:[ \t]*-[^\n]*(?:\n|$))+)", 1), F.lit(r"-[ \t]*([^\r\n]+)"), 1)
    clean = lambda s: F.regexp_replace(F.trim(s), r"^['\"\[]+|['\"\]]+$", "")
    return F.array_distinct(F.filter(F.transform(F.concat(inline, block), clean), lambda s: s != ""))


def damaged_blobs(manifest: DataFrame, blobs: DataFrame) -> DataFrame:
    """key, reason for manifest rows (key, sha256, bytes) whose blob (sha256 by name, content) is missing, of another size or content."""
    held = blobs.select(F.regexp_extract("path", r"([0-9a-f]{64})", 1).alias("sha256"), F.length("content").alias("_n"), F.sha2("content", 256).alias("_sha"))
    both = manifest.join(held, "sha256", "left")
    reason = F.when(F.col("_sha").isNull(), "missing").when(F.col("_n") != F.col("bytes"), "size").when(F.col("_sha") != F.col("sha256"), "content")
    return both.select("key", reason.alias("reason")).where("reason IS NOT NULL")


def blobs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def request_plan(keys: DataFrame, endpoints: Sequence[tuple[str, str]]) -> DataFrame:
    """name, id, path: a request for every key (id) at every endpoint (name, path with {id}); the templates are a given list."""
    templates = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(path).alias("template")) for name, path in endpoints])
    each = keys.select(F.col("id").cast("string").alias("id")).distinct().select("id", F.inline(templates))
    return each.select("name", "id", F.replace("template", F.lit("{id}"), F.url_encode("id")).alias("path"))


def published(spark: SparkSession, folder: str, schema: str | None = None, verify: bool = True, shards: DataFrame | None = None) -> DataFrame:
    """The dataset that folder/current.json points to, or its rows in some shards (a column shard), whose files only are read then.

    With verify, the manifest must have the digest that the pointer pins and every shard read the rows and the hash that the manifest
    says, else a ValueError names what is damaged; that reads these data once more.
    """
    from proofgrid.sinks import publish
    from proofgrid.sinks.storage import get_text

    pointer = json.loads(get_text(spark, f"{folder}/current.json"))
    if pointer.get("schemaVersion") != 1:
        raise ValueError(f"{folder}/current.json has an unknown schema")
    base = f"{folder}/{pointer['root']}"
    within = lambda df: df if shards is None else df.join(shards.select("shard").distinct(), "shard", "left_semi")
    data = within(spark.read.schema(schema or f"{pointer['schema']}, shard long").json(f"{base}/{pointer['dataset']}"))
    if verify:
        manifest = spark.read.schema("dataset string, shard long, path string, count long, sha256 string").json(f"{base}/manifest")
        if publish.manifest_digest(manifest) != pointer["manifestSha256"]:
            raise ValueError(f"the manifest of {base} is not the one pointed to")
        whole = within(spark.read.schema(f"{pointer['schema']}, shard long").json(f"{base}/{pointer['dataset']}"))
        bad = publish.damaged_shards(whole, within(manifest), pointer["keys"], pointer["columns"]).limit(5).collect()
        if bad:
            raise ValueError(f"damaged shards in {base}: {[tuple(r) for r in bad]}")
    return data


def published_keys(spark: SparkSession, folder: str, index: DataFrame, field: str, key: str, schema: str | None = None, verify: bool = True) -> DataFrame:
    """Rows of one key: the index names the shards, and only their files are read and verified, however many they are.

    The shards reach the scan as the keys of a join with the partition column, which prunes files when the query runs.
    """
    named = index.where((F.col("field") == field) & (F.col("key") == str(key))).select(F.regexp_extract("path", r"-([0-9]+)\.[^-]*$", 1).cast("long").alias("shard"))
    return published(spark, folder, schema, verify, named).where(F.col(field).cast("string") == str(key))


def eval_cases(files: DataFrame) -> DataFrame:
    """path, fields (front matter), sections (map of `# Name` to its body) of Markdown eval cases (path, text)."""
    parsed = files.select("path", front_matter(F.col("text")).alias("m"))
    parts = F.slice(F.split(F.concat(F.lit("\n"), "m.body"), r"\n# "), F.lit(2), F.lit(1 << 30))
    entry = lambda p: F.struct(F.trim(F.regexp_extract(p, r"^([^\n]*)", 1)).alias("key"), F.btrim(F.when(F.contains(p, F.lit("\n")), F.regexp_replace(p, r"^[^\n]*\n", "")).otherwise(""), F.lit(" \t\r\n")).alias("value"))
    return parsed.select("path", "m.fields", F.map_from_entries(F.transform(parts, entry)).alias("sections"))


def interpolated(cases: DataFrame, files: DataFrame, column: str = "text") -> DataFrame:
    """cases (path, text) with every {{file:name}} replaced by that file's text (files: path, text); unknown names stay as they are."""
    pattern = r"\{\{file:\s*([^}]+?)\s*\}\}"
    names = cases.select("path", F.posexplode(F.regexp_extract_all(column, F.lit(pattern), 1)).alias("at", "name"))
    found = names.join(files.select(F.col("path").alias("name"), F.col("text").alias("t")), "name", "left")
    texts = found.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name", "t"))), lambda x: F.coalesce(x["t"], F.concat(F.lit("{{file:"), x["name"], F.lit("}}")))).alias("_t"))
    gaps = F.split(column, pattern, -1)
    whole = F.array_join(F.zip_with(gaps, F.concat("_t", F.array(F.lit(""))), lambda g, t: F.concat(g, t)), "")
    return cases.join(texts, "path", "left").withColumn(column, F.when(F.col("_t").isNull(), F.col(column)).otherwise(whole)).drop("_t")
