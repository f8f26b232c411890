"""Publication of results: sharded JSON with a content-addressed version, pointer file, keyed indexes, upserts and staged loads.

Data files are written by tasks into one shared folder; the driver handles manifests only, a row a shard.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofgrid.functions.columns import row_hash
from proofgrid.operators.order import chain_digest, hash_tree, positions
from proofgrid.sinks.storage import exists, put_text, staged

ROWS, GZIP_BYTES = 2000, 512_000
#: Hashes in one list of a version: 64 MB of text, so up to two billion rows in shards of ROWS have the plain hash of their shards' hashes.
FLAT = 1 << 20


def in_shards(df: DataFrame, keys: Sequence[str], rows: int = ROWS, at: str | None = None) -> DataFrame:
    """Adds shard: the order by keys cut into runs of `rows`. at: a column that holds the places in that order already, which goes."""
    placed, at = (positions(df, list(keys), "_at"), "_at") if at is None else (df, at)
    return placed.withColumn("shard", F.floor(F.col(at) / rows).cast("long")).drop(at)


def shard_path(name: str) -> Column:
    """The file name of a row's shard: its number in three digits, or in as many as it has from a thousand on, so no two shards share one."""
    number = F.col("shard").cast("string")
    return F.concat(F.lit(f"{name}-"), F.lpad(number, F.greatest(F.length(number), F.lit(3)), F.lit("0")), F.lit(".json"))


def shard_manifest(df: DataFrame, name: str, keys: Sequence[str], columns: Sequence[str], rows: int = ROWS, at: str | None = None) -> DataFrame:
    """dataset, shard, path, count, sha256 of each shard: the hash of its rows as comma-joined text lines in key order.

    A shard holds at most `rows` rows, so its list is bounded.
    """
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in columns])
    sharded = in_shards(df, keys, rows, at).select("shard", F.struct(*keys).alias("k"), line.alias("line"))
    lists = sharded.groupBy("shard").agg(F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct("k", "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return lists.select(F.lit(name).alias("dataset"), "shard", shard_path(name).alias("path"), "count", F.sha2(text, 256).alias("sha256"))


def version_of(manifest: DataFrame, prefix: str = "v1-") -> DataFrame:
    """One row, version: the prefix and 16 digits of the SHA-256 over one dataset's shard hashes in order, in one run (beyond FLAT shards in runs of runs)."""
    return chain_digest(manifest, "shard", "sha256", FLAT).select(F.concat(F.lit(prefix), F.substring("digest", 1, 16)).alias("version"))


def merkle_root(lines: DataFrame, line: str, depth: int | None = None) -> DataFrame:
    """root, n: a hash of all lines that does not depend on their order."""
    return hash_tree(lines.select(F.sha2(line, 256).alias("h")), "h", depth).select(F.col("digest").alias("root"), "n")


def detail_index(sharded: DataFrame, name: str, fields: Sequence[str]) -> DataFrame:
    """dataset, field, key, path: which shards hold a key of a field; one row each, so that readers open only these."""
    path = shard_path(name)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("key")) for f in fields])
    return sharded.select(path.alias("path"), F.inline(rows)).where("key IS NOT NULL").distinct().select(F.lit(name).alias("dataset"), "field", "key", "path")


def write_dataset(df: DataFrame, folder: str, name: str, keys: Sequence[str], rows: int = ROWS, at: str | None = None) -> DataFrame:
    """Writes folder/name/shard=<n>/ JSON files, gzip-compressed, and returns the sharded rows. A shard is one file."""
    sharded = in_shards(df, keys, rows, at)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sharded.repartition(n, "shard").sortWithinPartitions("shard", *keys).write.partitionBy("shard").option("compression", "gzip").json(f"{folder}/{name}")
    return sharded


def oversized(spark: SparkSession, folder: str, name: str, most: int = GZIP_BYTES) -> DataFrame:
    """path, bytes of data files over the limit: shards to be cut smaller."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json.gz").load(f"{folder}/{name}")
    return files.where(F.col("length") >= most).select("path", F.col("length").alias("bytes"))


def manifest_digest(manifest: DataFrame) -> str:
    """SHA-256 over the manifest's rows in order of shards: what the pointer pins."""
    line = F.concat_ws("|", "path", F.col("count").cast("string"), "sha256")
    return chain_digest(manifest.withColumn("_d", F.sha2(line, 256)), "shard", "_d").first().digest


def damaged_shards(data: DataFrame, manifest: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """shard, reason (missing, unexpected, count or content) for shards of data (with `shard`) that are not what the manifest says."""
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in columns])
    lists = data.select("shard", F.struct(*keys).alias("k"), line.alias("line")).groupBy("shard").agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct("k", "line"))).alias("l"))
    held = lists.select(F.col("shard").cast("long").alias("shard"), "_n", F.sha2(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), 256).alias("_sha"))
    both = manifest.select(F.col("shard").cast("long").alias("shard"), "count", "sha256").join(held, "shard", "full")
    reason = F.when(F.col("_n").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("_n") != F.col("count"), "count").when(F.col("_sha") != F.col("sha256"), "content")
    return both.select("shard", reason.alias("reason")).where("reason IS NOT NULL")


def contract_faults(manifest: DataFrame, index: DataFrame, fields: Sequence[str], dataset: str = r"[a-z][a-z0-9_]*", key: str = r"[A-Za-z0-9_-]{1,64}") -> DataFrame:
    """rule, item of all that a manifest (dataset, path, count, sha256) and its index (dataset, field, key, path) break.

    Paths are plain names of shards and stand once, hashes and counts have their form, indexed fields are on the list, keys have a plain
    form, and an index names only paths of its own dataset.
    """
    broken = {
        "dataset-name": ~F.col("dataset").rlike(f"^{dataset}$"), "unsafe-path": ~F.col("path").rlike(rf"^{dataset}-[0-9]{{3,}}\.json$"),
        "bad-count": F.col("count") < 0, "bad-sha256": ~F.coalesce(F.col("sha256"), F.lit("")).rlike("^[0-9a-f]{64}$"),
    }
    rules = lambda checks, df, item: df.select(F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in checks.items()]))).alias("rule"), item.alias("item"))
    own = rules(broken, manifest, F.col("path"))
    repeated = manifest.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated-path").alias("rule"), F.col("path").alias("item"))
    entry = F.concat_ws(":", "field", "key")
    indexed = rules({"unknown-field": ~F.col("field").isin(*fields), "bad-key": ~F.col("key").rlike(f"^{key}$")}, index, entry)
    lost = index.join(manifest.select("dataset", "path").distinct(), ["dataset", "path"], "left_anti").select(F.lit("unknown-path").alias("rule"), F.col("path").alias("item")).distinct()
    return own.unionByName(repeated).unionByName(indexed).unionByName(lost)


def index_differences(index: DataFrame, sharded: DataFrame, name: str, fields: Sequence[str]) -> DataFrame:
    """dataset, field, key, path, side: entries that only the index or only the data have, the index being built anew from the data."""
    columns = ["dataset", "field", "key", "path"]
    tagged = index.select(*columns, F.lit(1).alias("i"), F.lit(0).alias("d")).unionByName(detail_index(sharded, name, fields).select(*columns, F.lit(0).alias("i"), F.lit(1).alias("d")))
    both = tagged.groupBy(*columns).agg(F.max("i").alias("i"), F.max("d").alias("d")).where("i <> d")
    return both.select(*columns, F.when(F.col("i") == 1, "index").otherwise("data").alias("side"))


def same_content(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: n_left, n_right, same: whether two tables hold the same rows in any order, by their digests; what a rebuilt table is held to."""
    a, b = (hash_tree(df.select(row_hash(*columns).alias("h")), "h").select(F.col("n").alias(f"n_{side}"), F.col("digest").alias(f"d_{side}")) for side, df in (("left", left), ("right", right)))
    return a.crossJoin(b).select("n_left", "n_right", (F.col("d_left") == F.col("d_right")).alias("same"))  # a row each


def publish(spark: SparkSession, df: DataFrame, folder: str, name: str, keys: Sequence[str], checks: Sequence[Callable[[DataFrame], DataFrame]] = (), rows: int = ROWS, most: int = GZIP_BYTES) -> str:
    """Checks, writes, reads back and points: the data go to folder/<version>/, then folder/current.json names it. Returns the version.

    Every check must return no rows, else nothing is pointed to. Shards are halved until every file is smaller than `most`. What was
    written is read again and held to the manifest, whose digest the pointer pins. A version that is there already is not written again,
    and the pointer is replaced last, so a reader sees the old data or the new.
    """
    for check in checks:
        if not check(df).isEmpty():
            raise ValueError(f"check {getattr(check, '__name__', check)} of {name} failed")
    while True:
        manifest = staged(shard_manifest(df, name, keys, df.columns, rows), "manifest")
        version = version_of(manifest).first().version
        base = f"{folder}/{version}"
        if exists(spark, f"{base}/manifest/_SUCCESS"):
            break
        write_dataset(df, base, name, keys, rows)
        large = halved(oversized(spark, base, name, most), most - 1).agg(F.max("pieces").alias("pieces")).first().pieces
        if large is not None and rows == 1:
            raise ValueError(f"a row of {name} is larger than {most} bytes")
        if large is None:
            back = spark.read.schema(f"{_ddl(df)}, shard long").json(f"{base}/{name}")
            if not damaged_shards(back, manifest, keys, df.columns).isEmpty():
                raise OSError(f"{base} does not hold what was written")
            manifest.write.mode("overwrite").json(f"{base}/manifest")
            break
        rows = max(1, rows // max(2, large))
    pointer = {"schemaVersion": 1, "root": version, "dataset": name, "manifestSha256": manifest_digest(manifest), "keys": list(keys), "schema": _ddl(df), "columns": df.columns}
    put_text(spark, f"{folder}/current.json", json.dumps(pointer))
    return version


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def upserted(existing: DataFrame, changed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of existing whose key has not changed, and all of changed."""
    return existing.join(changed.select(*keys).distinct(), list(keys), "left_anti").unionByName(changed)


def without_orphans(existing: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return existing.join(present.select(key).distinct(), key, "left_semi")


def changed_since(found: DataFrame, stored: DataFrame, key: str, mtime: str) -> DataFrame:
    """Rows of found that are new or newer than what is stored."""
    old = stored.groupBy(key).agg(F.max(mtime).alias("_old"))
    return found.join(old, key, "left").where(F.col("_old").isNull() | (F.col(mtime) > F.col("_old"))).drop("_old")


def new_edges(existing: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of sources in `edges` are replaced, each edge once."""
    return existing.join(edges.select("src").distinct(), "src", "left_anti").unionByName(edges).dropDuplicates(["src", "dst", "type"])


def append_log(entries: DataFrame, folder: str, at: str) -> None:
    """Appends JSON lines under day=<date>/: days replace rotation by size."""
    entries.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").json(folder)


def halved(manifest: DataFrame, limit: int, size: str = "bytes") -> DataFrame:
    """Adds pieces: into how many equal runs a shard must be cut so that each is under the limit (powers of two)."""
    return manifest.withColumn("pieces", F.pow(F.lit(2), F.greatest(F.ceil(F.log2(F.col(size) / F.lit(limit))), F.lit(0))).cast("long"))


def latest_rows(log: DataFrame, keys: Sequence[str], at: str, ties: Sequence[str] | None = None) -> DataFrame:
    """The latest row of each key: what an append-only table means. Rows of one time are told apart by `ties` (all other columns, if not given), the greatest first."""
    order = Window.partitionBy(*keys).orderBy(F.desc(at), *[F.desc(c) for c in (ties if ties is not None else sorted(set(log.columns) - {*keys, at}))])
    return log.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
