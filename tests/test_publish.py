"""Manifests of more than a thousand shards, and the size guard's edges."""

import hashlib
import math

from pyspark.sql import functions as F

from proofgrid.operators import oplog
from proofgrid.sinks import publish


def test_a_version_of_many_shards_is_the_hash_of_their_hashes_in_order(spark):
    manifest = spark.range(1003).select(F.col("id").alias("shard"), F.sha2(F.col("id").cast("string"), 256).alias("sha256")).repartition(4)
    flat = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(1003))
    assert publish.version_of(manifest).first().version == "v1-" + hashlib.sha256(flat.encode()).hexdigest()[:16]


def test_a_thousand_shards_and_more_have_paths_of_their_own(spark):
    df = spark.range(1012).select("id")
    manifest = publish.shard_manifest(df, "things", ["id"], ["id"], 1)
    paths = {r.shard: r.path for r in manifest.collect()}
    assert (paths[7], paths[100], paths[1001]) == ("things-007.json", "things-100.json", "things-1001.json") and len(set(paths.values())) == 1012
    assert publish.contract_faults(manifest, publish.detail_index(publish.in_shards(df, ["id"], 1), "things", ["id"]), ["id"]).isEmpty()


def test_size_guard_of_nothing(spark):
    changes = spark.createDataFrame([(1, 0.0, 5.0), (2, None, 5.0), (3, 10.0, 5.0)], "id long, old double, new double")
    found = {r.id: (r.removed_percent, r.warn) for r in oplog.size_guard(changes, "old", "new").collect()}
    assert found == {1: (0.0, False), 2: (None, None), 3: (50.0, True)}
    percent, warn = next((r.removed_percent, r.warn) for r in oplog.size_guard(changes, "old", "new", empty=math.nan).collect() if r.id == 1)
    assert math.isnan(percent) and warn
