"""A dataset of several tables under one chain of commits: staged, checked across tables, committed by compare-and-swap, swept.

    folder/data/<version>/<table>/shard=<n>/   gzip-compressed JSON
    folder/data/<version>/manifests/<table>/   a row a shard: path, count, sha256
    folder/commits/<number>.json               what a reader follows: version, and of each table keys, schema and manifest digest

A commit is a file that must not be there yet. A writer that has read commit n writes n + 1; who comes second finds the name taken and
learns that its input is stale. All tables are written, read back and held to each other before, so a reader sees all of them
old or all of them new, and a writer that dies leaves data that no commit names, which `sweep` removes.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.operators.order import positions
from proofgrid.sinks import publish
from proofgrid.sinks.storage import exists, get_text, names, put_new, put_text, remove, staged

MANIFEST = "dataset string, shard long, path string, count long, sha256 string"


class StaleWrite(RuntimeError):
    """Another writer has committed since the state that this write was made from."""


@dataclass(frozen=True)
class Reference:
    """Non-null values of the child's columns must be found in the parent's."""

    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


def head(spark: SparkSession, folder: str) -> int:
    """The number of the last commit, 0 without one."""
    return max([int(name.removesuffix(".json")) for name, _ in names(spark, f"{folder}/commits") if name.endswith(".json")], default=0)


def commit_of(spark: SparkSession, folder: str, number: int) -> dict:
    found = json.loads(get_text(spark, f"{folder}/commits/{number:012d}.json"))
    if found.get("schemaVersion") != 1:
        raise ValueError(f"commit {number} of {folder} has an unknown schema")
    return found


def read_table(spark: SparkSession, folder: str, version: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, shard long").json(f"{folder}/data/{version}/{name}")


def orphans(tables: Mapping[str, DataFrame], references: Sequence[Reference]) -> DataFrame:
    """child, columns, key of what the references do not find; a row a distinct key."""
    found = None
    for r in references:
        keys = tables[r.child].select(*r.columns).dropna().distinct()
        lost = keys.join(tables[r.parent].select(*[F.col(p).alias(c) for p, c in zip(r.parent_columns, r.columns)]), list(r.columns), "left_anti")
        part = lost.select(F.lit(r.child).alias("child"), F.lit(",".join(r.columns)).alias("columns"), F.concat_ws(",", *[F.col(c).cast("string") for c in r.columns]).alias("key"))
        found = part if found is None else found.unionByName(part)
    return found


def stage(spark: SparkSession, tables: Mapping[str, tuple[DataFrame, Sequence[str]]], folder: str, rows: int = publish.ROWS, most: int = publish.GZIP_BYTES) -> dict:
    """The first phase: writes all tables (name: rows, keys) under a version that follows from their content, reads them back, returns what a commit says.

    Shards are halved until every file is below `most`; a single row above it is an error. What is there already, whole, is not written again.
    """
    plans, said = {}, {}
    for name, (df, keys) in sorted(tables.items()):
        fit, placed = rows, positions(df, list(keys), "_at")  # sorted once, however often shards are halved
        while True:  # cut on a trial copy, so that the version does not depend on how often shards were halved
            manifest = staged(publish.shard_manifest(placed, name, keys, df.columns, fit, "_at"), "manifest")
            trial = f"{folder}/data/trial-{uuid.uuid4().hex}"
            publish.write_dataset(placed, trial, name, keys, fit, "_at")
            pieces = publish.halved(publish.oversized(spark, trial, name, most), most - 1).agg(F.max("pieces")).first()[0]
            if pieces is None:
                break
            remove(spark, trial)
            if fit == 1:
                raise ValueError(f"a row of {name} is larger than {most} bytes")
            fit = max(1, fit // max(2, pieces))
        plans[name] = trial, manifest, df, list(keys)
        said[name] = {"keys": list(keys), "schema": publish._ddl(df), "columns": df.columns, "manifestSha256": publish.manifest_digest(manifest)}
    version = "v1-" + hashlib.sha256(json.dumps(said, sort_keys=True).encode()).hexdigest()[:16]
    base = f"{folder}/data/{version}"
    for name, (trial, manifest, df, keys) in plans.items():
        if not exists(spark, f"{base}/manifests/{name}/_SUCCESS"):
            move(spark, f"{trial}/{name}", f"{base}/{name}")
            damaged = publish.damaged_shards(read_table(spark, folder, version, name, said[name]["schema"]), manifest, keys, df.columns)
            if not damaged.isEmpty():
                raise OSError(f"{base}/{name} does not hold what was written")
            manifest.write.mode("overwrite").json(f"{base}/manifests/{name}")
        remove(spark, trial)
    put_text(spark, f"{base}/staged", version)  # the version is young again, so that no sweep takes it before its commit
    return {"schemaVersion": 1, "root": version, "tables": said}


def move(spark: SparkSession, source: str, place: str) -> None:
    """Puts a folder in its place, over what an abandoned write has left there."""
    from proofgrid.sinks.storage import _path

    (a, store), (b, _) = _path(spark, source), _path(spark, place)
    store.delete(b, True)
    store.mkdirs(b.getParent())
    if not store.rename(a, b):
        raise OSError(f"{source} could not be moved to {place}")


def publish_tables(
    spark: SparkSession, tables: Mapping[str, tuple[DataFrame, Sequence[str]]], folder: str, references: Sequence[Reference] = (), checks: Sequence[Callable[[Mapping[str, DataFrame]], DataFrame]] = (),
    parent: int | None = None, rows: int = publish.ROWS, most: int = publish.GZIP_BYTES,
) -> int:
    """Publishes all tables at once and returns the number of the commit.

    parent is the commit that the tables were made from (the last one at the call, if not given); if another has followed since, StaleWrite is
    raised and nothing changes for readers. Checks get the staged tables by name and must return no rows, references must find all
    keys: both look at what was written, across tables.
    """
    parent = head(spark, folder) if parent is None else parent
    said = stage(spark, tables, folder, rows, most)
    held = {name: read_table(spark, folder, said["root"], name, t["schema"]) for name, t in said["tables"].items()}
    lost = orphans(held, references) if references else None
    if lost is not None and (few := lost.limit(5).collect()):
        raise ValueError(f"references without a target: {[tuple(r) for r in few]}")
    for check in checks:
        if not check(held).isEmpty():
            raise ValueError(f"check {getattr(check, '__name__', check)} failed")
    text = json.dumps(said | {"parent": parent, "at": time.time()})
    if head(spark, folder) != parent or not put_new(spark, f"{folder}/commits/{parent + 1:012d}.json", text):
        raise StaleWrite(f"{folder} has moved on from commit {parent}")
    return parent + 1


def read_tables(spark: SparkSession, folder: str, number: int | None = None, verify: bool = True) -> dict[str, DataFrame]:
    """The tables of a commit (the last one, if not given) by name.

    With verify, each manifest must have the digest that the commit pins, and every shard the rows and the hash that its manifest says.
    """
    number = head(spark, folder) if number is None else number
    if not number:
        raise FileNotFoundError(f"{folder} has no commit")
    said, found = commit_of(spark, folder, number), {}
    for name, t in said["tables"].items():
        data = read_table(spark, folder, said["root"], name, t["schema"])
        if verify:
            manifest = spark.read.schema(MANIFEST).json(f"{folder}/data/{said['root']}/manifests/{name}")
            if publish.manifest_digest(manifest) != t["manifestSha256"]:
                raise ValueError(f"the manifest of {name} is not the one committed")
            bad = publish.damaged_shards(data, manifest, t["keys"], t["columns"]).limit(5).collect()
            if bad:
                raise ValueError(f"damaged shards of {name}: {[tuple(r) for r in bad]}")
        found[name] = data
    return found


def shards(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """The manifest rows of all tables of a commit."""
    said = commit_of(spark, folder, head(spark, folder) if number is None else number)
    return spark.read.schema(MANIFEST).json([f"{folder}/data/{said['root']}/manifests/{name}" for name in said["tables"]])


def sweep(spark: SparkSession, folder: str, keep: int = 2, grace: float = 86_400) -> list[str]:
    """Removes data that none of the last `keep` commits names and that have not changed for `grace` seconds; returns their names.

    Earlier commits stay on record. The grace spares writers at work: staging makes a version young again.
    """
    last = head(spark, folder)
    named = {commit_of(spark, folder, n)["root"] for n in range(max(1, last - keep + 1), last + 1)}
    gone = []
    for name, at in names(spark, f"{folder}/data"):
        latest = max([at, *[t for _, t in names(spark, f"{folder}/data/{name}")]])
        if name not in named and time.time() - latest >= grace:
            remove(spark, f"{folder}/data/{name}")
            gone.append(name)
    return gone
