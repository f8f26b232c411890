"""Round trips of readers, sinks and streams."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from proofgrid.sinks import publish
from proofgrid.sources import readers
from proofgrid.streaming import logs


def test_publish_and_read_back(spark, tmp_path, rows):
    df = spark.range(25).select("id", (F.col("id") % 3).cast("string").alias("kind"))
    folder = f"file://{tmp_path}/site"
    version = publish.publish(spark, df, folder, "things", ["id"], checks=[lambda d: d.where("id < 0")], rows=10)
    assert version == publish.publish(spark, df.repartition(3), folder, "things", ["id"], rows=10)
    back = readers.published(spark, folder)
    assert rows(back, "id", "kind") == rows(df) and back.select("shard").distinct().count() == 3
    index = publish.detail_index(publish.in_shards(df, ["id"], 10), "things", ["id"])
    assert rows(readers.published_keys(spark, folder, index, "id", 17), "id", "shard") == [(17, 1)]
    assert readers.published_keys(spark, folder, index, "id", 99).count() == 0
    assert publish.oversized(spark, f"{folder}/{version}", "things", most=1).count() == 3


def test_shards_are_halved_until_they_are_small(spark, tmp_path, rows):
    df = spark.range(400).select("id", F.sha2(F.col("id").cast("string"), 256).alias("noise"))
    folder = f"file://{tmp_path}/small"
    version = publish.publish(spark, df, folder, "noise", ["id"], rows=400, most=6000)
    assert publish.oversized(spark, f"{folder}/{version}", "noise", most=6000).isEmpty() and readers.published(spark, folder).select("shard").distinct().count() > 3


def test_damage_is_found_on_read(spark, tmp_path):
    folder = f"file://{tmp_path}/hurt"
    version = publish.publish(spark, spark.range(30).select("id", F.lit("x").alias("v")), folder, "d", ["id"], rows=10)
    assert readers.published(spark, folder).count() == 30
    spark.range(10, 12).select("id", F.lit("x").alias("v")).write.mode("overwrite").option("compression", "gzip").json(f"{folder}/{version}/d/shard=1")
    with pytest.raises(ValueError, match="damaged shards"):
        readers.published(spark, folder)
    assert readers.published(spark, folder, verify=False).count() == 22
    index = publish.detail_index(publish.in_shards(spark.range(30), ["id"], 10), "d", ["id"])
    assert readers.published_keys(spark, folder, index, "id", 25).count() == 1  # its shard is whole
    with pytest.raises(ValueError, match="damaged shards"):
        readers.published_keys(spark, folder, index, "id", 11)
    spark.createDataFrame([("d", 0, "d-000.json", 10, "00")], "dataset string, shard long, path string, count long, sha256 string").write.mode("overwrite").json(f"{folder}/{version}/manifest")
    with pytest.raises(ValueError, match="manifest"):
        readers.published(spark, folder)


def test_log_days_and_interpolation(spark, tmp_path, rows):
    entries = spark.sql("select timestamp'2024-01-01 10:00' t, 1 k union all select timestamp'2024-01-02 10:00', 2")
    publish.append_log(entries, f"{tmp_path}/log", "t")
    publish.append_log(entries, f"{tmp_path}/log", "t")
    assert spark.read.json(f"{tmp_path}/log").groupBy("day").count().count() == 2 and spark.read.json(f"{tmp_path}/log").count() == 4
    cases = spark.createDataFrame([("a", "x {{file: f.md }} y {{file:none}}{{file:f.md}}"), ("b", "plain"), ("c", None)], "path string, text string")
    files = spark.createDataFrame([("f.md", "F")], "path string, text string")
    assert rows(readers.interpolated(cases, files), "path", "text") == [("a", "x F y {{file:none}}F"), ("b", "plain"), ("c", None)]


def test_a_failed_check_leaves_the_pointer(spark, tmp_path):
    df = spark.range(5)
    try:
        publish.publish(spark, df, f"file://{tmp_path}/s", "t", ["id"], checks=[lambda d: d])
    except ValueError:
        assert not (tmp_path / "s/current.json").exists()
    else:
        raise AssertionError("the check did not fail")


def test_upserts_edges_and_changes(spark, rows):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "f string, m int")
    new = spark.createDataFrame([("b", 2), ("c", 1), ("a", 1)], "f string, m int")
    assert rows(publish.changed_since(new, old, "f", "m")) == [("b", 2), ("c", 1)]
    assert rows(publish.upserted(old, new.where("f = 'b'"), ["f"])) == [("a", 1), ("b", 2)]
    assert rows(publish.without_orphans(old, new.where("f = 'b'"), "f")) == [("b", 1)]
    e = lambda *x: spark.createDataFrame(list(x), "src string, dst string, type string")
    assert rows(publish.new_edges(e(("a", "x", "t"), ("b", "y", "t")), e(("a", "z", "t"), ("a", "z", "t")))) == [("a", "z", "t"), ("b", "y", "t")]
    assert [r.pieces for r in publish.halved(spark.createDataFrame([(10,), (512_001,), (2_000_000,)], "bytes long"), 512_000).collect()] == [1, 2, 4]


def test_markdown_tree(spark, tmp_path, rows):
    for name, text in {"a/x.md": "---\nk: v\n---\nhi", "y.md": "root", "a/.hid/z.md": "no", "node_modules/q.md": "no", "a/t.txt": "no"}.items():
        p = tmp_path / "kb" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    assert rows(readers.markdown(spark, f"{tmp_path}/kb"), "path", "layer", "text") == [("a/x.md", "a", "---\nk: v\n---\nhi"), ("y.md", "root", "root")]


def test_journal_skips_malformed_lines(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"written_at": "2024-01-02", "kind": "a"}\n{bad\n{"written_at": "2024-01-01", "kind": "b"}\n')
    read = lambda **k: [r.kind for r in readers.journal(spark, str(tmp_path / "j.jsonl"), "written_at string, kind string", **k).collect()]
    assert sorted(read()) == ["a", "b"] and read(newest=1) == ["a"] and read(kind="b") == ["b"] and read(since="2024-01-02") == ["a"]


def test_blobs(spark, tmp_path, rows):
    good, bad = b"good", b"bad"
    names = {k: hashlib.sha256(k).hexdigest() for k in (good, bad, b"gone")}
    (tmp_path / names[good]).write_bytes(good)
    (tmp_path / names[bad]).write_bytes(b"bax")
    manifest = spark.createDataFrame([("g", names[good], 4), ("b", names[bad], 3), ("n", names[b"gone"], 4)], "key string, sha256 string, bytes int")
    assert rows(readers.damaged_blobs(manifest, readers.blobs(spark, str(tmp_path)))) == [("b", "content"), ("n", "missing")]


def test_eval_cases(spark):
    files = spark.createDataFrame([("c.md", "---\nskill: s\n---\n# Input\nfoo\nbar\n# Expected\nbaz\n")], "path string, text string")
    case = readers.eval_cases(files).first()
    assert case.fields == {"skill": "s"} and case.sections == {"Input": "foo\nbar", "Expected": "baz"}


def test_streams_give_what_batches_give_and_go_on(spark, tmp_path, rows):
    events = spark.createDataFrame([(i, f"2024-01-0{1 + i // 10} 00:00:0{i % 10}", i % 3, "k", 1.0 * i) for i in range(40)], "event_id int, ts string, user_id int, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = lambda: logs.event_stream(spark, f"{tmp_path}/in/*", events.schema)
    found = logs.run_available(logs.windowed_kinds(stream(), "ts", "event_type", "value"), f"{tmp_path}/w")
    assert rows(found.select(F.date_format("start", "dd").alias("d"), "n")) == [("01", 10), ("02", 10)]  # the watermark has not passed the third day
    later = events.limit(1).select("event_id", F.expr("timestamp_ntz'2024-01-09'").alias("ts"), "user_id", "event_type", "value")
    later.write.parquet(f"{tmp_path}/in/b")
    found = logs.run_available(logs.windowed_kinds(stream(), "ts", "event_type", "value"), f"{tmp_path}/w")
    assert found.count() == 4
    twice = logs.run_available(logs.without_repeats(stream().withColumn("event_id", F.col("event_id") % 5), "ts", "event_id", "30 days"), f"{tmp_path}/d")
    assert twice.count() == 5
    one = logs.run_available(logs.sessions(stream(), "ts", "user_id"), f"{tmp_path}/s")
    assert json.loads(one.select(F.sum("n").alias("n")).toJSON().first())["n"] == 40
