"""Publication of several tables: one commit for all, references across them, two writers, a writer that dies, sweeping."""

import pytest
from pyspark.sql import functions as F

from proofgrid.sinks import dataset as D
from proofgrid.sinks.storage import get_text, names, put_new, shared_folder

REFERENCES = [D.Reference("child", ("p",), "parent", ("id",))]


def tables(spark, n=25, bump=0):
    parent = spark.range(10).select("id", (F.col("id") + bump).cast("string").alias("name"))
    child = spark.range(n).select("id", (F.col("id") % 10).alias("p"))
    return {"parent": (parent, ["id"]), "child": (child, ["id"])}


def child(spark, n=25):
    return {"child": tables(spark, n)["child"]}


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/set"


def test_all_tables_come_with_one_commit(spark, folder, rows):
    made = tables(spark)
    assert D.publish_tables(spark, made, folder, REFERENCES, rows=10) == 1
    back = D.read_tables(spark, folder)
    for name, (df, _) in made.items():
        assert rows(back[name], *df.columns) == rows(df)
    assert back["child"].select("shard").distinct().count() == 3 and D.shards(spark, folder).count() == 4
    assert D.publish_tables(spark, tables(spark, 30, 1), folder, REFERENCES, rows=10) == 2
    assert D.read_tables(spark, folder)["child"].count() == 30 and D.read_tables(spark, folder, 1)["child"].count() == 25
    assert D.publish_tables(spark, tables(spark), folder, REFERENCES, rows=10) == 3  # back to the first content: the same version under a new commit
    assert D.commit_of(spark, folder, 3)["root"] == D.commit_of(spark, folder, 1)["root"] and not [n for n, _ in names(spark, f"{folder}/data") if n.startswith("trial")]


def test_references_and_checks_look_across_what_is_staged(spark, folder):
    D.publish_tables(spark, tables(spark), folder, REFERENCES)
    broken = tables(spark) | {"parent": (tables(spark)["parent"][0].where("id <> 3"), ["id"])}
    with pytest.raises(ValueError, match="'3'"):
        D.publish_tables(spark, broken, folder, REFERENCES)
    with pytest.raises(ValueError, match="check"):
        D.publish_tables(spark, tables(spark, 12), folder, checks=[lambda held: held["child"].join(held["parent"], F.col("p") == held["parent"]["id"]).limit(1)])
    assert D.head(spark, folder) == 1 and D.read_tables(spark, folder)["parent"].count() == 10
    nulls = spark.createDataFrame([(1, None), (2, 5)], "id long, p long")
    assert D.publish_tables(spark, tables(spark) | {"child": (nulls, ["id"])}, folder, REFERENCES) == 2  # null refers to nothing


def test_of_two_writers_one_is_told_that_it_is_stale(spark, folder):
    D.publish_tables(spark, child(spark), folder)
    seen = D.head(spark, folder)
    assert D.publish_tables(spark, child(spark, 40), folder, parent=seen) == 2
    with pytest.raises(D.StaleWrite):
        D.publish_tables(spark, child(spark, 50), folder, parent=seen)
    assert D.read_tables(spark, folder)["child"].count() == 40
    assert D.publish_tables(spark, child(spark, 50), folder, parent=2) == 3


def test_writers_that_meet_at_the_last_step(spark, folder, monkeypatch):
    """Both have seen the same head right before they commit; the file of the commit decides."""
    D.publish_tables(spark, child(spark), folder)
    monkeypatch.setattr(D, "head", lambda *_: 1)
    D.publish_tables(spark, child(spark, 40), folder)
    with pytest.raises(D.StaleWrite):
        D.publish_tables(spark, child(spark, 50), folder)
    monkeypatch.undo()
    assert D.head(spark, folder) == 2 and D.read_tables(spark, folder)["child"].count() == 40


def test_a_writer_that_dies_between_the_phases_changes_nothing_and_is_swept(spark, folder, monkeypatch):
    D.publish_tables(spark, child(spark), folder)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(D, "put_new", dies)
        with pytest.raises(KeyboardInterrupt):
            D.publish_tables(spark, child(spark, 60), folder)
    assert D.head(spark, folder) == 1 and D.read_tables(spark, folder)["child"].count() == 25
    assert len(names(spark, f"{folder}/data")) == 2 and D.sweep(spark, folder) == []  # too young
    assert len(D.sweep(spark, folder, grace=0)) == 1 and D.read_tables(spark, folder)["child"].count() == 25
    assert D.publish_tables(spark, child(spark, 60), folder) == 2 and D.read_tables(spark, folder)["child"].count() == 60


def test_a_half_written_version_is_written_again(spark, folder, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(D.publish, "damaged_shards", lambda *_: spark.range(1))
        with pytest.raises(OSError):
            D.publish_tables(spark, child(spark), folder)
    assert D.publish_tables(spark, child(spark), folder) == 1 and D.read_tables(spark, folder)["child"].count() == 25


def test_sweep_keeps_the_last_commits(spark, folder):
    for n in (10, 20, 30):
        D.publish_tables(spark, child(spark, n), folder)
    gone = D.sweep(spark, folder, keep=2, grace=0)
    assert gone == [D.commit_of(spark, folder, 1)["root"]] and [D.read_tables(spark, folder, k)["child"].count() for k in (2, 3)] == [20, 30]


def test_damage_is_found_on_read_and_rows_too_large_are_refused(spark, folder):
    D.publish_tables(spark, child(spark), folder, rows=10)
    version = D.commit_of(spark, folder, 1)["root"]
    spark.range(10, 12).select("id", F.lit(1).alias("p")).write.mode("overwrite").option("compression", "gzip").json(f"{folder}/data/{version}/child/shard=1")
    with pytest.raises(ValueError, match="damaged shards of child"):
        D.read_tables(spark, folder)
    assert D.read_tables(spark, folder, verify=False)["child"].count() == 17
    noise = spark.range(3).select("id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(200)), lambda k: F.sha2((k + F.col("id")).cast("string"), 256)), "").alias("x"))
    with pytest.raises(ValueError, match="larger than"):
        D.publish_tables(spark, {"noise": (noise, ["id"])}, folder, most=3000)
    with pytest.raises(FileNotFoundError):
        D.read_tables(spark, f"{folder}-none")


def test_a_new_file_is_written_once(spark, tmp_path):
    uri = f"file://{tmp_path}/c/1.json"
    assert put_new(spark, uri, "a") and not put_new(spark, uri, "b") and get_text(spark, uri) == "a" and [n for n, _ in names(spark, f"file://{tmp_path}/c")] == ["1.json"]


def test_a_table_is_sorted_once_however_often_its_shards_are_halved(spark, folder, rows):
    ordered = lambda: {n for n, _ in names(spark, shared_folder(spark)) if n.startswith("ordered-")}
    df, before = spark.range(400).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text")), ordered()
    D.publish_tables(spark, {"texts": (df, ["id"])}, folder, rows=400, most=8000)
    assert len(ordered() - before) == 1 and D.shards(spark, folder).count() > 2
    assert rows(D.read_tables(spark, folder)["texts"], "id", "text") == rows(df)
