"""The index that follows a Markdown tree: after any changes, crashes and restarts it is what a full build gives."""

import os

import pytest

from proofgrid.operators import lexical_index as L
from proofgrid.streaming import knowledge as K


@pytest.fixture(autouse=True)
def few_slots(monkeypatch):
    monkeypatch.setattr(L, "SLOTS", 4)


def write(root, name, text, at=None):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    if at:
        os.utime(path, (at, at))


def note(k, word):
    return f"---\nrelated: [n{k + 1}]\n---\n# Title {k}\n" + f"{word} and further words about it that make the part long enough to be kept as a chunk number {k}\n" * 2


def holds(spark, rows, folder, asked):
    return rows(K.found(spark, folder, asked)), rows(L.live(spark, folder, "chunks")), rows(L.live(spark, folder, "links")), [r[0] for r in rows(L.live(spark, folder, "files"), "file")]


def test_changes_crashes_and_restarts_give_a_full_build(spark, rows, tmp_path, monkeypatch):
    root, kept = tmp_path / "kb", f"file://{tmp_path}/kept"
    asked = spark.createDataFrame([(1, "apple"), (2, "pear number"), (3, "melon")], "qid long, text string")
    for k, word in enumerate(("apple", "pear", "plum", "apple pear")):
        write(root, f"a/n{k}.md", note(k, word), 1_700_000_000 + k)
    run = lambda: K.follow(spark, str(root), kept, f"{tmp_path}/state", 2)
    run().awaitTermination()
    assert L.head(spark, kept) == 1  # the first batch brings all that is there; the second finds nothing to do
    # a file changes, one goes, one loses its chunks, one comes; the writer dies after its commit and before the stream's checkpoint
    write(root, "a/n0.md", note(0, "melon"), 1_700_000_100)
    (root / "a/n1.md").unlink()
    write(root, "a/n2.md", "short", 1_700_000_101)
    write(root, "b/n9.md", note(9, "pear"), 1_700_000_102)
    real = L.update

    def dies(*args, **options):
        real(*args, **options)
        raise RuntimeError("died after the commit")

    monkeypatch.setattr(L, "update", dies)
    with pytest.raises(Exception, match="died after the commit"):
        run().awaitTermination()
    monkeypatch.setattr(L, "update", real)
    assert L.head(spark, kept) == 2
    run().awaitTermination()
    assert L.head(spark, kept) == 2  # the batch came again and was known
    whole = f"file://{tmp_path}/whole"
    K.sync(spark, str(root), whole)
    assert holds(spark, rows, kept, asked) == holds(spark, rows, whole, asked)
    assert {r.file for r in K.found(spark, kept, asked).collect()} == {"a/n0.md", "a/n3.md", "b/n9.md"}
    # compaction keeps the tables by file; without changes nothing is written
    L.compact(spark, kept)
    assert holds(spark, rows, kept, asked) == holds(spark, rows, whole, asked) and K.sync(spark, str(root), kept) == 3


def test_a_writer_that_dies_before_its_commit_leaves_no_trace(spark, rows, tmp_path, monkeypatch):
    root, kept = tmp_path / "kb", f"file://{tmp_path}/kept"
    asked = spark.createDataFrame([(1, "apple")], "qid long, text string")
    write(root, "n0.md", note(0, "apple"))
    K.sync(spark, str(root), kept)
    before = holds(spark, rows, kept, asked)
    write(root, "n1.md", note(1, "apple"))

    def dies(*_):
        raise RuntimeError("died before the commit")

    with monkeypatch.context() as m:
        m.setattr(L, "put_new", dies)
        with pytest.raises(RuntimeError):
            K.sync(spark, str(root), kept)
    assert holds(spark, rows, kept, asked) == before
    K.sync(spark, str(root), kept)
    assert len(rows(K.found(spark, kept, asked))) == 2
