"""Vectors of texts against a plain version, and searches from raw Markdown to evaluated hits."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from proofgrid.operators import embedding as E
from proofgrid.operators import retrieval as R

TEXTS = [(1, "Maps and mirrors, maps"), (2, "mirrored MAPS"), (3, ""), (4, None), (5, "42 — ¡ñandú! naïve"), (6, "maps and mirrors maps"), (7, "..."), (8, "wholly other words entirely")]


def plain(texts):
    lists = [[w for w in re.split(r"[^\w]|_", (t or "").lower()) if w] for _, t in texts]
    lists = [ws + ["~" + w[:5] for w in ws if len(w) > 5] for ws in lists]
    hexes = {f: hashlib.md5(f.encode()).hexdigest() for ws in lists for f in ws}
    df = Counter(b for ws in lists for b in {hexes[f][:5] for f in ws})
    out = {}
    for (i, _), ws in zip(texts, lists):
        v = np.zeros(256)
        for f, n in Counter(ws).items():
            h = hexes[f]
            w = (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[h[:5]])) + 1)
            for k in range(4):
                v[int(h[6 + 2 * k : 8 + 2 * k], 16)] += w * (0.5 if int(h[16 + k], 16) % 2 == 0 else -0.5)
        out[i] = v / np.linalg.norm(v) if ws else None
    return out


def test_vectors_are_those_of_the_plain_version(spark):
    docs = spark.createDataFrame(TEXTS, "id long, text string").withColumn("source url", F.lit("kept"))
    got, want = E.embed(docs, E.Weights.fit(docs)).collect(), plain(TEXTS)
    assert len(got) == len(TEXTS) and all(r["source url"] == "kept" for r in got)
    for r in got:
        if want[r.id] is None:
            assert r.vector is None
        else:
            assert np.allclose(r.vector, want[r.id]) and np.linalg.norm(r.vector) == pytest.approx(1)
    assert E.embed(docs.limit(0), E.Weights.fit(docs.limit(0))).count() == 0


def test_texts_that_are_alike_are_near(spark):
    docs = spark.createDataFrame(TEXTS, "id long, text string")
    v = {r.id: np.array(r.vector) for r in E.embed(docs, E.Weights.fit(docs)).where("vector IS NOT NULL").collect()}
    assert v[1] @ v[6] == pytest.approx(1) and v[1] @ v[2] > 0.4 > abs(v[1] @ v[8])


def test_fitting_reads_each_text_once(spark):
    docs, seen = spark.createDataFrame(TEXTS, "id long, text string").repartition(2), spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    E.Weights.fit(docs.mapInArrow(through, docs.schema))
    assert seen.value == len(TEXTS)


def test_features_are_counted_in_pieces_as_in_whole_texts(monkeypatch):
    """Pieces of few bytes, texts longer than a piece, repeated words and stems, characters that only a later Unicode calls letters."""
    texts = pa.array(["", "mirror mirrors mirrors a", "...", "x" * 50, "a\u0870b ñandúes", "mirrored"])
    monkeypatch.setattr(E, "AT_ONCE", 20)
    got, rows, sizes = Counter(), 0, []
    for batch in E.pieces(pa.RecordBatch.from_pydict({"_text": texts})):
        row, code, n, features = E.counted(batch.column("_text"))
        names = features.to_pylist()
        got.update({(rows + int(r), names[c]): int(x) for r, c, x in zip(row, code, n)})
        rows += batch.num_rows
        sizes.append(batch.num_rows)
    assert rows == len(texts) and max(sizes) < 3
    assert got == {(1, "mirror"): 1, (1, "mirrors"): 2, (1, "a"): 1, (1, "~mirro"): 3, (3, "x" * 50): 1, (3, "~xxxxx"): 1, (4, "a\u0870b"): 1, (4, "ñandúes"): 1, (4, "~ñandú"): 1, (5, "mirrored"): 1, (5, "~mirro"): 1}


TOPICS = ["economy rounds rifles", "smoke grenades lineups", "veto strategy pools", "roster signing transfer", "crosshair mouse settings", "demo review notes", "travel visa schedule", "sponsor contract terms"]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """Eight notes of two sections on a topic each, padded with words that all share."""
    root = tmp_path_factory.mktemp("kb")
    for k, topic in enumerate(TOPICS):
        words = topic.split()
        body = lambda n: " ".join(f"{words[j % 3]} with the usual remark number {j}" for j in range(n))  # noqa: E731, B023
        (root / f"layer{k % 2}").mkdir(exist_ok=True)
        (root / f"layer{k % 2}" / f"note{k}.md").write_text(f"---\nmap: arena{k}\nrelated: [note{(k + 1) % 8}]\n---\n# First {k}\n{body(6)}\n\n## Second {k}\n{body(9)}\n")
    return str(root)


def test_from_markdown_to_evaluated_hits(spark, tree):
    """Every topic's note is found first by its words; evaluated as probes, with recall of 1."""
    queries = spark.createDataFrame([(k, t.upper()) for k, t in enumerate(TOPICS)], "qid long, text string")
    hits = E.search_markdown(spark, tree, queries, k=10, hints=("map",))
    found = R.distinct_files(hits.select("qid", "file", "rank"), "file", 5)
    relevant = spark.createDataFrame([(k, f"layer{k % 2}/note{k}.md") for k in range(8)], "qid long, file string")
    scores = {r.category: r for r in R.evaluate(found, relevant, queries.select("qid", F.lit("topic").alias("category"))).collect()}
    assert scores["overall"].recall_at_3 == 1.0 and scores["overall"].mrr >= 0.9


def test_hints_are_embedded_but_not_stored_and_links_join_files(spark, tree):
    chunks, links = E.markdown_chunks(spark, tree, ("map", "absent"))
    rows = chunks.collect()
    assert len(rows) == 16 and all(r.embedded.startswith("[meta: map=arena") and "meta" not in r.text and "map:" not in r.text for r in rows)
    assert ("layer0/note0.md", "layer1/note1.md") in {tuple(r) for r in links.collect()} and links.count() == 8
    asked = spark.createDataFrame([(1, "arena5")], "qid long, text string")
    hits = E.search_markdown(spark, tree, asked, k=16, hints=("map",)).collect()
    first = next(r for r in hits if r.vec_rank == 1)
    assert first.file == "layer1/note5.md" and first.bm25_rank is None and any(r.graph_rank for r in hits)


def test_another_embedder_can_stand_in(spark, tree):
    two = lambda df, column: df.withColumn("vector", F.array(F.when(F.contains(column, F.lit("visa")), 1.0).otherwise(0.0), F.when(F.contains(column, F.lit("visa")), 0.0).otherwise(1.0)))
    asked = spark.createDataFrame([(1, "visa")], "qid long, text string")
    assert E.search_markdown(spark, tree, asked, k=2, embedder=two).select("file").distinct().collect()[0].file == "layer0/note6.md"
