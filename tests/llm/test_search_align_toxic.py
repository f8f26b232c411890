"""Ranked search, cross-tokenizer alignment and toxicity: against brute force, at edge cases, with labels held out."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")
EDGES = [
    (1, None), (2, ""), (3, "one"), (None, "no id"), (5, "twice"), (5, "twice"), (6, "x" * 50_000), (7, "le mot " * 30_000), (8, "tab\tand space  two\n\n"), (9, "Ünïcode ß 漢字 😀 é"),
    (10, " lead"), (11, "trail "), (12, " "), (13, "a▁b c"), (14, "<|endoftext|> x <s> </s> <0x41> <unk>"), (15, "a \n b\n  c \t d"), (16, "don't we'll 123 4567 ??? !!!  ... a  b   c"), (17, "漢字" * 3000),
    (18, "\x00 a\x01b \x7f"), (19, "　a   b   c ​ d"), (20, "a 's 't x's  's"), (21, "  \n\n  "),
]


def frame(spark, rows):
    """With extra columns whose names the operators use inside."""
    extra = {c: F.lit("x") for c in ("n", "terms", "item", "keys", "block", "score", "source url", "label", "fold")}
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(extra)


def plain(rows):
    """Rows with their nulls last, in order."""
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x) for x in r))


# --- ranked search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def ranking(docs, items, k=10):
    """Every document scored for every item, in Python's integers."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n, whole = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            if c:
                m = 25 + 75 * sum(c.values()) * n // whole
                score = sum(math.floor(1000 * math.log((2.0 * n + 2) / (2.0 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
                if score > 0:
                    scored.append((-score, i is None, i or 0))
        out += [(item, r, None if gone else i, -s) for r, (s, gone, i) in enumerate(sorted(scored)[:k], 1)]
    return plain(out)


def test_ranked_search_is_its_sql_and_brute_force(spark):
    got = plain(entry.queries()["op11_ranked_search"](spark, DATA).select("item_id", "rank", "doc_id", "score").collect())
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert got == plain(con.execute(entry.oracle_sql()["op11_ranked_search"]).fetchall())
    docs, items = (con.execute(f"SELECT {c}, text FROM {t}").fetchall() for c, t in (("doc_id", "documents"), ("item_id", "benchmark")))
    assert got == ranking(docs, items)


def test_ranked_search_of_edge_cases(spark):
    from proofgrid.llm import search

    items = [(1, "Twice one"), (1, "twice twice ONE mot"), (None, "漢字 id"), (4, None), (5, ""), (6, "unheard of"), (7, "le"), (7, "le")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(3)).withColumn("terms", F.lit("x"))
    got = search.rank_documents(frame(spark, EDGES), bench, segment=4)
    assert plain(got.collect()) == ranking(EDGES, items)
    assert search.rank_documents(frame(spark, EDGES).limit(0), bench).count() == 0 == search.rank_documents(frame(spark, EDGES), bench.limit(0)).count()


def test_ranked_search_in_blocks_and_small_segments_is_the_same(spark):
    """Ties, terms in a third of all rows, segments of 3 to 500 documents, blocks of a few items."""
    from proofgrid.llm import search

    draw = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [" ".join(draw.choices(vocabulary, [1 / (1 + k) for k in range(400)], k=draw.randint(1, 60))) for _ in range(900)]
    docs = [(k, texts[k % 600]) for k in range(900)]
    items = [(k, " ".join(draw.choices(vocabulary, k=draw.randint(1, 25)))) for k in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = ranking(docs, items)
    for segment, block in ((3, 1 << 20), (500, 600)):
        got = search.rank_documents(frame(spark, docs), bench, block_bytes=block, segment=segment)
        assert plain(got.collect()) == want


def test_items_with_a_proof_stop_at_high_tiers_and_others_fall_through(spark):
    """Rare terms decide some items early; an item of common terms only has to read all tiers; both give whole results."""
    from proofgrid.llm import search

    docs = spark.createDataFrame([(k, f"{'the of and' if k % 20 else ''} {'rare' if k % 150 == 0 else ''} x{k} y{k % 7}" + " pad" * (k % 11)) for k in range(3000)], "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([(0, "rare the of"), (1, "the of and")], "item long, text string")
    counts = search.term_counts(bench)
    index = search.build_index(docs, counts.select("term").distinct(), segment=1000)
    hits = search.search(index, counts).collect()
    deepest = {i: max(r.tier for r in hits if r.item == i) for i in (0, 1)}
    assert deepest[0] == 0 < deepest[1]


# --- alignment


@pytest.fixture(scope="module")
def pair():
    from proofgrid.llm.alignment import Pair

    return Pair(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


def aligned(pair, docs):
    """Whole texts through the libraries, links by comparing all tokens of a group."""
    counts, each = Counter(), []
    for i, text in docs:
        a, b = (pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)) if text else ([], [])
        raw = f" {text}".encode()
        if a and not b"".join(pair.bytes_a[x] for x in a) == raw == b"".join(pair.bytes_b[x] for x in b):
            a, b = [], []
        ends_a, ends_b = np.cumsum([len(pair.bytes_a[x]) for x in a]).tolist(), np.cumsum([len(pair.bytes_b[x]) for x in b]).tolist()
        keys, links, p, q = [], [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            r, s = ends_a.index(cut, p) + 1, ends_b.index(cut, q) + 1
            keys.append(",".join(map(str, a[p:r])) + "|" + ",".join(map(str, b[q:s])))
            start = lambda ends, k: ends[k - 1] if k else 0
            links += [(a[x], b[y]) for x in range(p, r) for y in range(q, s) if start(ends_a, x) < ends_b[y] and start(ends_b, y) < ends_a[x]]
            p, q = r, s
        counts.update(links)
        each.append((i, len(a), len(b), len(keys), links, hashlib.sha256(";".join(keys).encode()).hexdigest() if a else ""))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    return plain((i, na, nb, ng, len(ls), sum(counts[p] == top[p[1]] for p in ls), sum(counts[p] for p in ls), h) for i, na, nb, ng, ls, h in each)


def test_alignment_is_that_of_whole_texts(spark, pair):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert plain(entry.queries()["op12_cross_tokenizer_alignment"](spark, DATA).collect()) == aligned(pair, docs)


def test_alignment_of_edge_cases(spark, pair):
    from proofgrid.llm import alignment

    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    assert plain(alignment.align(frame(spark, EDGES), *paths).collect()) == aligned(pair, EDGES)
    assert alignment.align(frame(spark, EDGES).limit(0), *paths).count() == 0


def test_alignment_at_every_kind_of_cut(spark, pair):
    """Texts of marks and blanks at random: words are cut only where neither library's tokens span."""
    from proofgrid.llm import alignment

    draw = random.Random(8)
    marks = [" ", " ", " ", "  ", "\n", "\t", " ", " ", "a", "B", "é", "漢", "1", "12", "'s", "'", "-", "_", "▁", "é", "😀", "\r\n", "the", "on"]
    docs = [(k, "".join(draw.choices(marks, k=draw.randint(1, 40)))) for k in range(400)]
    assert plain(alignment.align(frame(spark, docs).repartition(3), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).collect()) == aligned(pair, docs)


def test_links_are_the_overlaps():
    from proofgrid.llm.alignment import links_of

    assert links_of([2, 3], [1, 4]) == [(0, 0), (0, 1), (1, 1)] and links_of([5], [1, 1, 3]) == [(0, 0), (0, 1), (0, 2)]


# --- toxicity


@pytest.fixture(scope="module")
def grammar():
    from proofgrid.llm import toxicity

    return lambda text: dict(zip(toxicity.FEATURES, toxicity.features(text, toxicity.Lexicon({}))))


def test_clauses_are_scored_by_pattern(grammar):
    high = math.log1p(2.0)
    assert grammar("What an idiot.")["plain"] == pytest.approx(high)
    assert grammar("He is not an idiot.")["negated"] == pytest.approx(high)
    assert grammar("She said idiot once.")["reported"] == pytest.approx(high) and grammar("« idiot »")["reported"] == pytest.approx(high)
    for text in ("you stupid thing", "stupid you", "du bist dumm", "tú estúpido"):
        assert grammar(text)["directed"] == pytest.approx(high), text
    assert grammar("we will kill you")["directed_threat"] == pytest.approx(high) and grammar("we will kill time")["threat"] == pytest.approx(high)
    assert grammar("not now. idiot")["plain"] == pytest.approx(high)  # a scope ends with its clause
    assert all(v == 0 for k, v in grammar("a peaceful clause").items() if k != "size")


def test_composition_is_running_one_machine_after_another():
    from proofgrid.llm import toxicity as t

    draw = random.Random(2)
    machines = t.negation(), t.reported_speech(), t.target()
    for _ in range(300):
        symbols = [draw.randrange(t.SYMBOLS) for _ in range(draw.randint(1, 25))]
        assert t.GRAMMAR.run(symbols) == [a | b | c for a, b, c in zip(*[m.run(symbols) for m in machines])]


def test_toxicity_of_held_out_labels(spark):
    """At least nine of ten held-out toxic documents come before clean ones, and clean ones are left alone."""
    data = "/root/testdata/sf0.01"
    got = entry.queries()["op13_toxicity"](spark, data).join(spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    toxic, clean = ([r.score for r in got if r.toxic == x] for x in (1, 0))
    above = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert above >= 0.9 and sum(s >= 0.5 for s in clean) <= 0.05 * len(clean)


def test_toxicity_meets_inflected_forms_that_no_label_had(spark):
    """Stems are learned: other endings of a stem are met, in texts of the fold held out."""
    from proofgrid.llm import toxicity

    draw = random.Random(4)
    word = lambda: "".join(draw.choices("bdfgklmnprst", k=1)) + "".join(draw.choices("aeiou", k=1)) + "".join(draw.choices("bdfgklmnprst", k=3))
    rows, labels = [], []
    for k in range(1500):
        words, bad = [word() for _ in range(40)], k % 8 == 0
        for _ in range(3 * bad):
            words[draw.randrange(40)] = "vrolz" + word()[:3]
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    found = toxicity.classify(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    assert found and all(r.predicted == int(r.doc_id % 8 == 0) for r in found)


def test_toxicity_of_edge_cases(spark):
    from proofgrid.llm import toxicity

    docs, labels = frame(spark, [*EDGES, (30, "you idiot, you stupid scum. We will kill you.")]), spark.createDataFrame([(1, 1), (3, None), (99, 1), (None, 1)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        got = toxicity.classify(docs, known).collect()
        assert len(got) == len(EDGES) + 1 and all(0 <= r.score <= 1 for r in got) and {r.doc_id: r.predicted for r in got}[30] == 1 and sum(r.predicted for r in got) == 1
    twice = spark.createDataFrame([(3, 1), (3, 0), (7, 0), (8, 0), (9, 0)], "doc_id long, toxic int")
    assert toxicity.classify(docs, twice).count() == len(EDGES) + 1 and toxicity.classify(docs.limit(0), twice).count() == 0


def test_toxicity_learns_from_a_bounded_sample(spark):
    from proofgrid.llm import toxicity

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    one = docs.unionByName(spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    n = toxicity.labelled_texts(one, labels.unionByName(labels), "doc_id", "text", "toxic", 500).count()
    assert 380 <= n <= 620
