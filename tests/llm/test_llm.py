"""The corpus operators: small cases, edge cases, and every registered query against a brute-force version or a round trip."""

import base64
import bisect
import bz2
import hashlib
import json
import random
import re
import zlib
from urllib.parse import quote

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [(1, None), (2, ""), (3, "one"), (None, "no id"), (5, "twice"), (5, "twice"), (6, "x" * 50_000), (7, "le mot " * 30_000), (8, "tab\tand\u00a0space  two\n\n"), (9, "Ünïcode ß 漢字 😀 e\u0301")]


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls, empty and long texts, repeated rows, an extra column whose name clashes."""
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in EDGES], SCHEMA).withColumn("n_words", F.lit(1)).withColumn("keys", F.lit("x"))


def results(spark, name):
    return entry.queries()[name](spark, DATA).collect()


# --- tokens and sequences


@pytest.fixture(scope="module")
def words_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_token_counts_are_the_librarys(spark, docs, words_tokenizer):
    got = {r.doc_id: r for r in results(spark, "op2_token_counts")}
    assert len(got) == len(docs)
    for i, text in docs:
        n = len(words_tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 2048)


def test_token_counts_of_edge_cases(spark, edges, words_tokenizer):
    from proofgrid.llm import tokens

    special = spark.createDataFrame([(20, "a <|endoftext|> b<|startoftext|>", None, None, None), (21, "don't we'll x.y,z 12,5 A.B.", None, None, None)], SCHEMA)
    both = edges.select(*special.columns).unionByName(special)
    got = sorted(((r.doc_id or 0, r.n_tokens) for r in tokens.count_tokens(both, P.path("word_bpe_49k.json")).collect()))
    want = sorted((r.doc_id or 0, len(words_tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in both.collect())
    assert got == want
    assert tokens.count_tokens(edges.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_sequences_read_back_as_the_librarys_ids(spark, docs, words_tokenizer):
    got = {r.doc_id: r for r in results(spark, "op3_token_sequences")}
    at = 0
    for i, text in docs:
        ids = words_tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_sequence_files_are_fixed_size_lists_with_masks(spark, edges, tmp_path):
    from proofgrid.llm import sequences

    manifest = sequences.write_sequences(edges, P.path("word_bpe_49k.json"), f"file://{tmp_path}/s", length=64)
    assert sum(m[4] for m in manifest) == len(EDGES) and sequences.write_sequences(edges.limit(0), P.path("word_bpe_49k.json"), f"file://{tmp_path}/e") == []
    for _, _, seq, _, _, n in manifest:
        file = sequences.SequenceFile(f"file://{tmp_path}/s/{seq}")
        ids, mask = file.sequence((n - 1) // 64)
        assert len(ids) == 64 and mask.sum() == (n - 1) % 64 + 1
    back = sequences.read_digests(spark, f"file://{tmp_path}/s", manifest).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in back) == sorted((i is not None, i or 0) for i, _ in EDGES)


# --- byte-level BPE


@pytest.fixture(scope="module")
def byte_tokenizer():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_is_the_librarys_and_round_trips(spark, docs, byte_tokenizer):
    got = {r.doc_id: r for r in results(spark, "op7_byte_bpe")}
    for i, text in docs:
        ids = byte_tokenizer.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_byte_bpe_of_edge_cases_and_decoding(spark, edges, byte_tokenizer):
    from proofgrid.llm import bpe

    encoded = bpe.encode(edges, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep=("source",))
    got = sorted(((r.doc_id or 0), r.n_tokens, r.ids) for r in encoded.collect())
    assert got == sorted(((i or 0), len(ids), ids) for i, t in EDGES for ids in [byte_tokenizer.encode_ordinary(t or "")])
    back = sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in bpe.decode(encoded, P.path("byte_bpe_50k.tiktoken")).collect())
    assert back == sorted((i or 0, t or "") for i, t in EDGES)


def test_merge_replay_of_random_bytes(byte_tokenizer):
    from proofgrid.llm.bpe import Replay, load_ranks

    random.seed(5)
    replay = Replay(load_ranks(P.path("byte_bpe_50k.tiktoken")))
    pieces = ["".join(random.choice("aab e") for _ in range(random.choice([1, 3, 20, 200]))) for _ in range(200)]
    pieces += ["ababab" * 40, "a" * 1000, " " * 300]
    for ids, piece in zip(replay.encode([p.encode() for p in pieces]), pieces):
        assert ids == byte_tokenizer._core_bpe.encode_single_piece(piece.encode()) and replay.decode(ids) == piece.encode()


# --- URLs


def test_url_parts_and_rules(spark, rows):
    from proofgrid.llm import urls

    cases = [
        (1, "http://A.Com/en/x?q=1#f", "a.com", "/en/x"), (2, "https://example.com/en/7/8", "example.com", "/en/7/8"), (3, "no scheme", "", ""), (4, None, "", ""), (5, "x://h?p=/net/", "h", ""),
        (6, "http://example.net/de/81", "example.net", "/de/81"), (7, "http://notcom/en/", "notcom", "/en/"), (8, "http://u.net/de/1", "u.net", "/de/1"), (9, "a://b://c/d", "b:", "//c/d"),
    ]
    found = urls.judge(spark.createDataFrame([(i, u) for i, u, _, _ in cases], "page_id long, url string"))
    got = {r.page_id: r for r in found.collect()}
    assert {i: (got[i].host, got[i].path) for i, *_ in cases} == {i: (h, p) for i, _, h, p in cases}
    assert {i: got[i].rule for i in got if got[i].rule} == {1: "com/en/", 2: "example.com/en/7", 6: "example.net/de/8", 8: "net/de/"}
    assert {i: got[i].verdict for i in (1, 2, 6, 8)} == {1: "block", 2: "allow", 6: "block", 8: "allow"}
    assert urls.judge(found.select("page_id", F.lit("u").alias("url")).limit(0)).count() == 0


def test_url_verdicts_of_the_query_agree_with_a_loop(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    got = results(spark, "op4_url_filter")
    assert len(got) == len(pages)
    for r in got:
        rest = (pages[r.page_id] or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
        fit = [k for k in rules if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith(k[k.index("/") :])]
        best = max(fit, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, best) and r.verdict in ("allow", "block") and (best is None or r.verdict == rules[best])


def test_url_features(spark):
    from proofgrid.llm import urls

    df = urls.with_lexical_features(spark.createDataFrame([(1, "http://aab.c/x/y1?a=1&b=2")], "page_id long, url string")).select("*", urls.entropy(F.lit("aabb")).alias("e")).first()
    assert (df.f_depth, df.f_labels, df.f_params, df.e) == (2, 2, 2, 1.0)


# --- quality


def test_quality_ranks_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    from proofgrid.llm import quality

    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.classify(documents, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    good, bad = np.sort(found.score[found.quality == 1]), found.score[found.quality == 0].to_numpy()
    below, upto = np.searchsorted(good, bad, "left"), np.searchsorted(good, bad, "right")
    area = 1 - (below + (upto - below) / 2).mean() / len(good)
    assert len(found) > 500 and area > 0.9 and (found.predicted == found.quality).mean() > 0.85
    assert ((found.score >= 0.5).astype(int) == found.predicted).all() and found.score.between(0, 1).all()


def test_quality_query_is_whole_and_held_out_by_hash(spark, docs):
    got = results(spark, "op5_quality")
    assert sorted(r.doc_id for r in got) == [i for i, _ in docs]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_quality_of_edge_cases(spark, edges):
    from proofgrid.llm import quality

    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(edges, none).collect()} == {0.5}
    one_kind = spark.createDataFrame([(i, 1, 0) for i in range(1, 10)] + [(5, None, 0), (None, 1, 0), (99, 0, 0)], none.schema)
    assert {r.score for r in quality.classify(edges, one_kind).collect()} == {1.0}
    assert quality.classify(edges.limit(0), one_kind).count() == 0


def test_isotonic_pools_violators():
    from proofgrid.llm.quality import isotonic

    x, y = isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 0.8, 0.2, 1.0]), np.ones(4))
    assert y.tolist() == [0, 0.5, 1] and x.tolist() == [0, 1.5, 3]


# --- shards


def test_shards_are_even_gapless_and_whole(spark, docs):
    got = results(spark, "op6_hilbert_shards")
    text = dict(docs)
    assert sorted(r.doc_id for r in got) == [i for i, _ in docs]
    sizes = [sum(r.shard == s for r in got) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and {r.law for r in got} == {"rows"}
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got)


def test_hilbert_curve_visits_every_cell_by_single_steps():
    from proofgrid.llm.sharding import hilbert_index

    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = cells[np.argsort(hilbert_index(cells, 3))]
    assert sorted(hilbert_index(cells, 3)) == list(range(512)) and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_shards_of_edge_cases_and_pruning(spark, edges, tmp_path):
    from proofgrid.llm import sharding

    found = sharding.shard_documents(edges, f"file://{tmp_path}/a", 3).collect()
    assert sorted(sum(r.shard == s for r in found) for s in range(3)) == [3, 3, 4]
    assert sharding.shard_documents(edges.limit(0), f"file://{tmp_path}/b", 3).count() == 0
    grid = spark.range(4096).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), (F.col("id") % 64).alias("a"), F.floor(F.col("id") / 64).alias("b"))
    cut = sharding.shard_documents(grid, f"file://{tmp_path}/c", 16, dimensions=("a", "b"))
    ranges = cut.groupBy("shard").agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1")).collect()
    for c in ("a", "b"):  # a range of a sixteenth of either dimension touches few files
        assert sum(r[f"{c}0"] <= 32 <= r[f"{c}1"] for r in ranges) <= 8


# --- fingerprints


def test_fingerprint_query_against_a_loop(spark, docs):
    got = {r.doc_id: r for r in results(spark, "op8_simhash")}
    order = [(i, t or "") for i, t in sorted(docs, key=lambda r: -r[0])]
    assert len(got) == len(docs)
    by_text = {}
    for k, (i, text) in enumerate(order):
        nxt = order[(k + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[1][:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        bits = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 64
        assert r.near_edited == bits(r.fingerprint, r.edited_fingerprint) and r.near_next == bits(r.fingerprint, got[nxt[0]].fingerprint)
    prints = [int(r.fingerprint, 16) for r in got.values()]
    for i in (i for i in got if i % 100 == 0):
        assert got[i].n_near == sum(bin(int(got[i].fingerprint, 16) ^ p).count("1") <= 3 for p in prints) - 1


def test_block_tables_find_all_within_the_radius(spark):
    from proofgrid.llm import fingerprints

    random.seed(9)
    base = [random.getrandbits(64) for _ in range(30)]
    rows = base + [b ^ sum(1 << k for k in random.sample(range(64), n)) for b in base for n in (1, 3, 4, 7)] + base[:5]
    signed = [r - (1 << 64) if r >> 63 else r for r in rows]
    df = spark.createDataFrame([(r,) for r in signed], "fingerprint long")
    found = {(r["query"], r.found): (r.distance, r.n) for r in fingerprints.near(df.limit(30), df, 3).collect()}
    count = {s: signed.count(s) for s in signed}
    mask = (1 << 64) - 1
    want = {(a, b): (d, count[b]) for a in set(signed[:30]) for b in set(signed) if (d := bin((a ^ b) & mask).count("1")) <= 3}
    assert found == want


def test_fingerprints_of_edge_cases(spark, edges):
    from proofgrid.llm import fingerprints

    got = fingerprints.edit_report(edges).collect()
    assert len(got) == len(EDGES) and {r.fingerprint for r in got if r.doc_id in (1, 2)} == {"0" * 16}
    assert len({r.fingerprint for r in got if r.doc_id == 5}) == 1
    single = fingerprints.edit_report(edges.where("doc_id = 3")).first()
    assert single.near_next == 1.0 and fingerprints.edit_report(edges.limit(0)).count() == 0


# --- secrets


def loop_spans(text):
    kinds = [
        ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m.group(2)) >= 12),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 18), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 16),
    ]
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in p.finditer(text) if ok(m)]
    return [f"{kinds[k][0]}:{a}:{b}" for a, k, b in sorted(found)]


def test_base_secrets_against_a_loop(spark, docs):
    got = {r.doc_id: r for r in results(spark, "op9_secret_scan")}
    for i, text in docs:
        spans = loop_spans(text or "")
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r.spans.split(",") if r.spans else [])


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: base64.b64encode(s.encode()).decode(), lambda s: quote(s, safe=""), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: "".join(f"&#{ord(c)};" for c in s),
        lambda s: base64.b64encode(zlib.compress(s.encode())).decode(), lambda s: base64.b64encode(bz2.compress(s.encode())).decode(), lambda s: base64.b64encode(quote(base64.b64encode(s.encode()).decode(), safe="").encode()).decode(),
    ],
)
def test_wrapped_secrets_are_found_at_their_place(wrap):
    from proofgrid.llm.secrets import scan

    inner = "password = 'Abcdefgh1234XYZ' end of text"
    outer = wrap(inner)
    text = f"é😀 before {outer} after"
    base, every, _, beyond = scan(text)
    start = text.index(outer)
    added = [s for s in every if s not in base]
    assert not beyond and any(kind == 0 and start <= a and b <= start + len(outer) for a, kind, b in added)


def test_layers_end_on_cycles_and_bombs():
    from proofgrid.llm import secrets

    text = "%2525252525" * 50 + base64.b64encode(zlib.compress(b"0" * (1 << 22))).decode()
    assert secrets.scan(text, most=1 << 16)[3] and not secrets.scan("plain text")[3]


def test_copies_and_repeats_use_up_no_budget():
    from proofgrid.llm import secrets

    hidden = base64.b64encode(b"token=abcdefghijklmnop and more").decode()
    text = "a%20b \\u0041 " + "some words " * 300 + hidden
    base, every, _, beyond = secrets.scan(text, most=1000)
    assert not beyond and any(a == text.index(hidden) for a, _, _ in set(every) - set(base))


def test_secrets_are_replaced(spark, edges):
    from proofgrid.llm import secrets

    df = spark.createDataFrame([(1, "token=abcdefghijkl and deadbeefdeadbeef1", None, None, None), (2, None, None, None, None)], SCHEMA)
    assert [r.text for r in secrets.rewrite(df, "[S]").orderBy("doc_id").collect()] == ["[S] and [S]", None]
    assert secrets.find_secrets(edges).count() == len(EDGES) and secrets.find_secrets(edges.limit(0)).count() == 0


# --- contamination


def loop_contamination(text, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, met = words(text), set(), set()
    for item, t in items:
        v = words(t)
        if not v:
            continue
        for k in range(max(1, len(v) - size + 1)):
            win = v[k : k + size]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    met.add(str(item))
    return len(w), len(hit), sorted(met)


def test_contamination_query_against_a_loop(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: r for r in results(spark, "op10_decontamination")}
    dirty = [d for d in docs if got[d[0]].contaminated][:15] + docs[:10]
    for i, text in dirty:
        n, hit, met = loop_contamination(text, items)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256) == (n, hit, len(met), hashlib.sha256(",".join(met).encode()).hexdigest())


def test_contamination_of_edge_cases_and_blocks(spark, edges):
    from proofgrid.llm import contamination

    items = [(1, "one"), (2, "TWICE!"), (3, None), (None, "tab"), (4, "..."), (5, "le mot le mot le mot le mot le mot le"), (6, "twice")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (16 << 20, 40):
        got = {(r.doc_id or 0): r for r in contamination.find_contamination(edges, bench, block_bytes=block).collect()}
        for i, text in EDGES:
            n, hit, met = loop_contamination(text if i != 7 else "", [x for x in items if x[0]])
            if i != 7:
                assert (got[i or 0].n_words, got[i or 0].n_hit, got[i or 0]["items"]) == (n, hit, met)
        assert got[7].n_hit == 60_000 and got[5].passages[0].asDict() == {"start": 0, "end": 5}
    assert contamination.find_contamination(edges.limit(0), bench).count() == 0
    assert {r.n_hit for r in contamination.find_contamination(edges, bench.limit(0)).collect()} == {0}


# --- near duplicates


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_banded_distance_is_exact_within_the_band():
    from proofgrid.llm.neardup import banded_distance

    random.seed(4)
    for _ in range(400):
        a = [random.choice("abcd") for _ in range(random.randrange(30))]
        b = a[:] if random.random() < 0.5 else [random.choice("abcd") for _ in range(random.randrange(30))]
        for _ in range(random.randrange(6)):
            b.insert(random.randrange(len(b) + 1), random.choice("abcd"))
            if b:
                b.pop(random.randrange(len(b)))
        d, most = distance(a, b), random.randrange(12)
        assert banded_distance(a, b, most) == (d if d <= most else None)


def planted(seed=1):
    """Groups of near copies (a fifth of a twentieth of the words edited), a chain, short texts, and unrelated ones."""
    random.seed(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    text = lambda n: [random.choice(vocabulary) for _ in range(n)]

    def edit(words, n):
        out = words[:]
        for _ in range(n):
            at = random.randrange(len(out))
            kind = random.random()
            out[at : at + 1] = [random.choice(vocabulary)] if kind < 0.4 else [] if kind < 0.7 else [out[at], random.choice(vocabulary)]
        return out

    rows = []
    for _ in range(12):
        base = text(random.choice([60, 150, 400]))
        rows += [base] + [edit(base, max(1, len(base) // 25)) for _ in range(random.choice([1, 2, 6]))] + [base]
    rows += [text(random.choice([20, 100])) for _ in range(40)] + [["a"], ["a"], ["b"], [], []]
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def classes_of(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_classes(rows, threshold=0.8):
    from proofgrid.llm.neardup import similar

    return classes_of([(a, b) for k, (a, x) in enumerate(rows) for b, y in rows[k + 1 :] if (min(len(x.split()), len(y.split())) >= 5 or x == y) and similar(x, y, threshold)], [i for i, _ in rows])


def test_near_duplicates_against_all_pairs(spark):
    from proofgrid.llm import neardup

    rows = planted()
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_near_duplicate_query_has_no_false_links_and_loses_no_close_copies(spark, docs):
    from proofgrid.llm.neardup import similar

    got = {r.doc_id: r.class_id for r in results(spark, "op1_order_minhash")}
    texts = [(i, t or "") for i, t in docs]
    want = brute_classes(texts)
    assert len(got) == len(docs)
    assert all(want[i] == want[c] for i, c in got.items())  # what is joined, all pairs join too
    close = classes_of([(a, b) for k, (a, x) in enumerate(texts) for b, y in texts[k + 1 :] if len(x.split()) >= 5 and similar(x, y, 0.9)], list(got))
    assert all(got[i] == got[c] for i, c in close.items())


def test_order_matters_to_the_sketch():
    from proofgrid.llm.neardup import hashed_words, order_sketches

    random.seed(2)
    words = [f"w{k}" for k in range(400)]
    blocks = [words[k : k + 20] for k in range(0, 400, 20)]
    random.shuffle(blocks)
    same = lambda a, b: (order_sketches(hashed_words(a), sketches=400) == order_sketches(hashed_words(b), sketches=400)).mean()
    assert same(words, words) == 1.0 and same(words, sum(blocks, [])) < 0.55  # most 5-grams are shared, half of the pairs in order


def test_near_duplicates_of_edge_cases(spark, edges):
    from proofgrid.llm import neardup

    got = neardup.near_duplicates(edges).collect()
    assert len(got) == len(EDGES)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].class_id == by[2].class_id == 1 and sum(r.kept for r in got if r.doc_id == 5) == 1
    assert neardup.near_duplicates(edges.limit(0)).count() == 0


def test_texts_that_share_a_long_repeat_are_sifted(spark):
    """A bucket of texts with one repeated pair of words and different rests: the links are those of all pairs."""
    from proofgrid.llm import neardup

    random.seed(8)
    rows = [(i, " ".join([f"u{i}_{k}" for k in range(random.randrange(5, 60))] + ["is", "on"] * 60)) for i in range(60)]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def spread(n, gap, start):
    """Places of edits in a text of n words, one in every `gap`."""
    return list(range(start, n, gap))


def test_spread_edits_down_to_five_words_are_found(spark):
    """Pairs whose edits leave no 5 words, or one run of 5, whole; each pair is linked and no two pairs are."""
    from proofgrid.llm import neardup

    random.seed(21)
    cases = [(5, [2]), (6, [3]), (7, [3]), (10, [4]), (10, [3, 7]), (11, [5]), (20, [6, 13]), (20, spread(20, 5, 4)), (45, spread(45, 5, 4)), (100, spread(100, 5, 4)), (400, spread(400, 5, 4)), (400, spread(400, 7, 3))]
    rows = []
    for n, places in cases * 4:
        words = [f"w{random.randrange(10**6)}" for _ in range(n)]
        changed = [f"v{random.randrange(10**6)}" if k in places else w for k, w in enumerate(words)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(changed))]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


# --- components, filters, pipeline


def test_components_against_union_find(spark):
    from proofgrid.llm.components import connected_components

    random.seed(3)
    pairs = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 470)] + [(7, 7)]
    found = {r.v: r.c for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    ids = {x for a, b in pairs if a != b for x in (a, b)}
    assert found == classes_of([(a, b) for a, b in pairs if a != b], ids)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_likely_members_keeps_all_members_and_few_others(spark):
    from proofgrid.llm.common import likely_members

    df, wanted = spark.range(20_000).withColumn("x", F.lit(1)), spark.range(0, 20_000, 40).select(F.col("id").alias("w"))
    kept = likely_members(df, "id", wanted, "w")
    assert kept.columns == ["id", "x"] and kept.where("id % 40 = 0").count() == 500 and kept.count() < 600


def test_cut_points_and_segments(spark):
    from proofgrid.llm.common import bucket_of, cut_points, segments

    cuts = cut_points(spark.range(1000), "id", 7)
    found = spark.range(1000).select("id", bucket_of(F.col("id"), cuts).alias("b")).collect()
    assert all(r.b == bisect.bisect_right(cuts, r.id) for r in found)
    assert bucket_of(F.col("id"), []) is not None
    text = "word " * 1000 + "x" * 500 + " end"
    assert "".join(segments(text, 64)) == text and len(list(segments(text, 64))) > 50


def test_pipeline_stage_by_stage(spark, docs, byte_tokenizer):
    """run() gives what the stages' plain versions give, each applied to all its predecessor kept."""
    import corpus_pipeline as C
    from proofgrid.llm import neardup, quality
    from proofgrid.llm.secrets import redacted, scan

    text = dict(docs)
    documents, labels, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    good = {r.doc_id for r in quality.classify(documents, labels).where("predicted = 1").collect()}
    kept = {r.doc_id for r in neardup.near_duplicates(documents.where(F.col("doc_id").isin(list(good)))).where("kept").collect()}
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    wins = {tuple(w[k : k + 10]) for _, t in items for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())] for k in range(max(1, len(w) - 9))}

    def dirty(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return any(tuple(w[i : i + 10]) in wins for i in range(len(w)))

    clean = {i for i in kept if not dirty(text[i])}
    got = {r.doc_id: r for r in C.run(spark, DATA).collect()}
    assert set(got) == clean and 0 < len(clean) < len(docs)
    for i in clean:
        t = text[i] or ""
        assert got[i].ids == byte_tokenizer.encode_ordinary(redacted(t, scan(t)[1], C.MARK))
    assert [n for n, _ in C.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "secret scans", "byte-level BPE"]


def test_stages_decide_row_by_row(spark, tmp_path):
    """Rows without a doc_id and rows that repeat one, each stage alone against a loop; empty tables give no rows."""
    import corpus_pipeline as C

    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    prose = lambda k: " ".join(f"w{k}_{j}" for j in range(30))
    junk = "!!! $$$ ### " * 30
    texts = [(1, prose(1)), (1, prose(1)), (None, prose(2)), (None, prose(3)), (None, prose(3)), (2, prose(4)), (2, passage), (None, passage), (None, prose(1)), (3, junk), (3, prose(5)), (None, junk), (None, None)]
    texts += [(100 + i, prose(100 + i) if i % 2 else junk + str(i)) for i in range(40)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], SCHEMA)
    spark.createDataFrame([(100 + i, i % 2) for i in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ordered = lambda rows: sorted(rows, key=str)
    run = lambda stage, df=docs: ordered((r.doc_id, r.text) for r in stage(spark, df, str(tmp_path)).collect())
    assert run(C.contamination_stage) == ordered(x for x in texts if x[1] != passage)
    marked = ordered(x for x in texts if x[1] is None or "w" in x[1])
    assert [x for x in run(C.quality_stage) if x[1] is not None and x[1] != passage] == [x for x in marked if x[1] is not None and x[1] != passage]
    few = texts[:9]
    best = {}
    for i, t in few:
        best[t] = min(best.get(t, (True, 0)), (i is None, i or 0))
    assert run(C.neardup_stage, docs.limit(9)) == ordered((None if none else i, t) for t, (none, i) in best.items())
    for _, stage in C.STAGES[:4]:
        out = stage(spark, docs.limit(0), str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert json.dumps(sorted(entry.oracle_sql()))
