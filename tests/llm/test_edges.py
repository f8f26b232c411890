"""Further cases of the corpus operators: brute-force versions, recall by length, bounded memory, ties, damaged and hostile inputs."""

import base64
import bz2
import gzip
import lzma
import random
import re
import zlib
from urllib.parse import quote, unquote_to_bytes

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def b64(x):
    return base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()


# --- secrets

SECRET = "password = 'Abcdefgh1234XYZ' end of text"
WRAPS = {
    "path": "https://h/get/" + b64(SECRET), "dash": "id-" + b64(SECRET), "key": "key/" + b64(SECRET), "low": "id_" + b64(SECRET), "letter": "a" + b64(SECRET), "letters": "ab" + b64(SECRET),
    "mime": base64.encodebytes((SECRET + " pad" * 60).encode()).decode(), "mime-crlf": base64.encodebytes(("p" * 50 + SECRET).encode()).decode().replace("\n", "\r\n"),
    "mime-zlib": base64.encodebytes(zlib.compress((SECRET + " ".join(map(str, range(500)))).encode())).decode(), "binary": b64(b"\xff\xfe\x00\x81" + SECRET.encode() + b"\x9c\xff"), "utf-16": b64(SECRET.encode("utf-16")),
    "xz": b64(lzma.compress(SECRET.encode())), "gzip in a path": "q/" + b64(gzip.compress(SECRET.encode())), "twice": b64(zlib.compress(bz2.compress(SECRET.encode()))), "percent bytes": quote(gzip.compress(SECRET.encode()), safe=""),
}


@pytest.mark.parametrize("name", WRAPS)
def test_secrets_in_every_wrapping_are_found_at_their_place(name):
    from proofgrid.llm.secrets import scan

    text = f"é😀 before {WRAPS[name]} after"
    base, every, _, beyond = scan(text)
    start = text.index(WRAPS[name])
    assert not beyond and any(kind == 0 and start <= a and b <= start + len(WRAPS[name]) for a, kind, b in set(every) - set(base))


def plain_spans(text, depth=0):
    """All spans by plain recursion over whole decoded texts: (start, kind, end), an inner hit at the place of the whole run."""
    from proofgrid.llm.secrets import base_spans

    found = set(base_spans(text))
    if depth > 6:
        return found
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}(?:\r?\n[A-Za-z0-9+/_-]+)*", text):
        run = re.sub(r"[\r\n]", "", m.group()).translate({45: "+", 95: "/"})
        for start in range(4):
            part = run[start:]
            part = part[:-1] if len(part) % 4 == 1 else part
            raw = base64.b64decode(part + "=" * (-len(part) % 4))
            layers = [raw]
            for i in range(len(raw)):
                for opened in (lambda x: zlib.decompress(x, 47), bz2.decompress):
                    try:
                        layers.append(opened(raw[i:]))
                    except Exception:
                        pass
            for layer in layers:
                if plain_spans(layer.decode("latin-1"), depth + 1):
                    found |= {(m.start(), k, m.end()) for _, k, _ in plain_spans(layer.decode("latin-1"), depth + 1)}
    for m in re.finditer(r"(?:%[0-7][0-9A-Fa-f])+", text):
        inner = unquote_to_bytes(m.group()).decode("latin-1")
        found |= {(m.start(), k, m.end()) for _, k, _ in plain_spans(inner, depth + 1)}
    return found


def test_all_spans_against_plain_recursion():
    from proofgrid.llm.secrets import scan

    random.seed(12)
    secrets = ["token=abcdefghijkl9", "AKIA" + "A1" * 9, "deadbeef" * 3]
    wraps = [b64, lambda s: b64(zlib.compress(s.encode())), lambda s: "".join(f"%{ord(c):02x}" for c in s), lambda s: "k/" + b64(s)]
    for _ in range(40):
        parts = []
        for _ in range(random.randrange(4)):
            inner = f"say {random.choice(secrets)} now"
            for _ in range(random.randrange(3)):
                inner = f"see {random.choice(wraps)(inner)} there"
            parts += [inner, "plain words,"]
        text = " ".join(parts)
        kinds = lambda spans: {(k, a, b) for a, k, b in spans}
        got, want = kinds(scan(text)[1]), kinds(plain_spans(text))
        assert {s for s in want if not any(s[0] == g[0] and g[1] <= s[1] and s[2] <= g[2] or s[0] == g[0] and s[1] <= g[1] and g[2] <= s[2] for g in got)} == set()


def test_bombs_are_scanned_to_the_end_in_bounded_memory():
    import tracemalloc

    from proofgrid.llm.secrets import scan

    end = b" password=abcdefghijklmnop"
    for data in (b"\0" * (64 << 20) + end, b" " * (64 << 20) + end):
        text = "x " + b64(zlib.compress(data)) + " y"
        tracemalloc.start()
        _, every, _, beyond = scan(text)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert not beyond and [(k, a) for a, k, _ in every] == [(0, 2)] and peak < 32 << 20
    assert scan("x " + b64(zlib.compress(b"ab, " * (1 << 20))), most=1 << 20)[3]


def test_what_stays_wrapped_is_held_back(spark, monkeypatch):
    from proofgrid.llm import secrets

    bomb = b64(lzma.compress(b"ab, " * 1000, preset=9 | lzma.PRESET_EXTREME))  # needs a larger decoder than is allowed
    df = spark.createDataFrame([(1, f"x {bomb} y", None, None, None), (2, "clean", None, None, None), (None, None, None, None, None)], SCHEMA)
    flags = {r.doc_id: r.too_large for r in secrets.find_secrets(df).collect()}
    kept = sorted((r.doc_id or 0) for r in secrets.rewrite(df).collect())
    assert not flags[2] and not flags[None] and kept == [0] + [i for i in (1, 2) if not flags[i]]


# --- tokens


def test_long_texts_without_spaces_are_cut_at_safe_places(spark):
    from tokenizers import Tokenizer

    from proofgrid.llm import tokens
    from proofgrid.llm.common import segments

    random.seed(2)
    text = "".join(random.choice("汉字文本处理数据模型训练") if random.random() < 0.9 else "。" for _ in range(300_000)) + "٣x　é" * 20_000
    assert len(list(segments(text, 1 << 16))) > 4
    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    model.no_truncation()
    df = spark.createDataFrame([(1, text, None, None, None)], SCHEMA)
    assert tokens.count_tokens(df, P.path("word_bpe_49k.json")).first().n_tokens == len(model.encode(text, add_special_tokens=False).ids)


def test_memos_keep_no_long_units():
    from proofgrid.llm.bpe import Coder, as_ids
    from proofgrid.llm.common import Memo

    random.seed(3)
    texts = ["".join(random.choice("abcdefgh") for _ in range(4000)) for _ in range(100)]
    coder = Coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, as_ids)
    assert len([1 for _ in coder.texts(texts)]) == 100 and not coder.memo and not coder.known
    memo = Memo(len)
    assert [memo[t] for t in texts[:3]] == [4000] * 3 and not memo and memo["ab"] == 2 and len(memo) == 1


def test_sequences_and_masks_are_views_of_the_file(spark, tmp_path):
    from proofgrid.llm import sequences

    df = spark.createDataFrame([(i, "some words " * (i + 1), None, None, None) for i in range(50)], SCHEMA)
    manifest = sequences.write_sequences(df, P.path("word_bpe_49k.json"), f"file://{tmp_path}/s", length=32, run_bytes=4000)
    assert len(manifest) > 3 and [m[1] for m in manifest] == [sum(x[5] for x in manifest[:k]) for k in range(len(manifest))]
    file = sequences.SequenceFile(f"file://{tmp_path}/s/{manifest[0][2]}")
    ids, mask = file.sequence(0)
    assert not ids.flags.owndata and not mask.flags.owndata and mask.dtype == np.uint8 and mask.all()


# --- shards


def test_shard_law_holds_for_tied_rows_and_files_are_cut_by_bytes(spark, tmp_path):
    from proofgrid.llm import sharding

    rows = [(7 if i < 50 else i, "same" if i < 50 else "t" * (i * 40), "en", "s", 4) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit("mine")).withColumn("slot", F.lit(1)).repartition(3)
    found = sharding.shard_documents(df, f"file://{tmp_path}/a", 24, file_bytes=8000)
    got = found.collect()
    sizes = [sum(r.shard == s for r in got) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and {r.given_shard for r in got} == {"mine"} and {r.given_slot for r in got} == {1}
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert len(found.inputFiles()) > 24 and sorted(len(r.text) for r in got) == sorted(len(r[1]) for r in rows)


# --- URLs


def test_trees_learn_given_labels_and_hold_out_accuracy(spark):
    from proofgrid.llm import urls

    random.seed(6)
    letters = lambda n: "".join(random.choice("abcdefghij") for _ in range(n))
    bad = lambda: f"http://{letters(6)}{random.randrange(10**6)}.biz/{letters(4)}/{random.randrange(10**8)}?a={letters(9)}&b={random.randrange(99)}&c=1"
    good = lambda: f"https://{letters(8)}.org/{letters(6)}/{letters(7)}"
    rows = [(i, bad() if i % 2 else good(), (i % 2) if i % 3 else None) for i in range(1200)]
    rows += [(5000, rows[1][1], 1), (5001, None, None), (5002, "", None), (5003, "no scheme", None), (None, "http://x.y/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, spam int").withColumn("host", F.lit("clash")).withColumn("label", F.lit(9))
    got = urls.judge(df, rules=(), label_col="spam").collect()
    held = [(r.verdict == "block") == bool(r.page_id % 2) for r in got if r.page_id is not None and r.page_id < 1200 and r.page_id % 3 == 0]
    assert len(got) == len(rows) and sum(held) / len(held) > 0.95 and {r.host for r in got if r.page_id in (5001, 5002, 5003)} == {""}
    assert urls.judge(df.limit(0), rules=(), label_col="spam").count() == 0


# --- contamination


def test_clean_rows_keep_all_columns_with_one_block_or_more(spark):
    from proofgrid.llm import contamination

    rows = [(1, "one two three", "a"), (None, "ONE, two", "b"), (2, None, "c"), (2, "zz", "d"), (3, "other words", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, items string")
    bench = spark.createDataFrame([(1, "two three"), (2, "zz"), (3, None), (None, "other")], "item_id long, text string")
    for block in (1 << 20, 20):
        got = sorted(map(str, map(tuple, contamination.without_contamination(df, bench, block_bytes=block).collect())))
        assert got == sorted(map(str, [rows[1], rows[2], rows[4]]))


# --- quality


def test_ridge_and_calibration_against_plain_numpy(spark):
    from proofgrid.llm import quality

    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, len(quality.STATISTICS)))
    y = (x[:, 0] + 0.5 * rng.normal(size=600) > 0).astype(int)
    fold = rng.integers(0, 2, 600)
    df = spark.createDataFrame([(r.tolist(), int(a), int(f)) for r, a, f in zip(x, y, fold)], "statistics array<double>, label int, fold int").repartition(5)
    model = quality.fit(df)
    z = model.features(x)
    plain = np.linalg.solve(z.T @ z + 1e-3 * len(z) * np.eye(z.shape[1]) / 128, z.T @ y)
    assert np.allclose(model.raw(x), z @ plain, atol=1e-6)
    levels = model.levels
    assert (np.diff(levels) >= 0).all() and ((model.score(x) >= 0.5) == y).mean() > 0.8
    cross = np.empty(600)
    for f in (0, 1):
        m = fold == f
        w = np.linalg.solve(z[m].T @ z[m] + 1e-3 * m.sum() * np.eye(z.shape[1]) / 128, z[m].T @ y[m])
        cross[~m] = z[~m] @ w
    assert abs((cross * 1).mean() - np.average(model.knots, weights=np.ones(len(model.knots)))) < 1 and levels.min() >= 0 and levels.max() <= 1


# --- fingerprints


def test_fingerprint_bits_against_plain_votes(spark):
    import xxhash

    from proofgrid.llm import fingerprints

    texts = ["the quick brown fox, the lazy dog!", "one", "", "汉字 and words", "a-b_c 12 12 12"]
    want = []
    for t in texts:
        words = [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", re.sub(r"([一-鿿])", r" \1 ", t.lower()))]
        votes, total = [0] * 64, 0
        for w in words:
            h = xxhash.xxh64_intdigest(w.encode(), seed=42)
            total += len(w)
            for k in range(64):
                votes[k] += len(w) * (h >> k & 1)
        want.append(sum(1 << k for k in range(64) if 2 * votes[k] > total))
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("block", F.lit(1))
    got = {r.k: r.fingerprint % (1 << 64) for r in fingerprints.fingerprints(df, ["k"]).collect()}
    assert [got[k] for k in range(len(texts))] == want


# --- near duplicates


@pytest.mark.parametrize("n", [6, 8, 10, 15, 20, 30, 45, 60, 100, 200, 400])
def test_recall_at_the_threshold_by_length(n):
    """Pairs of similarity 0.8 or just above, by substitutions, deletions and insertions at random or even places: nine in ten share a sketch at least."""
    from proofgrid.llm.neardup import hashed_words, order_sketches, short_sketches, similar

    random.seed(n)
    edits, met, pairs = n // 5, 0, 0
    for trial in range(60):
        words = [f"w{random.randrange(10**6)}" for _ in range(n)]
        places = list(range(2, n, 5))[:edits] if trial % 2 else random.sample(range(n), edits)
        other = words[:]
        for at in sorted(places, reverse=True):
            kind = trial // 2 % 3
            other[at : at + 1] = [f"v{random.randrange(10**6)}"] if kind == 0 else [] if kind == 1 else [other[at], f"v{random.randrange(10**6)}"]
        a, b = " ".join(words), " ".join(other)
        if min(len(words), len(other)) < 5 or not similar(a, b, 0.8):
            continue
        pairs += 1
        one, two = (np.concatenate([order_sketches(h), short_sketches(h, 5, 0.8)]) for h in (hashed_words(words), hashed_words(other)))
        met += len(np.intersect1d(one, two)) > 0
    assert pairs >= 20 and met / pairs >= 0.9


def test_frequent_keys_take_the_other_path_to_the_same_classes(spark, monkeypatch):
    """A passage that many texts share, with keys counted by partial sums and members dealt into chunks: the classes are those of all pairs."""
    from proofgrid.llm import neardup

    random.seed(31)
    passage = [f"p{k}" for k in range(30)]
    rows = [(i, " ".join(passage + [f"u{random.randrange(10**6)}" for _ in range(20)])) for i in range(60)]
    rows += [(100 + i, " ".join(passage + [f"x{k}" for k in range(30)][: 28 + i % 3])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    for name, value in (("SAMPLE", 1), ("MANY", 10), ("CHUNK", 16)):
        monkeypatch.setattr(neardup, name, value)
    other = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    from tests_brute import all_pairs

    assert got == other == all_pairs(rows, 0.8)


def gz(x):
    return gzip.compress(x if isinstance(x, bytes) else x.encode(), mtime=0)


def zstd(x):
    import zstandard

    return zstandard.ZstdCompressor().compress(x if isinstance(x, bytes) else x.encode())


INDENTED = "\n".join("    " + line for line in base64.encodebytes(gz(SECRET + " ".join(map(str, range(300))))).decode().split("\n") if line)
LAYERED = {
    "after a header": b64(gz(b"header text, of some length: " + gz(SECRET))), "at an odd place of a stream in a stream": b64(zlib.compress(b"\x00\x01x" * 77 + bz2.compress(b"pad" * 999 + gz(b"\xff" * 5 + gz(SECRET) + b"tail")))),
    "second member": b64(gz(gz("nothing here") + gz(SECRET))), "over two members": b64(gz(SECRET[:20]) + gz(SECRET[20:])), "members within": b64(gz(gz("a " + SECRET[:20]) + gz(SECRET[20:]))),
    "second frame": b64(zstd(zstd("nothing") + zstd(SECRET))), "xz in zstd": b64(zstd(b"\x00lead" + lzma.compress(SECRET.encode()))), "literal breaks": base64.encodebytes(gz(SECRET + " ".join(map(str, range(300))))).decode().replace("\n", "\\n"),
    "json": base64.encodebytes(zlib.compress((SECRET + " ".join(map(str, range(400)))).encode())).decode().replace("\n", "\\r\\n").replace("/", "\\/"), "indented": INDENTED, "braces": "".join(f"\\u{{{ord(c):x}}}" for c in SECRET),
    "long": "".join(f"\\U{ord(c):08x}" for c in SECRET), "percent u": "".join(f"%u{ord(c):04x}" for c in SECRET), "far into a stream": b64(zlib.compress(bytes(range(256)) * 9000 + gz(SECRET))),
}


@pytest.mark.parametrize("name", LAYERED)
def test_secrets_at_any_place_of_any_stream_are_found(name):
    from proofgrid.llm.secrets import scan

    text = f"é😀 before {LAYERED[name]} ; after"
    base, every, _, beyond = scan(text)
    start = text.index(LAYERED[name])
    assert not beyond and any(kind == 0 and start <= a and b <= start + len(LAYERED[name]) for a, kind, b in set(every) - set(base))


def test_every_offset_of_every_layer_against_plain_recursion():
    """Random nestings of gzip, zlib and bzip2 at random places; what a plain version that tries every offset of every layer finds is found."""
    from proofgrid.llm.secrets import scan

    draw = random.Random(21)
    packs = gz, lambda x: zlib.compress(x if isinstance(x, bytes) else x.encode()), lambda x: bz2.compress(x if isinstance(x, bytes) else x.encode())

    def holds(raw, depth=0):
        if re.search(rb"token=[a-z0-9]{12}", raw):
            return True
        for i in range(len(raw)):
            for open_ in (lambda x: zlib.decompressobj(47).decompress(x), lambda x: bz2.BZ2Decompressor().decompress(x)):
                try:
                    inner = open_(raw[i:])
                except Exception:
                    continue
                if inner and inner != raw and depth < 6 and holds(inner, depth + 1):
                    return True
        return False

    for k in range(30):
        data = b"say token=abcdefghijkl now" if k % 3 else b"say nothing at all, ever"
        for _ in range(draw.randint(1, 4)):
            data = bytes(draw.choices(range(256), k=draw.randint(0, 40))) + draw.choice(packs)(data) + bytes(draw.choices(range(256), k=draw.randint(0, 9)))
        _, every, _, beyond = scan("x " + b64(data) + " y")
        assert not beyond and bool(every) == holds(data) == bool(k % 3)


def test_marks_without_data_cost_little():
    """Ten million characters of base64 that decode to marks of compressed data only, and to members one after another."""
    import time

    from proofgrid.llm.secrets import scan

    for data in (b"\x78\x9c" * 3_750_000, b"\x1f\x8b\x08" * 2_500_000, gz("a") * 300_000):
        start = time.process_time()
        _, _, _, beyond = scan("x " + b64(data))
        assert time.process_time() - start < 30 and (not beyond or data[:3] == data[3:6])


def test_streams_deeper_than_the_bound_are_marked():
    from proofgrid.llm import secrets

    data = SECRET.encode()
    for _ in range(secrets.DEPTH - 1):
        data = bz2.compress(data)
    assert secrets.scan(b64(data))[1] and not secrets.scan(b64(data))[3]
    for _ in range(3):
        data = bz2.compress(data)
    assert secrets.scan(b64(data))[3]


def test_streams_that_can_be_read_along_many_ways_are_read_once():
    """Stored blocks show what they hold also from without, so each level can be entered twice: 2^30 ways if all were taken."""
    from proofgrid.llm import secrets

    data = SECRET.encode()
    for _ in range(30):
        data = zlib.compress(data, 0)
    assert [k for _, k, _ in secrets.scan(b64(data))[1]] == [0] and not secrets.scan(b64(data))[3]


def test_members_of_many_shared_buckets_meet_once(spark, monkeypatch):
    """Texts of one frame with differing passages share most of their buckets; a text is a row a leader there, and links are those of each bucket by itself."""
    from proofgrid.llm import neardup

    rng = random.Random(17)
    frame = [f"w{i}" for i in range(100)]
    texts = [[*frame[:at], *(f"x{rng.random()}" for _ in range(30)), *frame[at + 30 :]] for at in (rng.randrange(70) for _ in range(40))]
    texts += [[*t[:50], "other", *t[51:]] for t in texts[:5]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    seen, bridges = [], neardup.bridges
    monkeypatch.setattr(neardup, "bridges", lambda parts, *more: seen.append(parts.count()) or bridges(parts, *more))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert all(got[40 + i] == got[i] for i in range(5))
    assert len(texts) <= seen[0] <= 8 * len(texts)
