"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A sketch holds the `PICKS` least of a text's occurrence-labelled word k-mers under one hash, in text order, so two texts
agree on it only if they share those k-mers in the same order: it follows edit similarity, where a plain MinHash
follows the bag of k-mers. Texts that agree on any of `SKETCHES` are candidates; two are linked if the word edit
distance is at most (1 - threshold) of the longer text. Classes are the components of the links.

Equal texts are merged first. Candidates come in steps, so that a group of thousands of copies never yields all of its pairs:
every bucket's members meet its least member; then, only in buckets that still hold several components, members of different
components meet within tasks, all buckets of one least member at once, sifted by bounds on the edit distance from counts of words and word pairs, aligned where
they lie, and only links that join two components come out.

Edits spread over a text can leave no k-mer whole, but never few shorter ones: a link at 0.8 of n words keeps at least 0.4 n - 2
of its word triples and 0.6 n - 1 of its word pairs wherever the edits lie. So a third step sketches triples, or pairs where
the texts are short (`SHORT_KMERS`), and lets those of different components meet in the same way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.llm.common import Memo, in_arrow, kept, likely_members, materialize
from proofgrid.llm.components import connected_components

WORDS, PICKS, SKETCHES, THRESHOLD = 5, 2, 40, 0.8
#: Bins of the counts that sift pairs (half for words, half for word pairs), which also fold into fewer for a first look.
BINS, COARSE = 1024, 128
#: Members and words of a bucket that a task compares with as many others at once; larger buckets are dealt into such chunks.
CHUNK, CHUNK_WORDS = 4096, 1 << 21
#: Keys with MANY rows or more in a sample of one in SAMPLE texts are counted by partial sums; any other's rows fit one task.
SAMPLE, MANY = 256, 16
#: Short k-mers of texts of FEW words and more, and of shorter ones: (words, picks, sketches).
SHORT_KMERS, SHORTER, FEW = (3, 2, 80), (2, 1, 24), 40
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def hashed_words(words: list[str]) -> np.ndarray:
    mine = kept(__name__)
    if "words" not in mine:
        import xxhash

        mine["words"] = Memo(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "replace")))
    return np.fromiter(map(mine["words"].__getitem__, words), np.uint64, len(words))


def order_sketches(hashes: np.ndarray, k: int = WORDS, picks: int = PICKS, sketches: int = SKETCHES) -> np.ndarray:
    """The sketches of a text's word hashes; a text of fewer than k words counts as one k-mer, one of none has no sketch."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    k = min(k, len(hashes))
    n = len(hashes) - k + 1
    grams = np.zeros(n, np.uint64)
    for j in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    grams = mix(grams)
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    begins = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    place = np.arange(n)
    seen = np.empty(n, np.uint64)
    seen[order] = (place - np.maximum.accumulate(np.where(begins, place, 0))).astype(np.uint64)
    labelled = mix(grams + seen * np.uint64(0xD6E8FEB86659FD93))
    out = np.empty(sketches, np.uint64)
    at_once = max(1, (1 << 20) // n)
    for first in range(0, sketches, at_once):
        numbers = np.arange(first, min(first + at_once, sketches), dtype=np.uint64)
        seeds = mix((numbers + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
        values = (labelled[None, :] ^ seeds[:, None]) * _M1
        values ^= values >> np.uint64(32)
        rows = np.arange(len(numbers))
        chosen = []
        for _ in range(min(picks, n)):
            least = values.argmin(axis=1)
            chosen.append(least)
            values[rows, least] = np.uint64(2**64 - 1)
        key = seeds.copy()
        for place_ in np.sort(np.stack(chosen), axis=0):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grams[place_])
        out[first : first + len(numbers)] = key
    return out


def short_sketches(hashes: np.ndarray, k: int, threshold: float) -> np.ndarray:
    """The sketches of short k-mers of a text of k words or more: two texts that may be linked have those of long texts both, or those of short ones."""
    n, out = len(hashes), [np.zeros(0, np.uint64)]
    if n >= max(k, FEW):
        out.append(order_sketches(hashes, *SHORT_KMERS))
    if k <= n and n * threshold <= FEW:
        out.append(mix(order_sketches(hashes, *SHORTER)))
    return np.concatenate(out)


def sketch_in_tasks(k: int, picks: int, sketches: int, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            counts, digests, keys, short_keys = [], [], [], []
            for text in batch.column("text").to_pylist():
                words = text.lower().split()
                hashes = hashed_words(words)
                counts.append(len(words))
                digests.append(xxhash.xxh128_hexdigest(" ".join(words).encode("utf-8", "replace")))
                keys.append(order_sketches(hashes, k, picks, sketches).view(np.int64))
                short_keys.append(short_sketches(hashes, k, threshold).view(np.int64))
            longs = pa.list_(pa.int64())
            arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(keys, longs), pa.array(short_keys, longs)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "digest", "keys", "short_keys"])

    return run


def hash_words_in_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each text as 32-bit hashes, packed."""
    for batch in batches:
        packed = [hashed_words(text.lower().split()).astype(np.uint32).tobytes() for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], names=["rep", "words"])


def banded_distance(a: list, b: list, most: int) -> int | None:
    """The edit distance of two sequences if it is at most `most`, else None: bit-parallel over a diagonal band.

    A column's 2 * most + 1 cells about the diagonal are the bits of an integer (Hyyro's band of the Myers automaton).
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    first = 0
    while first < len(b) and a[first] == b[first]:
        first += 1
    last = 0
    while last < len(b) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if not b:
        return len(a) if len(a) <= most else None
    if len(a) - sum((Counter(a) & Counter(b)).values()) > most:
        return None
    band = min(most, len(a) - 1)
    width = 2 * band + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    up, down, distance, row = full ^ ((1 << band) - 1), 0, band, top >> 1
    for j, x in enumerate(b):
        at = j - band
        match = where.get(x, 0)
        match = (match >> at if at >= 0 else match << -at) & full
        zero = ((((match & up) + up) ^ up) | match | down) & full
        plus, minus = (down | ~(zero | up)) & full, zero & up
        if j < len(a) - band:
            distance += not zero & top
        else:
            distance += bool(plus & row) - bool(minus & row)
            row >>= 1
        half = zero >> 1
        up, down = (minus | ~(half | plus)) & full, half & plus
    return distance if distance <= most else None


def similar(a: str, b: str, threshold: float) -> bool:
    """Whether the word edit distance of two texts is at most (1 - threshold) of the longer one's words."""
    x, y = a.lower().split(), b.lower().split()
    longer = max(len(x), len(y))
    return longer == 0 or banded_distance(x, y, int((1 - threshold) * longer + 1e-9)) is not None


def verify_in_tasks(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(x, y, threshold) for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts align; each text travels once for each pair that names it."""
    left, right = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return in_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb"), verify_in_tasks(threshold), "a bigint, b bigint")


def counts_of(words: np.ndarray) -> np.ndarray:
    """Words and word pairs counted in bins of their hashes: an edit changes at most 2 counts of words and 4 of pairs by one."""
    half = BINS // 2
    pairs = mix(words[:-1].astype(np.uint64) << np.uint64(32) | words[1:]) if len(words) > 1 else np.zeros(0, np.uint64)
    return np.concatenate([np.bincount((w & np.uint64(half - 1)).astype(np.int64), minlength=half) for w in (words.astype(np.uint64), pairs)]).astype(np.int32)


def side_by_side(keys: list[list[int]]) -> np.ndarray:
    """Key lists as rows whose columns compare; of short k-mers a text has those of long texts, those of short ones, or both.

    What a text lacks is filled with a number of its own, which no other row has.
    """
    long, short = SHORT_KMERS[2], SHORTER[2]
    if len({len(k) for k in keys}) == 1:
        return np.array(keys, np.int64)
    out = np.repeat(np.arange(len(keys))[:, None], long + short, axis=1)
    for row, k in enumerate(keys):
        at = slice(long, None) if len(k) == short else slice(0, len(k))
        out[row, at] = k
    return out


def met_links(rows: list[dict], threshold: float) -> Iterator[tuple[int, int]]:
    """Links (class, class) between members of two chunks, or of one chunk among themselves, if low and high are one; the buckets of one leader meet at once.

    Only members of classes not joined yet are compared, so no more links come out than there are classes. A pair that
    shares several buckets of `keys` is compared in the first of them only, and not at all if it shares one of `before`, in which it has
    been compared before. Buckets of the same members, as near copies have, are gone through once and not one by one.
    """
    low, high = rows[0]["low"], rows[0]["high"]
    part, group = np.array([r["part"] for r in rows]), np.array([r["c"] for r in rows])
    words = [np.frombuffer(r["words"], np.uint32) for r in rows]
    n = np.array([len(w) for w in words])
    counts = np.stack([counts_of(w) for w in words])
    folded = counts.reshape(len(rows), -1, BINS // COARSE).sum(axis=2)
    keys = side_by_side([r["keys"] for r in rows])
    before = None if rows[0]["before"] is None else np.array([r["before"] for r in rows], np.int64)
    classes = group.copy()
    at = np.repeat(np.arange(len(rows)), [len(r["here"]) for r in rows])
    here, bucket = np.unique(np.concatenate([r["here"] for r in rows]).astype(np.int64), return_inverse=True)
    in_order = np.argsort(bucket, kind="stable")
    buckets = np.split(at[in_order], np.cumsum(np.bincount(bucket))[:-1])
    known = [here[k : k + 1] for k in range(len(here))]
    if sum(len(b) ** 2 for b in buckets) >= len(rows) ** 2:
        buckets, known = [np.arange(len(rows))], [here]
    for among, of in zip(buckets, known):
        left, right = among[part[among] == low], among[part[among] == high]
        for i in left:
            others = right[right > i] if low == high else right
            others = others[group[others] != group[i]]
            most = ((1 - threshold) * np.maximum(n[others], n[i]) + 1e-9).astype(np.int64)
            near = np.abs(n[others] - n[i]) <= most
            others, most = others[near], most[near]
            for sketch in (folded, counts):
                if len(others):
                    apart, middle = np.abs(sketch[others] - sketch[i]), sketch.shape[1] // 2
                    near = (apart[:, :middle].sum(axis=1) <= 2 * most) & (apart[:, middle:].sum(axis=1) <= 4 * most)
                    others, most = others[near], most[near]
            if len(others):
                shared = keys[others] == keys[i]
                mine = shared.any(axis=1) & np.isin(keys[i, shared.argmax(axis=1)], of)
                if before is not None:
                    mine &= ~(before[others] == before[i]).any(axis=1)
                others, most = others[mine], most[mine]
            if len(others):
                one = words[i].tolist()
                for k, at_most in zip(others.tolist(), most.tolist()):
                    if group[k] != group[i] and banded_distance(one, words[k].tolist(), at_most) is not None:
                        yield classes[i], classes[k]
                        group[group == group[k]] = group[i]


def meet_in_tasks(threshold: float) -> Callable:
    """Takes rows sorted by (leader, low, high), one run of rows a meeting of two chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        found: set[tuple[int, int]] = set()

        def flush() -> None:
            if len(held) > 1:
                found.update((min(p), max(p)) for p in met_links(held, threshold))

        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["leader"], row["low"], row["high"]) != (held[0]["leader"], held[0]["low"], held[0]["high"]):
                    flush()
                    held = []
                held.append(row)
            if len(found) > 50_000:
                yield pairs_batch(found)
                found = set()
        flush()
        yield pairs_batch(found)

    return run


def pairs_batch(found: set) -> pa.RecordBatch:
    pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_pydict({"s": pa.array(pairs[:, 0]), "t": pa.array(pairs[:, 1])})


def meetings(members: DataFrame) -> DataFrame:
    """Members of buckets (key, leader, rep, c, n_words) dealt by hash to the meetings of chunks: leader, rep, c, here, part, low, high.

    Buckets of one leader meet at once: near copies share most of their buckets, so a member is one row with the keys `here`, not a row a bucket.
    Only leaders of more than a chunk are joined back, at most one in CHUNK members or CHUNK_WORDS words.
    """
    met = materialize(members.groupBy("leader", "rep").agg(F.first("c").alias("c"), F.first("n_words").alias("n_words"), F.collect_set("key").alias("here")), "members")
    n = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n_words") / CHUNK_WORDS)).cast("int")
    large = met.groupBy("leader").agg(n.alias("n")).where("n > 1")
    parts = met.join(F.broadcast(large), "leader", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return materialize(parts.select("leader", "rep", "c", "here", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")), "meetings")


def bridges(parts: DataFrame, docs: DataFrame, keys: DataFrame, threshold: float) -> DataFrame:
    """Classes (s, t) that a link joins, from what meetings() gives; docs: doc_id, text; keys: rep, the keys of all its buckets, and those of an earlier step."""
    members = parts.select("rep").distinct()
    words = in_arrow(likely_members(docs, "doc_id", members, "rep"), hash_words_in_tasks, "rep bigint, words binary")
    each = words.groupBy("rep").agg(F.first("words").alias("words")).join(likely_members(keys, "rep", members, "rep"), "rep")
    full = parts.join(each, "rep")
    dealt = full.repartition("leader", "low", "high").sortWithinPartitions("leader", "low", "high")
    return materialize(in_arrow(dealt.select("leader", "rep", "c", "here", "part", "low", "high", "words", "keys", "before"), meet_in_tasks(threshold), "s bigint, t bigint").distinct(), "bridges")


def with_totals(texts: DataFrame, keys: str, totals: dict[str, Callable], more: dict[str, Callable] | None = None) -> DataFrame:
    """Rows (key, rep and the other columns of texts) of each of the `keys` of each text, with `totals` of all rows of a key.

    totals: name -> a function from aggregate-to-column, given F's aggregates over the key. Rows of frequent keys get them from
    partial sums and a join, so that no task sees all of them; those of others from a window, so they are shuffled once. `more`: further
    columns for the latter by a window of the key in order of n_words; null for the former.
    """
    exploded = lambda df: df.select(F.explode(keys).alias("key"), *[c for c in texts.columns if c != keys])
    more = more or {}
    sampled = exploded(texts.where(F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(SAMPLE)) == 0)).groupBy("key").agg(F.count("*").alias("n"))
    frequent = materialize(sampled.where(F.col("n") >= MANY).select("key", F.lit(True).alias("frequent")), "frequent")
    whole, ordered = Window.partitionBy("key"), Window.partitionBy("key").orderBy("n_words")
    windowed = lambda df: df.withColumns({**{name: f().over(whole) for name, f in totals.items()}, **{name: f(ordered) for name, f in more.items()}})
    rows = exploded(texts)
    if frequent.isEmpty():
        return windowed(rows)
    marked = rows.join(frequent, "key", "left")
    rare, hot = marked.where("frequent IS NULL").drop("frequent"), marked.where("frequent").drop("frequent")
    summed = materialize(hot.groupBy("key").agg(*[f().alias(name) for name, f in totals.items()]), "totals")
    return windowed(rare).unionByName(hot.join(summed, "key"), allowMissingColumns=True)


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, k: int = WORDS, picks: int = PICKS, sketches: int = SKETCHES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Returns doc_id, class_id (least doc_id of the class), kept (whether the row is the one that stays) for every row of docs.

    Words are lower-cased and cut at white space. Null texts and texts without words are equal texts of one class;
    texts of fewer than k words are one k-mer, so only equal ones meet; very long texts are compared whole; rows that repeat a doc_id share
    a class and one of them is kept; a null doc_id gets its class but no link of its own and is kept only if the whole class has none; an
    empty table gives no rows; other columns are not read. Ids are integers; of rows that repeat a doc_id any text may link it. Shuffled: sketch
    keys (8 bytes a sketch), and the texts of colliding rows; a filter of fixed size picks these where the texts lie. Of short k-mers
    only the buckets travel on in which texts of different classes and like lengths meet.
    """
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketched = materialize(in_arrow(narrow, sketch_in_tasks(k, picks, sketches, threshold), "doc_id bigint, n_words bigint, digest string, keys array<bigint>, short_keys array<bigint>"), "sketches")
    firsts = [F.first(c).alias(c) for c in ("n_words", "keys", "short_keys")]
    reps = materialize(sketched.groupBy("digest").agg(F.min("doc_id").alias("rep"), *firsts), "representatives")
    named = reps.where("rep IS NOT NULL")
    leader = {"leader": lambda: F.min("rep")}
    met = materialize(with_totals(named.select("rep", "n_words", "keys"), "keys", {**leader, "size": lambda: F.count("*")}).where("size > 1").drop("size"), "buckets")
    stars = materialize(met.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    texts = materialize(likely_members(narrow, "doc_id", met.select("rep").distinct(), "rep"), "texts")
    classes = connected_components(materialize(verified(stars, texts, threshold), "links"))
    first = classes.withColumnRenamed("c", "class")

    grouped = met.join(first.withColumnRenamed("v", "rep"), "rep", "left").withColumn("c", F.coalesce("class", "rep")).drop("class")
    mixed = grouped.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("key")
    found = bridges(meetings(grouped.join(mixed, "key", "left_semi")), texts, named.select("rep", "keys", F.lit(None).cast("array<bigint>").alias("before")), threshold)
    merged = connected_components(found, "s", "t").select(F.col("v").alias("class"), F.col("c").alias("whole"))
    known = reps.join(first.withColumnRenamed("v", "rep"), "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    known = materialize(known.join(merged, "class", "left").select("digest", "rep", "n_words", "keys", "short_keys", F.coalesce("whole", "class").alias("c")), "classes")

    # short k-mers: only buckets in which classes meet, and only members that have another of like length beside them
    like = lambda less, n: less >= n * threshold - 1e-6
    n_words = F.col("n_words")
    beside = {"below": lambda w: like(F.lag("n_words").over(w), n_words), "above": lambda w: like(n_words, F.lead("n_words").over(w)), "seen": lambda w: F.lit(True)}
    rows = with_totals(known.where("rep IS NOT NULL").select("rep", "c", "n_words", "short_keys"), "short_keys", {"least": lambda: F.min("c"), "most": lambda: F.max("c"), **leader}, beside)
    rows = rows.where("least <> most AND (seen IS NULL OR coalesce(below, false) OR coalesce(above, false))")
    late = bridges(meetings(rows), narrow, known.where("rep IS NOT NULL").select("rep", F.col("short_keys").alias("keys"), F.col("keys").alias("before")), threshold)
    merged = connected_components(late, "s", "t").select(F.col("v").alias("c"), F.col("c").alias("whole"))
    named = known.join(merged, "c", "left").select("digest", F.coalesce("whole", "c").alias("class_id"))
    copies = sketched.select("doc_id", "digest").join(named, "digest").select("doc_id", "class_id")
    first = F.row_number().over(Window.partitionBy("class_id", "doc_id").orderBy(F.lit(0))) == 1
    single = copies.withColumn("first", first)
    return single.select("doc_id", "class_id", (F.col("first") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))
