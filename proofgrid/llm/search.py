"""Ranked lexical search over a tiered index: high-impact postings first, exact by residual bounds.

The index is a table of segments, each of some thousand documents. A posting's impact is the part of its score that its term's weight
multiplies; in a segment every term's postings stand in tiers of falling impact, the first of TOP postings, each next one GROWTH times
as large, and within a tier by document, so a document is looked up by bisection. With each tier stands the greatest impact in it:
the sum of what is left of an item's terms bounds every document that was not met yet.

A search runs twice over the segments. The first pass reads the first tiers, completes the most promising documents by
lookups and so learns a score that ten documents of the corpus reach for certain. In the second pass an item is done with a segment as
soon as no unmet document can reach that score; items without this proof fall through to the next tier, at last to the lowest,
where every posting has been met. Nothing is cut: results are those of scoring every document.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.llm.common import Memo, in_arrow, kept, materialize
from proofgrid.llm.contamination import word_list

#: Documents and postings at which a segment is closed.
SEGMENT, POSTINGS = 4096, 2_000_000
#: Postings of a term in the first tier of a segment, and how much larger each next tier is; the last takes the rest.
TOP, GROWTH, TIERS = 8, 8, 4
#: Text bytes of the items that are searched for at once.
BLOCK_BYTES = 4 << 20
#: Bits of the sieve that keeps terms of no item out of an index: 512 KB, whatever the items.
SIEVE_BITS = 22

COUNTED = "doc_id {kind}, n bigint, terms array<string>, tfs array<bigint>"
SEGMENTS = "doc_ids array<{kind}>, terms array<string>, counts array<bigint>, ends array<bigint>, bounds array<bigint>, places array<int>, impacts array<int>"


def sieve_of(terms: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of the terms (term): all that are among them pass, and few others. Words of it reach the driver, 65,536 at most."""
    at = F.crc32(F.col("term").cast("binary")).bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))
    bit = F.call_function("shiftleft", F.lit(1), F.pmod(at, F.lit(8)).cast("int"))
    words = terms.select(F.shiftright(at, 3).alias("byte"), bit.alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("mask"))
    packed = words.groupBy(F.shiftright("byte", 3).alias("word")).agg(F.collect_list(F.struct("byte", "mask")).alias("bytes"))  # eight at most
    found = np.zeros(1 << (SIEVE_BITS - 3), np.uint8)
    for row in packed.toLocalIterator():
        for byte, mask in row.bytes:
            found[byte] = mask
    return found


def count_in_tasks(sieve, name: str) -> Callable:
    """doc_id, number of terms, the terms that pass the sieve (all, without one) and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = kept(__name__)
        if mine.get("sieve") != name:
            mine.clear()
            bits = None if sieve is None else sieve.value.tobytes()
            mask = (1 << SIEVE_BITS) - 1

            def passes(word: bytes) -> bool:
                at = zlib.crc32(word) & mask
                return bool(bits[at >> 3] >> (at & 7) & 1)

            mine.update(sieve=name, passes=None if bits is None else Memo(passes, 400_000))
        passes = mine["passes"]
        for batch in batches:
            sizes, lengths, terms, tfs = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = word_list(text or "")
                counts = Counter(found if passes is None else filter(passes.__getitem__, found))
                sizes.append(len(found))
                lengths.append(len(counts))
                terms += counts
                tfs += counts.values()
            ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, v) for v in (pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return run


def segment_rows(doc_ids: list[pa.Array], ns: list[np.ndarray], terms: list[pa.Array], lengths: list[np.ndarray], tfs: list[np.ndarray], n_docs: int, n_terms: int) -> pa.RecordBatch:
    """One segment of the documents of some batches, as one row."""
    n, ids = np.concatenate(ns), pa.concat_arrays(doc_ids)
    known = pa.chunked_array(terms).dictionary_encode().unify_dictionaries().combine_chunks() if terms else pa.array([], pa.string()).dictionary_encode()
    known = known.chunk(0) if isinstance(known, pa.ChunkedArray) else known
    term = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(n), dtype=np.int64), np.concatenate(lengths))
    tf = np.concatenate(tfs)
    size = {k: 25 + 75 * k * n_docs // n_terms for k in set(n.tolist())} if n_terms else {}  # Python's integers: no overflow
    m = np.array([size.get(k, 25) for k in n.tolist()], np.int64)
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
    counts = np.bincount(term, minlength=len(known.dictionary))
    order = np.lexsort((doc, -impact, term))
    place = np.arange(len(term)) - np.repeat(np.cumsum(counts) - counts, counts)  # of a posting in its term, by impact
    limits = np.cumsum(TOP * GROWTH ** np.arange(TIERS - 1))
    tier = np.empty(len(term), np.int64)
    tier[order] = np.searchsorted(limits, place, side="right")
    order = np.lexsort((doc, term, tier))
    cell = tier * len(counts) + term
    bounds = np.zeros(TIERS * len(counts), np.int64)
    np.maximum.at(bounds, cell, impact)
    ends = np.cumsum(np.bincount(cell, minlength=TIERS * len(counts)))
    one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind))
    return pa.RecordBatch.from_arrays(
        [one(ids, ids.type), one(known.dictionary, pa.string()), one(counts, pa.int64()), one(ends, pa.int64()), one(bounds, pa.int64()), one(doc[order], pa.int32()), one(impact[order], pa.int32())],
        names=["doc_ids", "terms", "counts", "ends", "bounds", "places", "impacts"],
    )


def segments_in_tasks(n_docs: int, n_terms: int, segment: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(5)]
        docs = postings = 0
        for whole in batches:
            for at in range(0, whole.num_rows, segment):
                batch = whole.slice(at, segment)
                lists = batch.column("terms")
                parts = batch.column("doc_id"), batch.column("n").to_numpy(), lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False), batch.column("tfs").flatten().to_numpy()
                if docs and docs + batch.num_rows > segment:
                    yield segment_rows(*held, n_docs, n_terms)
                    held, docs, postings = [[] for _ in range(5)], 0, 0
                for have, part in zip(held, parts):
                    have.append(part)
                docs, postings = docs + batch.num_rows, postings + len(parts[4])
                if postings >= POSTINGS:
                    yield segment_rows(*held, n_docs, n_terms)
                    held, docs, postings = [[] for _ in range(5)], 0, 0
        if docs:
            yield segment_rows(*held, n_docs, n_terms)

    return run


class Index:
    """segments: the table of segments; n_docs and n_terms: documents that have a term, and all their terms with repeats."""

    def __init__(self, segments: DataFrame, n_docs: int, n_terms: int):
        self.segments, self.n_docs, self.n_terms = segments, n_docs, n_terms


def build_index(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> Index:
    """The index of the texts of docs, written to the shared folder; with terms (term), of these terms (and some of equal hashes) only.

    Null and empty texts have no terms, and count neither in n_docs nor in n_terms; null ids are kept; repeated rows are each indexed;
    texts of any length are read whole; an empty table gives an index without segments; other columns are not read. Two
    passes, the second over the counts: no shuffle of documents or postings.
    """
    sc = docs.sparkSession.sparkContext
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    sieve = None if terms is None else sc.broadcast(sieve_of(terms))
    counted = materialize(in_arrow(narrow, count_in_tasks(sieve, uuid.uuid4().hex), COUNTED.format(kind=kind)), "counted")
    n_docs, n_terms = counted.agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    segments = in_arrow(counted, segments_in_tasks(n_docs, n_terms, segment), SEGMENTS.format(kind=kind))
    return Index(materialize(segments, "segments"), n_docs, n_terms)


class Segment:
    """One row of the index, ready to be searched."""

    def __init__(self, doc_ids: pa.Array, terms: pa.Array, ends: np.ndarray, bounds: np.ndarray, places: np.ndarray, impacts: np.ndarray):
        self.doc_ids, self.places, self.impacts = doc_ids, places, impacts
        self.number = {t: k for k, t in enumerate(terms.to_pylist())}
        self.starts = np.concatenate([[0], ends[:-1]]).reshape(TIERS, -1).tolist() if len(ends) else []
        self.ends, self.bounds = ends.reshape(TIERS, -1).tolist(), bounds.reshape(TIERS, -1)
        self.left = np.maximum.accumulate(self.bounds[::-1], axis=0)[::-1]  # the greatest impact from a tier on

    @classmethod
    def rows(cls, batch: pa.RecordBatch) -> Iterator["Segment"]:
        for k in range(batch.num_rows):
            column = lambda name: batch.column(name)[k].values
            yield cls(column("doc_ids"), column("terms"), *[column(name).to_numpy() for name in ("ends", "bounds", "places", "impacts")])

    def asked(self, terms: list[str], weights: list[int]) -> list[tuple[int, int]]:
        """The item's terms that occur here by number, each with its weight times its repeats."""
        return [(self.number[t], w) for t, w in zip(terms, weights) if w and t in self.number]

    def residual(self, asked: list[tuple[int, int]], tier: int) -> int:
        """What a document that no tier up to this one has met can reach."""
        return sum(w * int(self.left[tier + 1][t]) for t, w in asked) if tier + 1 < TIERS else 0

    def add(self, scores: np.ndarray, asked: list[tuple[int, int]], tier: int) -> None:
        starts, ends = self.starts[tier], self.ends[tier]
        for t, w in asked:
            at = slice(starts[t], ends[t])
            scores[self.places[at]] += w * self.impacts[at].astype(np.int64)  # a document once a term

    def complete(self, scores: np.ndarray, picked: np.ndarray, asked: list[tuple[int, int]], tier: int) -> np.ndarray:
        """The whole scores of some documents, of which the tiers up to this one are in scores: lookups in the lower tiers."""
        found = scores[picked]
        for low in range(tier + 1, TIERS):
            starts, ends = self.starts[low], self.ends[low]
            for t, w in asked:
                a, b = starts[t], ends[t]
                if a < b:
                    there = self.places[a:b]
                    at = np.minimum(np.searchsorted(there, picked), b - a - 1)
                    found = found + np.where(there[at] == picked, w * self.impacts[a:b][at].astype(np.int64), 0)
        return found

    def best_of_first(self, asked: list[tuple[int, int]], k: int) -> list[int]:
        """Whole scores of up to k documents that the first tier makes look best."""
        scores = np.zeros(len(self.doc_ids), np.int64)
        self.add(scores, asked, 0)
        seen = np.flatnonzero(scores)
        if len(seen) > k:
            seen = np.sort(seen[np.argpartition(-scores[seen], k - 1)[:k]])
        return self.complete(scores, seen, asked, 0).tolist()

    def best(self, asked: list[tuple[int, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the k best documents among those of `least` and more, ties by doc_id, and the tier that the proof took."""
        scores = np.zeros(len(self.doc_ids), np.int64)
        for tier in range(TIERS):
            self.add(scores, asked, tier)
            left = self.residual(asked, tier)
            if left < least or not left:
                break
        seen = np.flatnonzero((scores > 0) & (scores + left >= least))
        whole = self.complete(scores, seen, asked, tier)
        reach = whole >= least
        seen, whole = seen[reach], whole[reach]
        if len(seen) > k:
            top = whole >= np.partition(whole, len(whole) - k)[len(whole) - k]
            seen, whole = seen[top], whole[top]
            ids = self.doc_ids.take(pa.array(seen)).to_pylist()
            order = sorted(range(len(seen)), key=lambda i: (-whole[i], ids[i] is None, ids[i] if ids[i] is not None else 0))[:k]
            seen, whole = seen[order], whole[order]
        return seen, whole, tier


def floors_in_tasks(items, k: int) -> Callable:
    """item, score: of every item up to k scores that documents of the task reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, list[int]] = {}
        for batch in batches:
            for segment in Segment.rows(batch):
                for item, terms, weights in items.value:
                    asked = segment.asked(terms, weights)
                    if asked:
                        top[item] = sorted(top.get(item, []) + segment.best_of_first(asked, k), reverse=True)[:k]
        flat = [(i, s) for i, scores in top.items() for s in scores]
        yield pa.RecordBatch.from_pydict({"item": pa.array([i for i, _ in flat], pa.int64()), "score": pa.array([s for _, s in flat], pa.int64())})

    return run


def search_in_tasks(items, floors: dict[int, int], k: int) -> Callable:
    """item, doc_id, score, tier: what each segment holds of the items' best documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment in Segment.rows(batch):
                rows: list[int] = []
                places, scores, tiers = [], [], []
                for item, terms, weights in items.value:
                    asked = segment.asked(terms, weights)
                    if asked:
                        seen, whole, tier = segment.best(asked, k, floors.get(item, 1))
                        rows += [item] * len(seen)
                        places.append(seen)
                        scores.append(whole)
                        tiers += [tier] * len(seen)
                if rows:
                    ids = segment.doc_ids.take(pa.array(np.concatenate(places)))
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), ids, pa.array(np.concatenate(scores), pa.int64()), pa.array(tiers, pa.int32())], names=["item", "doc_id", "score", "tier"])

    return run


def term_counts(items: DataFrame) -> DataFrame:
    """item, term, q of items (item, text): each term of an item and its repeats, by Spark's own functions."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.split(F.translate(F.coalesce("text", F.lit("")), upper, lower), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return items.select("item", F.explode(words).alias("term")).where("term <> ''").groupBy("item", "term").agg(F.count("*").alias("q"))


def search(index: Index, counts: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item, doc_id, score, tier, rank: the k best documents of each item of counts (item, term, q), equal scores by doc_id, null ids last.

    Items, a stated query set, go out in blocks of about block_bytes of their terms; each block passes twice over the segments. Only the
    scores that a block's items reach for certain, a number an item, come to the driver between the passes.
    """
    spark = index.segments.sparkSession
    held = index.segments.select(F.inline(F.arrays_zip("terms", "counts"))).toDF("term", "df")
    df = held.join(counts.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * index.n_docs + 2.0) / (2 * F.col("df") + 1).cast("double")))
    asked = counts.join(df.select("term", weight.alias("w")), "term").groupBy("item").agg(F.collect_list("term").alias("terms"), F.collect_list(F.col("q") * F.col("w")).alias("weights"))
    asked = materialize(asked, "asked")
    total = asked.agg(F.coalesce(F.sum(F.octet_length(F.array_join("terms", " ")) + 8 * F.size("terms")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    kind = index.segments.schema["doc_ids"].dataType.elementType.simpleString()
    found = []
    for block in range(n):
        items = spark.sparkContext.broadcast([tuple(r) for r in asked.where(F.pmod(F.xxhash64("item"), F.lit(n)) == block).collect()])
        reached = in_arrow(index.segments.drop("counts"), floors_in_tasks(items, k), "item bigint, score bigint")
        order = Window.partitionBy("item").orderBy(F.desc("score"))
        floors = {r.item: r.score for r in reached.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).where(F.col("rank") == k).collect()}
        found.append(in_arrow(index.segments.drop("counts"), search_in_tasks(items, floors, k), f"item bigint, doc_id {kind}, score bigint, tier int"))
        if n > 1:
            found[-1] = materialize(found[-1], "found")
            items.unpersist()
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, benchmark: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, segment: int = SEGMENT) -> DataFrame:
    """Returns item_id, rank, doc_id, score: of every row of benchmark its k highest-scoring documents with a score above 0.

    Null, empty and term-free texts are found by no item and find nothing; items that repeat an id, or have none, are ranked row
    by row under the id they have; rows of docs that repeat are each ranked; null doc_ids are kept and lose ties; an
    empty table on either side gives no rows; texts of any length are read whole; other columns are not read.
    """
    items = materialize(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).withColumn("item", F.monotonically_increasing_id()), "items")
    counts = materialize(term_counts(items), "counts")
    index = build_index(docs, counts.select("term").distinct(), id_col, text_col, segment)
    hits = search(index, counts, k, block_bytes)
    return hits.join(items.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
