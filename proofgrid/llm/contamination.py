"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items, each text scanned once.

Texts and items are reduced to words as bytes: ASCII letters lower-cased, every other ASCII byte but digits a gap, all
bytes of other characters kept. That table maps bytes one to one, so a hit's words lead back to offsets in the text. The
automaton runs over numbers of words, not over bytes, so a window takes at most ten nodes however long its words are.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import in_arrow, kept, materialize

WINDOW = 10
#: Each byte's stand-in: gaps become spaces, A-Z become a-z.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
WORD = re.compile(rb"[^ ]+")


def word_list(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(TABLE).split()


def windows(text: str, size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """The item's windows; an item of fewer words than size, but not none, is one window."""
    found = word_list(text)
    return [tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))] if found else []


class Scanner:
    """The automaton of a block of items (item, text): words are numbered from 1, words of no item are 0.

    A window takes up to `size` nodes of some 60 bytes, and each of its words an entry: about 1 KB a word of the items in all.
    """

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        import ahocorasick

        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            for window in windows(text or "", size):
                owners.setdefault(window, set()).add(item)
        self.number = {w: n for n, w in enumerate(dict.fromkeys(w for window in owners for w in window), 1)}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, ids in owners.items():
            self.automaton.add_word(tuple(map(self.number.__getitem__, window)), (len(window), tuple(sorted(ids))))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    @classmethod
    def of(cls, shared, name: str, size: int) -> "Scanner":
        """The scanner of a broadcast block, kept by the worker until another one is asked for."""
        mine = kept(__name__)
        if mine.get("name") != name:
            mine.clear()
            mine.update(name=name, scanner=cls(shared.value, size))
        return mine["scanner"]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint, ascending runs [first, last) of hit words, and the items met."""
        if self.empty or not words:
            return [], set()
        number = self.number.get
        runs: list[list[int]] = []
        items: set[str] = set()
        for end, (n, owners) in self.automaton.iter(tuple([number(w, 0) for w in words])):
            items.update(owners)
            runs.append([end + 1 - n, end + 1])
        runs.sort()
        merged: list[tuple[int, int]] = []
        for first, last in runs:
            if merged and first <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
            else:
                merged.append((first, last))
        return merged, items


def merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(a + b):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def passages(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Runs of words as code-point offsets of the original text, end exclusive."""
    if not runs:
        return []
    raw = text.encode("utf-8", "replace")
    spans = [m.span() for m in WORD.finditer(raw.translate(TABLE))]
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(chars[spans[first][0]]), "end": int(chars[spans[last - 1][1]])} for first, last in runs]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def scan_in_tasks(shared, name: str, size: int, form: str) -> Callable:
    """Scans by a block of items. form: `full` gives all rows with what was found, `hits` only rows with hits, `clean` the rows without, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner.of(shared, name, size)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lists = [word_list(t or "") for t in texts]
            found = [scanner.scan(words) for words in lists]
            hit = pa.array([bool(runs) for runs, _ in found], pa.bool_())
            if form == "clean":
                yield batch.filter(pc.invert(hit))
                continue
            n_words, items = pa.array([len(w) for w in lists], pa.int64()), pa.array([sorted(i) for _, i in found], pa.list_(pa.string()))
            if form == "hits":
                flat = pa.array([[x for r in runs for x in r] for runs, _ in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("_row"), flat, items], names=["_row", "runs", "items"]).filter(hit)
            else:
                n_hit = pa.array([sum(b - a for a, b in runs) for runs, _ in found], pa.int64())
                spans = pa.array([passages(t, runs) for t, (runs, _) in zip(texts, found)], SPANS)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_words, n_hit, items, spans], names=["doc_id", "n_words", "n_hit", "items", "passages"])

    return run


def gather_in_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts together what several blocks found in a text."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        runs = [merge([], [tuple(r[i : i + 2]) for r in rs or [] for i in range(0, len(r), 2)]) for rs in batch.column("runs").to_pylist()]
        items = [sorted({i for part in parts or [] for i in part}) for parts in batch.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(word_list(t)) for t in texts], pa.int64()), pa.array([sum(b - a for a, b in r) for r in runs], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array([passages(t, r) for t, r in zip(texts, runs)], SPANS)],
            names=["doc_id", "n_words", "n_hit", "items", "passages"],
        )


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    """(number of blocks, items of one), one block at a time, of about `limit` text bytes, so that no automaton, broadcast or driver outgrows a known size.

    Items are dealt by their hash; one item longer than the limit is a longer block.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(text_col, F.lit("")).alias("text")).where(F.col("item").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-total // limit))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for k in range(n):
        yield n, [tuple(r) for r in (items if n == 1 else items.where(part == k)).collect()]


BLOCK_BYTES = 1 << 20


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Returns doc_id, n_words, n_hit, items (array), passages (array of start, end code points) for every row of docs.

    Null texts have no words; items with a null id or without words give no window; items with equal windows are all
    named; repeated rows are each scanned; texts of any length are scanned whole; empty tables give no rows or no hits; other columns are
    not read. Narrow over the documents: no shuffle. The test items, a stated query set, are sent out in blocks of about block_bytes
    of text, whose automaton takes some hundred times that; if they are more, the documents are numbered and scanned once a block, one
    block after another, and the hits put together by a shuffle of the rows.
    """
    sc = docs.sparkSession.sparkContext
    found = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = found.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, items array<string>, passages array<struct<start:bigint,end:bigint>>"
    hits, rows = [], found
    for n, block in blocks_of(benchmark, item_col, item_text_col, block_bytes):
        shared, name = sc.broadcast(block), uuid.uuid4().hex
        if n == 1:
            return in_arrow(found, scan_in_tasks(shared, name, window, "full"), schema)
        if not hits:
            rows = materialize(found.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        hits.append(materialize(in_arrow(rows.select("_row", "text"), scan_in_tasks(shared, name, window, "hits"), "_row bigint, runs array<bigint>, items array<string>"), "hits"))
        shared.unpersist()
    each = reduce(DataFrame.unionByName, hits).groupBy("_row").agg(F.collect_list("runs").alias("runs"), F.collect_list("items").alias("items"))  # a row a block at most
    return in_arrow(rows.join(each, "_row", "left").select("doc_id", "text", "runs", "items"), gather_in_tasks, schema)


def without_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs whose `text` holds no window of an item, with all their columns, however named; null texts stay, repeated rows are each judged.

    Texts of any length are scanned whole; an empty table gives no rows.

    Narrow: a row is judged where it stands. More than one block of items means a written table after each.
    """
    sc, schema = docs.sparkSession.sparkContext, docs.schema
    for n, block in blocks_of(benchmark, item_col, item_text_col, block_bytes):
        docs = in_arrow(docs, scan_in_tasks(sc.broadcast(block), uuid.uuid4().hex, window, "clean"), schema)
        docs = docs if n == 1 else materialize(docs, "clean")
    return docs


def contamination_digest(found: DataFrame) -> DataFrame:
    """The contract's columns from find_contamination's rows."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
