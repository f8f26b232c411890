"""Cross-tokenizer alignment: what two tokenizers' tokens have to do with each other, over a whole corpus, by a dictionary of groups.

Where a token of either tokenizer ends at the same byte, the text is cut; what lies between two cuts is a group: some ids of A over some
ids of B. A corpus has few distinct groups, so they are interned: a block of texts keeps its distinct groups and how often each
occurs in a text. Links (pairs of tokens whose bytes overlap) are expanded once for each distinct group of the corpus and
multiplied by its frequency; the counts of id pairs come back to the blocks by the group's key.

Both tokenizers are applied to words: no token of either spans a single space between two marks that are no white space, which is
checked against the vocabularies, so a text is cut there, and a word's groups are found once and kept in a bounded memo.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import in_arrow, kept, materialize

#: Text bytes of a block, whose distinct groups share a dictionary; words that a worker remembers for each generation, of what length; words encoded together.
BLOCK_BYTES, WORDS, LONGEST, TOGETHER = 8 << 20, 150_000, 64, 1000
#: Places where a text may be cut, and words that may stand between two of them.
CUT = re.compile(r" (?=[\w!-~])(?<=[\w!-~] )")
WHOLE = re.compile(r"[\w!-~](?:.*[\w!-~])?", re.DOTALL)

BLOCKS = "block bigint, keys array<string>, freqs array<bigint>, doc_ids array<{kind}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, digests array<string>, ends array<int>, groups array<int>, times array<int>"
RESULT = "doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """The printable character of each byte in byte-level vocabularies, by their rule: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class Pair:
    """Both tokenizers and the byte lengths of their tokens; `Pair.of` keeps one a worker."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet, added = byte_alphabet(), {t.content for t in self.a.get_added_tokens_decoder().values()}
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = token.encode() if token in added else bytes(alphabet[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(re.search(r"[\w!-~] ", t.decode("utf-8", "ignore")) for t in (*self.bytes_a, *self.bytes_b)):
            raise ValueError("a token has a space after a mark, so texts cannot be cut at spaces")
        self.len_a, self.len_b = (np.array([len(t) for t in ts], np.int64) for ts in (self.bytes_a, self.bytes_b))

    @classmethod
    def of(cls, path_a: str, path_b: str) -> "Pair":
        mine = kept(__name__)
        if mine.get("paths") != (path_a, path_b):
            mine.clear()
            mine.update(paths=(path_a, path_b), pair=cls(path_a, path_b))
        return mine["pair"]

    def encode(self, words: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for texts to which a space is put before: A gets it as text, B puts it there itself."""
        batch = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        return [e.ids for e in batch([f" {w}" for w in words], add_special_tokens=False)], self.b.encode(words, num_threads=1)


class Groups:
    """Distinct groups by number, and words by their groups; a word is (packed numbers, key text), or (None, None) if its tokens' bytes are others."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.number: dict[bytes, int] = {}
        self.keys: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.words: dict[str, tuple[bytes | None, bytes | None]] = {}
        self.old: dict[str, tuple[bytes | None, bytes | None]] = {}
        self.loose: set[str] = set()  # known words that may not stand between two cuts

    def renew(self) -> None:
        """Between blocks: words unused for a whole generation go; a dictionary that has grown large goes as a whole."""
        if len(self.keys) > 2_000_000:
            self.__init__(self.pair)
        elif len(self.words) > WORDS:
            self.old, self.words = self.words, {}
            self.loose &= self.old.keys()

    def intern(self, a: np.ndarray, b: np.ndarray) -> int:
        raw = a.tobytes() + b"|" + b.tobytes()
        found = self.number.get(raw)
        if found is None:
            found = self.number[raw] = len(self.keys)
            self.keys.append(f"{','.join(map(str, a.tolist()))}|{','.join(map(str, b.tolist()))}".encode())
            self.sizes.append((len(a), len(b)))
        return found

    def learn(self, words: set[str]) -> list[str]:
        """Finds the groups of all words that are new, in one call of each library; returns the words too long to be kept."""
        new = []
        for w in words - self.words.keys():
            if w in self.old:
                self.words[w] = self.old[w]
            else:
                new.append(w)
        if not new:
            return []
        new.sort(key=self.loose.__contains__)  # those that may stand between cuts first: they are encoded many in one text
        n_loose = sum(w in self.loose for w in new)
        tight, raws, names = new[: len(new) - n_loose], [f" {w}".encode() for w in new], new
        texts = [" ".join(tight[k : k + TOGETHER]) for k in range(0, len(tight), TOGETHER)] + new[len(tight) :]
        ids_a, ids_b = self.pair.encode(texts)
        spelled = lambda spelling, ids: b"".join(map(spelling.__getitem__, chain.from_iterable(ids)))
        if not spelled(self.pair.bytes_a, ids_a) == b"".join(raws) == spelled(self.pair.bytes_b, ids_b):  # some word is not what its tokens say
            ids_a, ids_b = self.pair.encode(new)
            good = [k for k, raw in enumerate(raws) if spelled(self.pair.bytes_a, ids_a[k : k + 1]) == raw == spelled(self.pair.bytes_b, ids_b[k : k + 1])]
            self.words.update(dict.fromkeys(set(new) - {new[k] for k in good}, (None, None)))
            ids_a, ids_b, raws, names = ([x[k] for k in good] for x in (ids_a, ids_b, raws, new))
        if names:
            flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
            ends_a, ends_b = np.cumsum(self.pair.len_a[flat_a]), np.cumsum(self.pair.len_b[flat_b])  # all words one after another: the same bytes on both sides
            common, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
            to_a, to_b = at_a + 1, at_b + 1
            from_a, from_b = np.concatenate([[0], to_a[:-1]]), np.concatenate([[0], to_b[:-1]])
            numbers = np.empty(len(common), np.int32)
            single = (to_a - from_a == 1) & (to_b - from_b == 1)
            pairs, back = np.unique(flat_a[from_a[single]] << 32 | flat_b[from_b[single]], return_inverse=True)
            known = [self.intern(np.array([p >> 32], np.int64), np.array([p & 0xFFFFFFFF], np.int64)) for p in pairs.tolist()]
            numbers[single] = np.array(known, np.int32)[back] if len(known) else 0
            for k in np.flatnonzero(~single).tolist():
                numbers[k] = self.intern(flat_a[from_a[k] : to_a[k]], flat_b[from_b[k] : to_b[k]])
            ends = (np.searchsorted(common, np.cumsum([len(r) for r in raws])) + 1).tolist()
            keys, packed, start = list(map(self.keys.__getitem__, numbers.tolist())), numbers.tobytes(), 0
            for name, end in zip(names, ends):
                self.words[name] = packed[4 * start : 4 * end], b";".join(keys[start:end])
                start = end
        return [w for w in new if len(w) > LONGEST]

    def cut(self, texts: list[str | None]) -> tuple[list[list[str]], list[str]]:
        """Each text as words with one space between any two, all of them known; and the words that are too long to be kept.

        A text is taken apart at its spaces; where a word so found may not stand between two cuts, the text is cut at the safe places only.
        """
        parts = [t.split(" ") if t else [] for t in texts]
        fresh = set().union(*parts) - self.words.keys() - self.old.keys()
        self.loose.update(w for w in fresh if WHOLE.fullmatch(w) is None)
        for k, words in enumerate(parts):
            if not self.loose.isdisjoint(words):
                parts[k] = CUT.split(texts[k])
                self.loose.update(w for w in (parts[k][0], parts[k][-1]) if WHOLE.fullmatch(w) is None)
        return parts, self.learn(set().union(*parts))


class Block:
    """Texts of a block and their groups, until the block is written as one row."""

    def __init__(self):
        self.ids, self.docs, self.size = [], [], 0

    def row(self, groups: Groups, block: int, kind: pa.DataType) -> pa.RecordBatch:
        used = np.unique(np.concatenate([d[3] for d in self.docs])) if self.docs else np.zeros(0, np.int32)
        freqs = np.zeros(len(used), np.int64)
        places, times = [], []
        for _, _, _, numbers, counts, _ in self.docs:
            at = np.searchsorted(used, numbers).astype(np.int32)
            freqs[at] += counts
            places.append(at)
            times.append(counts)
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))
        joined = lambda parts: np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
        keys = pa.array([groups.keys[g].decode() for g in used.tolist()], pa.string())
        columns = [
            pa.array([block], pa.int64()), one(keys, None), one(freqs, pa.int64()), one(pa.concat_arrays(self.ids).cast(kind), None), *[one([d[k] for d in self.docs], pa.int64()) for k in range(3)],
            one([d[5] for d in self.docs], pa.string()), one(np.cumsum([len(p) for p in places]), pa.int32()), one(joined(places), pa.int32()), one(joined(times), pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BLOCKS.split(", ")])


NOTHING = 0, 0, 0, np.zeros(0, np.int32), np.zeros(0, np.int64), ""


def group_in_tasks(path_a: str, path_b: str):
    """Rows of BLOCKS: distinct groups of a block with their frequencies, and of each text which of them it has, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(path_a, path_b)
        groups = kept(__name__).setdefault("groups", Groups(pair))
        block, number, kind = Block(), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, None
        for batch in batches:
            kind = batch.column("doc_id").type
            texts, start = batch.column("text").to_pylist(), 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size < BLOCK_BYTES // 4):
                    size += len(texts[end] or "")
                    end += 1
                cut, passing = groups.cut(texts[start:end])
                known = np.array(groups.sizes, np.int64).reshape(-1, 2)
                for words in cut:
                    found = list(map(groups.words.__getitem__, words))
                    if not found or (None, None) in found:
                        block.docs.append(NOTHING)
                        continue
                    flat = np.frombuffer(b"".join([f[0] for f in found]), np.int32)
                    numbers, counts = np.unique(flat, return_counts=True)
                    n_a, n_b = counts @ known[numbers]
                    block.docs.append((int(n_a), int(n_b), len(flat), numbers, counts, hashlib.sha256(b";".join([f[1] for f in found])).hexdigest()))
                for w in passing:
                    groups.words.pop(w, None)
                block.ids.append(batch.column("doc_id").slice(start, end - start))
                block.size += size
                start = end
                if block.size >= BLOCK_BYTES:
                    yield block.row(groups, number, kind)
                    groups.renew()
                    block, number = Block(), number + 1
        if block.docs:
            yield block.row(groups, number, kind)
            groups.renew()

    return run


def links_of(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Index pairs of tokens whose byte ranges overlap, from the byte lengths of a group's tokens."""
    ends_a, ends_b = np.cumsum(a).tolist(), np.cumsum(b).tolist()
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        out.append((i, j))
        low = min(ends_a[i], ends_b[j])
        i, j = i + (ends_a[i] == low), j + (ends_b[j] == low)
    return out


def links_in_tasks(path_a: str, path_b: str):
    """key, freq, a, b: the links of each distinct group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(path_a, path_b)
        for batch in batches:
            rows, left, right = [], [], []
            for k, key in enumerate(batch.column("key").to_pylist()):
                a, b = ([int(i) for i in side.split(",")] for side in key.split("|"))
                for i, j in links_of(pair.len_a[a], pair.len_b[b]):
                    rows.append(k)
                    left.append(a[i])
                    right.append(b[j])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("freq").take(at), pa.array(left, pa.int32()), pa.array(right, pa.int32())], names=["key", "freq", "a", "b"])

    return run


def totals_in_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each block with the sums over their groups."""
    for batch in batches:
        for k in range(batch.num_rows):
            column = lambda name: batch.column(name)[k].values
            at, values = column("at").to_numpy(), np.zeros((3, len(column("keys"))), np.int64)
            for row, name in zip(values, ("links", "best", "sums")):
                row[at] = column(name).to_numpy()
            groups, times, ends = (column(name).to_numpy() for name in ("groups", "times", "ends"))
            sums = np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(values[:, groups] * times, axis=1)], axis=1)
            each = np.diff(np.concatenate([np.zeros((3, 1), np.int64), sums[:, ends]], axis=1), axis=1)
            totals = [pa.array(x, pa.int64()) for x in each]
            yield pa.RecordBatch.from_arrays([column("doc_ids"), column("n_a"), column("n_b"), column("n_groups"), *totals, column("digests")], names=[c.split()[0] for c in RESULT.split(", ")])


def group_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written table of blocks of docs: the first pass, and the only one over the texts."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return materialize(in_arrow(narrow, group_in_tasks(path_a, path_b), BLOCKS.format(kind=kind)), "blocks")


def group_links(blocks: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """key, freq, a, b: the group dictionary of the corpus, each distinct group with its frequency and its links."""
    held = blocks.select(F.inline(F.arrays_zip("keys", "freqs"))).toDF("key", "freq")
    return materialize(in_arrow(held.groupBy("key").agg(F.sum("freq").alias("freq")), links_in_tasks(path_a, path_b), "key string, freq bigint, a int, b int"), "links")


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, count, best: how many links of the corpus hold each id pair, and whether that is the most of its B id (ties: all are)."""
    counts = links.groupBy("a", "b").agg(F.sum("freq").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs.

    A encodes a space and the text, B the text (it puts the space there itself), both without special tokens. A text that is null or
    empty, or whose tokens' bytes are not those of the text after a space, has no tokens: zeros and an empty digest. Repeated rows are each
    counted; null ids are kept; an empty table gives no rows; texts of any length are read whole; other columns are not read.

    The texts are read once. What is shuffled are the distinct groups of each block, the links of the distinct groups, and a row a block.
    """
    blocks = group_blocks(docs, path_a, path_b, id_col, text_col)
    links = group_links(blocks, path_a, path_b)
    counted = materialize(pair_counts(links), "pairs")
    values = links.join(counted, ["a", "b"]).groupBy("key").agg(F.count("*").alias("links"), F.sum(F.col("best").cast("long")).alias("best"), F.sum("count").alias("sums"))
    held = blocks.select("block", F.posexplode("keys").alias("at", "key"))
    back = held.join(values, "key").groupBy("block").agg(F.collect_list(F.struct("at", "links", "best", "sums")).alias("v"))  # a row a group of the block
    whole = blocks.drop("freqs").join(back, "block", "left")
    none = F.array()
    for name, type_ in (("at", "int"), ("links", "bigint"), ("best", "bigint"), ("sums", "bigint")):
        whole = whole.withColumn(name, F.coalesce(F.col(f"v.{name}"), none.cast(f"array<{type_}>")))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return in_arrow(whole.drop("v", "block"), totals_in_tasks, RESULT.format(kind=kind))
