"""Byte-level BPE by merge replay over the words of a block of the corpus, and its exact inverse.

A block of texts is cut at places no token can span. The distinct pieces it holds that the worker has not met yet
form one table of symbols; an inverted index from each mergeable pair, named by the token it makes, to the positions where it
stands in these pieces is replayed in rank order, every merge applied at all its places, touching only the two neighbours of
each. The table is that of a block, not of the whole corpus: pieces do not touch each other, so the ids are the same, and
neither the pieces nor their ids have to be shuffled back to the texts that hold them.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import in_arrow, kept

BLOCK_CHARS = 1 << 20
#: Rows of an Arrow batch whose ids a task holds at once.
ROWS = 2048
#: Characters of the longest unit that a memo keeps after its block, so that the memos are bounded in bytes.
KEEP = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Replay:
    """Applies the merges of a rank table to many pieces at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {r: b for b, r in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        #: (left << 32 | right) -> the token that the two make, for every cut of every token into two tokens
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self.first = np.full((256, 256), -1)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.first[token[0], token[1]] = rank

    def index(self, pieces: list[bytes]) -> tuple[list[int], list[int], list[int], list[int], dict[int, list[int]]]:
        """Symbols of the pieces laid end to end, their neighbours (-1: none), where pieces start, and the pair index."""
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces])
        starts = np.cumsum(sizes) - sizes
        after, before = np.arange(1, len(raw) + 1), np.arange(-1, len(raw) - 1)
        after[starts + sizes - 1], before[starts] = -1, -1
        made = np.full(len(raw), -1)
        made[:-1] = self.first[raw[:-1], raw[1:]]
        made[after < 0] = -1
        at = np.flatnonzero(made >= 0)
        at = at[np.argsort(made[at], kind="stable")]
        ranks, begin = np.unique(made[at], return_index=True)
        places = {r: x.tolist() for r, x in zip(ranks.tolist(), np.split(at, begin[1:]))} if len(at) else {}
        return self.single[raw].tolist(), after.tolist(), before.tolist(), starts.tolist(), places

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece: at every step the lowest-ranked pair of a piece merges, its leftmost place first."""
        out: list[list[int] | None] = [[r] if (r := self.ranks.get(p)) is not None else None if p else [] for p in pieces]
        todo = [k for k, ids in enumerate(out) if ids is None]
        if todo:
            for k, ids in zip(todo, self.in_order([pieces[k] for k in todo])):
                out[k] = ids
        return out

    def in_order(self, pieces: list[bytes]) -> list[list[int]]:
        """Replay rank by rank over the index of pairs, each at all its places."""
        symbol, after, before, starts, places = self.index(pieces)
        made, push = self.pairs.get, heapq.heappush
        heap = sorted(places)
        while heap:
            rank = heapq.heappop(heap)
            spots = places.pop(rank, None)
            if spots is None:
                continue
            spots.sort()
            for k, i in enumerate(spots):
                j = after[i]
                if j < 0 or symbol[i] < 0 or made(symbol[i] << 32 | symbol[j]) != rank:
                    continue  # a merge has taken one of the two meanwhile
                symbol[i], symbol[j] = rank, -1
                left, right = before[i], after[j]
                after[i], least = right, rank
                if right >= 0:
                    before[right] = i
                    if (r := made(rank << 32 | symbol[right])) is not None:
                        if r in places:
                            places[r].append(i)
                        else:
                            places[r] = [i]
                            push(heap, r)
                        if r < least:
                            least = r
                if left >= 0 and (r := made(symbol[left] << 32 | rank)) is not None:
                    if r in places:
                        places[r].append(left)
                    else:
                        places[r] = [left]
                        push(heap, r)
                    if r < least:
                        least = r
                if least < rank and k + 1 < len(spots):  # a lower rank has come up: it goes before the other places
                    places[rank] = spots[k + 1 :]
                    push(heap, rank)
                    break
        out = []
        for at in starts:
            ids = []
            while at >= 0:
                ids.append(symbol[at])
                at = after[at]
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class Coder:
    """Units of text to values made of their ids, with a memo of two generations of at most `cap` units each (or one block's, if those are more).

    Units and pieces of over KEEP characters are kept for their block only.
    """

    def __init__(self, path: str, pattern: str, form: Callable[[Replay, list[int]], object], cap: int = 100_000):
        import regex

        self.replay, self.find, self.safe, self.form, self.cap = Replay(load_ranks(path)), regex.compile(pattern).findall, regex.compile(r"(?<=\S) (?=\S)"), form, cap
        self.passing: list = []
        self.passing_pieces: list[str] = []
        self.memo: dict = {}
        self.old: dict = {}
        self.known: dict[str, list[int]] = {}
        self.known_old: dict[str, list[int]] = {}

    @classmethod
    def of(cls, path: str, pattern: str, form) -> "Coder":
        key = path, pattern, form.__name__
        mine = kept(__name__)
        if key not in mine:
            mine[key] = cls(path, pattern, form)
        return mine[key]

    def units(self, text: str, careful: bool = False) -> list[list]:
        """Runs of units that join to the text. A unit is a word with the space before it; a tuple has no space before it.

        A single space between two characters that are no white space always starts a token; other spaces stay inside.
        Unless careful, only neighbouring spaces are looked for; learn() tells where other white space stands beside one.
        """
        runs: list[list] = []
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > BLOCK_CHARS and (cut := self.safe.search(text, at + BLOCK_CHARS)):
                end = cut.start()
            parts: list = text[at:end].split(" ")
            if "" in parts or careful:
                joined = [parts[0]]
                for p in parts[1:]:
                    if p and joined[-1] and not p[0].isspace() and not joined[-1][-1].isspace():
                        joined.append(p)
                    else:
                        joined[-1] += " " + p
                parts = joined
            if not runs:
                parts[0] = (parts[0],)
            runs.append(parts)
            at = end + 1
        return runs

    def cut(self, unit) -> list[str]:
        """The pieces that the pattern finds in a unit; plain words, alone or before one mark, need no search."""
        if isinstance(unit, tuple):
            return self.find(unit[0])
        if unit.isalpha():
            return [" " + unit]
        if unit[-1] in ".,!?;:" and unit[:-1].isalpha():
            return [" " + unit[:-1], unit[-1]]
        return self.find(" " + unit)

    def learn(self, units: set) -> None:
        """Makes sure that the memo holds these units."""
        if len(self.memo) + len(units) > self.cap:
            self.old, self.memo = self.memo, {}
        memo, old, new = self.memo, self.old, []
        for u in units:
            if u not in memo:
                if (v := old.get(u)) is not None:
                    memo[u] = v
                else:
                    new.append(u)
        if not new:
            return
        self.passing = [u for u in new if len(u[0] if isinstance(u, tuple) else u) > KEEP]
        cut = [self.cut(u) for u in new]
        ids = self.pieces({p for c in cut for p in c})
        for u, c in zip(new, cut):
            memo[u] = self.form(self.replay, ids[c[0]] if len(c) == 1 else [i for p in c for i in ids[p]])

    def pieces(self, wanted: set[str]) -> dict[str, list[int]]:
        """Ids of these pieces, by a memo of their own: many new units are a known piece beside another mark."""
        if len(self.known) + len(wanted) > self.cap:
            self.known_old, self.known = self.known, {}
        known, old, new = self.known, self.known_old, []
        for p in wanted:
            if p not in known:
                if (v := old.get(p)) is not None:
                    known[p] = v
                else:
                    new.append(p)
        self.passing_pieces = [p for p in new if len(p) > KEEP]
        for p, ids in zip(new, self.replay.encode([p.encode("utf-8", "replace") for p in new])):
            known[p] = ids
        return known

    def texts(self, texts: list[str]) -> Iterator[list[list]]:
        """For each text its runs of unit values, in order."""
        held: list[tuple[str, list[list]]] = []
        wanted: set = set()
        size, collects = 0, gc.isenabled()
        gc.disable()  # the memo holds many small lists and no cycles
        try:
            for text in texts:
                runs = self.units(text)
                held.append((text, runs))
                for r in runs:
                    wanted.update(r)
                size += len(text)
                if size >= BLOCK_CHARS:
                    yield from self._values(held, wanted)
                    held, wanted, size = [], set(), 0
            yield from self._values(held, wanted)
        finally:
            if collects:
                gc.enable()

    def _values(self, held: list[tuple[str, list[list]]], wanted: set) -> Iterator[list[list]]:
        loose = {u for u in wanted if isinstance(u, str) and u and (u[0].isspace() or u[-1].isspace()) or isinstance(u, tuple) and u[0][-1:].isspace()}
        if loose:  # white space other than a space beside a space: cut those texts again, with care
            for k, (text, runs) in enumerate(held):
                if any(not loose.isdisjoint(r) for r in runs):
                    held[k] = text, self.units(text, careful=True)
                    for r in held[k][1]:
                        wanted.update(r)
            wanted -= loose - {u for _, runs in held for r in runs for u in r}
        self.learn(wanted)
        for _, runs in held:
            yield [list(map(self.memo.__getitem__, r)) for r in runs]
        for memo, passing in ((self.memo, self.passing), (self.known, self.passing_pieces)):
            for u in passing:
                memo.pop(u, None)
        self.passing, self.passing_pieces = [], []


def as_ids(replay: Replay, ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


def as_text(replay: Replay, ids: list[int]) -> tuple[bytes, bytes]:
    """The ids as decimal text, and the bytes that they decode to."""
    return " ".join(map(str, ids)).encode(), replay.decode(ids)


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encode_in_tasks(path: str, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(path, pattern, as_ids)
        for batch in in_slices(batches):
            packed = [b"".join(b"".join(r) for r in runs) for runs in coder.texts(batch.column("text").to_pylist())]
            ends = np.cumsum([0] + [len(p) // 4 for p in packed])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            kept = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(np.diff(ends), pa.int64()), ids], names=[*kept, "n_tokens", "ids"])

    return run


def decode_in_tasks(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = {r: b for b, r in load_ranks(path).items()}
        for batch in batches:
            raw = [b"".join(map(name.__getitem__, ids)) if ids is not None else None for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "decoded"])

    return run


def digest_in_tasks(path: str, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(path, pattern, as_text)
        for batch in in_slices(batches):
            counts, ids_sha, text_sha = [], [], []
            for runs in coder.texts(batch.column("text").to_pylist()):
                listed, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
                for k, run_values in enumerate(runs):
                    line = b" ".join([v[0] for v in run_values])
                    n += line.count(b" ") + 1
                    listed.update(b" " + line if k else line)
                    decoded.update(b"".join([v[1] for v in run_values]))
                counts.append(n)
                ids_sha.append(listed.hexdigest())
                text_sha.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return narrow, narrow.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Returns doc_id, the columns to keep, n_tokens and ids (array of int) for every row of docs.

    A null or empty text has no ids; repeated rows are each encoded; an empty table gives no rows; other columns are
    not read, so their names do not matter. Narrow: no shuffle; a task holds one Arrow batch, one block of units and the memo.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "text")
    return in_arrow(narrow, encode_in_tasks(ranks_path, pattern), f"{kept}, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Returns doc_id and decoded (binary): the bytes that the ids stand for; null for null ids; an unknown id fails."""
    narrow = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return in_arrow(narrow, decode_in_tasks(ranks_path), f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256.

    A null text is empty, and an empty text has no ids, so both digests are those of no bytes; null ids stay, repeated rows are
    each encoded, an empty table gives no rows, other columns are not read. Narrow: no shuffle.
    """
    narrow, kind = _narrow(docs, id_col, text_col)
    return in_arrow(narrow, digest_in_tasks(ranks_path, pattern), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
