"""Token counts and token ids of whole texts, by a tokenizers-library vocabulary.

The vocabulary's pre-tokenizer drops white space, so no token spans a space or line break: there (and before full-width marks)
long texts are cut into segments. Segments are packed into batches of about equal bytes; the words of a batch that are new to the
worker go through the library's batch encoder in one call, and a bounded memo keeps their lengths, the only thing that leaves the
function. `WordEncoder` gives the ids of words by a bounded memo.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import Memo, in_arrow, kept, segments

#: Bytes of a batch; the library's encodings take some thirty times as much until they are counted.
BATCH_BYTES = 1 << 20
#: Marks that the pre-tokenizer cuts from the letters before them.
MARKS = (".", ",", "!", "?", ";", ":")


class WordEncoder:
    """Library encoding of single words for vocabularies that drop white space; `WordEncoder.of` keeps one a worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        self.model, self.norm, self.pre = self.full.model, self.full.normalizer, self.full.pre_tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = tuple(t["content"] for t in spec["added_tokens"])
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        if not any(s.get("behavior") == "Removed" and s.get("invert") for s in steps):
            raise ValueError("this vocabulary keeps white space, so words cannot be encoded on their own")
        self.width = np.dtype("<u2" if self.full.get_vocab_size() <= 1 << 16 else "<u4")
        self.packed = Memo(self._pack)

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        mine = kept(__name__)
        if path not in mine:
            mine[path] = cls(path)
        return mine[path]

    @staticmethod
    def simpler(word: str) -> tuple[str, ...] | None:
        """Words that together have the same ids and are likelier known: without a closing mark, in lower case."""
        if word.isascii() and word.isalpha():
            return None if word.islower() else (word.lower(),)
        if word[-1:] in MARKS and word[:-1].isalpha():
            return word[:-1], word[-1]
        return None

    def _pack(self, word: str) -> bytes:
        parts = self.simpler(word)
        return array(self.width.char, self.ids(word)).tobytes() if parts is None else b"".join([self.packed[p] for p in parts])

    def ids(self, word: str) -> list[int]:
        """The library's ids of one word, without special tokens added around it."""
        if word.isascii() and word.isalpha():  # one piece of the pre-tokenizer, its own byte alphabet
            return [t.id for t in self.model.tokenize(word.lower())]
        if any(t in word for t in self.added):
            return self.full.encode(word, add_special_tokens=False).ids
        out: list[int] = []
        for piece, _ in self.pre.pre_tokenize_str(self.norm.normalize_str(word)):
            out += [t.id for t in self.model.tokenize(piece)]
        return out


def words(text: str) -> list[str]:
    """Cuts a text at the safe boundaries: ASCII spaces, tabs and line breaks."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def balanced(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """Packs segments of the texts into batches of about `limit` bytes: yields (row of each segment, segments)."""
    rows: list[int] = []
    parts: list[str] = []
    size = 0
    for row, text in enumerate(texts):
        for part in segments(text, limit // 4):
            rows.append(row)
            parts.append(part)
            size += len(part) if part.isascii() else len(part.encode("utf-8", "replace"))
            if size >= limit:
                yield rows, parts
                rows, parts, size = [], [], 0
    if parts:
        yield rows, parts


def batch_encoder(path: str) -> Callable:
    """The library's batch encoder, one a worker, on the task's own core."""
    mine = kept(__name__)
    if ("batch", path) not in mine:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        mine["batch", path] = getattr(model, "encode_batch_fast", model.encode_batch)
    return mine["batch", path]


class WordLengths(dict):
    """Words to their numbers of tokens, of at most about 2 * cap words; words of over `longest` characters stay for their batch only."""

    def __init__(self, encode: Callable, cap: int = 200_000, longest: int = 64):
        super().__init__()
        self.encode, self.cap, self.longest, self.old = encode, cap, longest, {}

    def learn(self, found: set[str]) -> list[str]:
        """Makes sure that all of these words are here, by one call of the batch encoder; returns those that are not to stay."""
        if len(self) > self.cap:
            self.old = dict(self)
            self.clear()
        new = [w for w in found if w not in self]
        parts = {w: WordEncoder.simpler(w) or (w,) for w in new if w}
        asked = list({p for ps in parts.values() for p in ps} - self.keys())
        for p in [p for p in asked if p in self.old]:
            self[p] = self.old[p]
        asked = [p for p in asked if p not in self]
        self.update(zip(asked, map(len, self.encode(asked, add_special_tokens=False))))
        self.update({w: sum(self[p] for p in ps) for w, ps in parts.items()})
        if "" in found:
            self[""] = 0
        return [w for w in (*asked, *new) if len(w) > self.longest]


def count_in_tasks(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = kept(__name__)
        if ("lengths", path) not in mine:
            mine["lengths", path] = WordLengths(batch_encoder(path))
        lengths = mine["lengths", path]
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for rows, parts in balanced(batch.column("text").to_pylist()):
                cut = [words(p) for p in parts]
                passing = lengths.learn(set().union(*cut))
                for row, found in zip(rows, cut):
                    n[row] += sum(map(lengths.__getitem__, found))
                for w in passing:
                    lengths.pop(w, None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, n_bytes, n_tokens, over_limit for every row of docs; only lengths leave the Arrow function.

    A null text counts as an empty one (0 bytes, 0 tokens). Repeated rows are each counted; null ids are kept; an
    empty table gives no rows; other columns are not read. Narrow: one pass, no shuffle; a task holds one Arrow batch and the
    encodings of one batch of BATCH_BYTES. A text without any safe boundary is one segment.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    counted = in_arrow(narrow, count_in_tasks(tokenizer_path), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
