"""Token ids as Arrow files of fixed-size-list batches, for zero-copy random access to equal-length sequences.

Layout of an output folder, one pair of files for each run of documents in ascending doc_id order:
  seq-<run>-<attempt>.arrow    Arrow IPC file; each batch holds up to ROWS sequences: `ids` fixed_size_list<uint16|uint32>[L]
                               and `mask` fixed_size_list<uint8>[L] (1 for an id, 0 where the last sequence is padded), so both are views of the file
  index-<run>-<attempt>.arrow  Arrow IPC file; one row a document: doc_id, start (within the run), n_tokens
Only the files that a finished task reported count, so failed or repeated attempts leave no trace in a result.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.llm.common import bucket_of, cut_points, in_arrow, new_path, segments
from proofgrid.llm.tokens import WordEncoder, words

LENGTH, ROWS = 2048, 64
#: Bytes of text of a run of documents, and how many finer ranges of ids each is put together from.
RUN_BYTES, FINER = 32 << 20, 4


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


class SequenceWriter:
    """Streams ids into one Arrow file; holds at most one batch of them."""

    def __init__(self, sink, dtype: np.dtype, length: int = LENGTH, rows: int = ROWS):
        self.dtype, self.length, self.full = dtype, length, rows * length * dtype.itemsize
        item = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([pa.field("ids", pa.list_(pa.field("item", item, False), length), False), pa.field("mask", pa.list_(pa.field("item", pa.uint8(), False), length), False)])
        self.out, self.buffer = pa.ipc.new_file(sink, self.schema), bytearray()

    def add(self, packed: bytes) -> None:
        self.buffer += packed
        while len(self.buffer) >= self.full:
            self._batch(bytes(self.buffer[: self.full]))
            del self.buffer[: self.full]

    def _batch(self, packed: bytes) -> None:
        ids = np.frombuffer(packed, self.dtype)
        pad = -len(ids) % self.length
        mask = np.ones(len(ids) + pad, np.uint8)
        if pad:
            mask[len(ids) :] = 0
            ids = np.concatenate([ids, np.zeros(pad, self.dtype)])
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((ids, mask), self.schema)]
        self.out.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.buffer:
            self._batch(bytes(self.buffer))
        self.out.close()


class SequenceFile:
    """Random access to a written file: memory-mapped without copies where the store is local, by ranged reads elsewhere."""

    def __init__(self, uri: str):
        store, path = _store(uri)
        self.source = pa.memory_map(path) if store.type_name == "local" else store.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self._at, self._ids = -1, None

    def _batch(self, i: int) -> np.ndarray:
        if i != self._at:
            self._at, self._ids = i, self.reader.get_batch(i).column("ids").flatten().to_numpy(zero_copy_only=True)
        return self._ids

    def sequence(self, i: int, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
        """Sequence i of the file and its mask, both views of the file."""
        batch, row = self.reader.get_batch(i // rows), i % rows
        at = slice(row * self.length, (row + 1) * self.length)
        ids, mask = (batch.column(c).flatten().to_numpy(zero_copy_only=True)[at] for c in ("ids", "mask"))
        return ids, mask

    def tokens(self, start: int, n: int, rows: int = ROWS) -> Iterator[np.ndarray]:
        """The ids from start to start + n, as views of the batches that hold them."""
        size = rows * self.length
        while n > 0:
            view = self._batch(start // size)[start % size : start % size + n]
            yield view
            start, n = start + len(view), n - len(view)


def write_in_tasks(path: str, folder: str, end_id: int, length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(path)
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        end, width = np.array([end_id], encoder.width).tobytes(), encoder.width.itemsize
        run_id, files, attempt, at, n_docs = None, {}, uuid.uuid4().hex, 0, 0
        sinks: list = []
        writer = index = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                run_id = batch.column("run")[0].as_py()
                files = {k: f"{k}-{run_id:06d}-{attempt}.arrow" for k in ("seq", "index")}
                sinks = [store.open_output_stream(f"{base}/{name}") for name in files.values()]
                writer = SequenceWriter(sinks[0], encoder.width, length)
                rows = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                index = pa.ipc.new_file(sinks[1], rows)
            starts, counts = [], []
            for text in batch.column("text").to_pylist():
                starts.append(at)
                for part in segments(text):
                    packed = b"".join(map(encoder.packed.__getitem__, words(part)))
                    writer.add(packed)
                    at += len(packed) // width
                writer.add(end)
                at += 1
                counts.append(at - starts[-1])
            n_docs += len(starts)
            index.write_batch(pa.record_batch([batch.column("doc_id"), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=index_schema(batch)))
        if writer is not None:
            writer.close()
            index.close()
            for sink in sinks:
                sink.close()
            yield pa.RecordBatch.from_pydict({"run": pa.array([run_id], pa.int32()), "seq": [files["seq"]], "index": [files["index"]], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([at], pa.int64())})

    return run


def index_schema(batch: pa.RecordBatch) -> pa.Schema:
    return pa.schema([("doc_id", batch.schema.field("doc_id").type), ("start", pa.int64()), ("n_tokens", pa.int64())])


def run_cuts(narrow: DataFrame, run_bytes: int) -> list:
    """Values of doc_id that cut the documents into runs of about run_bytes of text: ranges of about equal counts, put together by their bytes.

    The driver sees a number a range, and there is a range for every run_bytes / FINER of text.
    """
    sized = narrow.select("doc_id", (F.octet_length("text") + 64).alias("bytes"))
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    cuts = cut_points(sized, "doc_id", FINER * max(1, -(-total // run_bytes)))
    sizes = dict(map(tuple, sized.groupBy(bucket_of(F.col("doc_id"), cuts)).agg(F.sum("bytes")).collect()))
    chosen, held = [], sizes.get(0, 0)
    for k, cut in enumerate(cuts, 1):
        if held and held + sizes.get(k, 0) > run_bytes:
            chosen.append(cut)
            held = 0
        held += sizes.get(k, 0)
    return chosen


def write_sequences(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", run_bytes: int = RUN_BYTES) -> list[tuple]:
    """Encodes every whole text, ends it with end_id and writes the files; returns the manifest, one entry a run of documents.

    Entries are (run, base, seq file, index file, n_docs, n_tokens) in ascending doc_id order; base is the position of the
    run's first id among all ids. A null text is empty (it has only the end id); a null doc_id comes first; rows that
    repeat a doc_id follow each other in one run; an empty table gives an empty manifest; other columns are not read. One shuffle of the
    texts by doc_id range (a run of about run_bytes a task, streamed; a very long text or a doc_id of very many rows makes a longer one),
    and a manifest of one small row a run on the driver.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = run_cuts(narrow, run_bytes)
    ordered = narrow.withColumn("run", bucket_of(F.col("doc_id"), cuts)).repartitionById(len(cuts) + 1, "run").sortWithinPartitions("doc_id")
    schema = "run int, seq string, index string, n_docs long, n_tokens long"
    found = sorted(map(tuple, in_arrow(ordered, write_in_tasks(tokenizer_path, folder, end_id, length), schema, owner="proofgrid.llm.tokens").collect()))
    out, base = [], 0
    for run, seq, index, n_docs, n_tokens in found:
        out.append((run, base, seq, index, n_docs, n_tokens))
        base += n_tokens
    return out


def read_in_tasks(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in batch.to_pylist():
                file = SequenceFile(f"{folder}/{entry['seq']}")
                store, base = _store(folder)
                with store.open_input_file(f"{base}/{entry['index']}") as source:
                    reader = pa.ipc.open_file(source)
                    for i in range(reader.num_record_batches):
                        docs = reader.get_batch(i)
                        starts, counts = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                        sums = np.zeros(len(starts), np.int64)
                        for k, (start, n) in enumerate(zip(starts.tolist(), counts.tolist())):
                            crc = 0
                            for view in file.tokens(start, n):
                                crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                            sums[k] = crc
                        yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array(starts + entry["base"]), pa.array(counts), pa.array(sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_digests(spark: SparkSession, folder: str, manifest: list[tuple], id_type: str = "bigint") -> DataFrame:
    """Reads written files back: doc_id, start among all ids, n_tokens and ids_crc32, a task for each run of documents."""
    entries = spark.createDataFrame(manifest, "run int, base long, seq string, index string, n_docs long, n_tokens long")
    dealt = entries.repartitionById(max(1, len(manifest)), "run")
    return in_arrow(dealt, read_in_tasks(folder), f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def sequence_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """Writes the files of docs into the shared folder and returns what they hold for each document: doc_id, start, n_tokens, ids_crc32.

    Nulls, empty texts, repeats and empty tables are as in write_sequences; an empty table gives no rows.
    """
    folder = new_path(docs.sparkSession, "sequences")
    manifest = write_sequences(docs, tokenizer_path, folder, end_id, length)
    return read_digests(docs.sparkSession, folder, manifest, docs.schema["doc_id"].dataType.simpleString())
