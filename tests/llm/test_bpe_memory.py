"""What a worker remembers of byte-level BPE is bounded, and ids do not depend on the slices of a batch."""

import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")


def test_memos_stay_within_their_bound_on_ever_new_words():
    from proofgrid.llm import bpe

    path = P.path("byte_bpe_50k.tiktoken")
    coder = bpe.Coder(path, P.PATTERN, bpe.as_ids)
    words = [f"w{k:x}q{k * 7919 % 99991:08d}" for k in range(240_000)]
    texts = [" ".join(words[at : at + 100]) for at in range(0, len(words), 100)]
    assert sum(len(runs) for runs in coder.texts(texts)) == len(texts)
    assert len(coder.memo) + len(coder.old) <= 200_000 and len(coder.known) + len(coder.known_old) <= 200_000


def test_slices_of_a_batch_give_the_rows_of_the_whole(monkeypatch):
    from proofgrid.llm import bpe

    path = P.path("byte_bpe_50k.tiktoken")
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(50)), "text": [f"some words {k}, {'x' * k} é" if k % 9 else "" for k in range(50)]})
    whole = list(bpe.encode_in_tasks(path, P.PATTERN)(iter([batch])))
    monkeypatch.setattr(bpe, "ROWS", 7)
    cut = list(bpe.encode_in_tasks(path, P.PATTERN)(iter([batch])))
    assert len(whole) == 1 and len(cut) == 8 and [r for b in cut for r in b.to_pylist()] == whole[0].to_pylist()
