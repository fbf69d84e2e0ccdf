"""Operator 6: byte-level BPE encoding and decoding over Arrow batches.

``encode`` gives token ids and the character span of each token; ``decode``
gives back bytes (and text) from ids through the reversed byte table, so a
character split over tokens comes back whole once its last byte is there.

Rules: null text counts as empty and has no tokens; every row of the input
gives one row, repeated ids too; a tokenizer file's special tokens are found in
texts as the library's own ``encode`` does, a rank file has none; ids outside the vocabulary decode to nothing;
bytes that are no UTF-8 show as U+FFFD in ``text`` and stay in ``bytes``."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from upshelf.llm.common import pick, small_batches
from upshelf.llm.ranks import Pieces, offsets, rank_file, tokenizer_of_ranks


@functools.cache
def coder(path: str) -> tuple[Pieces, list[bytes], np.ndarray]:
    """The worker's encoder for a rank file or a tokenizer file, with the bytes of each id."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
    else:
        tok = tokenizer_of_ranks(rank_file(path))
    pieces = Pieces(tok)
    table = pieces.token_bytes()
    return pieces, table, np.array([len(b) for b in table], dtype=np.int64)


def decoded(ids: np.ndarray, table: list[bytes]) -> bytes:
    if len(ids) and int(ids.max()) >= len(table):
        ids = ids[ids < len(table)]
    return b"".join(map(table.__getitem__, ids.tolist()))


def encode(docs: DataFrame, path: str, spans: bool = True) -> DataFrame:
    """(doc_id, ids array<int>, starts, ends array<int>): tokens of every whole text."""
    small_batches(docs.sparkSession)

    def run(batches):
        pieces, _, lengths = coder(path)
        for b in batches:
            ids, starts, ends = [], [], []
            for t in b.column(1).to_pylist():
                text = t or ""
                got = np.frombuffer(pieces.ids(text), "<u4").astype(np.int64)
                ids.append(got.astype(np.int32))
                s, e = offsets(got, lengths, text.encode("utf-8", "surrogatepass")) if spans else (got[:0], got[:0])
                starts.append(s.astype(np.int32))
                ends.append(e.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.list_(pa.int32())) for x in (ids, starts, ends))],
                ["doc_id", "ids", "starts", "ends"])

    return pick(docs, doc_id="long", text="string").mapInArrow(
        run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes, text) from (doc_id, ids)."""
    def run(batches):
        _, table, _ = coder(path)
        for b in batches:
            raw = [decoded(np.array([i for i in x if i is not None and i >= 0], dtype=np.int64), table)
                   for x in (y or [] for y in b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())],
                ["doc_id", "bytes", "text"])

    return pick(tokens, doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, bytes binary, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) in one pass: the ids are
    made, decoded again and hashed where they are, so no token array is moved."""
    small_batches(docs.sparkSession)

    def run(batches):
        pieces, table, _ = coder(path)
        for b in batches:
            n, a, d = [], [], []
            for t in b.column(1).to_pylist():
                raw = pieces.ids(t or "")
                n.append(len(raw) // 4)
                a.append(hashlib.sha256(raw).hexdigest())
                d.append(hashlib.sha256(decoded(np.frombuffer(raw, "<u4"), table)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(docs, doc_id="long", text="string").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

