"""Byte-level BPE encoding and decoding by the tiktoken library with a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import clean_text, held, long_rows, small_batches

#: A longer text goes to the library in parts of about this many characters.
PART = 100_000
#: The pattern always splits before a space that follows a visible character and precedes another.
_SAFE = re.compile(r"(?<=\S)(?= \S)")


def encoding(rank_file: str) -> tiktoken.Encoding:
    """The worker's encoding for a rank file of public_tokenizers; no special tokens."""
    return held(f"ranks {rank_file}", lambda: _read(rank_file))


def _read(rank_file: str) -> tiktoken.Encoding:
    with open(public_tokenizers.path(rank_file), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(rank_file, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text, cut at the first safe boundary after every size characters; a stretch without one stays whole."""
    start = 0
    while len(text) - start > size and (m := _SAFE.search(text, start + size)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Rows (doc_id, ids array<int>), one for each row of docs; a null or empty text has no ids. Strings of special tokens are ordinary text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoding(rank_file).encode_ordinary
        for b in small_batches(batches):
            ids = [np.array(one(t) if len(t) <= PART else [i for part in parts(t) for i in one(part)], np.int32) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids)))], ["doc_id", "ids"])

    return long_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), clean_text(F.col(text_col)).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, rank_file: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Adds decoded, the raw bytes of ids, to rows of (doc_id, ids): a cut inside a character loses nothing. No or null ids give no bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = encoding(rank_file).decode_bytes
        for b in small_batches(batches):
            text = pa.array([whole(ids or []) for ids in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text], ["doc_id", "ids", "decoded"])

    return long_rows(tokens).select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")

