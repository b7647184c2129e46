"""A binary file of token ids whose document boundaries are Elias-Fano encoded.

A file holds consecutive documents by ascending id: a header, the ids of the documents and the ends of their token runs as two
Elias-Fano sequences, then all token ids, two bytes each where the vocabulary allows. Everything is little-endian.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.common import clean_text, fresh_path, in_key_order, long_rows, materialize, partitions_of, small_batches
from gristmill.llm.tokens import encoder

MAGIC = b"GMEF0001"
#: magic, bytes a token id, documents, documents without an id, tokens, first document id, bytes of the two sequences
HEADER = struct.Struct("<8sIIIQqII")
#: Every so many documents, the place of its bit in the upper half is kept.
STRIDE = 256
#: Bytes of text that a task writes, about, and tokens after which a new file begins.
PARTITION_BYTES = 64 << 20
FILE_TOKENS = 4_000_000
#: Documents whose boundaries are decoded at once.
WINDOW = 1000
END = 1


@dataclass
class EliasFano:
    """An ascending sequence below a bound: about two bits and the logarithm of bound / length for each value."""

    length: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    marks: np.ndarray

    @classmethod
    def of(cls, values: Sequence[int] | np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        low = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        return cls(n, bits, np.packbits(low, bitorder="little"), np.packbits(high, bitorder="little"), places[::STRIDE].astype("<u4"))

    def select(self, i: int) -> int:
        """Value i, found from the nearest mark before it."""
        if not 0 <= i < self.length:
            raise IndexError(i)
        return int(self.window(i, i + 1)[0])

    def window(self, a: int, b: int) -> np.ndarray:
        """Values a to b - 1. Of the upper half, only the bytes between the marks around them are looked at."""
        a, b = max(0, a), min(b, self.length)
        if a >= b:
            return np.zeros(0, np.uint64)
        first = int(self.marks[a // STRIDE]) // 8
        next_mark = -(-b // STRIDE)
        last = int(self.marks[next_mark]) // 8 + 1 if next_mark < len(self.marks) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[first:last], bitorder="little")) + 8 * first
        skip = int(np.searchsorted(ones, int(self.marks[a // STRIDE]))) + a % STRIDE
        upper = (ones[skip : skip + b - a] - np.arange(a, b)).astype(np.uint64)
        start = a * self.low_bits // 8
        bits = np.unpackbits(self.low[start : -(-b * self.low_bits // 8)], bitorder="little")[a * self.low_bits - 8 * start :][: (b - a) * self.low_bits]
        low = (bits.reshape(b - a, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (upper << np.uint64(self.low_bits)) + low

    def pack(self) -> bytes:
        return struct.pack("<IIII", self.length, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.marks.tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> EliasFano:
        n, bits, low, high = struct.unpack_from("<IIII", raw)
        return cls(n, bits, np.frombuffer(raw, np.uint8, low, 16), np.frombuffer(raw, np.uint8, high, 16 + low), np.frombuffer(raw, "<u4", -(-n // STRIDE), 16 + low + high))


def pack_file(doc_ids: Sequence[int | None], runs: Sequence[bytes], width: int) -> bytes:
    """A file's bytes: documents by ascending id, those without an id first; runs are their token ids of width bytes each."""
    unnamed = sum(x is None for x in doc_ids)
    first = doc_ids[unnamed] if unnamed < len(doc_ids) else 0
    ids = EliasFano.of([x - first for x in doc_ids[unnamed:]]).pack()
    ends = EliasFano.of(np.cumsum([len(r) // width for r in runs])).pack()
    head = HEADER.pack(MAGIC, width, len(runs), unnamed, sum(map(len, runs)) // width, first, len(ids), len(ends))
    return b"".join([head, ids, ends, *runs])


class TokenFile:
    """Reads a file's bytes: a document's tokens by its place, without decoding the boundaries of others."""

    def __init__(self, raw: bytes) -> None:
        magic, self.width, self.n_docs, self.unnamed, self.n_tokens, self.first, ids, ends = HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEADER.size
        self.ids, self.ends = EliasFano.unpack(raw[at : at + ids]), EliasFano.unpack(raw[at + ids : at + ids + ends])
        self.tokens = np.frombuffer(raw, f"<u{self.width}", self.n_tokens, at + ids + ends)

    def document(self, i: int) -> np.ndarray:
        """Document i's tokens."""
        return self.tokens[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def offsets(self, a: int, b: int) -> np.ndarray:
        """The token offsets at which documents a to b - 1 begin and, last, at which the last of them ends."""
        ends = self.ends.window(a - 1, b).astype(np.int64)
        return ends if a else np.concatenate(([0], ends))

    def doc_ids(self, a: int, b: int) -> list[int | None]:
        """The ids of documents a to b - 1."""
        named = self.ids.window(a - self.unnamed, b - self.unnamed).tolist()
        return [None] * (min(b, self.n_docs) - a - len(named)) + [self.first + x for x in named]


def write_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", end: int = END) -> DataFrame:
    """Writes all documents' token ids, each with the end id, to files under path; returns rows (file, n_docs, n_tokens).

    Files are named so that their order is the order of document ids (nulls first; equal ids by text). Null texts
    count as empty; very long ones are one document like others. A file is written beside its name and then moved, so a task that
    runs again leaves the same files.
    """
    docs = long_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), clean_text(F.col(text_col)).alias("text"))
    tasks = max(partitions_of(docs, "text", PARTITION_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = in_key_order(docs, tasks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        width = words.kind.itemsize
        last = np.array([end], words.kind).tobytes()
        store, folder = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        store.create_dir(folder, recursive=True)
        part, number, ids, runs, size, done = TaskContext.get().partitionId(), 0, [], [], 0, []

        def close() -> None:
            nonlocal number, ids, runs, size
            if ids:
                name = f"part-{part:08d}-{number:06d}.gmef"
                raw = pack_file(ids, runs, width)
                beside = f"{folder}/_{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(beside) as out:
                    out.write(raw)
                store.move(beside, f"{folder}/{name}")
                done.append((name, len(ids), size // width))
            number, ids, runs, size = number + 1, [], [], 0

        for b in small_batches(batches, 500):
            for doc, tokens in zip(b.column(0).to_pylist(), words.encode(b.column(1).to_pylist()), strict=True):
                if size >= FILE_TOKENS * width:
                    close()
                ids.append(doc)
                runs.append(tokens + last)
                size += len(tokens) + width
        close()
        if done:
            names, n_docs, n_tokens = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n_docs, pa.int64()), pa.array(n_tokens, pa.int64())], ["file", "n_docs", "n_tokens"])

    return materialize(dealt.mapInArrow(run, "file string, n_docs long, n_tokens long"), "token-files")


def read_files(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) from files under path: ids as little-endian 32-bit integers, start counts the tokens of all documents before.

    files: the rows of write_files. Boundaries are selected for WINDOW documents at a time. Only the number of tokens a file
    holds is summed over files, in one window of a row a file.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = TokenFile(raw)
                for k in range(0, f.n_docs, WINDOW):
                    at = f.offsets(k, k + WINDOW)
                    ids = pa.array(f.doc_ids(k, k + WINDOW), pa.int64())
                    tokens = [f.tokens[x:y].astype("<u4").tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    columns = [pa.array([name] * len(ids)), ids, pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(tokens, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["file", "doc_id", "local", "n_tokens", "ids"])

    base = files.select("file", (F.sum("n_tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")).alias("base"))
    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.gmef").schema("path string, modificationTime timestamp, length long, content binary")
    named = content.load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    rows = named.mapInArrow(run, "file string, doc_id long, local long, n_tokens long, ids binary")
    return rows.join(base, "file").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids")


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", end: int = END) -> DataFrame:
    """Writes docs as token files in the shared folder and reads them back. An empty table gives no files and no rows."""
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    files = write_files(docs, path, id_col, text_col, vocabulary, end)
    if not files.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    return read_files(spark, path, files)
