"""Target-distribution importance resampling over a sparse matrix of documents by hashed features.

Runs of one to three words are hashed to BUCKETS. The matrix is written as blocks in compressed sparse rows: a block's row ends,
its bucket numbers and their counts. Column sums of the blocks are the corpus' distribution; the target's is counted alike. A
bucket's gain is the logarithm of their ratio, and the product of the blocks with the gains is the documents' weight. Noise
that depends on the id alone turns the largest scores into a sample drawn by weight.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import clean_text, discard, let_go, long_rows, materialize, short_batches, small_batches

BUCKETS, LONGEST_RUN = 10_000, 3
#: Bytes that are no part of a word become spaces; A to Z become a to z; bytes of other characters stay.
_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_BLOCK = "doc_ids array<long>, words array<int>, ends array<int>, columns binary, counts binary"
#: Bytes of a row group of written blocks, and of their batches to Python. Spark's reader takes up to 4,096 rows of a group at once, and blocks are long rows.
GROUP_BYTES = 1 << 22
#: The size is looked at after each block, and nothing that is written is longer once it is read.
_WRITTEN = {
    "compression": "uncompressed",
    "parquet.enable.dictionary": "false",
    "parquet.block.size": str(GROUP_BYTES),
    "parquet.page.size.row.check.min": "1",
    "parquet.page.size.row.check.max": "1",
}


def buckets(text: str | None) -> tuple[int, np.ndarray]:
    """The number of words of a whole text, and the bucket of each of its features, repeats included."""
    words = text.encode().translate(_TABLE).split() if text else []
    # The hash of a longer run goes on from that of its beginning.
    found, spaced = list(map(crc32, words)), [b" " + w for w in words]
    runs = found
    for n in range(1, LONGEST_RUN):
        runs = list(map(crc32, spaced[n:], runs))
        found += runs
    return len(words), np.array(found, np.uint32) % BUCKETS


def _packed(numbers: np.ndarray, kind: str) -> bytes:
    return pa.compress(numbers.astype(kind).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind).astype(np.int64)


class Block:
    """Rows of the matrix: row k's entries are ends[k] to ends[k + 1] of columns and counts. Written columns are steps from the entry before in the row, both compressed."""

    def __init__(self, row: dict) -> None:
        self.ends = np.array([0, *row["ends"]], np.int64)
        self.counts = _unpacked(row["counts"], "<u4", int(self.ends[-1]))
        steps = _unpacked(row["columns"], "<u2", int(self.ends[-1]))
        total = np.concatenate([[0], np.cumsum(steps)])
        self.columns = total[1:] - np.repeat(total[self.ends[:-1]], np.diff(self.ends))

    def sums(self) -> np.ndarray:
        """Column sums."""
        return np.bincount(self.columns, self.counts, BUCKETS).astype(np.int64)

    def times(self, vector: np.ndarray) -> np.ndarray:
        """The product with a vector of whole numbers."""
        total = np.concatenate([[0], np.cumsum(self.counts * vector[self.columns])])
        return total[self.ends[1:]] - total[self.ends[:-1]]

    def row_sums(self) -> np.ndarray:
        return self.times(np.ones(BUCKETS, np.int64))


def matrix(docs: DataFrame, id_col: str | None, text_col: str = "text") -> DataFrame:
    """The matrix' blocks, at most a batch of texts each; every row of docs is a row of one block. A null text has no words. Without id_col ids are null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in small_batches(batches):
            words, columns, counts = [], [], []
            for text in b.column(1).to_pylist():
                n, found = buckets(text)
                column, count = np.unique(found, return_counts=True)
                words.append(n)
                columns.append(column.astype(np.int64))
                counts.append(count)
            ends = np.cumsum(list(map(len, columns)))
            steps = [np.diff(c, prepend=0) for c in columns]
            row = {
                "doc_ids": b.column(0).to_pylist(),
                "words": words,
                "ends": ends.tolist(),
                "columns": _packed(np.concatenate(steps), "<u2"),
                "counts": _packed(np.concatenate(counts), "<u4"),
            }
            yield pa.RecordBatch.from_pylist([row], kind)

    kind = pa.schema({"doc_ids": pa.list_(pa.int64()), "words": pa.list_(pa.int32()), "ends": pa.list_(pa.int32()), "columns": pa.binary(), "counts": pa.binary()})
    ids = F.lit(None).cast("long") if id_col is None else F.col(id_col).cast("long")
    return long_rows(docs).select(ids.alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _BLOCK)


def column_sums(blocks: DataFrame) -> np.ndarray:
    """The features of all rows by bucket: BUCKETS sums, whatever the number of blocks. A task sums its blocks before anything is shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        total = np.zeros(BUCKETS, np.int64)
        for b in small_batches(batches, 1):
            total += Block(b.to_pylist()[0]).sums()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in blocks.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket a thousand times the logarithm of its smoothed share of the target by that of the corpus, rounded down."""
    s_all, t_all = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """A thousand times a draw from the Gumbel distribution, rounded down, from the id alone; a null id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(blocks: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight, score), one for each row of the matrix."""
    sent = blocks.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in small_batches(batches, 1):
            row = b.to_pylist()[0]
            block = Block(row)
            weight = block.times(sent.value)
            score = weight + np.array([noise(i, seed) for i in row["doc_ids"]], np.int64)
            columns = [row["doc_ids"], row["words"], block.row_sums(), weight, score]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "n_words", "n_features", "weight", "score"])

    return blocks.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, order: list, ties: list) -> DataFrame:
    """rows with rank: their place from 1 in this order, rows of equal values in any; no task sorts more than a range of them.

    ties are columns that part rows of equal order values further, so that a value which many rows share is no range of its own.
    """
    # Plain names on the way to Python and back: those of rows may hold dots.
    plain = [f"_c{i}" for i in range(len(rows.columns))]
    spread = rows.repartitionByRange(*order, *ties).sortWithinPartitions(*order, *ties).toDF(*plain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            place = pa.array(np.arange(at + 1, at + len(b) + 1))
            at += len(b)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), part, np.int32)), place], [*b.schema.names, "_part", "_place"])

    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(plain, rows.schema, strict=True))
    placed = materialize(spread.mapInArrow(run, f"{fields}, _part int, _place long"), "placed")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.max("_place").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, "_part").select(*[F.col(n).alias(c) for n, c in zip(plain, rows.columns, strict=True)], (F.col("_start") + F.col("_place")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """Rows (doc_id, n_features, weight, score, rank), all long, one for each row of docs: documents drawn like target's texts.

    Of the N documents of least_words words or more the floor(percent * N / 100) with the largest scores are drawn and ranked from 1; ties go to the
    smaller id, null ids last. Others have null rank. Null and empty texts have no features and weight 0; a text of any length is counted whole, and its
    row holds at most BUCKETS entries. Repeated rows are documents of their own. Empty docs give no rows; an empty target has no features.
    Other columns of both tables are left out, whatever their names.
    """
    blocks = materialize(matrix(docs, id_col, text_col), "blocks", _WRITTEN)
    with short_batches(docs.sparkSession, GROUP_BYTES):
        gain = gains(column_sums(blocks), column_sums(matrix(target, None, text_col)))
        scored = materialize(weights(blocks, gain, seed), "scores")
    discard(blocks)
    enough = F.col("n_words") >= least_words
    # Ranks end at the last one that is drawn; what is left out stays in the result all the same.
    drawn = scored.where(enough).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranks = ranked(scored.where(enough).drop("n_words"), order, [F.monotonically_increasing_id()])
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    few = scored.where(~enough).drop("n_words").withColumn("rank", F.lit(None).cast("long"))
    return ranks.withColumn("rank", rank).unionByName(few)
