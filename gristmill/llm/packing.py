"""Packing: documents into sequences of a fixed length by shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import clean_text, discard, long_rows, materialize, small_batches
from gristmill.llm.tokens import encoder

SEQUENCE = 2048
END = 1


def plan_patterns(histogram: Mapping[int, int], sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and how often each is used, for lengths below or at sequence and their counts.

    Lengths are placed longest first, each to the packs with the most room, as many at once as both counts allow. The work
    depends on the number of different lengths, not on how many documents have them. Every length is placed count times.
    """
    room: dict[int, dict[tuple[int, ...], int]] = {}
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        most = max(room, default=0)
        if most < length:
            room.setdefault(sequence - length, {})[(length,)] = left
            continue
        placed: dict[int, dict[tuple[int, ...], int]] = {}
        while left and (most := max(room, default=0)) >= length:
            pattern, n = room[most].popitem()
            if not room[most]:
                del room[most]
            used = min(n, left)
            left -= used
            longer = placed.setdefault(most - length, {})
            longer[(*pattern, length)] = longer.get((*pattern, length), 0) + used
            if n > used:
                room.setdefault(most, {})[pattern] = n - used
            # The packs just filled may have the most room again: they go back once the others have less.
            if placed and (not room or max(placed) >= max(room)):
                _merge(room, placed)
                placed = {}
        _merge(room, placed)
        if left:
            _merge(room, {sequence - length: {(length,): left}})
    return sorted(((p, n) for packs in room.values() for p, n in packs.items()), reverse=True)


def _merge(room: dict[int, dict[tuple[int, ...], int]], more: dict[int, dict[tuple[int, ...], int]]) -> None:
    for free, packs in more.items():
        into = room.setdefault(free, {})
        for pattern, n in packs.items():
            into[pattern] = into.get(pattern, 0) + n


class Slots:
    """For each length, where its documents go by rank: runs of (first rank, first sequence, offset)."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]) -> None:
        runs: dict[int, list[tuple[int, int, int]]] = {}
        ranks: dict[int, int] = {}
        self.sequences = 0
        for pattern, n in patterns:
            offset = 0
            for length in pattern:
                runs.setdefault(length, []).append((ranks.get(length, 0), self.sequences, offset))
                ranks[length] = ranks.get(length, 0) + n
                offset += length
            self.sequences += n
        self.runs = {length: tuple(zip(*r, strict=True)) for length, r in runs.items()}

    def place(self, length: int, rank: int) -> tuple[int, int]:
        """(sequence, offset) of the document with this rank among those of this length."""
        ranks, sequences, offsets = self.runs[length]
        i = bisect_right(ranks, rank) - 1
        return sequences[i] + rank - ranks[i], offsets[i]


def tokenize(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end: int, sequence: int) -> DataFrame:
    """Rows (doc_id, ids, part, rest, rank, full): ids as little-endian bytes, two or four an id; rest: the length of the piece
    that is left after the full ones; rank and full: how many of that length, and how many full pieces, the same part had before."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        last = np.array([end], words.kind).tobytes()
        part, seen, full = TaskContext.get().partitionId(), [0] * sequence, 0
        for b in small_batches(batches, 500):
            ids = [x + last for x in words.encode(b.column(1).to_pylist())]
            rows = []
            for x in ids:
                pieces, rest = divmod(len(x) // words.kind.itemsize, sequence)
                rows.append((rest, seen[rest], full))
                seen[rest] += 1
                full += pieces
            rest, rank, before = zip(*rows, strict=True)
            wide = [pa.array(x, pa.int64()) for x in ([part] * len(rows), rest, rank, before)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), *wide, pa.array([words.kind.itemsize] * len(rows), pa.int64())], ["doc_id", "ids", "part", "rest", "rank", "full", "width"])

    docs = long_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), clean_text(F.col(text_col)).alias("text"))
    return docs.mapInArrow(run, "doc_id long, ids binary, part long, rest long, rank long, full long, width long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", end: int = END, sequence: int = SEQUENCE) -> DataFrame:
    """Rows (doc_id, start, length, doc_tokens, ids, sequence_id, offset), one for each piece of a document; ids as little-endian 32-bit integers.

    A document's tokens and its end id are cut into full sequences and a rest; rests are packed by length. Only the histogram
    of lengths (sequence numbers) and the patterns reach the driver. Ranks are counted within the parts in which documents
    were tokenized and then added up over parts, so that a length that a third of all documents have is never dealt to one task. A part's row of offsets is
    joined to its documents; Spark broadcasts those rows only below its threshold and shuffles by part beyond.
    Null and empty texts are the end id alone. Repeated rows are packed as often as they occur. Very long texts are cut like others. An empty table gives no rows.
    """
    tokens = materialize(tokenize(docs, id_col, text_col, vocabulary, end, sequence), "packing-tokens")
    counted = materialize(tokens.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.length("ids") / F.col("width") / sequence)).alias("pieces")), "packing-counts")
    histogram = {r["rest"]: r["n"] for r in counted.groupBy("rest").agg(F.sum("n").alias("n")).collect() if r["rest"]}
    slots = Slots(plan_patterns(histogram, sequence))
    # One row a part: how many full pieces, and of each rest that it has, the parts before had. A part's documents look their ranks up in its row.
    parts = counted.groupBy("part").agg(F.sum("pieces").alias("pieces"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.select("part", (F.sum("pieces").over(before) - F.col("pieces")).alias("full_before"))
    same = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = counted.select("part", "rest", (F.sum("n").over(same) - F.col("n")).alias("rank_before"))
    ranks = ranks.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("rest", "rank_before"))).alias("r")).select("part", F.col("r.rest").alias("rests"), F.col("r.rank_before").alias("ranks_before"))
    offsets = materialize(ranks.join(parts, "part"), "packing-offsets")
    discard(counted)
    placed = tokens.join(offsets, "part").select(
        "doc_id", "ids", "width", "rest", (F.col("rank") + F.element_at("ranks_before", F.array_position("rests", F.col("rest")).cast("int"))).alias("rank"), (F.col("full") + F.col("full_before")).alias("full")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
        kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 2
        for b in small_batches(batches, 500):
            out: list[tuple] = []
            for doc, raw, width, rest, rank, full in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = len(raw) // width
                ids = raw if width == 4 else np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
                for i in range(n // sequence):
                    out.append((doc, i * sequence, sequence, n, ids[4 * i * sequence : 4 * (i + 1) * sequence], slots.sequences + full + i, 0))
                if rest:
                    out.append((doc, n - rest, rest, n, ids[4 * (n - rest) :], *slots.place(rest, rank)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return placed.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long")
