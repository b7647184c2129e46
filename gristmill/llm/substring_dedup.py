"""Substring dedup: content-defined chunks, cut where a rolling gear hash says so, are compared by digest.

A cut depends on the bytes just before it alone, so text that is inserted or removed shifts no chunk but those around it. Cuts are
at white space, and inside long stretches without any also between characters.
Runs of chunks that another document had first are repeated passages.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import clean_text, let_go, long_rows, materialize, small_batches

#: One white space in so many is a cut, so a chunk has about as many words.
WORDS_PER_CHUNK = 5
#: Where the last STRETCH bytes have no white space, one character in so many is a cut.
STRETCH, CHARS_PER_CHUNK = 32, 32
#: Bytes after which a chunk without a cut ends, which only text that repeats a few characters over and over meets.
LONGEST = 512
#: A chunk counts as so many words as it has, and at least as one for so many bytes: texts without spaces have passages too.
BYTES_PER_WORD = 16
#: Words in a run that one earlier document had, for the run to be a repeated passage. A passage of 50 words that two documents
#: share begins and ends inside chunks, so that a run holds fewer of its words.
MIN_WORDS = 20
#: The gear hash's bits: its lowest sixteen depend on the last sixteen bytes.
WINDOW = 16
GEAR = np.random.Generator(np.random.PCG64(77)).integers(0, 2**16, 256, np.uint16)
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def chunk_texts(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: its number, and its chunks' ends in bytes, ends in characters, and words up to each end.

    The texts are hashed together, with zero bytes between them, so that each is cut as if it were alone.
    """
    gap = bytes(WINDOW)
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    gear = GEAR[data]
    for step in (1, 2, 4, 8):
        wider = gear.copy()
        wider[step:] += gear[:-step] << step
        gear = wider
    space = _SPACES[data]
    spots = np.flatnonzero(space)
    cuts = spots[(gear[spots - 1] >> 4) % WORDS_PER_CHUNK == 0]
    dense = np.flatnonzero(((gear[:-1] >> 4) % CHARS_PER_CHUNK == 0) & (data[1:] & 0xC0 != 0x80)) + 1
    blank = np.flatnonzero(space | (data == 0))
    dense = dense[dense - blank[np.maximum(np.searchsorted(blank, dense) - 1, 0)] > STRETCH]
    cuts = np.union1d(cuts, dense) if len(dense) else cuts
    chars = np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)
    words = np.cumsum(~space[1:] & (space[:-1] | (data[:-1] == 0)), dtype=np.int32)
    at = WINDOW
    for n, text in enumerate(texts):
        end = at + len(text)
        ends = cuts[np.searchsorted(cuts, at + 1) : np.searchsorted(cuts, end)]
        ends = np.concatenate((ends, [end])) if text else ends[:0]
        if len(ends) and (np.diff(ends, prepend=at) > LONGEST).any():
            ends = _bounded(ends, at, data)
        first_word = words[at - 2]
        yield n, ends - at, chars[ends - 1] - chars[at - 1], words[ends - 2] - first_word
        at = end + WINDOW


def _bounded(ends: np.ndarray, start: int, data: np.ndarray) -> np.ndarray:
    """Ends with more of them where chunks are too long, never inside a character."""
    out = []
    for end in ends.tolist():
        while end - start > LONGEST:
            start += LONGEST
            while start < end and data[start] & 0xC0 == 0x80:
                start += 1
            if start < end:
                out.append(start)
        out.append(end)
        start = end
    return np.array(out)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (digest, doc_id, doc_key, start, chars, words, again), one for each chunk; again: the same document had the digest before.

    Chunks are compared without white space at their ends. doc_key tells rows apart that share an id; null texts have no chunks.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        names = ["digest", "doc_id", "doc_key", "start", "chars", "words", "again"]
        for b in small_batches(batches):
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column(2).to_pylist()]
            digests: list[int] = []
            again: list[bool] = []
            counts, starts, chars, words = [], [], [], []
            for n, ends, char_ends, word_ends in chunk_texts(texts):
                text, seen, last = texts[n], set(), 0
                for end in ends.tolist():
                    d = xxhash.xxh3_64_intdigest(text[last:end].strip())
                    digests.append(d)
                    again.append(d in seen)
                    seen.add(d)
                    last = end
                counts.append(len(ends))
                starts.append(np.concatenate(([0], char_ends[:-1])) if len(ends) else char_ends)
                chars.append(np.diff(char_ends, prepend=0))
                words.append(np.maximum(np.diff(word_ends, prepend=0), np.diff(ends, prepend=0) // BYTES_PER_WORD))
            if not digests:
                continue
            rows = pa.array(np.repeat(np.arange(len(texts)), counts))
            whole = lambda parts: pa.array(np.concatenate(parts).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(digests, np.uint64).view(np.int64)), b.column(0).take(rows), b.column(1).take(rows), whole(starts), whole(chars), whole(words), pa.array(again)], names
            )

    docs = long_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("doc_key"), clean_text(F.col(text_col)).alias("text"))
    return docs.mapInArrow(run, "digest long, doc_id long, doc_key long, start int, chars int, words int, again boolean")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, doc_key, start, end, n_words, first_doc_id): passages, in characters, that a document with a smaller id had before, or the same document further up.

    A passage is a run of neighbouring repeated chunks in which the chunks first seen in one document, first_doc_id, have min_words
    words at least. The first occurrence of a passage is no row. Rows that share an id are no repeats of each other; rows without
    an id repeat others' passages and are never named. Null, empty and short texts have no spans; very long ones are read whole; an empty table gives no rows.
    """
    found = chunks(docs, id_col, text_col)
    repeats = materialize(found.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first_doc"), "repeated-chunks")
    place = (F.shiftleft(F.col("start").cast("long"), 24) + F.shiftleft("chars", 12) + F.shiftleft("words", 1) + F.col("again").cast("int")).alias("place")
    hit = found.select("digest", "doc_id", "doc_key", place).join(repeats, "digest")
    hit = hit.where("place % 2 = 1 OR NOT first_doc <=> doc_id")
    per_doc = hit.groupBy("doc_id", "doc_key").agg(F.collect_list(F.struct("place", "first_doc")).alias("found"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            out = []
            for doc, key, rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out += [(doc, key, *span) for span in _runs(sorted({(r["place"] >> 1, r["first_doc"]) for r in rows}, key=lambda r: r[0]), min_words)]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "doc_key", "start", "end", "n_words", "first_doc_id"])

    return per_doc.mapInArrow(run, "doc_id long, doc_key long, start int, end int, n_words int, first_doc_id long")


def _runs(rows: list[tuple[int, int | None]], min_words: int) -> Iterator[tuple[int, int, int, int | None]]:
    """(start, end, words, source) of each run of neighbouring chunks that one source has min_words words of; rows by place."""
    start = end = 0
    words: dict[int | None, int] = {}

    def best() -> tuple[int, int, int, int | None] | None:
        if not words:
            return None
        source = max(words, key=lambda s: (words[s], -(s or 0)))
        return (start, end, sum(words.values()), source) if words[source] >= min_words else None

    for place, source in rows:
        at, chars, n = place >> 23, place >> 11 & 0xFFF, place & 0x7FF
        if at != end or not words:
            if (span := best()) is not None:
                yield span
            start, words = at, {}
        end = at + chars
        words[source] = words.get(source, 0) + n
    if (span := best()) is not None:
        yield span


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs, columns and rows alike, with repeated passages cut out of text_col; other columns are left as they are. Null texts stay null."""
    spans = repeated_spans(docs, id_col, text_col, min_words)
    cuts = materialize(spans.groupBy("doc_id", "doc_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts")), "repeated-spans")
    text = F.col(f"`{text_col}`")
    keyed = docs.withColumn("__doc_key", F.xxhash64(text))
    cuts = cuts.select(F.col("doc_id").alias("__doc_id"), F.col("doc_key").alias("__doc_key2"), F.col("cuts").alias("__cuts"))
    joined = keyed.join(cuts, (keyed["__doc_key"] == cuts["__doc_key2"]) & keyed[f"`{id_col}`"].cast("long").eqNullSafe(cuts["__doc_id"]), "left")
    # The kept parts lie between one cut's end and the next one's start.
    ends = F.concat(F.array(F.lit(0)), F.col("__cuts.end"))
    starts = F.concat(F.col("__cuts.start"), F.array(F.length(text)))
    kept = F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(text, a + 1, b - a)), "")
    return joined.select([F.when(F.col("__cuts").isNull(), text).otherwise(kept).alias(c) if c == text_col else keyed[f"`{c}`"] for c in docs.columns])
