"""Document fingerprints by consistent weighted sampling.

A text's terms are its words, weighted by how often they occur. For each of SAMPLES places, two gamma variables and a uniform
shift belong to each term; the term with the least value and its quantised weight are the sample. Two texts have the same sample
with the probability of their generalised Jaccard similarity: sum of least weights by sum of largest. The variables of a term are
drawn from a counter-based hash of the term's 64-bit hash and the place, so that there is no vocabulary and no two terms share any.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import clean_text, held, in_key_order, long_rows, materialize, partitions_of, small_batches

#: Samples in a fingerprint and hex digits for each.
SAMPLES = 64
DIGITS = 4
SEED = 20_240_229
#: A word counts as its stretches of so many characters, or whole if it has no more, so that texts without spaces have many terms too.
STRETCH = 12
#: Terms whose variables a worker remembers, a kilobyte each; the memory starts anew when it is full.
REMEMBERED = 131_072
#: Bytes of text that a task goes through, about.
PARTITION_BYTES = 64 << 20

_PLACES = (np.arange(SAMPLES, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits (the finaliser of a splittable generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def variables(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each term's hash and place: a gamma variable, a uniform shift and the logarithm of a second gamma variable."""
    counter = terms[:, None] + _PLACES[None, :]
    uniform = []
    for k in range(3):
        drawn = _mixed(counter + np.uint64((k + 1) * 0xD1342543DE82EF95 % 2**64))
        # Twenty-three bits and a half: exact in single precision, never 0 or 1.
        uniform += [(half.astype(np.float32) + np.float32(0.5)) * np.float32(2**-23) for half in (drawn >> np.uint64(41), drawn & np.uint64(0x7FFFFF))]
    r = -np.log(uniform[0] * uniform[1])
    log_c = np.log(-np.log(uniform[2] * uniform[3]))
    return r, uniform[4], log_c


class Sampler:
    """Fingerprints of texts; the variables of terms are remembered."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.hashes = np.zeros(REMEMBERED, np.uint64)
        self.r, self.beta, self.log_c, self.single = (np.zeros((REMEMBERED, SAMPLES), np.float32) for _ in range(4))

    def _learn(self, new: list[str]) -> None:
        at = len(self.known)
        for i in range(0, len(new), 2048):
            some = new[i : i + 2048]
            here = slice(at + i, at + i + len(some))
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"), SEED) for t in some), np.uint64, len(some))
            r, beta, log_c = variables(hashes)
            self.hashes[here], self.r[here], self.beta[here], self.log_c[here] = hashes, r, beta, log_c
            # A term that occurs once: its weight's logarithm is 0, and its step floor(beta) = 0.
            self.single[here] = log_c + r * beta - r
        self.known.update(zip(new, range(at, at + len(new)), strict=True))

    def fingerprint(self, text: str) -> str:
        """SAMPLES samples of DIGITS hex digits each; equal texts have equal fingerprints. A text without words has the empty string."""
        weights = term_weights(text)
        if not weights:
            return ""
        least, found, step = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.int64)
        items = sorted(weights.items()) if len(weights) > 8192 else list(weights.items())
        for i in range(0, len(items), 8192):
            self._sample(dict(items[i : i + 8192]), least, found, step)
        mixed = _mixed(found + step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 4 * DIGITS)
        return "".join(f"{x:0{DIGITS}x}" for x in mixed.tolist())

    def _sample(self, weights: dict[str, int], least: np.ndarray, found: np.ndarray, step: np.ndarray) -> None:
        """Lowers least, and sets the terms and steps that did, by some of a text's terms."""
        new = [t for t in weights if t not in self.known]
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = list(weights)
            self._learn(new)
        rows = np.fromiter(map(self.known.__getitem__, weights), np.int64, len(weights))
        counts = np.fromiter(weights.values(), np.int64, len(weights))
        places = np.arange(SAMPLES)
        once = rows[counts == 1]
        if len(once):
            self._lower(once, self.single[once], np.zeros((1, SAMPLES), np.int64), least, found, step, places)
        more = rows[counts > 1]
        if len(more):
            r, beta = self.r[more], self.beta[more]
            steps = np.floor(np.log(counts[counts > 1].astype(np.float32))[:, None] / r + beta)
            self._lower(more, self.log_c[more] - r * (steps - beta) - r, steps, least, found, step, places)

    def _lower(self, rows: np.ndarray, values: np.ndarray, steps: np.ndarray, least: np.ndarray, found: np.ndarray, step: np.ndarray, places: np.ndarray) -> None:
        at = values.argmin(axis=0)
        lowest = values[at, places]
        hashes = self.hashes[rows[at]]
        better = (lowest < least) | (lowest == least) & (hashes < found)
        least[better], found[better] = lowest[better], hashes[better]
        step[better] = steps[at if len(steps) > 1 else np.zeros(SAMPLES, np.int64), places][better].astype(np.int64)


def sampler() -> Sampler:
    """The worker's sampler."""
    return held("sampler", Sampler)


def term_weights(text: str) -> dict[str, int]:
    """How often each term occurs."""
    weights: dict[str, int] = {}
    for word, n in Counter(text.split()).items():
        if len(word) <= STRETCH:
            weights[word] = weights.get(word, 0) + n
            continue
        for i in range(len(word) - STRETCH + 1):
            piece = word[i : i + STRETCH]
            weights[piece] = weights.get(piece, 0) + n
    return weights


def fingerprint(text: str) -> str:
    """The fingerprint of a text."""
    return sampler().fingerprint(text)


def likeness(a: str, b: str) -> float:
    """The share of equal samples, an estimate of the generalised Jaccard similarity. Two texts without words are alike, one of them is like no other."""
    if not a or not b:
        return float(a == b)
    return sum(a[i : i + DIGITS] == b[i : i + DIGITS] for i in range(0, len(a), DIGITS)) / (len(a) // DIGITS)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first code points of the following one (or all that it has)."""
    cut = len(text) // 2
    return text[: len(text) - cut] + following[:cut]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [c.split()[0] for c in RESULT.split(", ")]
KINDS = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2


def _compared(doc: int | None, text: str, print_of_text: str, following: str, print_of_following: str) -> tuple:
    new = edited(text, following)
    e = fingerprint(new)
    return (doc, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), print_of_text, e, likeness(print_of_text, e), likeness(print_of_text, print_of_following))


def fingerprints_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one for each row of docs.

    Documents are dealt by ranges of ids, and each task goes through its range in order, holding one document besides the batch.
    Only the last document of a range lacks its next one: it waits beside the range's first, one row of texts for each task, and
    those few rows are joined afterwards. Nulls of the id come first, equal ids are in the order of their texts; null texts count
    as empty; very long texts are read whole. After the last document comes the first, so a lone one follows itself.
    """
    docs = long_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), clean_text(F.col(text_col)).alias("text"))
    tasks = max(partitions_of(docs, "text", PARTITION_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = [*NAMES, "part", "first_text", "last_text"]
    kinds = [*KINDS, pa.int64(), pa.string(), pa.string()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: str | None = None
        held: tuple | None = None
        for b in small_batches(batches, 500):
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                first = text if first is None else first
                at = held[2] if held and held[1] == text else fingerprint(text)
                if held:
                    out.append((*_compared(*held, text, at), None, None, None))
                held = (doc, text, at)
            if out:
                yield table(out)
        if held:
            yield table([(held[0], None, None, held[2], None, None, None, TaskContext.get().partitionId(), first, held[1])])

    found = materialize(in_key_order(docs, tasks).mapInArrow(run, f"{RESULT}, part long, first_text string, last_text string"), "fingerprints")
    ends = found.where("part IS NOT NULL")
    # One number a task: which range comes after, the first one after the last.
    order = ends.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    firsts = ends.select(F.col("part").alias("after"), F.col("first_text").alias("following"))
    joined = ends.select("part", "doc_id", "last_text", "fingerprint").join(order, "part").join(firsts, "after").select("doc_id", "last_text", "fingerprint", "following")

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 64):
            rows = [_compared(doc, text, at, following, fingerprint(following)) for doc, text, at, following in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)

    return found.where("part IS NULL").select(NAMES).unionByName(joined.mapInArrow(finish, RESULT))
