"""SimHash near-dedup: 64-bit fingerprints, linked by BK-trees over shards of fingerprints that may be near each other."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import connected_components, long_rows, materialize, small_batches

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
RADIUS = 2
#: Fingerprints are cut into four blocks of 16 bits. Two that differ in at most two bits agree in at least two blocks, so they share one of six shards.
BLOCKS = tuple(itertools.combinations(range(4), 2))
#: A shard with more fingerprints is cut into chunks of about this many; each pair of chunks is a task's unit of work.
CHUNK = 2048


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The XXH64 (seed 42) of each of a text's shingles, repeats included, as unsigned longs; none without words.

    A-Z are lower-cased. Shingles are words joined by single spaces; a text of fewer words is one shingle.
    """
    found = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not found:
        return np.zeros(0, "<u8")
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(found))
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(line[a:b], 42) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), "<u8", len(found) - k + 1)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The unsigned 64-bit number in which a bit is set if it is set in over half the hashes; zero without any."""
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        bits += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: str | None, words: int = 3) -> int:
    """The fingerprint of a text."""
    return fingerprint_of(shingle_hashes(text, words))


class BKTree:
    """Fingerprints by Hamming distance: a node's children are keyed by their distance to it, so a search follows only edges within the radius."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while d := (node[0] ^ value).bit_count():
            if d not in node[1]:
                node[1][d] = [value, {}]
                return
            node = node[1][d]

    def near(self, value: int, radius: int) -> list[int]:
        """All members within radius of value."""
        found, stack = [], [self.root] if self.root else []
        while stack:
            kept, children = stack.pop()
            d = (kept ^ value).bit_count()
            if d <= radius:
                found.append(kept)
            if children:
                stack += [children[e] for e in range(d - radius, d + radius + 1) if e in children]
        return found


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Rows (doc_id, fp): fp is the fingerprint's bits as a signed long. One row for each row of docs; null texts count as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            fp = np.array([simhash(t, words) for t in b.column(1).to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return long_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def near_edges(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of fps.fp that join the same groups as all links within radius (2 at most) would.

    Every shard's chunk gives one BK-tree, which the chunks of the same shard are searched in. Within a unit of work, only
    edges that join two groups are kept, one a fingerprint at most. A shard of one fingerprint is no work; no shard is capped.
    """
    if radius > 2:
        raise ValueError("four blocks find fingerprints that differ in two bits at most")
    keys = F.array(
        *[
            F.struct(F.lit(n).alias("f"), (F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) * 65536 + F.shiftrightunsigned("fp", 16 * j).bitwiseAND(0xFFFF)).alias("v"))
            for n, (i, j) in enumerate(BLOCKS)
        ]
    )
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.f", "k.v")
    sizes = materialize(keyed.groupBy("f", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shards")
    parts = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    keyed = keyed.join(sizes, ["f", "v"]).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    # A chunk meets itself and every other chunk of its shard once: as the tree where it has the smaller number, else as the queries.
    units = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = units.select("f", "v", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") <= F.col("other")).alias("tree"), "fp")
    units = units.groupBy("f", "v", "i", "j").agg(F.collect_list(F.when(F.col("tree"), F.col("fp"))).alias("tree"), F.collect_list(F.when(~F.col("tree"), F.col("fp"))).alias("queries"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 64):
            out: list[tuple[int, int]] = []
            for members, queries in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out += _joins([x & (2**64 - 1) for x in members], [x & (2**64 - 1) for x in queries], radius)
            found = np.array(out, "<u8").reshape(-1, 2).view("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])

    return units.select("tree", "queries").mapInArrow(run, "a long, b long")


def _joins(members: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges that join what the tree over members finds for members (without queries) or for queries."""
    up = {x: x for x in itertools.chain(members, queries)}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    tree, out = BKTree(), []
    if queries:
        for x in members:
            tree.add(x)
    for x in queries or members:
        for y in tree.near(x, radius):
            a, b = top(x), top(y)
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((x, y))
        if not queries:
            tree.add(x)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each row of docs: component_id is the smallest id among documents whose fingerprints are linked.

    Null and empty texts have fingerprint zero and are linked like others. Rows without an id get their group's component and never name one
    (null if no row of the group has an id). Repeated ids stay as they are. An empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    first = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    edges = near_edges(first.select("fp"), radius)
    roots = connected_components(first.select(F.col("fp").alias("node")), edges)
    named = first.join(roots, first["fp"] == roots["node"]).select("fp", "root", "first_id")
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = materialize(named.join(ids, "root").select("fp", "component_id"), "classes")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """docs without the documents whose group has one with a smaller id; columns as they are. Rows that share an id stay or go together; those without one go where a named one stays."""
    classes = near_duplicates(docs, id_col, text_col, words, radius)
    gone = materialize(classes.where("NOT doc_id <=> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "near-duplicates")
    return docs.join(gone, docs[f"`{id_col}`"].cast("long").eqNullSafe(gone["__gone"]), "left_anti")
