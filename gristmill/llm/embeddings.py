"""Embedding near-dedup by a forest of random-projection trees with spill overlap; pairs within leaves are verified and joined.

A round grows each open node by LEVELS levels at once. Its splits are fitted by a task on a bounded sample of the node's own
vectors, and all its vectors go down them; leaves that the sample was too small to judge are the next round's open nodes. So the
depth that is reached depends on a node's size alone, no vector or split passes the driver, and the sample bounds no result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import connected_components, discard, let_go, materialize, small_batches

COSINE = 0.93
TREES = 5
#: A node with more vectors is split; this share of it on either side of its median goes both ways.
LEAF = 256
SPILL = 0.05
#: Vectors of a node, about, that its splits are fitted on, the levels of splits of a round, and the fewest vectors of a sample that a split is fitted on.
SAMPLE, LEVELS, LEAST = 4096, 5, 64
#: A node in whose sample so large a share of pairs is linked is a leaf whatever its size: no split of it would keep its links.
DENSE = 0.2
#: Leaves are compared in pairs of chunks of so many vectors.
CHUNK = 1024
#: Places of a round's tree, as in a heap from 1 on, and what is at a place: nothing, a split, a leaf, or a node to be split later.
PLACES = 2 ** (LEVELS + 1)
ABSENT, SPLIT, CLOSED, OPEN = range(4)


def _id(root: int, place: int) -> int:
    return root if place == 1 else xxhash.xxh3_64_intdigest(f"{root} {place}".encode()) & (2**63 - 1)


class Directions:
    """The random projections of a root's places; those last used are remembered."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, int], np.ndarray] = {}

    def of(self, root: int, size: int) -> np.ndarray:
        """A matrix with a column for each place that can be a split."""
        if (root, size) not in self.known:
            if len(self.known) * size > 50_000:
                self.known.clear()
            draw = np.random.Generator(np.random.PCG64(root))
            self.known[root, size] = draw.standard_normal((PLACES // 2, size)).astype(np.float32).T
        return self.known[root, size]


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Equally long vectors as rows, scaled to unit length."""
    rows = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _is_dense(v: np.ndarray, cosine: float) -> bool:
    some = v[np.linspace(0, len(v) - 1, min(len(v), 200)).astype(int)]
    return (some @ some.T >= cosine).sum() - len(some) > DENSE * len(some) * (len(some) - 1)


def fit(root: int, v: np.ndarray, size: int, cosine: float, directions: Directions | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A root's tree from a sample of its size unit vectors: what is at each place, and of splits the upper bound of the left side and the lower bound of the right one."""
    along = v.astype(np.float32) @ (directions or Directions()).of(root, v.shape[1])
    kind = np.zeros(PLACES, np.int8)
    high, low = np.zeros(PLACES // 2, np.float32), np.zeros(PLACES // 2, np.float32)
    scale = max(1.0, size / len(v))
    members = {1: np.arange(len(v))}
    for place in range(1, PLACES):
        rows = members.pop(place, None)
        if rows is None:
            continue
        if len(rows) * scale <= LEAF or _is_dense(v[rows], cosine):
            kind[place] = CLOSED
        elif place >= PLACES // 2 or scale > 1 and len(rows) < LEAST:
            kind[place] = OPEN
        else:
            p = along[rows, place]
            low[place], high[place] = np.quantile(p, [0.5 - SPILL, 0.5 + SPILL])
            sides = rows[p <= high[place]], rows[p >= low[place]]
            if min(map(len, sides)) in (0, len(rows)) or max(map(len, sides)) == len(rows):
                kind[place] = CLOSED
                continue
            kind[place] = SPLIT
            members[2 * place], members[2 * place + 1] = sides
    return kind, high, low


def descend(root: int, v: np.ndarray, kind: np.ndarray, high: np.ndarray, low: np.ndarray, directions: Directions) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every leaf and open node that each of a root's unit vectors comes to; one at least."""
    along = v.astype(np.float32) @ directions.of(root, v.shape[1])
    inside = np.zeros((len(v), PLACES), bool)
    inside[:, 1] = True
    for level in range(LEVELS):
        at = slice(2**level, 2 ** (level + 1))
        here = inside[:, at] & (kind[at] == SPLIT)
        below = inside[:, 2 ** (level + 1) : 2 ** (level + 2)]
        below[:, 0::2] = here & (along[:, at] <= high[at])
        below[:, 1::2] = here & (along[:, at] >= low[at])
    return np.nonzero(inside & (kind != SPLIT))


def _grow(at: DataFrame, counts: DataFrame, cosine: float) -> DataFrame:
    """One round: rows (rep, node, v), v null where the node is a leaf, from the vectors (rep, node, v) of open nodes and their sizes (node, n)."""
    known = at.join(counts, "node")
    picked = F.pmod(F.xxhash64("rep", "node"), F.lit(1_000_000)) < F.lit(1_000_000.0 * SAMPLE) / F.col("n")
    samples = known.where(picked).groupBy("node").agg(F.first("n").alias("n"), F.collect_list("v").alias("sample"))

    def fitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in small_batches(batches, 1):
            root = b.column(0)[0].as_py()
            kind, high, low = fit(root, _matrix(b.column(2)[0].values), b.column(1)[0].as_py(), cosine)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([kind.tobytes() + high.tobytes() + low.tobytes()], pa.binary())], ["node", "tree"])

    trees = materialize(samples.mapInArrow(fitted, "node long, tree binary"), "trees")

    def down(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        directions = Directions()
        for b in batches:
            rep, v, nodes, trees = b.columns
            roots = nodes.to_numpy()
            order = np.argsort(roots, kind="stable")
            starts = np.flatnonzero(np.concatenate(([True], np.diff(roots[order]) != 0)))
            for rows in np.split(order, starts[1:]):
                root, tree = int(roots[rows[0]]), trees[int(rows[0])].as_py()
                kind = np.frombuffer(tree, np.int8, PLACES)
                high, low = np.frombuffer(tree, np.float32, PLACES, PLACES).reshape(2, -1)
                found = v.take(pa.array(rows))
                row, place = descend(root, _matrix(found), kind, high, low, directions)
                ids = np.array([_id(root, k) for k in range(PLACES)])
                kept = pa.array(row, mask=kind[place] != OPEN)
                yield pa.RecordBatch.from_arrays([rep.take(pa.array(rows[row])), pa.array(ids[place]), found.take(kept)], ["rep", "node", "v"])

    rows = at.join(trees, "node").select("rep", "v", "node", "tree")
    after = materialize(rows.mapInArrow(down, at.select("rep", "node", "v").schema), "nodes")
    discard(trees)
    return after


def leaves(classes: DataFrame, cosine: float) -> DataFrame:
    """Rows (rep, node): the leaves that each vector of (rep, label, v) is in. All vectors of a label and length are one leaf, or the root of TREES trees where they are too many."""
    group = F.xxhash64("label", F.size("v"))
    rows = classes.select("rep", "v", group.alias("group"))
    sizes = materialize(rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "label-sizes")
    rows = rows.join(sizes, "group")
    positive = lambda x: x.bitwiseAND(2**63 - 1)
    placed = rows.where(F.col("n") <= LEAF).select("rep", positive(F.col("group")).alias("node"))
    roots = F.transform(F.sequence(F.lit(1), F.lit(TREES)), lambda t: positive(F.xxhash64("group", t)))
    at = rows.where(F.col("n") > LEAF).select("rep", F.explode(roots).alias("node"), "v")
    counts = sizes.where(F.col("n") > LEAF).select(F.explode(roots).alias("node"), "n")
    while counts.limit(1).count():
        found = _grow(at, counts, cosine)
        placed = placed.unionByName(found.where("v IS NULL").select("rep", "node"))
        at = found.where("v IS NOT NULL")
        counts = materialize(at.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "open-nodes")
    return placed


def links(classes: DataFrame, placed: DataFrame, cosine: float) -> DataFrame:
    """Rows (rep, links, joined) from vectors (rep, v, n) and their leaves: how many vectors each is linked to, copies counted, and a vector of its group in the leaf.

    A pair that shares several leaves counts in the one with the smallest id, so that no pair has to be sent anywhere.
    """
    placed = materialize(placed, "leaves")
    sizes = materialize(placed.groupBy("node").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "leaf-sizes")
    nodes = placed.groupBy("rep").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    at = classes.select("rep", "v", "n").join(nodes, "rep").withColumn("node", F.explode("nodes"))
    at = at.join(sizes, "node").withColumn("parts", F.ceil(F.col("m") / F.lit(CHUNK)).cast("int")).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    units = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = units.select("node", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "v", "n", "nodes")
    units = units.groupBy("node", "i", "j").agg(F.collect_list(F.struct("part", "rep", "v", "n", "nodes")).alias("rows"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in small_batches(batches, 4):
            out = []
            for k in range(len(b)):
                first, second = b.column(1)[k].as_py(), b.column(2)[k].as_py()
                out.append(_compare(b.column(0)[k].as_py(), first == second, first, b.column(3)[k].values, cosine))
            columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["rep", "links", "joined"])

    return units.mapInArrow(run, "rep long, links long, joined long")


def _compare(node: int, own: bool, first: int, found: pa.StructArray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rep, links, joined) for a leaf's vectors (own), or between two of its chunks."""
    part, rep, n = (found.field(k).to_numpy(zero_copy_only=False) for k in ("part", "rep", "n"))
    unit = _matrix(found.field("v"))
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    if not own:
        near &= (part[:, None] == first) ^ (part[None, :] == first)
    lists = found.field("nodes")
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    padded = np.full((len(rep), lengths.max()), -1, np.int64)
    padded[np.arange(padded.shape[1])[None, :] < lengths[:, None]] = lists.flatten().to_numpy()
    count = np.zeros(len(rep), np.int64)
    p, q = np.nonzero(np.triu(near))
    for k in range(0, len(p), 20_000):
        a, b = p[k : k + 20_000], q[k : k + 20_000]
        left = padded[a]
        shared = (left[:, :, None] == padded[b][:, None, :]).any(axis=2) & (left >= 0)
        here = np.where(shared, left, np.iinfo(np.int64).max).min(axis=1) == node
        np.add.at(count, a[here], n[b[here]])
        np.add.at(count, b[here], n[a[here]])
    group = np.arange(len(rep))
    while True:
        least = np.minimum(group, np.where(near, group[None, :], len(rep)).min(axis=1, initial=len(rep)))
        least = least[least]
        if (least == group).all():
            break
        group = least
    linked = near.any(axis=1)
    return rep[linked], count[linked], rep[group[linked]]


def _digest(label: Column, v: Column) -> list[Column]:
    """128 bits that tell vectors and their labels apart."""
    return [F.xxhash64(label, v).alias("h"), F.xxhash64(F.lit("second"), v, label).alias("h2")]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of vectors.

    Vectors with equal, non-null labels and equal lengths are linked at a cosine of at least cosine. Vectors that are null, empty or zero, or
    hold null or non-finite numbers, link with nothing. Equal vectors of a label are compared as one and counted as many.
    component_id is the smallest id reachable over links; a row without an id never names a component, and is kept. Other
    columns are not read. An empty table gives no rows.
    """
    kept = vectors.schema[vector_col].dataType.simpleString()
    v = F.col(f"`{vector_col}`").cast(kept if kept in ("array<float>", "array<double>") else "array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"), F.col(f"`{label_col}`").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", "v", "label", valid.alias("valid"), *_digest(F.col("label"), F.col("v")))
    classes = rows.where("valid").groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    found = materialize(links(classes, leaves(classes, cosine), cosine), "vector-links")
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = connected_components(classes.select(F.col("rep").alias("node")), found.select(F.col("rep").alias("a"), F.col("joined").alias("b")))
    named = classes.select("h", "h2", "rep", "n", "first_id").join(roots.withColumnRenamed("node", "rep"), "rep").join(totals, "rep", "left")
    named = materialize(named.select("h", "h2", "root", "first_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "vector-totals")
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    hit = rows.where("valid").select("vec_id", "h", "h2").join(named.join(ids, "root"), ["h", "h2"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("NOT valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return hit.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
