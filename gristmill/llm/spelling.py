"""Spelling variants: words at a distance of one edit, met by Levenshtein automata in tries.

The words are sorted and cut into shards; a shard is a compact trie of five bytes a node and four a word's end. Groups of
shards are broadcast, one after the other, and each word's distance-one automaton walks every shard depth-first. Words are
walked in order, so that words that begin alike share their states. What a shard accepts is reduced to a count and a best form.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import discard, let_go, materialize, small_batches

#: What a word is made of; each code point is a byte of Latin-1, so tries hold bytes.
WORD = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Letters of a shard's words at most (a longer word is a shard of its own), and bytes of shards that are broadcast together.
SHARD_LETTERS, GROUP_BYTES = 1 << 20, 32 << 20
#: Rows of a batch of words; they are sorted in it.
ROWS = 20_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", misspell: int = 97) -> DataFrame:
    """Rows (word, n): the words of whole texts, lower-cased in A-Z only, of LEAST_LENGTH letters and LEAST_COUNT occurrences at least.

    An occurrence whose CRC-32 of `<id>:<word>` misspell divides loses the code point at that number modulo its length; misspell 0 changes nothing.
    A null text has no words; a null id counts as an empty one. Counts are summed before they are shuffled, so a frequent word costs no more than others.
    """
    lowered = F.translate(text_col, _UPPER, _LOWER)
    words = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(f"({WORD})"), 1)).alias("word"))
    words = words.where(F.length("word") >= LEAST_LENGTH)
    if misspell:
        h = F.crc32(F.concat_ws(":", "id", "word").cast("binary"))
        at = F.pmod(F.col("h"), F.length("word")).cast("int")
        dropped = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = words.select("word", h.alias("h")).select(F.when(F.col("h") % misspell == 0, dropped).otherwise(F.col("word")).alias("word"))
        words = words.where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Trie:
    """A shard: nodes level by level, a node's children side by side and sorted by letter.

    labels holds a letter a node; the children of node k are first[k] to first[k + 1]; word[k] is one more than the number of the word that ends in k, or 0.
    """

    def __init__(self, labels: bytes, first: memoryview, word: memoryview, counts: memoryview) -> None:
        self.labels, self.first, self.word, self.counts = labels, first, word, counts

    @classmethod
    def parts(cls, words: list[bytes], counts: list[int]) -> tuple[bytes, bytes, bytes, bytes]:
        """The arrays of the trie of sorted, distinct words."""
        labels, first, word = bytearray(b"\0"), array("I"), array("I")
        level, depth = [(0, len(words))], 0
        while level:
            below = []
            for start, end in level:
                first.append(len(labels))
                ends = len(words[start]) == depth
                word.append(start + 1 if ends else 0)
                start += ends
                while start < end:
                    letter, stop = words[start][depth], start + 1
                    if start + 1 < end and words[end - 1][depth] == letter:
                        stop = end
                    else:
                        while stop < end and words[stop][depth] == letter:
                            stop += 1
                    labels.append(letter)
                    below.append((start, stop))
                    start = stop
            level, depth = below, depth + 1
        first.append(len(labels))
        return bytes(labels), first.tobytes(), word.tobytes(), array("Q", counts).tobytes()

    @classmethod
    def read(cls, parts: tuple[bytes, bytes, bytes, bytes]) -> Trie:
        labels, first, word, counts = parts
        return cls(labels, memoryview(first).cast("I"), memoryview(word).cast("I"), memoryview(counts).cast("Q"))

    def spelled(self, node: int) -> str:
        """The letters from the root to a node; a node's parent is the one whose range of children holds it."""
        letters = bytearray()
        while node:
            letters.append(self.labels[node])
            node = bisect_right(self.first, node) - 1
        return letters[::-1].decode("latin-1")

    def near(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        """For each of sorted words the nodes where this trie's words at a distance of exactly one end.

        After some letters an automaton is in the node that they spell, or in none (-1), and in the nodes one edit away. Both are kept for each letter of the word before.
        """
        first, ends, find = self.first, self.word, self.labels.find
        exact, edited, before = [0], [set(range(first[0], first[1]))], b""
        for w in words:
            same, most = 0, min(len(w), len(exact) - 1)
            while same < most and w[same] == before[same]:
                same += 1
            del exact[same + 1 :], edited[same + 1 :]
            before = w
            for letter in w[same:]:
                node, states = exact[-1], edited[-1]
                if node < 0 and not states:
                    break
                after = {k for e in states if (k := find(letter, first[e], first[e + 1])) >= 0}
                if node >= 0:
                    # The word's letter is left out, or another one stands in its place.
                    start, end = first[node], first[node + 1]
                    after.add(node)
                    after.update(range(start, end))
                    node = find(letter, start, end)
                    if node >= 0:
                        # A letter more follows.
                        after.discard(node)
                        after.update(range(first[node], first[node + 1]))
                exact.append(node)
                edited.append(after)
            yield [e for e in edited[-1] if ends[e]] if len(exact) > len(w) else []


def shards(words: DataFrame) -> DataFrame:
    """Rows (size, labels, first, word, counts), a trie each, of rows (word, n): ranges of the sorted words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            parts = Trie.parts(held_words, counts)
            return pa.RecordBatch.from_pylist([{"size": sum(map(len, parts)), "labels": parts[0], "first": parts[1], "word": parts[2], "counts": parts[3]}], schema)

        held_words, counts, letters = [], [], 0
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held_words and letters + len(w) > SHARD_LETTERS:
                    yield made()
                    held_words, counts, letters = [], [], 0
                held_words.append(w.encode("latin-1"))
                counts.append(n)
                letters += len(w)
        if held_words:
            yield made()

    schema = pa.schema({"size": pa.int64(), "labels": pa.binary(), "first": pa.binary(), "word": pa.binary(), "counts": pa.binary()})
    letters = words.agg(F.sum(F.length("word"))).first()[0] or 0
    ranges = words.repartitionByRange(-(-letters // SHARD_LETTERS) or 1, "word").sortWithinPartitions("word")
    return ranges.select("word", "n").mapInArrow(run, "size long, labels binary, first binary, word binary, counts binary")


def _met(words: DataFrame, group: Broadcast) -> DataFrame:
    """Rows (word, n, n_near, best): how many words of a group of shards are near, and of these the best as (less its count, itself)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        tries = [Trie.read(parts) for parts in group.value]
        for b in small_batches(batches, ROWS):
            order = b.sort_by("word")
            found = [w.encode("latin-1") for w in order.column(0).to_pylist()]
            near, best = [0] * len(found), [None] * len(found)
            for trie in tries:
                ends, counts = trie.word, trie.counts
                for i, nodes in enumerate(trie.near(found)):
                    if nodes:
                        # Words are numbered in order, so of equal counts the smallest number is the smallest word.
                        m, number, node = min((-counts[ends[k] - 1], ends[k], k) for k in nodes)
                        near[i] += len(nodes)
                        if best[i] is None or m <= best[i]["m"]:
                            mine = {"m": m, "form": trie.spelled(node)}
                            best[i] = mine if best[i] is None else min(best[i], mine, key=lambda x: (x["m"], x["form"]))
            yield pa.RecordBatch.from_arrays([order.column(0), order.column(1), pa.array(near, pa.int64()), pa.array(best, kind)], ["word", "n", "n_near", "best"])

    kind = pa.struct({"m": pa.int64(), "form": pa.string()})
    return words.select("word", "n").mapInArrow(run, "word string, n long, n_near long, best struct<m: long, form: string>")


def _groups(tries: DataFrame) -> Iterator[list[tuple[bytes, ...]]]:
    """The shards in groups of GROUP_BYTES at most, or of one shard; one group at a time comes through the driver."""
    group, size = [], 0
    for row in tries.toLocalIterator():
        if group and size + row.size > GROUP_BYTES:
            yield group
            group, size = [], 0
        group.append(tuple(map(bytes, row[1:])))
        size += row.size
    if group:
        yield group


def nearest_forms(words: DataFrame) -> DataFrame:
    """Rows (word, n, n_near, form, form_n) for distinct (word, n): its near words' number, and the most frequent of them if at least twice as frequent.

    Words are of Latin-1 letters. Of equally frequent near words the smallest is taken. A word with no such near word has null form and form_n.
    """
    spark = words.sparkSession
    tries, met = materialize(shards(words), "shards"), []
    for group in _groups(tries):
        sent = spark.sparkContext.broadcast(group)
        met.append(materialize(_met(words, sent), "met"))
        sent.destroy()
    discard(tries)
    if not met:
        return words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"))
    best = reduce(DataFrame.unionByName, met).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    best = best.withColumn("best", F.when(-F.col("best.m") >= 2 * F.col("n"), F.col("best")))
    return best.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.m")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """Rows (word, root) for rows (word, form) without null forms or cycles: the last form that following leads to.

    Each round takes a form's form at once, so rounds grow with the logarithm of the longest chain.
    """
    found = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        x, y = found.alias("x"), found.alias("y")
        after = x.join(y, F.col("x.root") == F.col("y.word"), "left").select("x.word", F.coalesce("y.root", "x.root").alias("root"), F.col("y.word").isNotNull().alias("moved"))
        after = materialize(after, "roots")
        discard(found)
        found = after.select("word", "root")
        found.written_path = after.written_path
        if not after.where("moved").limit(1).count():
            return found


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", misspell: int = 0) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n): the words of docs (see word_counts), each with its more frequent spelling and where following these ends.

    Null and empty texts have no words; very long texts, runs and repeated rows count like others; other columns of docs are left out, whatever their names; no rows give no rows.
    """
    words = materialize(word_counts(docs, id_col, text_col, misspell), "words")
    forms = materialize(nearest_forms(words), "forms")
    found = forms.join(roots(forms.where("form IS NOT NULL")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
