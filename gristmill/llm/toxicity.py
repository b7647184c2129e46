"""Toxicity: noisy-channel deobfuscation of words, then a score of the restored text.

A written word is taken as a restored word that was disguised by look-alike signs, separators between letters and repeated
letters. Its character lattice is decoded by Viterbi under a character language model counted over all documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import clean_text, let_go, long_rows, small_batches

#: About as many labelled documents are learned from, chosen by a hash of their ids.
TRAIN_DOCS = 20_000
#: Words that tell toxic from other documents: at most so many, each in so many toxic documents at least, with so large a log-odds and so many of its standard errors.
WORDS, LEAST_DOCS, LEAST_ODDS, LEAST_SIGMAS = 2000, 5, 2.0, 3.0
#: Beginnings of words that are counted beside whole words, so that a stem tells in forms that were never labelled.
STEMS = (4, 5, 6)
#: Costs in nats of a look-alike, of a sign that stands for any letter, of a dropped separator and of a dropped repeat, of a gap that is read between spaced letters and of a separator that ends a word.
LOOK_ALIKE, ANY_LETTER, SEPARATOR, REPEAT, GAP, BREAK = 1.0, 2.5, 0.7, 0.7, 1.5, 1.5
#: About so many bytes of tokens and units are remembered by a task; the memory starts anew when it is full.
REMEMBERED = 40_000_000
#: Signs and the letters they look like.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
ANY = "*#%?"
SEPARATORS = "-._~'`/\\*"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: The model's alphabet: the end of a word, the letters, and one sign for all other letters.
CODES = {c: i + 1 for i, c in enumerate(LETTERS)}
N = len(LETTERS) + 2
OTHER = N - 1

_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_DISGUISE = re.compile(r"[^\W\d_]*(?:[0-9@$!|+(€£*#%?\-._~'`/\\]|(?P<x>\w)(?P=x)(?P=x))")
_SPACED = re.compile(r"(?<!\S)(?:\S[ \t]+){3,}\S(?!\S)")


@dataclass
class Model:
    """gains: log-probability of a character after two others; odds: log-odds of words; weights: of the features, the last one constant."""

    gains: np.ndarray
    odds: dict[str, float]
    weights: np.ndarray


def _table(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of triples, with pairs and single characters behind them."""
    triples = counts.reshape(N, N, N).astype(float)
    pairs, ones = triples.sum(axis=0), triples.sum(axis=(0, 1))
    single = (ones + 1) / (ones.sum() + N)
    double = (pairs + 20 * single) / (pairs.sum(axis=1, keepdims=True) + 20)
    return np.log((triples + 5 * double) / (triples.sum(axis=2, keepdims=True) + 5))


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts character triples of words over all documents: each task adds up its own, the sums are at most N**3."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        code = np.full(256, OTHER, np.int32)
        for c, i in CODES.items():
            code[ord(c)] = code[ord(c.upper())] = i
        # Anything below the letters, or between them, ends a word; bytes of other characters are other letters.
        code[[b for b in range(128) if not chr(b).isalpha()]] = 0
        counts = np.zeros(N**3, np.int64)
        for b in small_batches(batches):
            raw = np.frombuffer(b"\n\n" + "\n\n".join(b.column(0).to_pylist()).encode("utf-8", "surrogatepass") + b"\n\n", np.uint8)
            c = code[raw]
            c = c[np.concatenate(([True], (c[1:] != OTHER) | (c[:-1] != OTHER)))]
            # Two ends stand before a word, one after it.
            start = np.concatenate(([False], (c[:-1] == 0) & (c[1:] != 0)))
            c = np.insert(c, np.flatnonzero(start), 0)
            triples = (c[:-2] * N + c[1:-1]) * N + c[2:]
            counts += np.bincount(triples[(c[1:-1] != 0) | (c[:-2] == 0) & (c[2:] != 0)], minlength=N**3)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["cell", "n"])

    rows = long_rows(docs).select(clean_text(F.col(text_col)).alias("text")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(N**3)
    counts[rows["cell"].to_numpy(np.int64)] = rows["n"]
    return _table(counts)


def decode(token: str, gains: np.ndarray, spaced: bool = False) -> list[str]:
    """The likeliest restored words of a token of lower-case signs, of any length. All states are kept, so that nothing likelier is lost."""
    # A state is the last two characters and the written sign before, for repeats; its value the best cost and text, the latter as links to what stands before.
    states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
    for sign in token:
        options: list[tuple[str, float]] = [(sign, 0.0)] if sign.isalpha() else []
        options += [(c, LOOK_ALIKE) for c in SIGNS.get(sign, "")]
        after: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}

        def reach(state: tuple[int, int, str], cost: float, text: tuple | None, sign: str = "", after: dict = after) -> None:
            if state not in after or cost < after[state][0]:
                after[state] = (cost, (text, sign) if sign else text)

        if sign in ANY:
            _any_letter(states, gains, spaced, reach)
        for (a, b, last), (cost, text) in states.items():
            for c, price in options:
                code = CODES.get(c, OTHER)
                if c == last:
                    reach((a, b, last), cost + REPEAT, text)
                reach((b, code, c), cost + price - gains[a, b, code], text, c)
                if spaced and b:
                    ended = cost + GAP - gains[a, b, 0]
                    reach((0, code, c), ended + price - gains[0, 0, code], text, " " + c)
            if sign in SEPARATORS:
                reach((a, b, last), cost + SEPARATOR, text)
                if b:
                    reach((0, 0, ""), cost + BREAK - gains[a, b, 0], text, " ")
            elif not options and sign not in ANY:
                reach((0, 0, ""), cost + SEPARATOR - (gains[a, b, 0] if b else 0), text, " " if b else "")
        states = after
    _, text = min(((cost - gains[a, b, 0], text) for (a, b, _), (cost, text) in states.items()), key=lambda x: x[0])
    signs = []
    while text is not None:
        text, sign = text
        signs.append(sign)
    return "".join(reversed(signs)).split()


def _any_letter(states: dict, gains: np.ndarray, spaced: bool, reach: Callable[..., None]) -> None:
    """Reads a sign as each letter after all states: of those with the same last character, one is best for each letter."""
    keys, values = list(states), list(states.values())
    a, b = np.array([k[:2] for k in keys]).T
    costs = np.array([v[0] for v in values])
    for k, (cost, text) in zip(keys, values, strict=True):
        if k[2] in CODES:
            reach(k, cost + REPEAT, text)
    priced = costs[:, None] + ANY_LETTER - gains[a, b, 1:OTHER]
    for last in np.unique(b).tolist():
        rows = np.flatnonzero(b == last)
        best = rows[priced[rows].argmin(axis=0)]
        for i, (c, cost) in enumerate(zip(LETTERS, priced[best, range(len(LETTERS))].tolist(), strict=True)):
            reach((last, i + 1, c), cost, values[best[i]][1], c)
    if spaced and b.any():
        ended = np.where(b > 0, costs + GAP - gains[a, b, 0], np.inf)
        i = int(ended.argmin())
        for c, code in CODES.items():
            reach((0, code, c), float(ended[i] + ANY_LETTER - gains[0, 0, code]), values[i][1], " " + c)


def units(word: str) -> list[str]:
    """The word and its beginnings, which end in a star."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


class Restorer:
    """Units of a text's restored words, all or those that tell; tokens are remembered."""

    def __init__(self, gains: np.ndarray, telling: Iterable[str] | None = None) -> None:
        self.gains = gains
        self.telling = None if telling is None else frozenset(telling)
        self.known: dict[str, tuple[str, ...]] = {}
        self.held = 0

    def units(self, token: str) -> tuple[str, ...]:
        """The units of a token; very long tokens are not remembered."""
        kept = self.known.get(token)
        if kept is None:
            found = {u for word in self._token(token) for u in units(word)}
            kept = tuple(found if self.telling is None else found & self.telling)
            weight = 200 + len(token) + 80 * len(kept)
            if weight < REMEMBERED // 1000:
                if self.held + weight > REMEMBERED:
                    self.known.clear()
                    self.held = 0
                self.known[token] = kept
                self.held += weight
        return kept

    def _token(self, token: str) -> tuple[str, ...]:
        core = token.strip(_EDGES)
        if core.isalpha() and not (len(core) > 2 and _DISGUISE.match(core)):
            # Signs at an end may be letters too: "$cum". Only then is there a second reading.
            if len(core) == len(token) or not any(c in SIGNS for c in (token[0], token[-1])):
                return (core,)
            return (core, *decode(token.strip("".join(set(_EDGES) - SIGNS.keys())), self.gains))
        if not any(c.isalpha() for c in core):
            return (core,) if core else ()
        return tuple(decode(token.strip("".join(set(_EDGES) - SIGNS.keys() - set(ANY))), self.gains)) + tuple(decode(core, self.gains))

    def words(self, text: str) -> set[str]:
        """The units of all restored words of a text."""
        text = text.lower()
        found: set[str] = set()
        for kept in map(self.units, set(text.split())):
            if kept:
                found.update(kept)
        for m in _SPACED.finditer(text):
            for part in re.split(r"[ \t]{2,}", m.group()):
                read = {u for word in decode("".join(part.split()), self.gains, spaced=True) for u in units(word)}
                found.update(read if self.telling is None else read & self.telling)
        return found


def features(telling: set[str], odds: dict[str, float]) -> tuple[float, float, float]:
    """The largest log-odds of the telling units, their sum (to forty at most) and their number (to ten at most)."""
    found = [odds[w] for w in telling]
    return (max(found, default=0.0), min(40.0, sum(found)) / 10, min(10, len(found)) / 3)


def train(docs: DataFrame, labels: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = TRAIN_DOCS) -> Model:
    """Learns from the labelled rows among docs, about limit of them; rows of labels without an id or label say nothing.

    The chosen ids, at most a fourth over limit, are broadcast; words are counted by Spark. What reaches the driver is the
    telling units, at most WORDS, and three features of each chosen document.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label_col).cast("int").alias("__toxic")).where("__id IS NOT NULL AND __toxic IS NOT NULL").groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    n = known.count()
    if n > limit:
        known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(1_000_000 * limit / n)).limit(limit * 5 // 4)
    chosen = long_rows(docs).join(F.broadcast(known), docs[id_col] == known["__id"]).select(F.col("__toxic").alias("toxic"), clean_text(F.col(text_col)).alias("text"))

    def restored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        restorer = Restorer(gains)
        for b in small_batches(batches, 64):
            words = [sorted(restorer.words(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], ["toxic", "words"])

    rows = chosen.mapInArrow(restored, "toxic int, words array<string>")
    docs_by_label = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = docs_by_label.get(1, 0), docs_by_label.get(0, 0)
    if not bad or not good:
        return Model(gains, {}, np.array([0.0, 0.0, 0.0, -10.0 if good or not bad else 10.0]))
    seen = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    sigma = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    telling = seen.where(F.col("bad") >= LEAST_DOCS).select("word", odds.alias("odds"), (odds / sigma).alias("sigmas")).where((F.col("odds") >= LEAST_ODDS) & (F.col("sigmas") >= LEAST_SIGMAS))
    lexicon = {r["word"]: r["odds"] for r in telling.orderBy(F.desc("sigmas"), "word").limit(WORDS).collect()}

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        restorer = Restorer(gains, lexicon)
        for b in small_batches(batches, 64):
            columns = list(zip(*(features(restorer.words(t), lexicon) for t in b.column(1).to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns)], ["toxic", "top", "total", "share"])

    sample = chosen.mapInArrow(measured, "toxic int, top double, total double, share double").toPandas()
    x = np.column_stack([sample["top"], sample["total"], sample["share"], np.ones(len(sample))])
    return Model(gains, lexicon, _logistic(x, sample["toxic"].to_numpy(float)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score, predicted, words), one for each row of docs; words: the telling units of its restored words. Null texts count as empty."""
    kept = long_rows(docs).select(F.col(id_col).alias("doc_id"), clean_text(F.col(text_col)).alias("text"))
    return kept.mapInArrow(_scorer(model, 1, lambda b: [b.column(0)]), f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int, words array<string>")


def _scorer(model: Model, text_at: int, kept):  # noqa: ANN001, ANN202
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        restorer = Restorer(model.gains, model.odds)
        for b in small_batches(batches):
            words = [restorer.words(t) for t in b.column(text_at).to_pylist()]
            x = np.array([(*features(w, model.odds), 1.0) for w in words]).reshape(-1, 4)
            p = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
            told = [sorted(w) for w in words]
            yield pa.RecordBatch.from_arrays(
                [*kept(b), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(told, pa.list_(pa.string()))], [*(b.schema.names[: len(kept(b))]), "score", "predicted", "words"]
            )

    return run


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows that are predicted toxic; columns as they are. The score is found beside the row, so nothing is joined or shuffled."""
    import pyspark.sql.types as T

    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = long_rows(docs).toDF(*names)
    at = docs.columns.index(text_col)
    plain = plain.withColumn("__text", clean_text(F.col(names[at])))
    schema = T.StructType([*plain.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType()))])
    scored = plain.mapInArrow(_scorer(model, len(names), lambda b: b.columns[:-1]), schema)
    return scored.where("predicted = 0").select(names).toDF(*docs.columns)
