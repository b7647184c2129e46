"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores labels spans of mixed-language text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import clean_text, long_rows, small_batches

#: About as many documents are learned from, chosen by a hash of their ids; of a language, at least so many or all that it has.
TRAIN_DOCS, LEAST_DOCS = 20_000, 200
#: Character triples are hashed to so many counts for each language.
TRIPLES = 32_768
SMOOTHING = 0.5
#: What a change of language costs, in nats.
SWITCH = 12.0
#: A word's score is cut off at so many nats below its best language's, so that no single odd word forces a change.
LARGEST_GAP = 10.0
#: The score of a language that a word's script rules out: no path through it is ever best.
RULED_OUT = -1e6
#: A language counts as written in a script if so large a share of its words is.
SCRIPT_SHARE = 0.02
#: Words remembered per worker.
REMEMBERED = 400_000
#: The first code points of script ranges, as the Unicode standard lays them out. Letters between belong to the range before.
SCRIPT_STARTS = np.array([0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x20000])


@dataclass
class Model:
    """langs; gains: log-probability of each hashed triple for each language; scripts: whether a language is written in a script."""

    langs: list[str]
    gains: np.ndarray
    scripts: np.ndarray


def split_words(text: str) -> list[str]:
    return text.lower().split()


def word_triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words together: hashed triples of letters with a mark at a word's ends, the number of the word each is in, and for each word its letters and script (-1: no letter)."""
    points = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    which = np.cumsum(points == 10) - 1
    letter = np.fromiter(map(str.isalpha, "\n" + "\n".join(words) + "\n"), bool, len(points))
    kept = letter | (points == 10)
    points, which, letter = points[kept], which[kept], letter[kept]
    hashed = (points[:-2] * 40_503 + points[1:-1] * 65_599 + points[2:] * 2_654_435_761) % 2**32 % TRIPLES
    inside = letter[1:-1]
    letters = np.bincount(which[letter], minlength=len(words))
    scripts = np.full(len(words), -1, np.int64)
    at = np.flatnonzero(letter)[::-1]
    scripts[which[at]] = np.searchsorted(SCRIPT_STARTS, points[at], "right") - 1
    return hashed[inside], which[1:-1][inside], letters, scripts


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_DOCS) -> Model:
    """Learns from documents with a text and a language: counts of triples and scripts, summed over tasks. About limit documents are used.

    Every language is learned, a rare one from LEAST_DOCS of its documents or all. Only the counts reach the driver: at most
    TRIPLES and the number of scripts for each language. An empty table gives a model without languages.
    """
    docs = long_rows(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs, n = sorted(sizes), sum(sizes.values())
    if n > limit:
        share = F.create_map(*[F.lit(x) for lang, m in sizes.items() for x in (lang, int(1_000_000 * min(1, max(limit / n, LEAST_DOCS / m))))])
        docs = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share[F.col("lang")])
    place = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(langs), TRIPLES + len(SCRIPT_STARTS)), np.int64)
        for b in small_batches(batches, 64):
            for text, lang in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                hashed, _, _, scripts = word_triples(split_words(text))
                counts[place[lang], :TRIPLES] += np.bincount(hashed, minlength=TRIPLES)
                counts[place[lang], TRIPLES:] += np.bincount(scripts[scripts >= 0], minlength=len(SCRIPT_STARTS))
        at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(counts[at])], ["lang", "cell", "n"])

    rows = docs.mapInArrow(run, "lang long, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), TRIPLES + len(SCRIPT_STARTS)))
    counts[rows["lang"], rows["cell"]] = rows["n"]
    triples, scripts = counts[:, :TRIPLES] + SMOOTHING, counts[:, TRIPLES:]
    gains = np.log(triples / triples.sum(axis=1, keepdims=True)).T.astype(np.float32).reshape(TRIPLES, len(langs))
    return Model(langs, np.ascontiguousarray(gains), scripts > SCRIPT_SHARE * scripts.sum(axis=1, keepdims=True))


class Tagger:
    """Labels the words of texts; scores of words are remembered."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[str, int] = {}
        self.scores = np.zeros((REMEMBERED, len(model.langs)), np.float32)
        self.letters = np.zeros(REMEMBERED, np.int32)

    def _learn(self, new: list[str]) -> None:
        hashed, which, letters, scripts = word_triples(new)
        scores = np.zeros((len(new), len(self.model.langs)), np.float32)
        np.add.at(scores, which, self.model.gains[hashed])
        # A script that some languages are written in rules the others out.
        fits = self.model.scripts.T[scripts] & (scripts >= 0)[:, None]
        out = fits.any(axis=1)[:, None] & ~fits
        scores[out] = -np.inf
        scores = np.maximum(scores - scores.max(axis=1, keepdims=True), -LARGEST_GAP)
        scores[out] = RULED_OUT
        scores[scripts < 0] = 0
        at = len(self.known)
        self.scores[at : at + len(new)], self.letters[at : at + len(new)] = scores, letters
        self.known.update(zip(new, range(at, at + len(new)), strict=True))

    def _rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        new = set(words).difference(self.known)
        if len(new) > REMEMBERED // 2:  # a text of very many words is labelled in parts of its words' scores
            parts = [self._rows(words[i : i + REMEMBERED // 4]) for i in range(0, len(words), REMEMBERED // 4)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = set(words)
            self._learn(list(new))
        rows = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return self.scores[rows], self.letters[rows]

    def label(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """For each word the number of its language, and its letters."""
        scores, letters = self._rows(split_words(text))
        if not len(scores):
            return np.zeros(0, np.int64), letters
        totals = np.cumsum(scores, axis=0, dtype=np.float64)
        best = int(totals[-1].argmax())
        # If no stretch of words gains more than a change costs in another language, one language for all words is the best path.
        ahead = np.vstack((np.zeros(totals.shape[1]), totals - totals[:, [best]]))
        if (ahead - np.minimum.accumulate(ahead, axis=0)).max() <= SWITCH:
            return np.full(len(scores), best), letters
        return viterbi(scores, SWITCH), letters

    def predict(self, text: str | None) -> tuple[str, float, list[tuple[int, int, str]]]:
        """The language of the most letters, its share of them, and spans (first word, word after the last, language); und without a letter or without languages."""
        if not self.model.langs:
            return "und", 0.0, []
        labels, letters = self.label(text or "")
        total = int(letters.sum())
        if not total:
            return "und", 0.0, []
        share = np.bincount(labels, weights=letters, minlength=len(self.model.langs))
        best = int(share.argmax())
        starts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist()]
        spans = [(a, b, self.model.langs[labels[a]]) for a, b in zip(starts, [*starts[1:], len(labels)], strict=True)]
        return self.model.langs[best], float(share[best] / total), spans


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """The path of languages with the largest sum of scores less switch for each change."""
    path, best = [], [0.0] * scores.shape[1]
    for row in scores.tolist():
        top = max(best)
        leader = best.index(top)
        path.append((leader, [top - switch > x for x in best]))
        best = [max(x, top - switch) + s for x, s in zip(best, row, strict=True)]
    at = best.index(max(best))
    out = np.empty(len(path), np.int64)
    for i in range(len(path) - 1, -1, -1):
        out[i] = at
        leader, changed = path[i]
        if changed[at]:
            at = leader
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, lang_pred, score, spans), one for each row of docs; spans: array of (first_word, end_word, lang).

    Texts that are null or have no letter are und with score 0. Equal shares go to the first language by name. Very long texts
    are read whole; repeated rows get equal rows; an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        kind = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("lang", pa.string())]))
        for b in small_batches(batches):
            langs, scores, spans = zip(*map(tagger.predict, b.column(1).to_pylist()), strict=True)
            named = [[dict(zip(("first_word", "end_word", "lang"), s, strict=True)) for s in found] for found in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs), pa.array(scores), pa.array(named, kind)], ["doc_id", "lang_pred", "score", "spans"])

    docs = long_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), clean_text(F.col(text_col)).alias("text"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<first_word int, end_word int, lang string>>")
