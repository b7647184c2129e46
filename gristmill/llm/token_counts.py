"""Token counts of whole texts by byte-pair merging with a heap and a linked list; no ids are made.

A text's characters are its first symbols. The adjacent pair of lowest rank (of equal ones the leftmost) is merged again and again;
what is left is counted: first symbols less merges, where a character that the vocabulary lacks counts its UTF-8 bytes. No merge
crosses two characters that stand side by side in no piece, so a text can be cut there and a stretch's count be remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from operator import add

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import clean_text, held, long_rows, small_batches

#: Stretches, and parts of them, whose counts a worker remembers; a memory starts anew when it is full. Longer ones are counted each time.
REMEMBERED = 600_000
REMEMBERED_CHARS = 48
#: The mark that stands for a space.
SPACE = "▁"
#: A text that shows whether a model changes more than spaces.
PROBE = " ﬁ \tÅÅ  x　\n"


class Counter(dict):
    """Counts of stretches by a sentencepiece model of byte-pair pieces with byte fallback, found when first asked for.

    Refuses models that normalise texts, match strings of their own, or lack byte pieces: their counts follow other rules.
    """

    def __init__(self, name: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        if model.normalize(PROBE) != SPACE + PROBE.replace(" ", SPACE) or any(map(model.is_unused, ids)) or sum(map(model.is_byte, ids)) != 256:
            raise ValueError(f"{name} is no plain byte-pair model with byte fallback")
        pieces = [(model.id_to_piece(i), model.get_score(i)) for i in plain]
        self.rank = {p: -score for p, score in pieces if len(p) > 1}
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.adjacent = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        joined = set("".join(self.rank))
        self.whole = joined <= self.single
        self.known: dict[str, int] = {}
        # Spaces begin a stretch where no piece has one after another character.
        spaced = any(p[1] == SPACE != p[0] for p in self.adjacent) or SPACE not in joined
        letters = "".join(map(re.escape, sorted(joined - {SPACE})))
        self.stretch = re.compile(f"[{letters}{SPACE}]+|[^{letters}]" if spaced else f"{SPACE}*[{letters}]+|{SPACE}+|[^{letters}{SPACE}]")

    def __missing__(self, stretch: str) -> int:
        adjacent, known, start, n = self.adjacent, self.known, 0, 0
        ends = [i for i, pair in enumerate(map(add, stretch, stretch[1:]), 1) if pair not in adjacent]
        for end in (*ends, len(stretch)):
            part = stretch[start:end]
            m = known.get(part)
            if m is None:
                m = self._merged(part) if end - start > 1 or part in self.single else len(part.encode())
                self._keep(known, part, m)
            n += m
            start = end
        self._keep(self, stretch, n)
        return n

    @staticmethod
    def _keep(memory: dict[str, int], text: str, n: int) -> None:
        if len(text) <= REMEMBERED_CHARS:
            if len(memory) >= REMEMBERED:
                memory.clear()
            memory[text] = n

    def _merged(self, text: str) -> int:
        rank, symbols, last = self.rank.get, list(text), len(text)
        # An entry's length tells whether its two symbols are still what they were.
        heap = [(r, i, 2) for i, r in enumerate(map(rank, map(add, text, text[1:]))) if r is not None]
        heapify(heap)
        after, before, merges = list(range(1, last + 1)), list(range(-1, last - 1)), 0
        while heap:
            _, i, size = heappop(heap)
            left, j = symbols[i], after[i]
            if left is None or j == last or len(left) + len(symbols[j]) != size:
                continue
            symbols[i], symbols[j] = left, _ = left + symbols[j], None
            merges += 1
            k = after[i] = after[j]
            if k < last:
                before[k] = i
                if (r := rank(left + symbols[k])) is not None:
                    heappush(heap, (r, i, size + len(symbols[k])))
            h = before[i]
            if h >= 0 and (r := rank(symbols[h] + left)) is not None:
                heappush(heap, (r, h, size + len(symbols[h])))
        bare = 0 if self.whole else sum(len(s.encode()) - 1 for s in symbols if s is not None and len(s) == 1 and s not in self.single)
        return last - merges + bare

    def count(self, text: str) -> int:
        """Tokens of a whole text, without begin and end; strings of control pieces are ordinary text."""
        return sum(map(self.__getitem__, self.stretch.findall(SPACE + text.replace(" ", SPACE)))) if text else 0


def counter(name: str) -> Counter:
    """The worker's counter for a model file of public_tokenizers."""
    return held(f"counter {name}", lambda: Counter(name))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """Rows (doc_id, n_bytes long, n_tokens long, over_limit boolean), one for each row of docs, other columns left out.

    A null or empty text has no bytes and no tokens. Whole texts are counted, however long; in a text that no boundary cuts, memory
    grows with its length. Rows are counted on their own: repeated rows and ids stay, null ids too. No rows give no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_file).count
        for b in small_batches(batches):
            n = pa.array(map(count, b.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_length(b.column(1)).cast(pa.int64()), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return long_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), clean_text(F.col(text_col)).alias("text")).mapInArrow(run, schema)
