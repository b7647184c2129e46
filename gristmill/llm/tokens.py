"""Token ids by the tokenizers library, with a memory of pieces that were encoded before.

Both vocabularies split a text before any merge, and no merge crosses such a split. So a text can be cut where a split is
certain, and each piece's ids found once per worker. Pieces that are new in a batch go to the library together.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gristmill.llm.common import held

#: Pieces remembered per worker, some 200 MB; the memory starts anew when it is full.
REMEMBERED = 900_000
#: New pieces that one call joins.
JOINED = 400
#: Marks of ASCII.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_MARKS = frozenset(MARKS)
_SAFE = re.compile(r"(?= \S)")
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")
_BYTE_PLAIN = re.compile(r" ?\S+")
_WORD_PLAIN = re.compile(r"[^\s0]+")


def _byte_pieces(text: str) -> list[str]:
    """Cuts before a space that a visible character follows, and around a lone line feed: the byte-level pattern always splits there."""
    # All white space is single spaces and line feeds between visible signs: the certain cuts are all there are.
    if "\0" not in text and " ".join(text.split()) == text.replace("\n", " "):
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
    return _SAFE.split(text)


def _word_pieces(text: str) -> list[str]:
    """Cuts at white space, which the word-level vocabulary drops; it lower-cases too, which is done here where case has one meaning."""
    if _ODD_SPACE.search(text):
        return [text]
    return (text.lower() if text.isascii() else text).split()


class Encoder:
    """Ids of whole texts as little-endian bytes of self.kind, equal to those of one library call per text."""

    def __init__(self, name: str) -> None:
        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.library.encode_special_tokens = True
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 65536 else "<u4")
        word_ends = not self._ids(["a b"])[0] == self._ids(["a"])[0] + self._ids([" b"])[0]
        self.pieces = _word_pieces if word_ends or self._ids([" b"])[0] == self._ids(["b"])[0] else _byte_pieces
        self.plain, self.between = (_WORD_PLAIN, " 0 ") if self.pieces is _word_pieces else (_BYTE_PLAIN, "\n")
        (self.mark,) = self._ids([self.between])[0]
        self.known: dict[str, bytes] = {}

    def _ids(self, texts: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        # A letter or digit and a mark after it are always split, so a word's ids serve whatever marks follow it.
        tails, ask, whole = [], set(), self.plain.fullmatch
        for p in [p for p in new if p[-1:] in _MARKS]:
            word = p.rstrip(MARKS)
            if word[-1:].isalnum() and whole(p):
                tails.append((p, word, p[len(word) :]))
                ask.add(word)
                ask.add(p[len(word) :])
        # What is new is not known; of the words and marks some are.
        self._ask([*new.difference([p for p, _, _ in tails]), *ask.difference(self.known, new)])
        known = self.known
        for p, word, marks in tails:
            known[p] = known[word] + known[marks]

    def _ask(self, new: list[str]) -> None:
        plain, rest = [], []
        for p in new:
            (plain if self.plain.fullmatch(p) else rest).append(p)
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for group, ids in zip(groups, self._ids([self.between.join(g) for g in groups]), strict=True):
            array = np.array(ids, self.kind)
            cuts = np.flatnonzero(array == self.mark)
            if len(cuts) != len(group) - 1:
                rest += group
                continue
            raw, width = array.tobytes(), self.kind.itemsize
            starts, ends = [0, *((cuts + 1) * width).tolist()], [*(cuts * width).tolist(), len(raw)]
            self.known.update(zip(group, (raw[a:b] for a, b in zip(starts, ends, strict=True)), strict=True))
        for piece, ids in zip(rest, self._ids(rest), strict=True):
            self.known[piece] = np.array(ids, self.kind).tobytes()

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text."""
        cut = [self.pieces(t) for t in texts]
        for start in range(0, len(cut), 256):
            new = set().union(*cut[start : start + 256]).difference(self.known)
            if new and len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = set().union(*cut[start : start + 256])
            if new:
                self._learn(new)
            get = self.known.__getitem__
            for i in range(start, min(start + 256, len(cut))):
                cut[i] = b"".join(map(get, cut[i]))
        return cut


def encoder(name: str) -> Encoder:
    """The worker's encoder for a vocabulary file of public_tokenizers."""
    return held(f"encoder {name}", lambda: Encoder(name))
