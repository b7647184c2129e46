"""The decoder loses no state and no part of a token, and separators may end words."""

import numpy as np

from gristmill.llm import toxicity
from gristmill.llm.toxicity import CODES, N, decode


def gains_of(words):
    counts = np.zeros(N**3)
    for word, n in words.items():
        codes = [0, 0, *(CODES[c] for c in word), 0]
        for x, y, z in zip(codes, codes[1:], codes[2:]):
            counts[(x * N + y) * N + z] += n
    return toxicity._table(counts)


def crowd():
    """Many common beginnings with b, and one rarer word that only its last letters confirm."""
    words = {f"b{x}{y}": 400 for x in "abcdefghijklmnopqrs" for y in "abcdefghijklmnopqrs" if x + y != "cd"}
    return gains_of({**words, "bcdvwxyz": 40, "well": 500, "you": 500, "idiot": 100})


def test_masked_letters_keep_every_state():
    gains = crowd()
    assert decode("b##vwxyz", gains) == ["bcdvwxyz"]
    assert decode("b**vwxyz", gains) == ["bcdvwxyz"]


def test_a_separator_may_end_a_word():
    gains = crowd()
    assert decode("well...idiot", gains) == ["well", "idiot"]
    assert decode("you/idiot", gains) == ["you", "idiot"]
    assert decode("i-d.i_o-t", gains) == ["idiot"]


def test_long_tokens_are_decoded():
    gains = crowd()
    glued = ",".join(["well", "you"] * 10 + ["1di0t"] + ["you", "well"] * 10)
    assert "idiot" in toxicity.Restorer(gains).words(glued)
    assert "idiot" in toxicity.Restorer(gains).words("well." * 3000 + "1di0t")
