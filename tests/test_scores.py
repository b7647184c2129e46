"""Forms of English scores that compete: which one reads a number, and that no other one reads it again."""

from __future__ import annotations

import pytest

from gristmill.functions import scores

SKILLS = scores.SKILLS


def read(text: str) -> dict[str, tuple]:
    """By test: (form, overall, listening, reading, writing, speaking)."""
    return {k: (form, said.scores["overall"], *(said.scores.get(s) for s in SKILLS)) for k, (form, said) in scores.scores(text).items()}


CASES = [
    # A clause of a least score right after the number goes before the plain number, wherever that stands.
    ("IELTS 6.5 for some. IELTS 7.0 with no band below 6.5 for others.", {"ielts": ("floor", 7.0, 6.5, 6.5, 6.5, 6.5)}),
    ("IELTS minimum overall band of 6.5 with no individual band below 6.0", {"ielts": ("floor", 6.5, 6.0, 6.0, 6.0, 6.0)}),
    ("Academic IELTS 6.5 (no band less than 6.0)", {"ielts": ("floor", 6.5, 6.0, 6.0, 6.0, 6.0)}),
    # The clause of one test is not read for another one.
    ("TOEFL iBT 79, PTE 58 with no skill below 20", {"pte": ("floor", 58.0, 20.0, 20.0, 20.0, 20.0), "toefl": ("near", 79.0, None, None, None, None)}),
    ("IELTS 6.5 or PTE 58, with no band below 6.0", {"ielts": ("near", 6.5, 6.0, 6.0, 6.0, 6.0), "pte": ("near", 58.0, None, None, None, None)}),
    # An exception, first or last.
    ("IELTS 7.0 in three components (listening, reading, and speaking) and minimum score of 6.5 in writing", {"ielts": ("split", 7.0, 7.0, 7.0, 6.5, 7.0)}),
    ("IELTS 6.5 in writing and 7.0 in all other components", {"ielts": ("split", 7.0, 7.0, 7.0, 6.5, 7.0)}),
    ("IELTS 7.0 in 3 components (listening, reading, and speaking) and 6.5 in writing", {"ielts": ("split", 7.0, 7.0, 7.0, 6.5, 7.0)}),
    ("IELTS 7.0 with 7.0 in speaking and 6.5 in listening, reading and writing", {"ielts": ("split", 7.0, 6.5, 6.5, 6.5, 7.0)}),
    # In each, against overall alone.
    ("IELTS Academic 6.5 overall with 6.0 in each band", {"ielts": ("each", 6.5, 6.0, 6.0, 6.0, 6.0)}),
    # All skills by name need no range; some do.
    ("IELTS overall 6.5 listening 6.0 reading 6.5 writing 55 speaking 6.0", {"ielts": ("five", 6.5, 6.0, 6.5, 55.0, 6.0)}),
    ("IELTS overall band score: 6.5, writing 60, listening: 6", {"ielts": ("bands", 6.5, 6.0, None, None, None)}),
    # What is called overall goes before the first number.
    ("IELTS since 5 or overall: 6.5", {"ielts": ("overall", 6.5, None, None, None, None)}),
    ("PTE Academic | 50 | 36", {"pte": ("row", 50.0, 36.0, 36.0, 36.0, 36.0)}),
    ("PTE 70 then PTE 80", {"pte": ("near", 70.0, None, None, None, None)}),
    ("Pearson Test of English Academic 58, C2 Proficiency 200", {"pte": ("near", 58.0, None, None, None, None), "cambridge": ("near", 200.0, None, None, None, None)}),
    # A number before the name, with a preposition, and only if no form has read it.
    ("a score of 6.5 on the IELTS test", {"ielts": ("before", 6.5, None, None, None, None)}),
    ("PTE 50 in IELTS", {"pte": ("near", 50.0, None, None, None, None)}),
    ("3.5 on the IELTS, 150 in PTE", {}),
    # A clause further on, up to 250 characters.
    ("IELTS 6.5 is what all of our courses ask for at entry; in any case there is no band below 6.0", {"ielts": ("near", 6.5, 6.0, 6.0, 6.0, 6.0)}),
    ("IELTS 6.5. " + "x" * 300 + " no band below 6.0", {"ielts": ("near", 6.5, None, None, None, None)}),
    ("", {}),
    ("listening 6.0, overall 6.5", {}),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_forms(text, expected):
    assert read(text) == expected


def test_every_form_and_no_number_twice():
    assert {v[0] for _, e in CASES for v in e.values()} == {name for name, _ in scores.FORMS}
    for text, _ in CASES:
        used = [i for _, said in scores.scores(text).values() for i in said.used]
        assert len(used) == len(set(used))


def test_long_text():
    """Work grows with the text: many mentions, each with its number."""
    text = "IELTS 6.5 with no band below 6.0 and so on. " * 20_000
    assert read(text)["ielts"] == ("floor", 6.5, 6.0, 6.0, 6.0, 6.0)
    assert read("IELTS is asked for. " * 50_000) == {}
