"""Scores of English tests in running text. The text is cut into typed tokens once; forms of wording are then tried in a fixed order over all tests, and a number that one form has read is gone for the later ones."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType


class Test(NamedTuple):
    """low to high: overall scores; floor to ceiling: scores of one skill."""

    key: str
    names: str
    low: float
    high: float
    floor: float
    ceiling: float


#: Tests, what they are called, and the scores that they give (of TOEFL, overall ones that stand without its form).
TESTS = (
    Test("ielts", r"\bielts(?:\s+academic)?", 4, 9, 4, 9),
    Test("toefl", r"\btoefl(?:\s*ibt)?", 30, 120, 1, 30),
    Test("cambridge", r"\b(?:cambridge(?:\s+english)?|cae|cpe|c1\s*advanced|c2\s*proficiency)\b", 140, 230, 140, 230),
    Test("duolingo", r"\b(?:duolingo(?:\s+english\s+test)?|det)\b", 50, 160, 10, 160),
    Test("pte", r"\b(?:pte|pearson\s+test\s+of\s+english)(?:\s+academic)?\b", 10, 90, 10, 90),
)
BY_KEY = {t.key: t for t in TESTS}
ANY_TEST = re.compile("|".join(f"(?P<{t.key}>{t.names})" for t in TESTS), re.I)
SKILLS = ("listening", "reading", "writing", "speaking")
NUMBER = r"(?<![\d.,])\d{1,3}(?:\.\d)?(?![\d%])(?!\.\d)"

_PART = r"(?:band|skill|score|sub-?\s?score|component|section|area)s?"
#: The kinds of tokens; of two that begin at one place the first counts.
_TOKEN = re.compile(
    "|".join(
        [
            *(f"(?P<{t.key}>{t.names})" for t in TESTS),
            rf"(?P<least>\bno\s+(?:\w+\s+){{0,2}}?{_PART}\s+(?:score\s+)?(?:is\s+)?(?:below|less\s+than|lower\s+than|under)\b|\bnot\s+less\s+than\b|\bminimum\s+(?:band\s+)?of\b)",
            rf"(?P<rest>\b(?:in|for)\s+(?:all\s+)?(?:the\s+)?(?:other|remaining)\s+{_PART}\b)",
            rf"(?P<each>\b(?:(?:in|for|per)\s+)?(?:each|every)(?:\s+{_PART})?\b|\b(?:in|for)\s+all\s+{_PART}(?!\s*\()|\bper\s+{_PART}\b)",
            rf"(?P<skill>\b(?:{'|'.join(SKILLS)})\b)",
            r"(?P<overall>\boverall\b)",
            rf"(?P<number>{NUMBER})",
        ]
    ),
    re.I,
)


class Token(NamedTuple):
    kind: str
    start: int
    end: int
    value: float
    word: str


class Said(NamedTuple):
    """What a form has read: scores by part, and the places of the tokens of its numbers."""

    scores: dict[str, float]
    used: tuple[int, ...]
    sure: float = 0.85


class Place:
    """A mention of a test: the tokens after it that are said of it, which end at another test or at its next mention after a number."""

    def __init__(self, text: str, tokens: list[Token], at: int, taken: set[int]) -> None:
        self.text, self.tokens, self.at, self.taken = text, tokens, at, taken
        self.test, self.name = BY_KEY[tokens[at].kind], tokens[at]
        self.end, told = at + 1, False
        while self.end < len(tokens) and tokens[self.end].start <= self.name.end + 250:
            kind = tokens[self.end].kind
            if kind in BY_KEY and (kind != self.test.key or told):
                break
            told |= kind == "number"
            self.end += 1

    def after(self, kind: str, start: int | None = None) -> list[int]:
        """Tokens of a kind, of numbers those that are free, from start on."""
        return [i for i in range(self.at + 1 if start is None else start, self.end) if self.tokens[i].kind == kind and i not in self.taken]

    def gap(self, a: int, b: int) -> str:
        return self.text[self.tokens[a].end : self.tokens[b].start]

    def is_overall(self, i: int) -> bool:
        return self.test.low <= self.tokens[i].value <= self.test.high

    def is_band(self, i: int) -> bool:
        return self.test.floor <= self.tokens[i].value <= self.test.ceiling

    def first_number(self) -> int | None:
        """The first free number, if it is near the name and an overall score."""
        found = next(iter(self.after("number")), None)
        return found if found is not None and self.tokens[found].start - self.name.end <= 80 and self.is_overall(found) else None

    def stated(self) -> int | None:
        """The number that follows the word overall, or goes before it."""
        for i in self.after("overall"):
            if i + 1 < self.end and i + 1 in self.after("number") and re.fullmatch(r"(?:\s+(?:band|score|of))*[\s:.\-]{0,8}", self.gap(i, i + 1), re.I) and self.is_overall(i + 1):
                return i + 1
        return None

    def floors(self, start: int, stop: int) -> list[tuple[int, int]]:
        """(cue, number) of clauses between two places of the text that name a least score; the number may stand before "in each"."""
        found = []
        for i in range(bisect_left(self.tokens, start, key=lambda t: t.start), len(self.tokens)):
            t = self.tokens[i]
            if t.start >= stop:
                break
            n = i + 1 if t.kind == "least" else i - 1 if t.kind == "each" else None
            if n is not None and 0 <= n < len(self.tokens) and self.tokens[n].kind == "number" and n not in self.taken and self.is_band(n):
                if len(self.gap(min(i, n), max(i, n))) <= 12:
                    found.append((i, n))
        return found


def _same(floor: float) -> dict[str, float]:
    return dict.fromkeys(SKILLS, floor)


def with_floor(p: Place) -> Said | None:
    """An overall score, then at once a clause with the least score of a skill: "6.5 with no band below 6.0"."""
    n = p.first_number()
    if n is None or n + 2 >= p.end or p.tokens[n + 1].kind == "overall" and n + 3 >= p.end:
        return None
    cue = n + 2 if p.tokens[n + 1].kind == "overall" else n + 1
    told = [f for f in p.floors(p.tokens[cue].start, p.tokens[cue].end) if f[0] == cue and p.tokens[cue].kind == "least"]
    if not told or len(p.gap(n, cue)) > 50 or p.tokens[told[0][1]].value > p.tokens[n].value:
        return None
    floor = told[0][1]
    return Said({"overall": p.tokens[n].value, **_same(p.tokens[floor].value)}, (n, floor))


def split(p: Place) -> Said | None:
    """Two scores for different skills, the exception first or last; the overall score is one that stands before both, else the higher one."""
    groups: list[tuple[int, list[str]]] = []
    free = p.after("number")
    for n in free:
        i, named = n + 1, []
        if i < p.end and p.tokens[i].kind == "rest":
            named, i = ["rest"], i + 1
        elif i < p.end and p.tokens[i].kind == "skill" and re.fullmatch(r"\s+(?:or\s+\w+\s+)?(?:in|for)\s+(?:(?:the\s+)?(?:all|two|three|2|3)\s+)?(?:components?\s*)?\(?", p.gap(n, i), re.I):
            while i < p.end and p.tokens[i].kind == "skill" and (not named or re.fullmatch(r"[\s,/]*(?:(?:and|or)\s+)?", p.gap(i - 1, i), re.I)):
                named.append(p.tokens[i].word)
                i += 1
        elif i + 1 < p.end and p.tokens[i].kind == "number" and p.text[p.tokens[i].start : p.tokens[i].end] in ("2", "3") and re.fullmatch(r"\s+in\s+", p.gap(n, i), re.I):
            # "7.0 in 3 components (listening, ...)": the count is no score.
            i += 1
            while i < p.end and p.tokens[i].kind == "skill":
                named.append(p.tokens[i].word)
                i += 1
        if named and p.is_band(n):
            groups.append((n, named))
    if len(groups) < 2:
        return None
    groups = groups[:2]
    high = max(p.tokens[n].value for n, _ in groups)
    lead = next((n for n in free if n < groups[0][0] and p.is_overall(n)), None)
    overall = high if lead is None else p.tokens[lead].value
    if not p.test.low <= overall <= p.test.high:
        return None
    bands = _same(high)
    for n, named in groups:
        for s in named:
            if s != "rest":
                bands[s] = p.tokens[n].value
    return Said({"overall": overall, **bands}, tuple(n for n, _ in groups) + (() if lead is None else (lead,)))


def in_each(p: Place) -> Said | None:
    """An overall score, then one for each skill: "6.5 overall with 6.0 in each band"."""
    n = p.first_number()
    if n is None:
        return None
    m = n + 2 if n + 1 < p.end and p.tokens[n + 1].kind == "overall" else n + 1
    if m + 1 < p.end and m in p.after("number") and p.tokens[m + 1].kind == "each" and len(p.gap(m, m + 1)) <= 12 and len(p.gap(m - 1, m)) <= 30 and p.is_band(m) and p.tokens[m].value <= p.tokens[n].value:
        return Said({"overall": p.tokens[n].value, **_same(p.tokens[m].value)}, (n, m))
    return None


def _named(p: Place) -> dict[str, int]:
    """The number that follows a skill's name at once."""
    found: dict[str, int] = {}
    for i in p.after("skill"):
        if i + 1 < p.end and p.tokens[i + 1].kind == "number" and i + 1 not in p.taken and re.fullmatch(r"[\s:.\-–(|]{0,12}", p.gap(i, i + 1)):
            found.setdefault(p.tokens[i].word, i + 1)
    return found


def five_named(p: Place) -> Said | None:
    """Overall and all four skills with a number each, in the order of SKILLS. These need not be in range, since so full a list leaves no doubt."""
    said, named = p.stated(), _named(p)
    if said is None or [*named] != list(SKILLS) or said > min(named.values()):
        return None
    return Said({"overall": p.tokens[said].value, **{s: p.tokens[i].value for s, i in named.items()}}, (said, *named.values()))


def some_named(p: Place) -> Said | None:
    """An overall score and some skills with a number each, those in range."""
    named = {s: i for s, i in _named(p).items() if p.is_band(i)}
    said = p.stated()
    if said is None:
        said = p.first_number()
    if said is None or not named or said in named.values():
        return None
    return Said({"overall": p.tokens[said].value, **{s: p.tokens[i].value for s, i in named.items()}}, (said, *named.values()))


def _clause(p: Place, n: int, sure: float = 0.85) -> Said:
    """An overall score, with the first clause of a least score from 50 characters before its end to 250 after it."""
    end = p.tokens[n].end
    for _, floor in p.floors(end - 50, end + 250):
        if floor != n and p.tokens[floor].value <= p.tokens[n].value:
            return Said({"overall": p.tokens[n].value, **_same(p.tokens[floor].value)}, (n, floor), sure)
    return Said({"overall": p.tokens[n].value}, (n,), sure)


def row(p: Place) -> Said | None:
    """Cells of a table's row: the overall score and the least of a skill."""
    n = p.first_number()
    if n is None or p.test.key not in ("ielts", "pte", "toefl") or n + 1 not in p.after("number") or not re.fullmatch(r"[\s|]+", p.gap(n, n + 1)):
        return None
    if n + 2 < p.end and p.tokens[n + 2].kind in ("each", "rest", "skill") or not p.is_band(n + 1) or p.tokens[n + 1].value > p.tokens[n].value:
        return None
    return Said({"overall": p.tokens[n].value, **_same(p.tokens[n + 1].value)}, (n, n + 1))


def overall(p: Place) -> Said | None:
    """A number that is called overall."""
    n = p.stated()
    return None if n is None else _clause(p, n)


def near(p: Place) -> Said | None:
    """The first number after the name that is in range."""
    n = next((i for i in p.after("number") if p.tokens[i].start - p.name.end <= 80 and p.is_overall(i)), None)
    if n is None or n > p.at + 1 and p.tokens[n - 1].kind in ("least", "skill"):
        return None
    return _clause(p, n)


def before(p: Place) -> Said | None:
    """A number in range before the name: "6.5 overall in the IELTS"."""
    for n in range(p.at - 1, max(-1, p.at - 3), -1):
        t = p.tokens[n]
        if t.kind == "number":
            between = p.text[t.end : p.name.start]
            told = re.fullmatch(r"\s+(?:overall\s+)?(?:in|on|for)\s+(?:the\s+|an?\s+)?(?:academic\s+)?", between, re.I)
            return _clause(p, n, 0.75) if told and n not in p.taken and p.is_overall(n) else None
    return None


#: The forms in the order in which they are tried; each is tried at all places of all tests before the next one.
FORMS: tuple[tuple[str, Callable[[Place], Said | None]], ...] = (
    ("floor", with_floor), ("split", split), ("each", in_each), ("five", five_named), ("bands", some_named), ("row", row), ("overall", overall), ("near", near), ("before", before),
)


def tokens(text: str) -> list[Token]:
    """The typed tokens of a text in order; none overlaps another one."""
    out = []
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup or ""
        out.append(Token(kind, m.start(), m.end(), float(m[0]) if kind == "number" else 0.0, m[0].lower()))
    return out


def scores(text: str) -> dict[str, tuple[str, Said]]:
    """By test, the form that told its scores and what it read. Empty texts and texts without a test give nothing; of equal forms the earliest place counts."""
    if not ANY_TEST.search(text):
        return {}
    found, taken = tokens(text), set()
    places = [Place(text, found, i, taken) for i, t in enumerate(found) if t.kind in BY_KEY]
    told: dict[str, tuple[str, Said]] = {}
    for name, form in FORMS:
        for place in places:
            if place.test.key not in told and (said := form(place)):
                told[place.test.key] = (name, said)
                taken.update(said.used)
    return told


_READ = ArrayType(StructType([StructField("test", StringType()), StructField("part", StringType()), StructField("score", DoubleType()), StructField("form", StringType())]))


@pandas_udf(_READ)
def read_scores(text: pd.Series) -> pd.Series:
    """Scores that a text tells, by test in the order of TESTS. Null texts, empty ones and those without a test give an empty array; texts are read whole."""

    def one(t: str | None) -> list[dict[str, object]]:
        said = scores(t) if t else {}
        return [{"test": k, "part": part, "score": v, "form": said[k][0]} for k in BY_KEY if k in said for part, v in said[k][1].scores.items()]

    return text.map(one)
