"""Rules that read the parts of one page, in one pass where the page is parsed. Each gives (field, value, confidence, method), the best first; what classifies a found text is left to column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from gristmill.functions.scores import ANY_TEST, NUMBER, TESTS, Test, scores
from gristmill.functions.text import MONTHS

Found = tuple[str, str, float, str]


class Parts(NamedTuple):
    """What a page has. Labels are (kind of element, label in lower case, value); paragraphs are (text, last heading, in the main part)."""

    text: str
    title: str
    h1: str
    meta: str
    paragraphs: list[tuple[str, str, bool]]
    labels: list[tuple[str, str, str]]
    tables: list[list[list[str]]]
    modes: list[tuple[str, str]]


DEGREE = re.compile(r"\b(bachelor|master|doctor|diploma|certificate|degree|phd|mba)", re.I)


def _labelled(p: Parts, words: str, without: str = r"(?!)") -> Iterator[tuple[str, str]]:
    """(kind, value) of labels that have one of the words; values longer than a line are no values."""
    for kind, label, value in p.labels:
        if value and len(value) <= 200 and re.search(words, label) and not re.search(without, label):
            yield kind, value


def course_name(p: Parts) -> Iterator[Found]:
    title = re.sub(r"\s*[|–-]\s*[^|–-]*$", "", p.title).strip()
    if title and DEGREE.search(title) and not DEGREE.search(p.h1):
        yield "course_name", title, 0.9, "course_name.title"
    if p.h1:
        yield "course_name", p.h1, 0.9, "course_name.h1"
    if title:
        yield "course_name", title, 0.6, "course_name.title"


def description(p: Parts) -> Iterator[Found]:
    """The page's own description, else a paragraph under a heading that announces one, else the first in the main part, else the first; 40 to 500 characters."""
    fits = [q for q in p.paragraphs if 40 <= len(q[0]) <= 500]
    if 40 <= len(p.meta) <= 500:
        yield "description", p.meta, 0.95, "description.meta"
    for ok, sure, method in ((lambda q: re.search(r"overview|about|description|summary", q[1], re.I), 0.8, "heading"), (lambda q: q[2], 0.65, "main"), (lambda q: True, 0.5, "paragraph")):
        for q in fits:
            if ok(q):
                yield "description", q[0], sure, f"description.{method}"
                break


_PLACES = {"strong": (0.9, "strong"), "dt": (0.9, "dl"), "data": (0.88, "panel"), "th": (0.85, "table"), "heading": (0.7, "heading")}


def location(p: Parts) -> Iterator[Found]:
    told = sorted(((_PLACES[kind], value) for kind, value in _labelled(p, r"\b(location|campus)")), key=lambda x: -x[0][0])
    for (sure, method), value in told:
        yield "course_location", value, sure, f"location.{method}"
    if m := re.search(r"(?i:in[- ]person|face[- ]to[- ]face)\s*(?::|at|in|\()\s*(?:the\s+)?([A-Z][a-z]+(?: [A-Z][a-z]+)?)", p.text):
        yield "course_location", m[1], 0.85, "location.in_person"
    if m := re.search(r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)?) [Cc]ampus\b", p.text):
        yield "course_location", m[1], 0.5, "location.text"


AMOUNT = re.compile(r"\$\s?(\d{1,3}(?:,\d{3})+|\d{4,6})(?!\d)")
_POINTS = ((r"international", 5), (r"tuition", 3), (r"full\s*course|total", 4), (r"first\s*year", -3), (r"per\s*(?:year|annum)|annual", 2))
_FOR, _AGAINST = re.compile(r"tuition|fees?\b|international", re.I), re.compile(r"salar(?:y|ies)|domestic|scholarship", re.I)


def _money(m: re.Match) -> float:
    return float(m[1].replace(",", ""))


def fee(p: Parts) -> tuple[list[Found], str | None]:
    """A labelled amount; else of all amounts of 1,000 to 200,000 the one whose surroundings score highest, of equals the larger. Also the text that its currency and term are read from.

    An amount is none if a word for salaries, scholarships or domestic students is nearer to it than one for fees.
    """
    out, context = [], None
    for _, value in _labelled(p, r"\b(fee|tuition)", r"domestic|application"):
        m = AMOUNT.search(value)
        if m and 1000 <= _money(m) <= 200_000:
            out.append(("international_fee", str(_money(m)), 0.85, "fee.structural"))
            context = value
            break
    best = None
    for m in AMOUNT.finditer(p.text):
        amount, at = _money(m), min(80, m.start())
        around = p.text[m.start() - at : m.end() + 60]
        near = lambda words: min((max(x.start() - at, at - x.end()) for x in words.finditer(around)), default=1000)  # noqa: B023, E731
        if 1000 <= amount <= 200_000 and near(_AGAINST) >= near(_FOR) and near(_FOR) < 1000:
            score = sum(n for words, n in _POINTS if re.search(words, around, re.I)) + (10_000 <= amount <= 80_000)
            if best is None or (score, amount) > best[:2]:
                best = (score, amount, around)
    if best:
        out.append(("international_fee", str(best[1]), max(0.0, min(1.0, 0.4 + 0.1 * best[0])), "fee.scored"))
        context = context or best[2]
    return out, context


#: How far a column of a table for several levels of study is preferred.
LEVELS = ((r"\bpostgraduate\b|\bmaster|\bmba\b", 5), (r"\bbachelor", 4), (r"\bdiploma\b", 3), (r"\bassociate\b|\beap\s*2\b|\bfoundation\s*2\b", 2), (r"\bfoundation\b|\beap\b|\benglish\s+for\s+academic\b", 1))


def _level(cell: str) -> int:
    return next((n for words, n in LEVELS if re.search(words, cell, re.I)), 0)


def _test_of(cell: str) -> Test | None:
    m = ANY_TEST.search(cell)
    return next(t for t in TESTS if t.key == m.lastgroup) if m else None


def _score(test: Test, cell: str) -> float | None:
    return next((float(x) for x in re.findall(NUMBER, cell) if test.low <= float(x) <= test.high), None)


def _by_level(table: list[list[str]]) -> dict[str, float]:
    """Scores of a table with a column a level and a row a test, from the column of the highest level; two at least."""
    for r, head in enumerate(table):
        level, column = max(((_level(cell), -i) for i, cell in enumerate(head) if i), default=(0, 0))
        if level < 3 or sum(_level(cell) > 0 for cell in head[1:]) < 2:
            continue
        scores = {}
        for row in table[r + 1 :]:
            test = _test_of(row[0]) if row else None
            if test and len(row) > -column and (v := _score(test, row[-column])) is not None:
                scores.setdefault(test.key, v)
        if len(scores) >= 2:
            return scores
    return {}


def _equivalents(table: list[list[str]], ielts: float) -> dict[str, float]:
    """Scores of the other tests in the row of a table of equivalent scores that has the given IELTS score."""
    for r, head in enumerate(table):
        tests = {i: t for i, cell in enumerate(head) if (t := _test_of(cell))}
        at = next((i for i, t in tests.items() if t.key == "ielts"), None)
        if at is None or len(tests) < 2:
            continue
        for row in table[r + 1 :]:
            if len(row) > at and re.fullmatch(r"\d(?:\.\d)?", row[at]) and float(row[at]) == ielts:
                return {t.key: v for i, t in tests.items() if i != at and i < len(row) and (v := _score(t, row[i])) is not None}
    return {}


def english(p: Parts) -> Iterator[Found]:
    """Scores by a table of levels, then by what is said near each test's name, then by a table of scores that are equal to the page's IELTS score."""
    told: dict[str, float] = {}
    for table in p.tables:
        for key, v in _by_level(table).items():
            if key not in told:
                told[key] = v
                yield f"{key}_overall", str(v), 0.9, "english.program_table"
    # Numbers of such tables stand near any of their tests' names once the cells are one text.
    text = p.text
    for table in p.tables:
        if any(sum(_test_of(c) is not None for c in row) >= 2 for row in table) or _by_level(table):
            text = text.replace(" ".join(c for row in table for c in row if c), " ")
    said = scores(text)
    for key in (t.key for t in TESTS if t.key in said):
        form, read = said[key]
        for part, v in read.scores.items():
            yield f"{key}_{part}", str(v), read.sure if part == "overall" else 0.8, f"english.{form}"
        told.setdefault(key, read.scores["overall"])
    if "ielts" in told:
        for table in p.tables:
            for key, v in _equivalents(table, told["ielts"]).items():
                if key not in told:
                    told[key] = v
                    yield f"{key}_overall", str(v), 0.7, "english.equivalence"


#: A month's name or its first three letters; small letters only in full, since "may" and "mar" are words.
_MONTH = re.compile(r"\b(?:" + "|".join(f"{m}|{m.upper()}|{m[:3]}|{m[:3].upper()}" + ("" if m == "May" else f"|{m.lower()}") for m in MONTHS) + r"|Sept)\b")
_START = re.compile(rf"\bStarts?(?::|\s+on|\s+in)?\s+((?:[A-Z][a-z]+\s+)?(?:\d{{1,2}}\s+)?{_MONTH.pattern}[^.]{{0,40}})")
#: The month that a semester begins in.
SEMESTERS = {"1": "February", "2": "July", "3": "November"}


def _months(text: str) -> str:
    said = {m[0][:3].title() for m in _MONTH.finditer(text)}
    return ";".join(m for m in MONTHS if m[:3] in said)


def intake(p: Parts) -> Iterator[Found]:
    """Months in calendar order: of a table's intake row or column, of a label, after "Start", of days and months near words for intakes, of months there, of semesters."""

    def tries() -> Iterator[tuple[str, float, str]]:
        for table in p.tables:
            cells = [c for row in table if row and re.search(r"\b(intake|trimester|semester|session)", row[0], re.I) for c in row]
            columns = [i for i, c in enumerate(table[0]) if re.search(r"\bintakes?\b|start dates?", c, re.I)] if table else []
            yield _months(" ".join(cells + [row[i] for row in table[1:] for i in columns if i < len(row)])), 0.85, "intake.pivot"
        yield _months(" ".join(v for _, v in _labelled(p, r"\b(intake|start|commenc)"))), 0.8, "intake.structural"
        yield _months(" ".join(_START.findall(p.text))), 0.82, "intake.start"
        near = re.findall(r"(?i:\bintakes?\b|start dates?|commenc\w*|applications? open)[^.]{0,120}", p.text)
        yield _months(" ".join(re.findall(rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:of\s+)?{_MONTH.pattern}", " ".join(near)))), 0.7, "intake.day_month"
        yield _months(" ".join(near)), 0.7, "intake.month"
        yield ";".join(SEMESTERS[n] for n in sorted(set(re.findall(r"(?i:\bsemester)\s+([1-3])\b", p.text)))), 0.4, "intake.semester"

    for months, sure, method in tries():
        if months:
            yield "intake_months", months, sure, method


_SPAN = re.compile(r"\b(\d{1,3}(?:\.\d{1,2})?)\s*-?\s*(year|month|week)s?\b(?:\s*(?:and|,)?\s*(\d{1,2})\s*-?\s*months?\b)?", re.I)
_FULL = re.compile(r"full[- ]time", re.I)
_WEEKS = {"year": 52.0, "month": 4.345, "week": 1.0}


def duration(p: Parts) -> Iterator[Found]:
    """A labelled amount of time; else the one with the most weight: full time tenfold, compound ones half as much again, credit and combined ones hardly anything.

    Five to 24 years are months where the page names as many months. Years of schooling and of age are none.
    """
    found = []
    for m in _SPAN.finditer(p.text):
        before, after = p.text[max(0, m.start() - 30) : m.start()], p.text[m.end() : m.end() + 25]
        around = before + m[0] + after
        if re.search(r"school|years? old|of age|experience", around, re.I):
            continue
        weeks = float(m[1]) * _WEEKS[m[2].lower()] + float(m[3] or 0) * _WEEKS["month"]
        full = _FULL.search(after) or _FULL.search(before) and not re.search(r"part[- ]time", after, re.I)
        weight = (10 if full else 1) * (0.01 if re.search("credit", around, re.I) else 1) * (0.001 if re.search("combined|double", around, re.I) else 1) * (1.5 if m[3] else 1)
        found.append((weeks * 100 * weight, m))
    labels = [m for _, v in _labelled(p, r"\b(duration|length)") if (m := _SPAN.search(v))]
    months = {m[1] for _, m in found if m[2].lower() == "month"}
    best = [max(found, key=lambda x: x[0])[1]] if found else []
    for m, sure, method in [(m, 0.9, "duration.structural") for m in labels[:1]] + [(m, 0.6, "duration.text") for m in best]:
        meant = m[2].lower() == "year" and not m[3] and 5 <= float(m[1]) <= 24 and m[1] in months
        yield "duration", f"{m[1]} months" if meant else m[0], sure, method


def _mode(said: str) -> str | None:
    said = said.lower()
    has = lambda words: any(w in said and re.search(rf"\b{w}\b", said) for w in words)
    online, campus = has(("online", "distance")), has(("campus", "in person", "in-person", "face to face", "face-to-face"))
    if online and campus or has(("blended", "hybrid")):
        return "Blended"
    return "Online" if online else "On Campus" if campus else None


def study_mode(p: Parts) -> Iterator[Found]:
    """By an element that carries the mode, by its data attribute, by a label, by a share of online study, by key words."""
    tries = [(v, 0.9, kind) for kind, v in sorted(p.modes, key=lambda x: x[0] != "span")]
    tries += [(v, 0.7, "strong" if kind == "strong" else "label") for kind, v in sorted(_labelled(p, r"\b(mode|delivery|attendance)"), key=lambda x: x[0] != "strong")]
    for said, sure, method in tries:
        if mode := _mode(said):
            yield "study_mode", mode, sure, f"study_mode:{method}"
    if re.search(r"\b\d{1,2}\s?% online\b", p.text, re.I) and re.search(r"\bcampus\b", p.text, re.I):
        yield "study_mode", "Blended", 0.7, "study_mode:share"
    if mode := _mode(p.text):
        yield "study_mode", mode, 0.5, "study_mode:keyword"


def fields(p: Parts) -> tuple[list[Found], str | None]:
    """All that a page says, in the order that it is to be taken, and the text around its fee."""
    fees, context = fee(p)
    return [*course_name(p), *description(p), *location(p), *fees, *english(p), *intake(p), *duration(p), *study_mode(p)], context


#: The amounts that a cell of a fee table is believed to hold.
FEE_BOUNDS = (2_000.0, 200_000.0)


def fee_rows(table: list[list[str]], bounds: tuple[float, float] = FEE_BOUNDS) -> list[dict[str, object]]:
    """program, amount, column (international, total, unit or any) and the texts of row and head, for rows of a fee table with an amount within bounds.

    The head is the second row where the first only names the table. The program is the column that says so, else the first; the fee
    is the international column's, else the whole course's, else a unit's, else the first of any other column that is not for domestic students.
    """
    if len(table) < 2:
        return []
    own, any_fee, one, two = r"(subject|course|unit|total|program) fee", r"(subject|course|unit|total|program) fee|international|overseas", *(" ".join(r).lower() for r in table[:2])
    second = len(table) > 2 and re.search(any_fee, two) and not re.search(own, one) and not AMOUNT.search(two)
    head, rows = ([c.lower() for c in table[1]], table[2:]) if second else ([c.lower() for c in table[0]], table[1:])
    find = lambda words: next((i for i, c in enumerate(head) if re.search(words, c)), None)
    program = next((i for i, c in enumerate(head) if re.search(r"course|program|qualification", c) and "fee" not in c), 0)
    choices = [(k, i) for k, words in (("international", r"international|overseas|intl"), ("total", r"(course|total|program|full) fee|total cost"), ("unit", r"(subject|unit) fee|per (subject|unit)")) if (i := find(words)) is not None and i != program]
    ruled_out = {i for i, c in enumerate(head) if re.search(r"domestic|local|resident", c)} | {program}
    out = []
    for row in rows:
        if len(row) <= program or len(row[program]) < 3:
            continue
        places = choices[:1] or [("any", i) for i in range(len(row)) if i not in ruled_out]
        for kind, i in places:
            m = re.search(r"\$?\s?(\d{1,3}(?:,\d{3})+|\d{4,6})(?!\d)", row[i]) if i < len(row) else None
            if m and bounds[0] <= _money(m) <= bounds[1]:
                out.append({"program": row[program], "amount": _money(m), "kind": kind, "said": " ".join(row), "head": " ".join(head)})
                break
    return out


#: Words of a column's head, the levels that it holds for, and how much it counts for the page as a whole.
LEVEL_COLUMNS = (
    (("bachelor", "postgraduate"), ("postgraduate", "undergraduate"), 4), (("diploma", "advanced diploma", "associate diploma"), ("diploma",), 3),
    (("eap 2", "eap2", "academic purposes 2", "purposes 2"), (), 2), (("eap 1", "eap1", "academic purposes 1", "purposes 1"), (), 1),
)
#: Tests and how their cells give a score.
TEST_ROWS = (
    ("ielts", r"overall\s+(\d\.?\d*)"), ("pte", r"(?:academic\s+)?score\s+of\s+(\d{2,3})"), ("toefl", r"(?:(?:total|band)\s+)?score\s+of\s+(\d{2,3})"),
    ("cambridge", r"(?:band\s+)?score\s+of\s+(\d{3})"), ("duolingo", r"(?:overall\s+)?score\s+of\s+(\d{2,3})"),
)


def english_columns(table: list[list[str]]) -> list[dict[str, object]]:
    """level, test and score from a table with a column for each level and a row for each test; of equal ones the last counts.

    The page as a whole (level None) has the scores of the column that counts most, of equal ones the first. A table without a column of a known level gives nothing.
    """
    if len(table) < 2 or len(table[0]) < 3:
        return []
    known = {}
    for i, head in enumerate(table[0][1:], 1):
        low = head.lower()
        if found := next((c for c in LEVEL_COLUMNS if any(w in low for w in c[0])), None):
            known[i] = found[1:]
    if not known:
        return []
    top, out = max(known, key=lambda i: known[i][1]), {}
    for row in table[1:]:
        test = next(((t, p) for t, p in TEST_ROWS if row and t in row[0].lower()), None)
        for i, (levels, _) in known.items() if test else ():
            m = re.search(test[1], row[i], re.I) if i < len(row) else None
            for level in (*levels, *((None,) if i == top else ())) if m else ():
                out[level, test[0]] = float(m[1])
    return [{"level": level, "test": test, "score": score} for (level, test), score in out.items()]
