"""Matching in passes against a loop over all rows."""

import random
import re

import pytest

from gristmill.operators import cascade


def words(name):
    return {w for w in re.sub(r"[^a-z0-9\s]+", " ", (name or "").lower()).split() if w not in cascade.STOP_WORDS}


def award(name):
    return next((a for begin, a in cascade.AWARDS if (name or "").strip().lower().startswith(begin)), None)


def brute(left, right):
    out = set()
    for i, g, name, code in left:
        mine = words(name)
        coded = [r for r, h, *_, c in right if h == g and c and c == code]
        if mine and coded:
            out.add((g, i, min(coded), "cricos_match", None))
            continue
        found = []
        for r, h, other, more, _ in right if mine else []:
            main, extra = words(other), words(more)
            theirs = main | (extra if len(extra) <= 25 else set())
            both = len(mine & theirs)
            if h != g or not both or (award(name) and award(other) and award(name) != award(other)) or (both < 2 and mine != main):
                continue
            score = max(both / len(mine), both / len(theirs))
            if score >= 0.5:
                found.append((-score, abs(len(main) - len(mine)), r))
        s, _, r = min(found, default=(None, None, None))
        out.add((g, i, r, "name_match" if found else "no_match", -s if found else None))
    return out


def test_equals_a_loop(spark):
    r = random.Random(8)
    begins = ["Master of ", "Bachelor of ", "Graduate Certificate in ", "", "", "Diploma of "]
    stems = ["design", "data", "science", "nursing", "(health)", "public", "law", "business", "IT", "art", "music", "web"]
    name = lambda n: r.choice(begins) + " ".join(r.choice(stems) for _ in range(r.randrange(0, n)))
    left = [(i, i % 3, name(5), r.choice([None, "", f"c{r.randrange(40)}"])) for i in range(300)] + [(900, 0, None, "c1"), (901, 1, "Master of", "c2"), (902, 2, "Master of Design", None)]
    many = " ".join(f"w{k}" for k in range(30)) + " design data"
    right = [(i, i % 3, name(4), r.choice([None, "", many, name(6)]), r.choice([None, f"c{r.randrange(60)}"])) for i in range(120)] + [(700, 2, "Master of Design", None, None)]
    hot = [(1000 + i, 1, "Bachelor of Data Science", None) for i in range(400)]
    a = spark.createDataFrame(left + hot, "l int, g int, name string, code string")
    b = spark.createDataFrame(right, "r int, g int, name string, more string, code string")
    got = [tuple(x) for x in cascade.match_in_passes(a, b, "l", "name", "r", "name", ["g"], "code", "code", "more").collect()]
    want = brute(left + hot, right)
    assert len(got) == len(left + hot) and {m for *_, m, _ in got} == {"cricos_match", "name_match", "no_match"}
    assert {x[:4]: x[4] for x in got} == pytest.approx({x[:4]: x[4] for x in want})
    assert cascade.match_in_passes(a.limit(0), b, "l", "name", "r", "name").count() == 0
    assert {x.method for x in cascade.match_in_passes(a, b.limit(0), "l", "name", "r", "name", ["g"], "code", "code", "more").collect()} == {"no_match"}
