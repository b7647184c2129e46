"""Spelling variants against edits that are made out one by one."""

import random
import re
import zlib
from collections import Counter

from gristmill.llm import queries, spelling

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def edits(w):
    """All strings at a distance of one."""
    out = {w[:i] + w[i + 1 :] for i in range(len(w))}
    out |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in LETTERS}
    out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in LETTERS}
    return out - {w}


def brute(rows, misspell=97):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if misspell and h % misspell == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in edits(w) if v in n] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def as_dict(df):
    rows = df.collect()
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"] and len(rows) == len({r.word for r in rows})
    return {r.word: tuple(r)[1:] for r in rows}


def crowded(seed, n):
    """Words that are close to each other, of very unequal frequency."""
    r = random.Random(seed)
    words = ["".join(r.choice("abÀé") for _ in range(r.randrange(4, 9))) for _ in range(60)] + ["colour", "color", "colours", "hello", "hallo", "Äpfel", "äpfel", "Straße"]
    return [" ".join(r.choice(words[: r.randrange(1, len(words) + 1)]) for _ in range(r.randrange(0, 60))) for _ in range(n)]


def test_equals_brute_force(spark):
    texts = crowded(1, 120) + [None, "", "  \n", ("x" * 300 + " ") * 6 + ("x" * 299 + " ") * 3, "Hello HELLO hellO中hello"]
    rows = list(enumerate(texts)) + [(7, texts[7]), (7, texts[7]), (None, texts[8]), (None, "hello hello hallo")]
    docs = spark.createDataFrame([(*x, "a", 5, 1) for x in rows], "doc_id long, text string, word string, n int, form int").repartition(3)
    for misspell in (97, 0, 2):
        got = as_dict(spelling.variants(docs, misspell=misspell))
        assert len(got) > 50 and got == brute(rows, misspell)
    assert spelling.variants(docs.limit(0)).count() == 0


def test_very_long_words(spark):
    long = "ab" * 30_000
    text = f"{long} " * 6 + f"{long}c " * 3 + f"{long[1:]} " * 3 + ("other " * 3 + "words ") * 20_000
    got = as_dict(spelling.variants(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert {(w[:2] + w[-1], len(w)): (v[2], v[3], v[4], v[1] == long) for w, v in got.items() if len(w) > 9} == {
        ("abb", 60_000): (6, 2, None, True),
        ("abc", 60_001): (3, 1, 6, True),
        ("bab", 59_999): (3, 1, 6, True),
    }


def test_many_shards_and_groups(spark, monkeypatch):
    rows = list(enumerate(crowded(2, 150)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(spelling, "SHARD_LETTERS", 40)
    monkeypatch.setattr(spelling, "GROUP_BYTES", 2000)
    words = spelling.word_counts(docs)
    assert spelling.shards(words).count() > 8
    assert as_dict(spelling.variants(docs, misspell=97)) == brute(rows)


def test_ties_take_the_smallest_word_over_shards(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD_LETTERS", 1)
    words = spark.createDataFrame([("bbbbb", 1), ("abbbb", 4), ("bbbba", 4), ("ébbbb", 4), ("bbbbé", 3), ("zzzzz", 9)], "word string, n long")
    got = {r.word: (r.n_near, r.form, r.form_n) for r in spelling.nearest_forms(words).collect()}
    assert got["bbbbb"] == (4, "abbbb", 4) and got["zzzzz"] == (0, None, None) and got["abbbb"] == (2, None, None)


def test_roots_follow_long_chains(spark):
    links = [(f"w{i:03}", f"w{i + 1:03}") for i in range(70)] + [("a", "w000"), ("b", "w069"), ("c", "d")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {w: "d" if w == "c" else "w070" for w, _ in links}


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert as_dict(queries.op13_spelling(spark, sf_dir)) == brute(rows)
