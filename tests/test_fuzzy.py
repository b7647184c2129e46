"""Ratios against written-down values and plain definitions; joins against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import fuzzy
from gristmill.plans import matching
from gristmill.plans.registry import Tables


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_ratio(a, b):
    return 200.0 * plain_common(a, b) / (len(a) + len(b)) if a or b else 100.0


def plain_partial(a, b):
    """Every stretch of the longer one as long as the shorter, and every shorter one at its ends."""
    if len(a) > len(b):
        a, b = b, a
    both = [(a, b)] + ([(b, a)] if len(a) == len(b) else [])
    stretches = lambda s, t: (t[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1) if j - i == len(s) or (j - i < len(s) and (i == 0 or j == len(t))))
    return max(plain_ratio(s, part) for s, t in both for part in stretches(s, t))


def test_ratios_equal_plain_ones():
    r = random.Random(4)
    for _ in range(400):
        a, b = ("".join(r.choice("ab cé") for _ in range(r.randrange(1, 14))) for _ in range(2))
        assert fuzzy.ratio(a, b) == plain_ratio(a, b)
        assert abs(fuzzy.partial_ratio(a, b) - plain_partial(a, b)) < 1e-9, (a, b)
    assert fuzzy.ratio("x" * 300 + "y", "y" + "x" * 300) == 200 * 300 / 602


#: Pairs with their weighted ratio, worked out by hand from lengths and common letters.
WEIGHTED = [
    ("", "", 0.0), ("a", "", 0.0), ("same", "same", 100.0), ("abcd", "abce", 75.0), ("abcd", "dcba", 25.0), ("ab", "ba", 50.0),
    ("data science", "science data", 95.0), ("data science", "data sciences", 96.0), ("master of data science", "data science master of", 95.0),
    ("nursing", "Nursing", 600 / 7), ("bachelor of business", "bachelor of business", 100.0), ("business", "bachelor of business", 90.0),
    ("business", "bachelor of business administration", 90.0), ("law", "bachelor of laws", 90.0), ("law", "bachelor of laws and legal practice", 60.0), ("arts", "master of fine arts", 90.0),
    ("abc abc", "abc", 90.0), ("a b c", "c b a d", 95.0), ("a b", "b a", 95.0), ("abcdef", "uvwxyz", 0.0), ("ab cd", "ab ce", 80.0), ("ab cd", "cd xy", 57.0),
    ("fine arts", "arts fine", 95.0), ("music", "musics", 1000 / 11), ("music", "mosic", 80.0), ("nurse", "nurses x", 90.0), ("xy", "abxyab", 90.0),
    ("abcd efgh", "efgh abcd ijkl", 85.5), ("café", "cafe", 75.0), ("中文 课程", "课程 中文", 95.0), ("one", "two three four five six seven one", 60.0), ("aaaa", "aaaaaaaa", 90.0),
]


def test_weighted_ratio(spark):
    for a, b, want in WEIGHTED:
        assert fuzzy.weighted_ratio(a, b) == pytest.approx(want), (a, b)
        assert fuzzy.weighted_ratio(b, a) == pytest.approx(want), (b, a)
    df = spark.createDataFrame([*[(a, b) for a, b, _ in WEIGHTED], (None, "x"), (" Data ", "data")], "a string, b string")
    rows = df.select("a", "b", fuzzy.weighted_likeness("a", "b").alias("w"), fuzzy.same_name("a", "b").alias("s")).collect()
    for r in rows:
        want = fuzzy.weighted_ratio(r.a or "", r.b or "")
        assert r.w == pytest.approx(want) and r.s == bool(r.a and r.b and (r.a.strip().lower() == r.b.strip().lower() or want >= 92))


def names(seed, n):
    r = random.Random(seed)
    words = ["computing", "science", "of", "and", "master", "bachelor", "business", "arts", "fine", "nursing", "data", "law", "健康", "ab", "x", "engineering", "мир", "design"]

    def noisy(w):
        k = r.randrange(len(w))
        return r.choice([w, w, w[:k] + w[k + 1 :], w[:k] + r.choice("aeztq") + w[k:], w[:k] + "z" + w[k + 1 :]])

    return [" ".join(noisy(r.choice(words)) for _ in range(r.randrange(1, 6))) for _ in range(n)] + ["a", "b", "ab", "ba", "abc", "aab", "", "  ", None, "bachelor of computing"]


@pytest.mark.parametrize("least", [68.0, 80.0, 91.5])
def test_similar_pairs_lose_none(spark, least):
    a, b = names(1, 150), names(2, 150)
    rows = lambda ns: spark.createDataFrame([(i % 2, n) for i, n in enumerate(ns)], "g int, n string")
    got = {(r.g, r.a, r.b): r.score for r in fuzzy.similar_pairs(rows(a), rows(b), "n", "n", ["g"], least).collect()}
    pairs = {(i % 2, x, y) for i, x in enumerate(a) for j, y in enumerate(b) if i % 2 == j % 2 and x and y}
    assert got == {p: plain_ratio(*p[1:]) for p in pairs if plain_ratio(*p[1:]) >= least}


def test_match_names_equals_all_pairs(spark):
    left, right = names(3, 120), names(4, 90) + ["Master  of LAW"] * 200
    a = [(i, i % 3, n, ["postgraduate", "unknown", None][i % 3 - 1]) for i, n in enumerate(left)] + [(900 + k, 0, "master of law", None) for k in range(50)]
    b = [(i, i % 3, n, ["unknown", "postgraduate", "research"][i % 3]) for i, n in enumerate(right)]
    b += [(5000, 0, "level only", "postgraduate")]
    clean = lambda n: " ".join((n or "").lower().split())
    order = lambda n: " ".join(sorted(n.split()))
    want = set()
    for i, g, n, bucket in a:
        n, same = clean(n), [(j, clean(m), k) for j, h, m, k in b if h == g]
        exact = [j for j, m, _ in same if m and m == n]
        scored = sorted(((-plain_ratio(order(n), order(m)), j) for j, m, _ in same if m and n))
        fits = [j for j, _, k in same if k == bucket and k not in (None, "unknown")]
        if exact:
            want.add((g, i, min(exact), "exact", 100.0))
        elif scored and -scored[0][0] >= 80:
            want.add((g, i, scored[0][1], "high" if -scored[0][0] >= 85 else "medium", -scored[0][0]))
        elif fits and n:
            want.add((g, i, min(fits), "bucket", None))
        else:
            want.add((g, i, None, "none", None))
    schema = "{0} int, g int, name string, bucket string"
    got = fuzzy.match_names(spark.createDataFrame(a, schema.format("l")), spark.createDataFrame(b, schema.format("r")), "l", "name", "r", "name", ["g"], left_bucket="bucket", right_bucket="bucket")
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(a) and set(rows) == want and {r[3] for r in rows} == {"exact", "high", "medium", "bucket", "none"}


def test_best_match(spark):
    a, b = names(5, 40), names(6, 40)
    rows = lambda ns: spark.createDataFrame([(i, i % 2, n) for i, n in enumerate(ns)], "id int, g int, n string")
    got = {(r.g, r.x): (r.y, r.score) for r in fuzzy.best_match(rows(a).withColumnRenamed("n", "x"), rows(b).withColumnRenamed("n", "y"), "x", "y", ["g"], "id").collect()}
    want = {}
    for i, x in enumerate(a):
        scored = [(fuzzy.weighted_ratio(x or "", y or ""), -j, y) for j, y in enumerate(b) if i % 2 == j % 2]
        s, _, y = max(scored, key=lambda v: v[:2])
        if x and s >= 85:
            want[(i % 2, x)] = (y, s)
    assert got == want


def test_likeness_of_repeated_parts(spark, sf_dir, tmp_path):
    """Repeating the parts adds no pair of names, and the pairs that meet before they are made distinct do not grow with the square of the repeats."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    part.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("p_partkey", F.col("p_partkey") + 1_000_000 * F.col("i")).drop("i").write.parquet(f"{tmp_path}/part.parquet")
    once, often = (matching.str_18_likeness(Tables(spark, d)) for d in (sf_dir, str(tmp_path)))
    assert sorted(often.collect()) == sorted(once.collect())
    plan = often._jdf.queryExecution().optimizedPlan().toString()
    meeting = plan[plan.index("Join Inner") :]
    assert "Repartition 4" in plan and meeting.count("Aggregate [p_brand") == 2
