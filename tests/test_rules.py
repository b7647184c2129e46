"""Rule tables against loops over the rules."""

import random
import re

from gristmill.operators import rules


def test_categories_equal_loops(spark):
    r = random.Random(6)
    words = ["data", "science", "cyber", "security", "law", "health", "public", "art", "music", "air", "conditioning", "c++", "web-design", "nursing"]
    some = [" ".join(r.choice(words) for _ in range(r.randrange(1, 4))) for _ in range(120)]
    table = [(f"cat{k % 7}", f"sub{k}", p, k) for k, p in enumerate([*some, "air conditioning", "", " ", "one two three four five six seven eight"])]
    names = [" ".join(r.choice([*words, "of", "Master", "(IT)", "(Data Science)", "(Law) x (Art)", "()"]) for _ in range(r.randrange(1, 7))) for _ in range(200)]
    names += [None, "", "One two three four five six SEVEN eight", "one two three four five six seven", "air-conditioning", "lawful", "()(art)"]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    df = spark.createDataFrame(table, "category string, sub_category string, phrase string, pos int")

    def fits(phrase, text):
        return bool(phrase.strip()) and re.search(r"(?i)\b" + re.escape(phrase.strip()) + r"\b", text) is not None

    first, best = {}, {}
    for i, name in enumerate(names):
        for part in [*re.findall(r"\(([^)]+)\)", name or ""), name or ""]:
            if hit := next(((c, s) for c, s, p, _ in table if fits(p, part)), None):
                first[i] = hit
                break
        sums = {}
        for c, p in {(c, p) for c, _, p, _ in table if fits(p, name or "")}:
            sums[c] = sums.get(c, 0) + len(p.split())
        if sums:
            order = [c for c, *_ in table]
            best[i] = min(sums.items(), key=lambda kv: (-kv[1], order.index(kv[0])))
    assert {r.id: (r.category, r.sub_category) for r in rules.first_category(rows, df, "id", "name").collect()} == first
    assert {r.id: (r.category, r.score) for r in rules.best_category(rows, df, "id", "name").collect()} == best
    # A plan of many rules is as long as one of few.
    few = spark.createDataFrame(table[:3], df.schema)
    lines = [len(rules.best_category(rows, d, "id", "name")._jdf.queryExecution().optimizedPlan().toString().splitlines()) for d in (few, df)]
    assert lines[0] == lines[1]


def test_words_are_found_once_a_text_and_texts_are_dealt(spark):
    """A small file of many names is one task, and every run of words must not cut its text anew."""
    rows = spark.range(100).selectExpr("id", "concat('data science ', id) AS name").coalesce(1)
    table = spark.createDataFrame([("a", "b", "data science", 1)], "category string, sub_category string, phrase string, pos int")
    for found in (rules.first_category(rows, table, "id", "name"), rules.best_category(rows, table, "id", "name")):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(lower(") - plan.count("split(lower(phrase") == 1
        assert "RepartitionByExpression [id" in plan
        assert found.count() == 100


def test_session_months_and_blocked(spark):
    pages = spark.createDataFrame(
        [
            (1, "www.a.edu.au", "Autumn session and SPRING Session"), (2, "a.edu.au.evil.org", "Autumn session"), (3, "b.ac.nz", "Semester 1; autumn session"),
            (4, "a.edu.au", "autumn sessions"), (5, None, "autumn session"), (6, "A.edu.au", None),
        ],
        "page int, host string, phrase_text string",
    )
    table = spark.createDataFrame([("a.edu.au", "spring session", "July", 7), ("a.edu.au", "autumn session", "March", 3), ("ac.nz", "semester 1", "February", 2)], "host_ending string, phrase string, month string, month_number int")
    got = {r.page: r.months for r in rules.session_months(pages, table, "page", "host", "phrase_text").collect()}
    assert got == {1: ["March", "July"], 3: ["February"]}
    urls = [
        (1, "https://a.org/news/2024/x", "T"), (2, "https://a.org/course/apply", "T"), (3, "https://a.org/applying/news-x", "T"), (4, "https://a.org/x?page=2&Sort=asc#y", "T"), (5, "https://a.org/", "Page not found"),
        (6, None, "Search results for law"), (7, "/staff/profiles/x", None), (8, "https://a.org/x/?q=", "Page not found here"), (9, "https://a.org/profiles/staff", "x"),
    ]
    kinds = [("path", "/news/", 1), ("path", "staff/profiles", 2), ("last", "apply", 3), ("query", "sort", 4), ("title", "Page Not  Found", 5), ("title", "page not found", 6), ("title_start", "search results", 7), ("path", "/", 8)]
    found = rules.blocked(spark.createDataFrame(urls, "id int, url string, title string"), spark.createDataFrame(kinds, "kind string, value string, pos int"), "id", "url", "title")
    assert {r.id: r.reason for r in found.collect()} == {1: "path: news", 2: "last: apply", 4: "query: sort", 5: "title: page not found", 6: "title_start: search results", 7: "path: staff/profiles"}
